"""SentencePiece encoding and decoding of merge-type (BPE) models.

The ids of a merge-type model are the one sequence of pieces that cover the text with every two
neighbours compatible: merging their joined characters by the model's rule gives the same two pieces
back. `Encoder` finds it left to right. An Aho-Corasick automaton lists the pieces that match at each
place, longest first; a candidate that doesn't fit its left neighbour, or that would end where
no continuation exists (a bit field holds those places), gives way to the next shorter one, and when
none is left the last piece is taken back.

Merges never cross certain places (found from the vocabulary when a model is loaded): in front of a
space mark after another character, and behind a letter before a non-letter. Texts are cut there, and
the segments, which repeat a lot, are encoded once per worker.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.blocks import TextBlock, map_texts

MARK = "▁"
#: Segments (in each of two generations) and pairs of neighbours that a worker remembers at most; forgetting changes no result.
SEGMENTS, PAIRS = 200_000, 400_000


class Encoder:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        in_bytes = {i: b for b, i in self.byte_id.items()}
        self.piece = [model.id_to_piece(i) for i in range(size)]
        self.score = [model.get_score(i) for i in range(size)]
        self.raw = [b"" if i in special else bytes([in_bytes[i]]) if i in in_bytes else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        self.id = {p: i for i, p in enumerate(self.piece) if i not in special and i not in in_bytes}
        self.single = {p for p in self.id if len(p) == 1}
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in self.raw])])
        self.raw_all = np.frombuffer(b"".join(self.raw), np.uint8)
        self.pair_fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        automaton = ahocorasick.Automaton()
        reached = {p: i for p, i in self.id.items() if self.merged(p) == [i]}
        for p, i in reached.items():
            automaton.add_word(p, i)
        self.back = [len(p) - 1 for p in self.piece]
        self.shorter = [-1] * size
        for p, i in reached.items():
            self.shorter[i] = next((reached[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in reached), -1)
        automaton.make_automaton()
        self.automaton = automaton
        self.cut = self._cuts()

    def _cuts(self) -> re.Pattern:
        """Pattern of segments between which no piece reaches."""
        pairs = {(a, b) for p in self.id for a, b in zip(p, p[1:], strict=False)}
        if any(b == MARK != a for a, b in pairs):
            return re.compile(r"(?s:.+)")
        letter = re.compile(r"[^\W\d_]").match
        joined = {a if letter(a) else b for a, b in pairs if MARK not in (a, b) and bool(letter(a)) != bool(letter(b))}
        inner = "".join(map(re.escape, sorted(joined)))
        letters = rf"(?:(?![{inner}])[^\W\d_])" if inner else r"[^\W\d_]"
        other = rf"[\W\d_{inner}]"
        alone = "" if any("\n" in p for p in self.id) else "\\n"
        return re.compile(rf"{MARK}*{letters}+|{MARK}*(?:(?![{MARK}{alone}]){other})+|{MARK}+" + (f"|{alone}" if alone else ""))

    def merged(self, text: str) -> list[int]:
        """The model's rule itself: join the neighbours whose piece scores best, leftmost first, while any pair is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return [self.id.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two pieces stay as they are when their characters are merged anew."""
        key = left * len(self.piece) + right
        found = self.pair_fits.get(key)
        if found is None:
            if len(self.pair_fits) >= PAIRS:
                self.pair_fits.clear()
            found = self.pair_fits[key] = self.merged(self.piece[left] + self.piece[right]) == [left, right]
        return found

    def segment(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces."""
        n, back, shorter = len(text), self.back, self.shorter
        longest = [-1] * n
        for end, i in self.automaton.iter(text):
            longest[end - back[i]] = i
        out: list[int] = []
        failed, at, i = 0, 0, longest[0]
        while True:
            while i >= 0 and ((failed >> (at + back[i] + 1)) & 1 or out and not self.fits(out[-1], i)):
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at += back[i] + 1
                if at == n:
                    return out
                i = longest[at]
            elif out:
                failed |= 1 << at
                i = out.pop()
                at -= back[i] + 1
                i = shorter[i]
            else:
                raise ValueError("no sequence of pieces covers the text")

    def encode_segment(self, text: str) -> list[int]:
        """Ids of a segment; characters that are no pieces become their bytes."""
        if self.single.issuperset(text):
            return self.segment(text)
        ids: list[int] = []
        for same, run in groupby(text, self.single.__contains__):
            ids += self.segment("".join(run)) if same else [self.byte_id[b] for c in run for b in c.encode()]
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Begin, the ids of the text, end."""
        out = [np.array([self.begin], "<u4").tobytes()]
        if text:
            for part in self.cut.findall(MARK + text.replace(" ", MARK)):
                got = self.known.get(part)
                if got is None:
                    got = self.older.get(part) or np.array(self.encode_segment(part), "<u4").tobytes()
                    if len(part) <= 64:
                        if len(self.known) >= SEGMENTS:
                            self.known, self.older = {}, self.known
                        self.known[part] = got
                out.append(got)
        out.append(np.array([self.end], "<u4").tobytes())
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of an id sequence: marks become spaces, the space before the first piece goes, each byte that forms no character becomes U+FFFD."""
        ids = np.asarray(ids, np.int64)
        sizes = self.raw_at[ids + 1] - self.raw_at[ids]
        ends = np.cumsum(sizes)
        raw = self.raw_all[np.arange(sizes.sum()) + np.repeat(self.raw_at[ids] - ends + sizes, sizes)].tobytes()
        first = next((i for i in ids if self.raw[i]), None)
        raw = raw[1:] if first is not None and self.piece[first].startswith(MARK) else raw
        return raw.decode("utf-8", "tidemark_bytes").encode()


codecs.register_error("tidemark_bytes", lambda e: ("\ufffd", e.start + 1))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_pieces(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """Ids and decoded text of every document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded, and their SHA-256.

    `model` is the path of a merge-type model on every machine. One row per row of `docs`; a null text
    encodes as the empty one (begin and end only). Without `with_ids` the ids and texts themselves
    stay on the executors. Columns other than doc_id and text are not read.
    """

    def encode(block: TextBlock) -> dict[str, list]:
        coder, out = encoder(model), {k: [] for k in ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")}
        for text in block.texts.to_pylist():
            found = coder.encode(text)
            ids, decoded = found.tobytes(), coder.decode(found)
            out["n_tokens"].append(len(found))
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            if with_ids:
                out["ids"].append(ids)
                out["decoded"].append(decoded.decode())
        return out if with_ids else {k: v for k, v in out.items() if k not in ("ids", "decoded")}

    return map_texts(docs, encode, f"n_tokens long, {'ids binary, decoded string, ' * with_ids}ids_sha256 string, decoded_sha256 string")
