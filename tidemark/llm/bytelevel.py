"""Ids and bytes of byte-level BPE tokenizers."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: Fixed pattern of the pre-tokenizer that the format's `use_regex` stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_character() -> dict[str, int]:
    """The format's alphabet: printable bytes of Latin-1 stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A tokenizer file of the `tokenizers` library. `raw` has every id's bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        made = json.loads(self.library.to_str())
        added = {x["content"]: x["id"] for x in made["added_tokens"]}
        of = byte_of_character()
        vocabulary = {token: i for token, i in made["model"]["vocab"].items() if token not in added}
        self.raw = [b""] * self.library.get_vocab_size()
        for token, i in vocabulary.items():
            self.raw[i] = bytes(map(of.__getitem__, token))
        for token, i in added.items():
            self.raw[i] = token.encode()
        front = made["pre_tokenizer"]
        self.cuts_at_spaces = made["normalizer"] is None and (front["type"], front.get("use_regex"), front.get("add_prefix_space")) == ("ByteLevel", True, False)
        ranked = self._in_merge_order(vocabulary, made["model"]["merges"])
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={self.raw[i]: i for i in vocabulary.values()}, special_tokens=added) if ranked and self.cuts_at_spaces else None

    @staticmethod
    def _in_merge_order(vocabulary: dict[str, int], merges: list) -> bool:
        """Whether an id's place in the vocabulary is its merge's place, so that ids alone say what is merged first."""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        return len(vocabulary) == 256 + len(pairs) and all(vocabulary["".join(p)] == 256 + k for k, p in enumerate(pairs))

    def encode(self, text: str) -> np.ndarray:
        """The library's ids without added special tokens. Where ids are in the order of merges, a second library gives the same faster; it refuses very long white space."""
        if self.ranks is not None:
            try:
                return np.asarray(self.ranks.encode_to_numpy(text, allowed_special="all"), "<u4")
            except ValueError:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)
