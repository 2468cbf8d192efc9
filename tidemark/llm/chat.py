"""Chat formatting: a finite-state machine over roles and a declarative template.

`format_turns` turns a table of turns into text segments in reading order. Each segment is either one
of the template's control strings or escaped text, and says whether it counts for the loss. The
machine marks turns whose role may not follow the one before it, and ends behind a role that may not be the last; they are formatted all the same and
carry `valid = false`, so that a caller can drop the conversation.

Turns of a conversation are read as a sorted stream, so memory does not depend on its length; its machine needs them in order, so one conversation is one task's.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Which role may follow in which state; the state is the last role, "start" before the first turn.
FOLLOWS: dict[str, frozenset[str]] = {
    "start": frozenset({"system", "user"}),
    "system": frozenset({"user"}),
    "user": frozenset({"assistant"}),
    "assistant": frozenset({"user", "tool"}),
    "tool": frozenset({"assistant"}),
}


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings around roles and texts. `reserved` strings are escaped in texts as well."""

    begin: str = "<s>"
    role_open: str = "[ROLE]"
    text_open: str = "[INST]"
    turn_close: str = "[/INST]"
    end: str = "</s>"
    reserved: tuple[str, ...] = ("<unk>", "<<SYS>>", "<</SYS>>")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: FOLLOWS, hash=False)
    ends: frozenset[str] = frozenset({"assistant"})

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.role_open, self.text_open, self.turn_close, self.end)

    @cached_property
    def _starts(self) -> re.Pattern:
        some = sorted({*self.controls, *self.reserved}, key=lambda c: (-len(c), c))
        return re.compile(f"(?=(?:{'|'.join(map(re.escape, some))}))(.)", re.DOTALL)

    def escape(self, text: str) -> str:
        r"""Doubles backslashes and puts ``\.`` behind the first character of every control string."""
        return self._starts.sub(r"\1\\.", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\|\.)", lambda m: "\\" if m[1] == "\\" else "", text)

    def next_state(self, state: str, role: str) -> tuple[str, bool]:
        """State after a turn, and whether the turn was allowed."""
        return role, role in self.follows.get(state, frozenset())


SEGMENTS = "conv_id long, turn_no long, part string, role string, text string, loss boolean, valid boolean"
_ARROW = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("part", pa.string()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("formatted_sha256", pa.string())])
#: Code points after which rows go out.
FLUSH = 1 << 20


def _written(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def format_turns(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Segments of every conversation: conv_id, turn_no (0-based), part, role, text, loss, valid.

    Parts are begin, role_open, role, text_open, text, turn_close and end; joined in order they are the
    formatted conversation. Turns are ordered by (turn, role, text), nulls first; repeated rows
    are turns of their own. A null text or role counts as empty, and rows with a null conv_id
    form one conversation of their own. Other columns are not read. An empty table gives no segments.
    """

    def run(batches):
        rows, held, state, number, current, any_yet = [], 0, "start", 0, None, False
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not any_yet or conv != current:
                    if any_yet:
                        rows.append((current, number, "end", None, template.end, False, state in template.ends))
                    rows.append((conv, 0, "begin", None, template.begin, False, True))
                    any_yet, current, state, number = True, conv, "start", 0
                state, valid = template.next_state(state, role)
                body, loss = template.escape(text), role in template.loss_roles
                for part, piece, counts in (
                    ("role_open", template.role_open, False),
                    ("role", template.escape(role), False),
                    ("text_open", template.text_open, False),
                    ("text", body, loss),
                    ("turn_close", template.turn_close, False),
                ):
                    rows.append((conv, number, part, role, piece, counts, valid))
                number, held = number + 1, held + len(body) + 100
                if held >= FLUSH:
                    yield _written(rows, _ARROW)
                    rows, held = [], 0
        if any_yet:
            rows.append((current, number, "end", None, template.end, False, state in template.ends))
        if rows:
            yield _written(rows, _ARROW)

    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests of every formatted conversation, from the segments' text and loss flags alone.

    Roles and texts are found by the control strings and unescaped; the rows must stand in the order
    that `format_turns` gave them. Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, valid (every turn allowed, and the last one as an end) and formatted_sha256.
    """

    def fresh():
        return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "all": hashlib.sha256(), "valid": True, "slot": ""}

    def line(conv, s):
        return (conv, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["valid"], s["all"].hexdigest())

    def run(batches):
        current, s, rows = None, None, []
        for batch in batches:
            for conv, text, loss, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid")), strict=True):
                if s is None or text == template.begin:
                    if s is not None:
                        rows.append(line(current, s))
                    current, s = conv, fresh()
                s["chars"] += len(text)
                s["all"].update(text.encode())
                s["valid"] &= valid
                if text == template.turn_close:
                    if s["slot"] == "text":
                        s["turns"].update(b"\n")
                    s["n"], s["slot"] = s["n"] + 1, ""
                elif text == template.role_open:
                    s["slot"] = "role"
                elif text == template.text_open:
                    s["turns"].update(b"\n")
                    s["slot"] = "text"
                elif s["slot"]:
                    plain = template.unescape(text)
                    s["turns"].update(plain.encode())
                    if loss:
                        s["loss"].update(plain.encode())
                        s["loss_chars"] += len(plain)
            if len(rows) >= 1000:
                yield _written(rows, _DIGESTS)
                rows = []
        if s is not None:
            rows.append(line(current, s))
        if rows:
            yield _written(rows, _DIGESTS)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, formatted_sha256 string")
