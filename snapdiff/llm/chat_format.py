"""Chat formatting: a finite-state machine over roles emits text segments with loss flags.

The template is a table: per role the control strings before and after a text and whether the
text is under the loss mask. Control strings inside a text are escaped with a backslash (after
their first character; backslashes are doubled), so a formatted conversation can be read back.
Roles outside the template get a segment of their own, ``<|role|>``, with the role escaped.

The machine walks the turns of a conversation in order and marks each turn as valid or not: a
system turn only comes first, user and assistant alternate, beginning with the user. A turn that is
not valid is formatted all the same, and what the machine makes of the turns after it starts anew.

Rows are dealt by conversation and sorted inside partitions, and the machine keeps only its state
between rows, so a very long conversation is streamed and never gathered.

Nulls, ties and repeats: a null text or role is an empty one; turns with equal numbers are ordered
by role and text; null turns come first; rows that repeat are turns each; rows with a null conv_id
are one conversation; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: role -> (control string before, control string after, under the loss mask)
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n\n", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": (" ", " </s>", True),
}
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")
OPEN_OTHER, CLOSE_OTHER, END_OTHER = "<|", "|>", "</s>"
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

#: state -> role -> next state; a role that is missing there is not valid
MACHINE = {
    "start": {"system": "ready", "user": "asked"},
    "ready": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
AFTER = {"system": "ready", "user": "asked", "assistant": "answered"}


def escape(text: str) -> str:
    """Reversible, and free of control strings."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segments(role: str, text: str, first: bool, template: dict = TEMPLATE) -> list[tuple[str, bool]]:
    """A turn's segments: (text, under the loss mask)."""
    begin = [("<s>", False)] if first else []
    if role in template:
        before, after, loss = template[role]
        return [*begin, (before, False), (escape(text), loss), (after, False)]
    return [*begin, (OPEN_OTHER + escape(role) + CLOSE_OTHER, False), (escape(text), False), (END_OTHER, False)]


_NEXT = "conv_id long, place long, valid boolean, segments array<struct<text:string,loss:boolean>>"
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per turn: conv_id, place (from 0), valid, and its segments; a conversation is theirs in a row.

    Rows come dealt by conversation and in order inside each partition.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, state = object(), 0, "start"
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != now:
                    now, place, state = conv, 0, "start"
                valid = role in MACHINE[state]
                state = AFTER.get(role, "start")
                out.append((conv, place, valid, [{"text": t, "loss": x} for t, x in segments(role, text, place == 0)]))
                place += 1
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), _SEGMENTS), strict=True)], ["conv_id", "place", "valid", "segments"])

    return dealt.mapInArrow(run, _NEXT)


def read_turn(formatted: str, template: dict = TEMPLATE) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    body = formatted.removeprefix("<s>")
    if body.startswith(OPEN_OTHER):
        role, _, rest = body[len(OPEN_OTHER) :].partition(CLOSE_OTHER)
        return unescape(role), unescape(rest.removesuffix(END_OTHER))
    for role, (before, after, _) in template.items():
        if body.startswith(before) and body.endswith(after):
            return role, unescape(body[len(before) : len(body) - len(after)])
    raise ValueError("not a formatted turn")


class Reader:
    """Reads a formatted conversation from its parts, in order, and keeps digests only."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.valid = True
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, parts: list[dict], valid: bool) -> None:
        whole = "".join(p["text"] for p in parts)
        role, text = read_turn(whole)
        self.turns += 1
        self.valid &= valid
        self.chars += len(whole)
        self.all.update(f"{role}\n{text}\n".encode())
        for p in parts:
            if p["loss"]:
                under = unescape(p["text"])
                self.loss_chars += len(under)
                self.loss.update(under.encode())

    def row(self, conv: int | None) -> tuple:
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, from ``format_turns`` rows as they come: counts and digests of what the output holds."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in schema.split(", ")])
        now, reader = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if reader is None or row["conv_id"] != now:
                    if reader is not None:
                        done.append(reader.row(now))
                    now, reader = row["conv_id"], Reader()
                reader.add(row["segments"], row["valid"])
            if done:
                yield pack(done)
        if reader is not None:
            yield pack([reader.row(now)])

    return turns.mapInArrow(run, schema)
