"""Chat formatting with a grammar round trip.

A conversation is written as ``<s>``, its turns, ``<eos>``. A turn is an opening mark, the text and a closing mark;
user, assistant and system have marks of their own, any other role is named in its opening mark. Written text is read
back by a deterministic parser and compared with its source. Text goes out as it is where that comes back identical;
otherwise every character that could begin a control string or an escape is escaped by a backslash, which always does.

Turns are read in order as a sorted stream, so a conversation is never gathered: a task holds one turn at a time,
running digests, and offsets.

Defined cases: a null text is empty; a null role is the empty role; turns are taken by turn number, then role, then
text (nulls first), so ties and repeated rows have one order and all stay; rows without conversation id form one
conversation with that id; an empty table has no conversations; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "<eos>"
MARKS = {
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<ans>", "</s>"),
    "system": ("<<SYS>>\n", "\n<</SYS>>"),
}
OTHER = ("[ROLE ", "]", "[/ROLE]")
#: one step of reading a text: an escaped character or a closing mark
_STEP = re.compile(r"\\(.)|" + "|".join(re.escape(c) for c in (*(m[1] for m in MARKS.values()), OTHER[2])), re.S)
_CONTROL = re.compile("|".join(re.escape(x.strip()) for x in (BEGIN, END, *(y for m in MARKS.values() for y in m), OTHER[0], OTHER[2])))
_SPECIAL = re.compile(r"[\\<\[\]]")
LOSS_ROLE = "assistant"


def escaped(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def _marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (OTHER[0] + escaped(role) + OTHER[1], OTHER[2])


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where its text lies in it."""
    opening, closing = _marks(role)
    written = text
    if _CONTROL.search(text) or not _comes_back(opening + text + closing, role, text):
        written = escaped(text)
        if not _comes_back(opening + written + closing, role, text):
            raise ValueError("a turn does not survive the round trip")
    return opening + written + closing, len(opening), len(opening) + len(written)


def _comes_back(written: str, role: str, text: str) -> bool:
    try:
        return read(written) == [(role, text)]
    except ValueError:
        return False


def _until(s: str, at: int, closing: str) -> tuple[str, int]:
    """Unescaped text from ``at`` up to ``closing``, and the place behind it."""
    parts, start = [], at
    for step in _STEP.finditer(s, at):
        if step[1] is not None:
            parts += [s[start:step.start()], step[1]]
            start = step.end()
        elif step[0] == closing:
            return "".join([*parts, s[start:step.start()]]), step.end()
    raise ValueError("a turn does not end")


_ROLE_STEP = re.compile(r"\\(.)|\]", re.S)


def read(s: str) -> list[tuple[str, str]]:
    """Turns of a written text, without the marks of the conversation; raises on what is not in the grammar."""
    turns, at = [], 0
    while at < len(s):
        for role, (opening, closing) in MARKS.items():
            if s.startswith(opening, at):
                text, at = _until(s, at + len(opening), closing)
                break
        else:
            if not s.startswith(OTHER[0], at):
                raise ValueError("not a turn")
            parts, start, role = [], at + len(OTHER[0]), None
            for step in _ROLE_STEP.finditer(s, start):
                parts.append(s[start:step.start()])
                start = step.end()
                if step[1] is None:
                    role = "".join(parts)
                    break
                parts.append(step[1])
            if role is None:
                raise ValueError("a role does not end")
            text, at = _until(s, start, OTHER[2])
        turns.append((role, text))
    return turns


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order; Spark sorts on disk where memory ends."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("text").isNotNull().alias("known"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "known", "text").drop("known")


def _stream(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batched(rows, types: dict[str, pa.DataType], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types.values())], names=list(types))
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types.values())], names=list(types))


def _written(rows) -> Iterator[tuple]:
    """(conv_id, position, piece, offset, loss start, loss end, last) for the pieces of each conversation in order.

    Loss bounds are offsets in the conversation; -1 where a piece carries no loss.
    """
    rows = iter(rows)
    row = next(rows, None)
    while row is not None:
        conv, position, offset = row[0], 0, len(BEGIN)
        prefix = BEGIN
        while True:
            _, _, role, text = row
            piece, low, high = render(role, text)
            base = offset
            offset += len(piece)
            row = next(rows, None)
            last = row is None or row[0] != conv
            on = role == LOSS_ROLE
            yield (conv, position, prefix + piece + (END if last else ""), base - len(prefix),
                   base + low if on else -1, base + high if on else -1, last)
            prefix, position = "", position + 1
            if last:
                break


def format_turns(conversations: DataFrame) -> DataFrame:
    """The formatted conversations piece by piece: joined by position they are the text, with loss bounds in code points."""
    types = {"conv_id": pa.int64(), "position": pa.int64(), "formatted": pa.string(), "offset": pa.int64(),
             "loss_start": pa.int64(), "loss_end": pa.int64(), "last": pa.bool_()}
    return _ordered(conversations).mapInArrow(
        lambda batches: _batched(_written(_stream(batches)), types),
        "conv_id long, position long, formatted string, offset long, loss_start long, loss_end long, last boolean")


def _digests(pieces) -> Iterator[tuple]:
    """One row per conversation, from what the parser reads in the formatted pieces."""
    for conv, position, piece, offset, low, high, last in pieces:
        if position == 0:
            turns, loss, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        body = piece
        if position == 0:
            if not body.startswith(BEGIN):
                raise ValueError("a conversation does not begin")
            body = body[len(BEGIN):]
        if last:
            if not body.endswith(END):
                raise ValueError("a conversation does not end")
            body = body[:-len(END)]
        for role, text in read(body):
            n_turns += 1
            turns.update(f"{role}\n{text}\n".encode())
        if low >= 0:
            kept = re.sub(r"\\(.)", r"\1", piece[low - offset:high - offset], flags=re.S)
            loss.update(kept.encode())
            loss_chars += len(kept)
        chars += len(piece)
        if last:
            yield conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def round_trip(conversations: DataFrame) -> DataFrame:
    """Per conversation what is read back from its formatted text: turns, text under the loss mask, size."""
    types = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
             "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    return _ordered(conversations).mapInArrow(
        lambda batches: _batched(_digests(_written(_stream(batches))), types),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
