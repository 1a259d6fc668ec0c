"""Conversations as training text by columnar byte assembly.

A turn becomes ``### role: text</turn>\\n``. In texts each of ``\\ # <`` gets a backslash before it (in
roles also ``:``), so no control string can occur inside a text and reading back is exact. The bytes of
a whole batch of turns are assembled at once: the length of every segment, cumulative offsets and the
place of every byte are computed in numpy, and headers and contents are copied into one preallocated
buffer that becomes the Arrow column. The loss covers the texts of assistant turns.

Rows are sorted by (conversation, turn) inside partitions and streamed, so a conversation never has to
fit in memory: one of more than PART_BYTES leaves in several numbered parts.

Edge cases: a null text or role is an empty one; a null turn comes first; rows with equal turns are
ordered by role and text, repeated rows stay. A null conversation id is a conversation of its own. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.blocks import Texts, cut

OPEN, MIDDLE, CLOSE = b"### ", b": ", b"</turn>\n"
LEARNED = "assistant"
#: A conversation's formatted text is handed on in parts of about this size.
PART_BYTES = 8 * 1024 * 1024

_SPECIAL = np.zeros(256, dtype=bool)
_SPECIAL[list(rb"\#<")] = True
_SPECIAL_ROLE = _SPECIAL.copy()
_SPECIAL_ROLE[ord(":")] = True

_TURN = re.compile(rb"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.)*+)</turn>\n", re.DOTALL)
_ESCAPE = re.compile(rb"\\(.)", re.DOTALL)

FORMATTED = "conv_id long, part int, formatted string, turns array<struct<start:int,end:int,learned:boolean>>"


def _places(texts: Texts, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of every text once escaped, and each byte's shift inside its text."""
    mark = special[texts.data]
    total = np.concatenate(([0], np.cumsum(mark)))
    lengths = np.diff(texts.at) + np.diff(total[texts.at])
    own = np.repeat(np.arange(len(texts)), np.diff(texts.at))
    shift = np.arange(len(texts.data)) - texts.at[own] + total[1:] - total[texts.at[own]]
    return lengths, shift


def assemble(role: Texts, text: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, offsets of the turns, offsets where their texts begin."""
    role_len, role_shift = _places(role, _SPECIAL_ROLE)
    text_len, text_shift = _places(text, _SPECIAL)
    size = len(OPEN) + role_len + len(MIDDLE) + text_len + len(CLOSE)
    at = np.concatenate(([0], np.cumsum(size)))
    text_at = at[:-1] + len(OPEN) + role_len + len(MIDDLE)
    out = np.empty(int(at[-1]), dtype=np.uint8)
    for place, fixed in ((at[:-1], OPEN), (text_at - len(MIDDLE), MIDDLE), (at[1:] - len(CLOSE), CLOSE)):
        out[(place[:, None] + np.arange(len(fixed))).ravel()] = np.tile(np.frombuffer(fixed, np.uint8), len(place))
    for texts, begin, shift, special in ((role, at[:-1] + len(OPEN), role_shift, _SPECIAL_ROLE), (text, text_at, text_shift, _SPECIAL)):
        place = np.repeat(begin, np.diff(texts.at)) + shift
        out[place] = texts.data
        marked = special[texts.data]
        out[place[marked] - 1] = ord("\\")
    return out, at, text_at


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv: int | None | str = "none yet"
    part, pieces, spans, filled = 0, [], [], 0

    def row() -> pa.RecordBatch:
        whole = pa.array([b"".join(pieces)], pa.binary()).cast(pa.string())
        turns = pa.array([[{"start": a, "end": b, "learned": c} for a, b, c in spans]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("learned", pa.bool_())])))
        return pa.record_batch([pa.array([conv], pa.int64()), pa.array([part], pa.int32()), whole, turns], ["conv_id", "part", "formatted", "turns"])

    for batch in cut(batches):
        roles = batch.column(1)
        out, at, text_at = assemble(Texts(roles), Texts(batch.column(2)))
        ends = at[1:] - len(CLOSE)
        # Offsets count code points: bytes that do not continue one.
        points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
        ids, names = batch.column(0).to_pylist(), roles.to_pylist()
        begin = 0
        while begin < len(ids):
            end = begin + 1
            while end < len(ids) and ids[end] == ids[begin] and at[end] - at[begin] < PART_BYTES:
                end += 1
            if ids[begin] != conv or filled >= PART_BYTES:
                if pieces:
                    yield row()
                part = part + 1 if ids[begin] == conv else 0
                conv, pieces, spans, filled = ids[begin], [], [], 0
            base = (spans[-1][1] + len(CLOSE) if spans else 0) - points[at[begin]]
            pieces.append(out[at[begin] : at[end]].tobytes())
            filled += int(at[end] - at[begin])
            spans += [(int(base + points[text_at[t]]), int(base + points[ends[t]]), names[t] == LEARNED) for t in range(begin, end)]
            begin = end
    if pieces:
        yield row()


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, turns) of rows (conv_id, turn, role, text).

    ``turns`` holds, in code points of ``formatted``, where each turn's escaped text lies and whether
    the loss covers it.
    """
    tidy = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        "turn",
    )
    ordered = tidy.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


def read_turns(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of every turn of a formatted text, unescaped."""
    place = 0
    while place < len(formatted):
        found = _TURN.match(formatted, place)
        if found is None:
            raise ValueError(f"no turn at byte {place}")
        yield _ESCAPE.sub(rb"\1", found[1]), _ESCAPE.sub(rb"\1", found[2])
        place = found.end()


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv: int | None | str = "none yet"
    turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

    def row() -> dict:
        return {"conv_id": conv, "n_turns": counts[0], "turns_sha256": turns.hexdigest(), "loss_chars": counts[1], "loss_sha256": loss.hexdigest(), "formatted_chars": counts[2]}

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        done = []
        for i in range(batch.num_rows):
            own, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            if own != conv:
                if conv != "none yet":
                    done.append(row())
                conv, turns, loss, counts = own, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            for role, content in read_turns(text.encode()):
                turns.update(role + b"\n" + content + b"\n")
                counts[0] += 1
            counts[2] += len(text)
            for span in batch.column(2)[i].as_py():
                if span["learned"]:
                    content = _ESCAPE.sub(rb"\1", text[span["start"] : span["end"]].encode())
                    loss.update(content)
                    counts[1] += len(content.decode())
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if conv != "none yet":
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Counts and digests per conversation, read back from its formatted parts."""
    parts = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.select("conv_id", "formatted", "turns").mapInArrow(_digest, DIGESTS)
