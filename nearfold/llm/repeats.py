"""Passages that also start in a document with a smaller id: finding, routing and removing.

A window is ``window`` consecutive units (words or bytes) of one text. Comparing all windows would move
the text dozens of times over, so windows are first grouped into segments: neighbouring windows that
share the smallest hash of their runs of ``gram`` units. That hash depends on the window alone, hence
equal windows have equal keys wherever they stand, and only windows under a key that several documents
have can repeat. Equal segments (same key, 64-bit hash of the content, and length) are settled as wholes
(all but the first document's copies go), in every task before the exchange and after it. What is left, different segments under one key, is cut out
of the texts and sent by key to shards, where a solver compares window by window.

Nothing is cut short. Segments travel as packed arrays, by key; marks and texts meet by a hash of the
document id. A key with more than HOT different segments does not meet in one shard: its windows are
keyed by their own content instead. Buckets, document groups and shards have a size in units, and their
number follows the measured input.

Null and short texts have no windows. A null id takes no part: such rows stay whole. Rows that share an
id do not remove from each other. Repeated rows are treated alike.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.blocks import Texts, byte_values, covered, cut, gram_hashes, runs, sliding_min, span_hashes
from nearfold.session import staged

#: Segments in a bucket, bytes of text in a document group: what one task holds.
BUCKET_SEGMENTS, GROUP_BYTES = 1_000_000, 16 * 1024 * 1024
#: Segments that a task gathers before it deals them to buckets.
FLUSH_SEGMENTS = 400_000
#: Different segments under one key up to which they meet in one shard.
HOT = 2_000

PACKED = "dealt int, kind int, units long, payload binary"
#: Kinds of payload: segments by key; spans to remove; segments to compare; the same under a hot key.
SEGMENTS, REMOVED, OPEN, OPEN_HOT = range(4)


@dataclass(frozen=True)
class Unit:
    name: str
    window: int
    gram: int
    #: Units of a shard.
    shard: int

    def values(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        if self.name == "words":
            words = texts.words()
            return words.hashes(), words.at
        return byte_values(texts.data), texts.at


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    squeeze = zstandard.ZstdCompressor(level=1)
    planes = lambda a: a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
    return pickle.dumps([(a.dtype.str, len(a), squeeze.compress(planes(np.ascontiguousarray(a)))) for a in arrays])


def unpack(payload: bytes) -> list[np.ndarray]:
    grow = zstandard.ZstdDecompressor()
    out = []
    for kind, n, data in pickle.loads(payload):
        dtype = np.dtype(kind)
        planes = np.frombuffer(grow.decompress(data), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).ravel() if n else np.zeros(0, dtype))
    return out


def unpack_all(payloads: list[bytes], like: tuple[str, ...]) -> list[np.ndarray]:
    if not payloads:
        return [np.zeros(0, dtype=kind) for kind in like]
    return [np.concatenate(c) for c in zip(*map(unpack, payloads), strict=True)]


def rows_of(rows: list[tuple[int, int, int, bytes]]) -> dict[str, pa.Array]:
    dealt, kind, units, payload = zip(*rows, strict=True) if rows else ((), (), (), ())
    return {"dealt": pa.array(dealt, pa.int32()), "kind": pa.array(kind, pa.int32()), "units": pa.array(units, pa.int64()), "payload": pa.array(payload, pa.binary())}


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """The document group of an id; the same in tasks and in ``_texts``."""
    v = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((v >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)


def dealt(to: np.ndarray, kind: int, units: np.ndarray | None, *arrays: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """One packed row for every target in ``to``, in the given order."""
    if not len(to):
        return []
    order = np.argsort(to, kind="stable")
    sorted_to = to[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_to[1:] != sorted_to[:-1])))
    out = []
    for begin, end in zip(starts, [*starts[1:], len(to)], strict=True):
        mine = order[begin:end]
        out.append((int(sorted_to[begin]), kind, int(units[mine].sum()) if units is not None else 0, pack(*(a[mine] for a in arrays))))
    return out


def tags(texts: Texts) -> np.ndarray:
    """Tells apart the texts of rows that share an id."""
    return (span_hashes(byte_values(texts.data), texts.at[:-1], texts.at[1:]) >> np.uint64(40)).astype(np.uint32)


def segments(values: np.ndarray, at: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(text, start, windows, key) of the segments of a batch; start counts within the batch."""
    size = unit.window
    keys = sliding_min(gram_hashes(values, unit.gram), size - unit.gram + 1) if len(values) >= size else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(keys)]
    whole = np.arange(len(keys)) + size <= at[1:][owner]
    new = whole.copy()
    new[1:] &= (keys[1:] != keys[:-1]) | ~whole[:-1] | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.bincount((np.cumsum(new) - 1)[whole], minlength=len(first)).astype(np.int64)
    most = 4 * size  # in text that repeats itself one key may last; such segments are cut
    if (count > most).any():
        parts = -(-count // most)
        index = np.repeat(np.arange(len(first)), parts)
        step = (np.arange(len(index)) - np.repeat(np.cumsum(parts) - parts, parts)) * most
        first, count = first[index] + step, np.minimum(count[index] - step, most)
    return owner[first], first, count, keys[first]


def _first_copies(key: np.ndarray, doc: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, starts of its groups in that order, and the smallest document of each group.

    Neighbours in that order that differ in one of ``same`` are in different groups.
    """
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(_changes(*(a[order] for a in (key, *same))))
    return order, starts, np.minimum.reduceat(doc[order], starts)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in some column."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for a in columns:
        new[1:] |= a[1:] != a[:-1]
    return new


_SEGMENT = ("<u8", "<u8", "<i8", "<u4", "<i4", "<i4")
SPAN = ("<i8", "<u4", "<i4", "<i4")
_OPEN = ("<u8", *SPAN)


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[i] .. begin[i] + length[i] - 1 of all i end to end."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - length, length) + np.repeat(begin, length)


def windows_of(begin: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of every window of the segments."""
    count = end - begin - window + 1
    return np.repeat(np.arange(len(begin)), count), spans(begin, count)


def _emit(unit: Unit, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(gathered: list[tuple[np.ndarray, ...]], turn: int) -> pa.RecordBatch:
        key, content, doc, tag, start, n = (np.concatenate(c) for c in zip(*gathered, strict=True))
        both = key ^ (content * np.uint64(0x9E3779B97F4A7C15))
        order, starts, least = _first_copies(both, doc, key, content, n)
        later = np.zeros(len(key), dtype=bool)
        later[order] = doc[order] > np.repeat(least, np.diff(np.append(starts, len(key))))
        rows = dealt(np.full(int(later.sum()), turn % buckets, np.int32), REMOVED, None, doc[later], tag[later], start[later], (start + n + unit.window - 1)[later])
        stay = ~later
        bucket = ((key[stay] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        # Bits above 48 of the key may go: keys only gather candidates.
        short = key[stay] & np.uint64((1 << 56) - 1)
        rows += dealt(bucket, SEGMENTS, None, short, content[stay], doc[stay], tag[stay], start[stay], n[stay])
        return pa.RecordBatch.from_pydict(rows_of(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[np.ndarray, ...]] = []
        waiting = turn = 0
        for batch in cut(batches):
            batch = batch.filter(batch.column(0).is_valid())
            texts = Texts(batch.column(1))
            values, at = unit.values(texts)
            text, first, count, key = segments(values, at, unit)
            if not len(first):
                continue
            content = span_hashes(values, first, first + count + unit.window - 1)
            doc = batch.column(0).to_numpy()[text]
            gathered.append((key, content, doc, tags(texts)[text], (first - at[text]).astype(np.int32), count.astype(np.int32)))
            waiting += len(first)
            if waiting >= FLUSH_SEGMENTS:
                yield flush(gathered, turn)
                gathered, waiting, turn = [], 0, turn + 1
        if gathered:
            yield flush(gathered, turn)

    return run


def _settle(unit: Unit, groups: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        kinds, payloads = table["kind"].to_numpy(), table["payload"].to_pylist()
        removed = [unpack_all([p for p, k in zip(payloads, kinds, strict=True) if k == REMOVED], SPAN)]
        key, content, doc, tag, start, n = unpack_all([p for p, k in zip(payloads, kinds, strict=True) if k == SEGMENTS], _SEGMENT)
        rows: list[tuple[int, int, int, bytes]] = []
        if len(key):
            order, starts, least = _first_copies(key, doc)
            size = np.diff(np.append(starts, len(key)))
            most = np.maximum.reduceat(doc[order], starts)
            shared = order[np.repeat(least < most, size)]
            key, content, doc, tag, start, n = (a[shared] for a in (key, content, doc, tag, start, n))
        if len(key):
            by = np.lexsort((n, content, key))
            key, content, doc, tag, start, n = (a[by] for a in (key, content, doc, tag, start, n))
            new_key = _changes(key)
            new = _changes(key, content, n)
            starts = np.flatnonzero(new)
            first = np.minimum.reduceat(doc, starts)
            later = doc > np.repeat(first, np.diff(np.append(starts, len(key))))
            removed.append([doc[later], tag[later], start[later], (start + n + unit.window - 1)[later]])
            # Per key: its different segments and the first documents that have them.
            key_at = np.flatnonzero(new_key[starts])
            kinds_of = np.diff(np.append(key_at, len(starts)))
            differ = np.minimum.reduceat(first, key_at) < np.maximum.reduceat(first, key_at)
            of = np.cumsum(new_key) - 1
            compare = ~later & differ[of]
            hot = kinds_of[of] > HOT
            for kind, mine in ((OPEN, compare & ~hot), (OPEN_HOT, compare & hot)):
                end = (start + n + unit.window - 1)[mine]
                cost = n[mine] * unit.window if kind == OPEN_HOT else end - start[mine]
                rows += dealt(group_of(doc[mine], groups), kind, cost, key[mine], doc[mine], tag[mine], start[mine], end)
        gone = [np.concatenate(c) for c in zip(*removed, strict=True)]
        rows += dealt(group_of(gone[0], groups), REMOVED, None, *gone)
        return pa.table(rows_of(rows))

    return run


def _texts(docs: DataFrame, groups: int) -> DataFrame:
    """(dealt, doc_id, packed text) for meeting by document group; texts travel compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in cut(batches):
            ids = batch.column(0)
            to = group_of(ids.fill_null(0).to_numpy(zero_copy_only=False), groups)
            texts = Texts(batch.column(1))
            packed = pa.array([squeeze.compress(texts.raw(i)) for i in range(len(texts))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(to), ids, packed], ["dealt", "doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, "dealt int, doc_id long, packed binary")


def _some_texts(table: pa.Table, wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, Texts]]:
    """(ids, whether the id is null, texts) in batches, of the wanted ids or all."""
    grow = zstandard.ZstdDecompressor()
    ids = table["doc_id"].combine_chunks()
    null = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    packed = table["packed"]
    places = np.flatnonzero(np.isin(ids, wanted) & ~null) if wanted is not None else np.arange(len(ids))
    for begin in range(0, len(places), 256):
        mine = places[begin : begin + 256]
        text = pa.array([grow.decompress(packed[int(i)].as_py()) for i in mine], pa.binary())
        yield ids[mine], null[mine], Texts(text)


#: A solver gets the rows of its shard and says which spans go: (doc, tag, start, end).
Solver = Callable[[list[bytes]], tuple[np.ndarray, ...]]
#: A cutter packs compared segments: (values, key, doc, tag, start, begin, end, hot) -> rows by shard.
Cutter = Callable[..., list[tuple[int, int, int, bytes]]]


def _cut_out(unit: Unit, cutter: Cutter, shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, bytes]] = []
        for kind in (OPEN, OPEN_HOT):
            payloads = [p for p, k in zip(marks["payload"].to_pylist(), marks["kind"].to_numpy(), strict=True) if k == kind]
            key, doc, tag, start, end = unpack_all(payloads, _OPEN)
            if not len(key):
                continue
            by = np.lexsort((tag, doc))
            key, doc, tag, start, end = (a[by] for a in (key, doc, tag, start, end))
            for ids, null, batch in _some_texts(texts, np.unique(doc)):
                values, at = unit.values(batch)
                found: list[np.ndarray] = []
                base: list[np.ndarray] = []
                for i, (own, own_tag) in enumerate(zip(ids, tags(batch), strict=True)):
                    low, high = np.searchsorted(doc, own), np.searchsorted(doc, own, side="right")
                    mine = low + np.flatnonzero(tag[low:high] == own_tag)
                    if len(mine) and not null[i]:
                        found.append(mine)
                        base.append(np.full(len(mine), at[i]))
                if found:
                    mine, shift = np.concatenate(found), np.concatenate(base)
                    rows += cutter(unit, values, batch, key[mine], doc[mine], tag[mine], start[mine], start[mine] + shift, end[mine] + shift, kind == OPEN_HOT, shards)
        return pa.table(rows_of(rows))

    return run


def _solve(solver: Solver, groups: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        doc, tag, start, end = solver(table["payload"].to_pylist())
        return pa.table(rows_of(dealt(group_of(doc, groups), REMOVED, None, doc, tag, start, end)))

    return run


def _finish(unit: Unit, report: Callable[[Texts, list[np.ndarray]], dict[str, pa.Array]]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        doc, tag, start, end = unpack_all(marks["payload"].to_pylist(), SPAN)
        by = np.argsort(doc, kind="stable")
        doc, tag, start, end = (a[by] for a in (doc, tag, start, end))
        done = []
        for ids, null, batch in _some_texts(texts, None):
            counts = np.diff(batch.words().at if unit.name == "words" else batch.at)
            gone = []
            for i, (own, own_tag) in enumerate(zip(ids, tags(batch), strict=True)):
                low, high = (0, 0) if null[i] else (np.searchsorted(doc, own), np.searchsorted(doc, own, side="right"))
                mine = low + np.flatnonzero(tag[low:high] == own_tag)
                gone.append(covered(start[mine], end[mine], int(counts[i])))
            done.append(pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null), **report(batch, gone)}))
        return pa.concat_tables(done)

    return run


def find_and_remove(docs: DataFrame, unit: Unit, cutter: Cutter, solver: Solver, report, columns: str) -> DataFrame:
    """``doc_id`` and the reported columns of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = size / (6 if unit.name == "words" else 1)
    buckets = max(1, round(units * 2 / (unit.window - unit.gram + 2) / BUCKET_SEGMENTS))
    groups = max(1, -(-size // GROUP_BYTES))
    found = docs.mapInArrow(_emit(unit, buckets), PACKED).groupBy("dealt").applyInArrow(_settle(unit, groups), PACKED)
    marks = staged(found, f"{unit.name}-marks")
    open_ = marks.where(F.col("kind") >= OPEN)
    shards = max(1, -(-(open_.agg(F.sum("units")).first()[0] or 0) // unit.shard))
    cut_out = _texts(docs, groups).groupBy("dealt").cogroup(open_.groupBy("dealt")).applyInArrow(_cut_out(unit, cutter, shards), PACKED)
    solved = cut_out.groupBy("dealt").applyInArrow(_solve(solver, groups), PACKED)
    gone = marks.where(F.col("kind") == REMOVED).unionByName(solved)
    return _texts(docs, groups).groupBy("dealt").cogroup(gone.groupBy("dealt")).applyInArrow(_finish(unit, report), f"doc_id long, {columns}")


def removed_runs(gone: np.ndarray) -> int:
    return len(runs(gone)[0])
