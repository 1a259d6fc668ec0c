"""Periodic runs of words: tiles per octave of periods, fragments stitched by document and period.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``COPIES`` times q and
``LEAST`` words long, that no neighbouring word extends. Seen from its left ends, a run of length L is an interval
of L - q places whose word equals the word q further on.

1. Documents become segments of word numbers. One of up to ``SPAN`` words is a single segment and is
   solved where it was read. A longer one is exploded: octave T holds the periods T to 2T - 1, and its
   segments advance by ``SPAN`` or 4T words, whichever is more, and overlap by 4T, so that neighbouring segments
   both see enough of every interval between them. These rows are spread over the cluster.
2. A segment is solved octave by octave, on tiles around every T-th word b. Every interval that makes a run
   holds T places from some b on. Hashes of T words, doubled from octave to octave, find the shifts q whose words
   from b + q on can equal those from b on. For tiles with such a shift, Z-functions at the boundary b (forward
   over the tile, backward over the mirrored words before it) give how far the equality extends to both sides;
   they compare words themselves. A shift whose first q words are a power of a shorter word has a smaller
   period and is dropped, as are tiles inside a run of a smaller period. Octaves below ``DIRECT`` compare the segment
   with its shift.
3. Overlapping pieces of one segment are joined at once. Intervals too short for a run are dropped
   unless they touch a border inside the document. The rest is shuffled by document and period and
   stitched; runs then go back to the documents that had any fragment, and only these documents' texts.

Edge cases: a null or empty text has no words and no run. Words are told apart by 64-bit hashes within a
document. Repeated rows and rows with equal or null ids are examined each. Input columns named like a result are
refused. Texts of any length are examined whole. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.llm.blocks import Texts, Words, covered, cut, mixed, runs, word_hashes
from nearfold.session import staged

#: A run is at least so many words, and so many times its period, long.
LEAST, COPIES = 6, 4
#: Words of a document that are solved in one piece.
SPAN = 1 << 14
#: Periods below this are found by comparing the whole segment with its shift.
DIRECT = 8

RESULT = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_RUN = "array<struct<start:bigint,period:bigint,length:bigint>>"
_NOTHING = hashlib.sha256(b"").hexdigest()


def z_function(s: list[int], upto: int) -> list[int]:
    """For every i below ``upto``, the length of the longest common prefix of s and s[i:]; 0 at 0."""
    n = len(s)
    z = [0] * upto
    left = right = 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@functools.lru_cache(1 << 16)
def _primes(n: int) -> tuple[int, ...]:
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return (*found, n) if n > 1 else tuple(found)


def _is_power(z: list[int], q: int) -> bool:
    """Whether the first q words are a shorter word repeated; ``z`` is their Z-function."""
    return any(z[q // prime] >= q - q // prime for prime in _primes(q))


def _tile(ids: np.ndarray, b: int, shifts: np.ndarray, t: int) -> list[tuple[int, int, int]]:
    """(period, begin, end) of the equal places around b for every shift that is no power."""
    ahead = ids[b : b + 4 * t].tolist()
    z = z_function(ahead, min(2 * t, len(ahead)))
    candidates = [q for q in shifts.tolist() if z[q] >= t and not _is_power(z, q)]
    if not candidates:
        return []
    before = ids[max(b - t, 0) : b][::-1].tolist()
    facing = ids[b : b + 2 * t][::-1].tolist()
    back = z_function([*before, -1, *facing], len(before) + 1 + len(facing))
    # The words before b + q are those of ``facing`` from 2t - q on, or fewer at the end of the segment.
    mirror = len(before) + 1 + len(facing)
    return [(q, b - back[mirror - q], b + min(z[q], 2 * t)) for q in candidates]


def _joined(period: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching intervals of one period as one."""
    if not len(period):
        return period, begin, end
    order = np.lexsort((begin, period))
    period, begin, end = period[order], begin[order], end[order]
    # Ends grow along a period once later ones are lifted above all earlier periods.
    lift = (np.cumsum(np.concatenate(([0], period[1:] != period[:-1]))) * (int(end.max()) + 2)).astype(np.int64)
    reach = np.maximum.accumulate(end + lift)
    first = np.concatenate(([True], begin[1:] + lift[1:] > reach[:-1]))
    starts = np.flatnonzero(first)
    return period[starts], begin[starts], np.maximum.reduceat(end, starts)


def intervals(ids: np.ndarray, octaves: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, begin, end) of equal places, for periods from octaves[0] up to below octaves[1], both powers of two.

    ``ids`` are segments end to end with a number of its own, used nowhere else, after each. All intervals of
    at least 2 * T places of a primitive period in octave T are among them, as far as the segment shows them.
    """
    n = len(ids)
    found = [np.zeros((3, 0), dtype=np.int64)]
    reach = np.zeros(n + 1, dtype=np.int64)  # how far a run of a smaller period goes that begins here or before
    hashes, t = mixed(ids), 1

    def keep(period: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        nonlocal reach
        period, begin, end = _joined(period, begin, end)
        found.append(np.stack([period, begin, end]))
        np.maximum.at(reach, begin, end + period)
        reach = np.maximum.accumulate(reach)

    while t < octaves[1] and 3 * t <= n and len(hashes):
        if t >= octaves[0]:
            some: list[tuple[int, int, int]] = []
            if t < DIRECT:
                for q in range(t, min(2 * t, n)):
                    begin, end = runs(ids[:-q] == ids[q:])
                    # The first q words lie in a run of a smaller period: a power, or too short to matter.
                    new = (end - begin >= 2 * t) & (reach[begin] < end + q)
                    begin, end = begin[new], end[new]
                    keep(np.full(len(begin), q, dtype=np.int64), begin, end)
            else:
                blocks = np.resize(hashes, (-(-len(hashes) // t), t))
                row, shift = np.nonzero(blocks[1:] == blocks[:-1, :1])
                b = row * t
                new = (b + t + shift < len(hashes)) & (reach[b] < b + 3 * t)
                row, shift = row[new], shift[new]
                borders = np.flatnonzero(np.diff(row, prepend=-1, append=-1)) if len(row) else row
                for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                    some += _tile(ids, int(row[lo]) * t, shift[lo:hi] + t, t)
                if some:
                    keep(*np.array(some, dtype=np.int64).T)
        # Hashes of twice as many words.
        hashes = mixed(hashes[:-t] * np.uint64(0x9E3779B97F4A7C15) + hashes[t:]) if len(hashes) > t else hashes[:0]
        t *= 2
    period, begin, end = np.concatenate(found, axis=1)
    return period, begin, end


def word_numbers(texts: Texts) -> tuple[np.ndarray, Words]:
    """A number for every word, equal for equal words of the batch, and where the words are."""
    words = texts.words()
    _, numbers = np.unique(word_hashes(words), return_inverse=True)
    return numbers.astype(np.int64), words


def _segments(n: int, t: int, step: int) -> Iterator[tuple[int, int]]:
    """Borders of the segments of n words for octaves up to t."""
    for begin in range(0, n, step):
        yield begin, min(begin + step + 4 * t, n)
        if begin + step + 4 * t >= n:
            return


def exploded(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(least octave, octave beyond the last, begin, end) of all segments of a long document."""
    low, high = 1, max(SPAN // 8, DIRECT)
    while COPIES * low <= n:
        for begin, end in _segments(n, high // 2, max(SPAN, 4 * (high // 2))):
            yield low, high, begin, end
        low, high = high, high * 2


def _solve(ids: list[np.ndarray], octaves: tuple[int, int], offset: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, period, begin, end) in words of the document. Segment i stands at ``offset[i]`` of ``total[i]`` words."""
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    at = np.concatenate(([0], np.cumsum(lengths + 1)))
    flat = np.empty(at[-1], dtype=np.int64)
    top = max((int(x.max()) for x in ids if len(x)), default=0) + 1
    for i, x in enumerate(ids):
        flat[at[i] : at[i] + len(x)] = x
        flat[at[i + 1] - 1] = top + i
    period, begin, end = intervals(flat, octaves)
    which = np.searchsorted(at, begin, side="right") - 1
    begin, end = begin - at[which], end - at[which]
    left_open = (begin == 0) & (offset[which] > 0)
    right_open = (end + period == lengths[which]) & (offset[which] + lengths[which] < total[which])
    size = end - begin + period
    keep = left_open | right_open | ((size >= COPIES * period) & (size >= LEAST))
    return which[keep], period[keep], (begin + offset[which])[keep], (end + offset[which])[keep]


_FRAGMENTS = pa.list_(pa.struct([("period", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))
_SEGMENTS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def _by_owner(owner: np.ndarray, columns: list[np.ndarray], n: int) -> pa.Array:
    """Rows as one list of structs per owner."""
    order = np.argsort(owner, kind="stable")
    at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    fields = [pa.array(c[order]) for c in columns]
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(fields, names=["period", "begin", "end"]))


def _sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _joined_words(words: Words, lo: int, hi: int, keep: np.ndarray | None = None) -> bytes:
    chosen = np.arange(lo, hi) if keep is None else lo + np.flatnonzero(keep)
    data = words.data
    return b" ".join(data[s:e].tobytes() for s, e in zip(words.starts[chosen].tolist(), words.ends[chosen].tolist(), strict=True))


def _examine(docs: DataFrame, keep: list[str], with_text: bool) -> DataFrame:
    """First pass: fragments of short documents, segments of long ones, the digest where there is neither."""
    types = dict(docs.dtypes)
    schema = ", ".join(
        [
            *(f"`{c}` {types[c]}" for c in keep),
            "words string, n_words long, fragments array<struct<period:bigint,begin:bigint,end:bigint>>",
            "segments array<struct<low:bigint,high:bigint,offset:bigint,ids:array<int>>>, plain_sha256 string",
        ]
    )
    names = [*keep, "words", "n_words", "fragments", "segments", "plain_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            where = {name: i for i, name in enumerate(batch.schema.names)}
            texts = Texts(batch.column(where["text"]))
            numbers, words = word_numbers(texts)
            n = words.counts()
            short = np.flatnonzero(n <= SPAN)
            ids = [numbers[words.at[i] : words.at[i + 1]] for i in short]
            owner, period, begin, end = _solve(ids, (1, int(n.max(initial=0)) // COPIES + 1), np.zeros(len(short), np.int64), n[short])
            owner = short[owner]
            fragments = _by_owner(owner, [period, begin, end], batch.num_rows)
            segments: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(n > SPAN):
                own = np.unique(numbers[words.at[i] : words.at[i + 1]], return_inverse=True)[1].astype(np.int32)
                segments[i] = [{"low": low, "high": high, "offset": b, "ids": own[b:e]} for low, high, b, e in exploded(len(own))]
            open_ = np.bincount(owner, minlength=batch.num_rows) > 0
            open_ |= n > SPAN
            joined = [_joined_words(words, words.at[i], words.at[i + 1]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(where[c]) for c in keep),
                    pa.array([x.decode() if o or with_text else None for x, o in zip(joined, open_, strict=True)], pa.string()),
                    pa.array(n),
                    fragments,
                    pa.array(segments, _SEGMENTS),
                    pa.array([None if o else _sha(x) for x, o in zip(joined, open_, strict=True)], pa.string()),
                ],
                names,
            )

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def _solve_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uid, total, segment in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
            ids = segment["ids"].values.to_numpy().astype(np.int64)
            offset = np.array([segment["offset"].as_py()])
            octaves = (segment["low"].as_py(), segment["high"].as_py())
            _, period, begin, end = _solve([ids], octaves, offset, np.array([total]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(period), uid)), pa.array(period), pa.array(begin), pa.array(end)], ["uid", "period", "begin", "end"]
            )


def stitched(fragments: DataFrame) -> DataFrame:
    """(uid, start, length, period) of the runs in ``fragments`` (uid, period, begin, end)."""
    place = Window.partitionBy("uid", "period").orderBy("begin", "end")
    before = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("begin") > before), 1).otherwise(0)
    # ``part`` counts the gaps so far.
    parts = fragments.withColumn("new", new).withColumn("part", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("uid", "period", "part").agg(F.min("begin").alias("start"), F.max("end").alias("end"))
    length = (F.col("end") - F.col("start") + F.col("period")).alias("length")
    return whole.select("uid", "start", length, "period").where((F.col("length") >= COPIES * F.col("period")) & (F.col("length") >= LEAST))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest and the text without the repeats, in place of the words."""
    for batch in cut(batches, "words"):
        texts = Texts(batch.column(batch.schema.get_field_index("words")))
        words = texts.words()
        lists = batch.column(batch.schema.get_field_index("runs"))
        at = lists.offsets.to_numpy()
        start, length, period = (lists.values.field(name).to_numpy() for name in ("start", "length", "period"))
        kept, digest = [], []
        for i in range(batch.num_rows):
            own = slice(at[i], at[i + 1])
            lo, hi = int(words.at[i]), int(words.at[i + 1])
            gone = covered(start[own] + period[own], start[own] + length[own], hi - lo)
            kept.append(_joined_words(words, lo, hi, ~gone))
            digest.append(_sha("".join(f"{s},{n},{p}\n" for s, n, p in zip(start[own].tolist(), length[own].tolist(), period[own].tolist(), strict=True)).encode()))
        rest = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "words"]
        names = [c for c in batch.schema.names if c != "words"]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array([k.decode() for k in kept], pa.string()), pa.array([_sha(k) for k in kept], pa.string()), pa.array(digest, pa.string())],
            [*names, "collapsed", "collapsed_sha256", "runs_sha256"],
        )


def find_runs(docs: DataFrame, keep: list[str], with_text: bool = False) -> DataFrame:
    """The columns ``keep`` of every document and RESULT; with ``with_text`` also all ``runs`` and the text
    ``collapsed`` to one copy of every run, its words joined by blanks.
    """
    result = [c.split()[0] for c in RESULT.split(", ")]
    own = {"uid", "words", "fragments", "segments", "plain_sha256", "runs", "collapsed", "longest", *result}
    if own & set(keep):
        raise ValueError(f"columns {keep} clash with the result's own")
    first = staged(_examine(docs, keep, with_text).withColumn("uid", F.monotonically_increasing_id()), "examined")
    here = first.select("uid", F.inline("fragments"))
    long_ones = first.select("uid", "n_words", F.explode("segments").alias("segment"))
    spread = long_ones.repartition(F.xxhash64("uid", "segment.low", "segment.offset"))
    there = spread.mapInArrow(_solve_segments, "uid long, period long, `begin` long, `end` long")
    found = stitched(here.unionByName(there))
    listed = found.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))

    types = dict(first.dtypes)
    kept = [*keep, "n_words", "runs"]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"n_words long, runs {_RUN}, collapsed string, collapsed_sha256 string, runs_sha256 string"])
    no_runs = F.array().cast(_RUN)
    open_ = first.where("plain_sha256 is null").join(listed, "uid", "left").select(*keep, "n_words", F.coalesce("runs", no_runs).alias("runs"), "words")
    closed = first.where("plain_sha256 is not null").select(
        *keep, "n_words", no_runs.alias("runs"), F.col("words").alias("collapsed"), F.col("plain_sha256").alias("collapsed_sha256"), F.lit(_NOTHING).alias("runs_sha256")
    )
    both = open_.select(*kept, "words").mapInArrow(_collapse, schema).unionByName(closed)
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    both = both.withColumn("longest", F.array_min(order))
    return both.select(
        *keep,
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.less")).alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("-1000 * longest.less div longest.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
        *(["runs", "collapsed"] if with_text else []),
    )
