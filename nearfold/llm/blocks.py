"""Whole texts as flat numpy arrays: the shared ground of the operators that run on Arrow batches.

A batch of texts is one byte array plus offsets. Everything here is vectorised over such a batch and
bounded by it; batches are cut to a few megabytes of text, a longer text is a batch of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once in a task.
BATCH_BYTES = 3 * 1024 * 1024

#: The white space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 4 * BATCH_BYTES:  # a batch with one huge text does not leave its table behind
            _powers[base] = known
    return known[:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each values[start:end]; equal spans have equal hashes wherever they stand."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(_INVERSE, len(values) + 1)[starts])


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` values, by start; empty if there are fewer."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(n)
    return span_hashes(values, starts, starts + size)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by start, in log2(width) passes."""
    done, span = values, 1
    while span * 2 <= width:
        done = np.minimum(done[:-span], done[span:])
        span *= 2
    rest = width - span
    return np.minimum(done[: len(done) - rest], done[rest:]) if rest else done


def release() -> None:
    """Give memory that earlier tasks of this worker have freed back to the machine; workers are used again and again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its own counsel
        ctypes.CDLL(None).malloc_trim(0)


class Texts:
    """A batch of texts as bytes: ``data`` holds them end to end, text i is data[at[i]:at[i + 1]]."""

    def __init__(self, column: pa.Array) -> None:
        kind = column.type
        if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            width = np.int64
        else:
            width = np.int32
        if column.null_count:
            column = column.fill_null(b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        self.at = at - at[0]
        self.data = raw[at[0] : at[-1]]

    def __len__(self) -> int:
        return len(self.at) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def words(self) -> Words:
        return Words(self)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch; text i has words at[i]:at[i + 1]. Other separators on demand."""

    def __init__(self, texts: Texts, separators: np.ndarray = _IS_SPACE) -> None:
        data = texts.data
        space = separators[data]
        first = np.ones(len(data) + 1, dtype=bool)  # where a word may begin: after a space or at a text's start
        first[1:] = space
        first[texts.at[:-1]] = True
        first[-1] = False
        begins = first[:-1] & ~space
        last = np.ones(len(data) + 1, dtype=bool)
        last[:-1] = space
        last[texts.at] = True
        ends = last[1:] & ~space
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.at = np.searchsorted(self.starts, texts.at)
        self.data = data

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit id per word, from ``data`` if given (the same bytes, say, in lower case)."""
        return span_hashes(_BYTE[self.data if data is None else data], self.starts, self.ends)


#: Bytes of text whose words are hashed at once by ``word_hashes``.
SLICE_BYTES = 1024 * 1024


def word_hashes(words: Words, data: np.ndarray | None = None) -> np.ndarray:
    """As ``Words.hashes``, slice by slice, so that a text of any length needs no more memory than a slice.

    A word longer than a slice has a hash of its own making, which depends on its bytes alone too.
    """
    data = words.data if data is None else data
    out = np.empty(len(words.starts), dtype=np.uint64)
    begin = 0
    while begin < len(out):
        lo = int(words.starts[begin])
        end = int(np.searchsorted(words.ends, lo + SLICE_BYTES, side="right"))
        if end > begin:
            hi = int(words.ends[end - 1])
            out[begin:end] = span_hashes(_BYTE[data[lo:hi]], words.starts[begin:end] - lo, words.ends[begin:end] - lo)
        else:
            end = begin + 1
            out[begin] = int.from_bytes(hashlib.blake2b(data[lo : words.ends[begin]].tobytes(), digest_size=8).digest(), "little")
        begin = end
    return out


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte as it is."""
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), data)


def cut(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = Texts(batch.column(batch.schema.get_field_index(text))).at
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(at, at[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False]))))
    return edge[::2], edge[1::2]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the spans."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step[:n]) > 0
