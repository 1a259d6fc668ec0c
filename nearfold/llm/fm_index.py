"""Substring dedup by words: a compressed FM-index per shard and matching statistics of streamed texts.

A shard indexes its different segments: the Burrows-Wheeler transform of their words in a wavelet matrix
of packed bits, so that a backward step costs a few rank queries. Texts are streamed from their end; the
matching statistic of a place is the longest stretch from there that the index holds, up to ``cap``
words. Where it reaches the threshold, the suffixes of the interval share the whole window, and the
smallest document among them is read off. Suffixes are ordered by their first ``cap`` words or more,
which is all that steps over patterns of that length need.

Which windows reach a shard, and the treatment of nulls, repeated rows and hot passages: see ``repeats``.
"""

from __future__ import annotations

import hashlib
import pickle
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfold.llm import repeats
from nearfold.llm.blocks import Texts, runs, span_hashes
from nearfold.llm.repeats import Unit, spans, windows_of

WORDS = Unit("words", window=50, gram=12, shard=1_500_000)


class WaveletMatrix:
    """Ranks over a sequence of small whole numbers, one packed bit vector per binary digit."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.digits = max(1, int(symbols - 1).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        now = sequence
        for digit in reversed(range(self.digits)):
            bit = ((now >> digit) & 1).astype(bool)
            room = np.zeros(-(-(len(bit) + 1) // 64) * 64, dtype=bool)
            room[: len(bit)] = bit
            words = np.packbits(room, bitorder="little").view(np.uint64)
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1]
            self.levels.append((words, ones, int(len(bit) - bit.sum())))
            now = np.concatenate((now[~bit], now[bit]))
        self.begin = self._descend(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, (words, ones, zeros) in enumerate(self.levels):
            at = place >> 6
            below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            rank = ones[at] + np.bitwise_count(words[at] & below)
            place = np.where((symbol >> (self.digits - 1 - level)) & 1, zeros + rank, place - rank)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._descend(symbol, place) - self.begin[symbol]


class FmIndex:
    """Texts of symbols 1, 2, ..., each followed by a 0; ``doc`` names the document of every place."""

    def __init__(self, symbols: np.ndarray, doc: np.ndarray, cap: int) -> None:
        n = len(symbols)
        self.n, self.cap = n, cap
        kinds = int(symbols.max(initial=0)) + 1
        ranks, span = [symbols.astype(np.int64)], 1
        while span <= cap:
            last = ranks[-1]
            ahead = np.zeros(n, dtype=np.int64)
            ahead[: max(n - span, 0)] = last[span:] + 1
            pair = last * (n + kinds + 2) + ahead
            order = np.argsort(pair, kind="stable")
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], pair[order][1:] != pair[order][:-1])))
            ranks.append(rank)
            span *= 2
        self.suffixes = np.argsort(ranks[-1], kind="stable")
        self.lcp = self._common(ranks)
        self.first_row = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=kinds))))[:-1]
        self.bwt = WaveletMatrix(symbols[self.suffixes - 1], kinds)
        full = np.flatnonzero(self.lcp[:-1] < cap)
        self.first_doc = np.repeat(np.minimum.reduceat(doc[self.suffixes], full), np.diff(np.append(full, n)))
        edge = np.flatnonzero(self.lcp[:-1] < cap - 1)
        sizes = np.diff(np.append(edge, n))
        self.short_low, self.short_high = np.repeat(edge, sizes), np.repeat(edge + sizes, sizes)

    def _common(self, ranks: list[np.ndarray]) -> np.ndarray:
        """Words that neighbours in suffix order share, up to ``cap``; 0 at both ends."""
        left, right = self.suffixes[:-1].copy(), self.suffixes[1:].copy()
        shared = np.zeros(self.n - 1, dtype=np.int64)
        for level in reversed(range(len(ranks))):
            inside = np.maximum(left, right) < self.n
            same = inside.copy()
            same[inside] = ranks[level][left[inside]] == ranks[level][right[inside]]
            shared += same << level
            left += same << level
            right += same << level
        out = np.zeros(self.n + 1, dtype=np.int64)
        out[1:-1] = np.minimum(shared, self.cap)
        return out

    @cached_property
    def _parents(self) -> tuple[np.ndarray, np.ndarray]:
        """Per place of ``lcp``: the nearest smaller value before and after it."""
        place = np.arange(self.n + 1)
        before, after = np.zeros(self.n + 1, dtype=np.int64), np.full(self.n + 1, self.n)
        for depth in range(1, self.cap + 1):
            here = self.lcp == depth
            if here.any():
                less = self.lcp < depth
                before[here] = np.maximum.accumulate(np.where(less, place, 0))[here]
                after[here] = np.minimum.accumulate(np.where(less, place, self.n)[::-1])[::-1][here]
        return before, after

    def matching_statistics(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every place of the streamed texts symbols[at[i]:at[i + 1]]: the longest match that
        starts there (up to cap), and, where it reaches cap, the smallest document that has it.

        Unknown symbols are negative. All texts move in step, each by one word or one shortening.
        """
        length = np.zeros(len(symbols), dtype=np.int64)
        first = np.full(len(symbols), np.iinfo(np.int64).max)
        place = at[1:] - 1
        low, high = np.zeros(len(place), dtype=np.int64), np.full(len(place), self.n)
        depth = np.zeros(len(place), dtype=np.int64)
        live = np.flatnonzero(place >= at[:-1])
        while len(live):
            full = live[depth[live] == self.cap]
            low[full], high[full], depth[full] = self.short_low[low[full]], self.short_high[low[full]], self.cap - 1
            symbol = symbols[place[live]]
            known = np.maximum(symbol, 0)
            down = self.first_row[known] + self.bwt.rank(known, low[live])
            up = self.first_row[known] + self.bwt.rank(known, high[live])
            good = (down < up) & (symbol > 0)
            hit = live[good]
            low[hit], high[hit] = down[good], up[good]
            depth[hit] += 1
            length[place[hit]] = depth[hit]
            done = hit[depth[hit] == self.cap]
            first[place[done]] = self.first_doc[low[done]]
            place[hit] -= 1
            miss = live[~good]
            if len(miss):
                root = miss[depth[miss] == 0]
                place[root] -= 1
                self._shorten(miss[depth[miss] > 0], low, high, depth)
            live = live[place[live] >= at[:-1][live]]
        return length, first

    def _shorten(self, who: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> None:
        """Drop words from the match's end until the interval grows."""
        edge = np.where(self.lcp[low[who]] >= self.lcp[high[who]], low[who], high[who])
        before, after = self._parents
        depth[who] = self.lcp[edge]
        low[who], high[who] = before[edge], after[edge]
        root = who[depth[who] == 0]
        low[root], high[root] = 0, self.n


def _cutter(unit, values, texts, key, doc, tag, start, begin, end, hot, shards):
    if hot:  # each window by itself, keyed by its words
        which, at = windows_of(begin, end, unit.window)
        key = span_hashes(values, at, at + unit.window)
        doc, tag, start = doc[which], tag[which], (start[which] + at - begin[which]).astype(np.int32)
        begin, end = at, at + unit.window
    length = (end - begin).astype(np.int32)
    to = ((key >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    rows = []
    for shard in np.unique(to):
        mine = order[np.searchsorted(to[order], shard) : np.searchsorted(to[order], shard, side="right")]
        words, inverse = np.unique(values[spans(begin[mine], length[mine])], return_inverse=True)
        head = repeats.pack(key[mine], doc[mine], tag[mine], start[mine], length[mine])
        rows.append((int(shard), repeats.OPEN, 0, pickle.dumps((head, repeats.pack(words), repeats.pack(inverse.astype(np.uint32))))))
    return rows


def solve(payloads: list[bytes], unit: Unit = WORDS) -> tuple[np.ndarray, ...]:
    """Index the different segments of a shard, stream them, and return the spans that go."""
    parts = [(repeats.unpack(head), repeats.unpack(words)[0], repeats.unpack(inverse)[0]) for head, words, inverse in map(pickle.loads, payloads)]
    key, doc, tag, start, length = (np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True))
    values = np.concatenate([words[inverse] for _, words, inverse in parts])
    begin = np.cumsum(length.astype(np.int64)) - length
    content = span_hashes(values, begin, begin + length)
    order = np.lexsort((doc, content))
    new = np.concatenate(([True], content[order][1:] != content[order][:-1]))
    segment = np.empty(len(order), dtype=np.int64)
    segment[order] = np.cumsum(new) - 1
    chosen = order[new]  # the first document's copy of every different segment
    size = length[chosen].astype(np.int64)
    words, symbols = np.unique(values[spans(begin[chosen], size)], return_inverse=True)
    at = np.concatenate(([0], np.cumsum(size)))
    ended = np.insert(symbols + 1, at[1:], 0)
    index = FmIndex(ended, np.repeat(doc[chosen], size + 1), unit.window)
    _, first = index.matching_statistics(symbols + 1, at)
    repeated = first < np.repeat(doc[chosen], size)
    whole = doc > doc[chosen][segment]
    # Runs of repeated window starts, segment by segment (a segment's last words start no window).
    run_start, run_end = runs(repeated)
    of = np.searchsorted(at, run_start, side="right") - 1
    order = np.argsort(segment, kind="stable")
    low, high = np.searchsorted(segment[order], of), np.searchsorted(segment[order], of, side="right")
    run, copy = np.repeat(np.arange(len(of)), high - low), order[spans(low, high - low)]
    run, copy = run[~whole[copy]], copy[~whole[copy]]
    shift = start[copy] - at[of[run]]
    columns = (
        (doc[whole], doc[copy]), (tag[whole], tag[copy]),
        (start[whole], shift + run_start[run]), ((start + length)[whole], shift + run_end[run] - 1 + unit.window),
    )
    return tuple(np.concatenate(c).astype(kind) for c, kind in zip(columns, repeats.SPAN, strict=True))


def _report(with_text: bool):
    def report(texts: Texts, gone: list[np.ndarray]) -> dict[str, pa.Array]:
        kept = [b" ".join(w for w, g in zip(texts.raw(i).split(), gone[i], strict=True) if not g) if gone[i].any() else b" ".join(texts.raw(i).split()) for i in range(len(texts))]
        out = {
            "n_words": pa.array([len(g) for g in gone], pa.int64()),
            "n_removed": pa.array([int(g.sum()) for g in gone], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        return out | ({"kept": pa.array(kept, pa.binary()).cast(pa.string())} if with_text else {})

    return report


def remove_repeated_words(docs: DataFrame, unit: Unit = WORDS, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of documents (doc_id, text).

    Every word goes that lies in a window of 50 words whose sequence also starts in a document with a
    smaller id. ``kept`` is the rest, joined by blanks.
    """
    columns = "n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return repeats.find_and_remove(docs, unit, _cutter, solve, _report(with_text), columns)
