"""Sub-word merges from an inverted index of adjacent pieces.

Training goes in epochs. An epoch begins with one pass over the distinct words: it counts all pairs of neighbouring
pieces, tracks the ``TRACKED`` best and writes their postings, one row per tracked pair and word that holds
it, sorted by pair. The rounds of the epoch then read the postings of the pairs they merge and nothing else. A word's
present pieces are those of the epoch's beginning with the epoch's merges replayed, on arrays of a whole batch, so postings are never rewritten; a
pair with a new piece is found under the pair that piece was first made from. A round sends back how the counts of
tracked and of new pairs change. The epoch ends when the best pair is no longer sure to be among those tracked,
or a merge makes a piece that was known already, which could raise counts that are not tracked.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold import session

#: Pairs with postings in an epoch, and new pairs taken up per round.
TRACKED = 4096
#: Pairs looked at per round.
PAIRS_PER_ROUND = 256

Pair = tuple[str, str]
#: Every "left right" at a piece boundary of " t ##h ##e "; the look-ahead lets them overlap.
_ADJACENT = "(?<= )(?=([^ ]+ [^ ]+) )"


def independent(pairs: list[tuple[str, str, int]], room: int, least: int, beyond: int | None = None) -> list[tuple[str, str, int]]:
    """The leading pairs that one-at-a-time merging would pick in this very order.

    Merging (a, b) uses up an ``a`` before a ``b``, so it only changes counts of
    pairs that end in a or begin with b; and a pair made with the new piece
    never counts more than the one of these it came from. So the next pair in
    the ranking is safe while it is no such neighbour of an earlier pick and
    outranks all such neighbours by count. ``beyond`` is the count of the first
    pair that is not listed.
    """
    chosen: list[tuple[str, str, int]] = []
    lefts: set[str] = set()
    rights: set[str] = set()
    for i, (left, right, n) in enumerate(pairs):
        if n < least or len(chosen) == room:
            break
        if right in lefts or left in rights:
            break
        tied = [p for p in pairs[i + 1 :] if p[2] == n]
        if (chosen and beyond == n) or any(p[1] in lefts or p[0] in rights for p in tied):
            break
        chosen.append((left, right, n))
        lefts.add(left)
        rights.add(right)
    return chosen


class Coded:
    """A batch of words as piece numbers: word w of ``rows`` has the pieces where ``word`` is w, in order."""

    def __init__(self, texts: pa.Array, made: list[str]) -> None:
        lists = pc.split_pattern(pc.utf8_trim(texts, " "), " ")
        flat = lists.flatten().dictionary_encode()
        self.names: list[str] = flat.dictionary.to_pylist()
        self.number = {name: i for i, name in enumerate(self.names)}
        for name in made:
            if name not in self.number:
                self.number[name] = len(self.names)
                self.names.append(name)
        self.codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows = len(texts)
        self.word = np.repeat(np.arange(self.rows), pc.list_value_length(lists).to_numpy())

    def replay(self, merges: list[Pair], made: list[str]) -> None:
        """Apply the merges in order, each from left to right through all words."""
        present = np.zeros(len(self.names), dtype=bool)
        present[self.codes] = True
        for (left, right), piece in zip(merges, made, strict=True):
            a, b = self.number.get(left, -1), self.number.get(right, -1)
            if a < 0 or b < 0 or not (present[a] and present[b]):
                continue
            at = np.flatnonzero(self.codes[:-1] == a)
            at = at[(self.codes[at + 1] == b) & (self.word[at + 1] == self.word[at])]
            if a == b and len(at):  # of overlapping places every second one is free
                begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0]
            if len(at):
                c = self.number[piece]
                self.codes[at], present[c] = c, True
                self.codes, self.word = np.delete(self.codes, at + 1), np.delete(self.word, at + 1)

    def keep(self, rows: np.ndarray) -> None:
        chosen = rows[self.word]
        self.codes, self.word = self.codes[chosen], self.word[chosen]

    def sizes(self) -> np.ndarray:
        return np.bincount(self.word, minlength=self.rows)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Every pair of neighbours as one number, and its word."""
        at = np.flatnonzero(self.word[:-1] == self.word[1:])
        return self.codes[at] * len(self.names) + self.codes[at + 1], self.word[at]

    def joined(self) -> pa.Array:
        """The words as text again."""
        at = np.concatenate(([0], np.cumsum(self.sizes()))).astype(np.int32)
        pieces = pa.array(self.names, pa.string()).take(pa.array(self.codes))
        return pc.binary_join_element_wise("", pc.binary_join(pa.ListArray.from_arrays(at, pieces), " "), "", " ")


class Epoch:
    """Counts and postings of the best pairs of ``words`` (pieces, n), and the merges since then."""

    def __init__(self, words: DataFrame, least: int, continues: str) -> None:
        self.words, self.least, self.continues = words, least, continues
        adjacent = F.regexp_extract_all("pieces", F.lit(_ADJACENT), F.lit(1))
        ranked = (
            words.select(F.explode(adjacent).alias("pair"), "n")
            .groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
            .orderBy(F.desc("n"), F.split("pair", " ")).limit(TRACKED + 1).collect()
        )
        best = [(*r["pair"].split(" "), r["n"]) for r in ranked]
        self.counts: dict[Pair, int] = {(a, b): n for a, b, n in best[:TRACKED]}
        #: Rank of the best pair that is not tracked.
        self.boundary = _rank(best[TRACKED]) if len(best) > TRACKED else None
        self.roots: dict[Pair, Pair] = {pair: pair for pair in self.counts}
        self.origin: dict[str, Pair] = {}
        self.merges: list[Pair] = []
        self.made: list[str] = []
        if best:
            tracked = words.sparkSession.createDataFrame([(" ".join(p),) for p in self.counts], "pair string")
            held = words.select(F.explode(F.array_distinct(adjacent)).alias("pair"), "pieces", "n").join(F.broadcast(tracked), "pair", "left_semi")
            # By word too, as one pair may be in most of them.
            self.held = session.staged(held.repartitionByRange("pair", "pieces").sortWithinPartitions("pair"), "postings")

    def ranking(self) -> tuple[list[tuple[str, str, int]], int | None]:
        """The best pairs in order, as far as they are sure, and the count of the next."""
        ranked = sorted(_rank((*pair, n)) for pair, n in self.counts.items() if n >= self.least)
        sure = ranked[: bisect_left(ranked, self.boundary)] if self.boundary else ranked
        more = sure[PAIRS_PER_ROUND] if len(sure) > PAIRS_PER_ROUND else self.boundary
        return [(a, b, -n) for n, a, b in sure[:PAIRS_PER_ROUND]], more and -more[0]

    def merge(self, picks: list[tuple[str, str, int]]) -> None:
        begin, end = len(self.made), len(self.made) + len(picks)
        roots = sorted({self.roots[a, b] for a, b, _ in picks})
        for a, b, _ in picks:
            self.merges.append((a, b))
            self.made.append(a + b[len(self.continues) :])
        fresh = {self.made[begin + i]: self.roots[a, b] for i, (a, b, _) in enumerate(picks)}
        merges, made, tracked = self.merges, self.made, set(self.counts)
        asked = {" ".join(r): i for i, r in enumerate(roots)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = Coded(batch.column(1), made)
                # A word that is read under several pairs counts under the first.
                rank = {words.number[a] * len(words.names) + words.number[b]: i for i, (a, b) in enumerate(roots) if a in words.number and b in words.number}
                own = np.array([asked[p] for p in batch.column(0).to_pylist()])
                keys, word = words.pairs()
                known = np.array(sorted(rank))
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[place] == keys
                first = np.full(words.rows, len(roots))
                np.minimum.at(first, word[hit], np.array([rank[k] for k in known.tolist()])[place[hit]])
                words.keep(first == own)
                words.replay(merges[:begin], made[:begin])
                size = words.sizes()
                before, of_before = words.pairs()
                words.replay(merges[begin:end], made[begin:end])
                shorter = words.sizes() < size
                after, of_after = words.pairs()
                n = batch.column(2).to_numpy()
                old, new = shorter[of_before], shorter[of_after]
                keys = np.concatenate((before[old], after[new]))
                found, at = np.unique(keys, return_inverse=True)
                total = np.zeros(len(found), dtype=np.int64)
                np.add.at(total, at, np.concatenate((-n[of_before[old]], n[of_after[new]])))
                names = words.names
                changes = {(names[k // len(names)], names[k % len(names)]): t for k, t in zip(found.tolist(), total.tolist(), strict=True)}
                kept = [(p, n) for p, n in changes.items() if n and (p in tracked or p[0] in fresh or p[1] in fresh)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for (a, _), _ in kept], pa.string()), pa.array([b for (_, b), _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64()), pa.array([p not in tracked for p, _ in kept], pa.bool_())],
                    ["left", "right", "n", "fresh"],
                )

        read = self.held.filter(F.col("pair").isin([" ".join(r) for r in roots]))
        changed = read.select("pair", "pieces", "n").mapInArrow(run, "left string, right string, n long, fresh boolean")
        summed = changed.groupBy("left", "right", "fresh").agg(F.sum("n").alias("n")).filter(~F.col("fresh") | (F.col("n") >= self.least))
        most = len(self.counts) + TRACKED
        rows = summed.orderBy("fresh", F.desc("n"), "left", "right").limit(most + 1).collect()
        for r in rows[:most]:
            pair = (r["left"], r["right"])
            if r["fresh"]:
                self.counts[pair] = r["n"]
                self.roots[pair] = fresh.get(pair[0]) or fresh[pair[1]]
            else:
                self.counts[pair] += r["n"]
        if len(rows) > most:
            cut = _rank((rows[most]["left"], rows[most]["right"], rows[most]["n"]))
            self.boundary = min(self.boundary, cut) if self.boundary else cut

    def rewritten(self) -> DataFrame:
        """The words with all merges of the epoch."""
        merges, made = self.merges, self.made

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = Coded(batch.column(0), made)
                words.replay(merges, made)
                yield pa.RecordBatch.from_arrays([words.joined(), batch.column(1)], ["pieces", "n"])

        return session.staged(self.words.select("pieces", "n").mapInArrow(run, "pieces string, n long"), "words")


def _rank(pair: tuple[str, str, int]) -> tuple[int, str, str]:
    return -pair[2], pair[0], pair[1]


def best_merges(words: DataFrame, room: int, least: int, known: set[str], continues: str) -> list[str]:
    """New pieces in the order one-at-a-time merging makes them, ``room`` at most.

    ``words`` is a written table (pieces, n) with pieces as " t ##h ##e "; ``known`` are the pieces there are.
    Ties go to the pair that sorts first.
    """
    known, found = set(known), []
    epoch = Epoch(words, least, continues)
    while len(found) < room:
        ranking, beyond = epoch.ranking()
        picks = independent(ranking, room - len(found), least, beyond)
        if not picks:
            if not epoch.made:
                break
            epoch = Epoch(epoch.rewritten(), least, continues)
            continue
        epoch.merge(picks)
        revived = False
        for piece in epoch.made[-len(picks) :]:
            if piece in known:
                revived = True
            else:
                known.add(piece)
                found.append(piece)
        if revived:
            epoch = Epoch(epoch.rewritten(), least, continues)
    return found
