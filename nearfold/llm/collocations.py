"""Phrase collocations by relational mining: occurrence relations, merge joins, counted and semi-joined groups.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and these into words. Per language:

1. The relation of single words (piece, position, word), sorted by piece and position, is written once, as
   one row per block of documents; a block holds whole pieces. Words are 64-bit hashes, with their spelling
   once a block; hashes tell words and phrases apart.
2. For every further length the relation of the length before, restricted to frequent groups, is merge-joined
   with itself one position on, in the block: both the first and the last words of the new phrase are frequent. Its
   groups are counted in the block, then by Spark, and those with at least ``least`` occurrences are kept: no other
   phrase can be frequent, as no phrase occurs more often than its parts.
3. The restriction to frequent groups is a semi-join with a bit filter of fixed size (``SLOTS`` words of 64 bits,
   four bits a group), which is what tasks receive; it may let infrequent groups through, whose extensions
   then fail their own count. So results are exact at any fill, and only more is counted once the filter fills up.

A candidate's cuts are looked up in the counted groups of both parts. Products are decimals of 38 digits, exact while
no phrase occurs 10 ** 15 times.

Edge cases: a null or empty text has no pieces; a null language is ``und``; a language without candidates has no
rows. Repeated rows count each time. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfold.llm.blocks import Texts, Words, cut, lowered, mixed, release, word_hashes
from nearfold.session import staged

# --- fixed values: what ends a piece, what separates words, the name of no language --------
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
SPACES = b"\x20\x09"
NO_LANGUAGE = "und"
# -------------------------------------------------------------------------------------------

#: 64-bit words of the filter of frequent groups: 8 MB, whatever the input.
SLOTS = 1 << 20
#: Text of a block.
BLOCK_BYTES = 3 * 1024 * 1024
#: Groups that a task hands on at once.
HANDED_ON = 1 << 15

_END = np.isin(np.arange(256), list(ENDS))
_SEPARATOR = _END | np.isin(np.arange(256), list(SPACES))
_STEP = np.uint64(0x9E3779B97F4A7C15)

_BLOCK = "lang string, codes array<int>, sizes array<int>, words array<long>, spelled array<string>, times array<long>"


def group_hashes(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash per group of words of a language."""
    seed = np.frombuffer(lang.encode().ljust(-(-len(lang.encode()) // 8) * 8, b"\0"), dtype=np.uint64)
    start = reduce(lambda h, x: mixed(h * _STEP + x), seed.reshape(-1, 1), np.array([len(lang)], dtype=np.uint64))
    return reduce(lambda h, w: mixed(h * _STEP + w.astype(np.uint64)), words, start)


def _marks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filter word and the four bits in it of every group."""
    slot = (hashes >> np.uint64(40)) % np.uint64(SLOTS)
    bits = np.zeros(len(hashes), dtype=np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return slot.astype(np.int64), bits


def _passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot, bits = _marks(hashes)
    return (filter_[slot] & bits) == bits


def _word_columns(length: int) -> list[str]:
    return [f"w{i + 1}" for i in range(length)]


def occurrences(docs: DataFrame) -> DataFrame:
    """The relation of single words, a row per block and language.

    ``codes`` are the words in order, numbers into ``words`` and ``spelled``; ``sizes`` are the pieces' lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in cut(batches, limit=BLOCK_BYTES):
            langs = batch.column(1).fill_null(NO_LANGUAGE).dictionary_encode()
            lang = langs.indices.to_numpy()
            texts = Texts(batch.column(0))
            texts.data = lowered(texts.data)
            words = Words(texts, _SEPARATOR)
            if not len(words.starts):
                continue
            owner = np.repeat(np.arange(len(texts)), words.counts())
            ended = np.concatenate(([0], np.cumsum(_END[words.data], dtype=np.int32)))[words.starts]
            hashes = word_hashes(words)
            for code, name in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(lang[owner] == code)
                if not len(own):
                    continue
                new = (np.diff(owner[own], prepend=-1) != 0) | (np.diff(ended[own], prepend=-1) != 0)
                sizes = np.diff(np.append(np.flatnonzero(new), len(own)))
                distinct, first, codes, times = np.unique(hashes[own], return_index=True, return_inverse=True, return_counts=True)
                spelled = [words.data[words.starts[i] : words.ends[i]].tobytes().decode() for i in own[first]]
                columns = (codes.astype(np.int32), sizes.astype(np.int32), distinct.view(np.int64), pa.array(spelled, pa.string()), times)
                lists = [pa.ListArray.from_arrays(np.array([0, len(x)], dtype=np.int32), x if isinstance(x, pa.Array) else pa.array(x)) for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), *lists], [c.split()[0] for c in _BLOCK.split(", ")])

    return docs.select("text", "lang").mapInArrow(run, _BLOCK)


def _grown(key: np.ndarray, group: np.ndarray, words: list[np.ndarray], passes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Merge join of the frequent rows of a relation with themselves one position on.

    ``key`` is the sorted place of every row, ``group`` its group, ``words`` the groups' words. Also gives how
    often each new group occurs.
    """
    kept = passes[group]
    key, group = key[kept], group[kept]
    next_ = np.flatnonzero(key[1:] == key[:-1] + 1)  # places are unique, so a following one is the next row
    pair = group[next_] * len(passes) + group[next_ + 1]
    pairs, group, times = np.unique(pair, return_inverse=True, return_counts=True)
    first, second = np.divmod(pairs, len(passes))
    return key[next_], group, [*(w[first] for w in words), words[-1][second]], times


def _count_length(blocks: DataFrame, length: int, filters: list[np.ndarray], least: int) -> DataFrame:
    """Frequent groups of ``length`` words: (lang, w1, ..., n)."""
    columns = _word_columns(length)
    shared = blocks.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                codes, sizes, distinct = (batch.column(c)[i].values.to_numpy() for c in (1, 2, 3))
                piece = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
                position = np.arange(len(codes)) - np.repeat(np.cumsum(sizes, dtype=np.int64) - sizes, sizes)
                key, group, words, times = (piece << 32) + position, codes.astype(np.int64), [distinct], None
                for known in shared.value:
                    key, group, words, times = _grown(key, group, words, _passes(known, group_hashes(name, words)))
                del codes, sizes, distinct, piece, position, key, group
                for begin in range(0, len(times), HANDED_ON):
                    part = slice(begin, begin + HANDED_ON)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(name, pa.string()), len(times[part])), *(pa.array(w[part]) for w in words), pa.array(times[part])], ["lang", *columns, "n"]
                    )
                del words, times
                release()

    schema = ", ".join(["lang string", *(f"{c} long" for c in columns), "n long"])
    counted = blocks.select("lang", "codes", "sizes", "words").mapInArrow(run, schema)
    return counted.groupBy("lang", *columns).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _filter_of(groups: DataFrame, length: int) -> np.ndarray:
    """The bit filter of a table of groups."""
    columns = _word_columns(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            words = [batch.column(1 + i).to_numpy() for i in range(length)]
            for code, name in enumerate(langs.dictionary.to_pylist()):
                own = langs.indices.to_numpy() == code
                slot, bits = _marks(group_hashes(name, [w[own] for w in words]))
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits.view(np.int64))], ["slot", "bits"])

    marks = groups.select("lang", *columns).mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    table = marks.toArrow()  # at most SLOTS rows of two numbers
    out = np.zeros(SLOTS, dtype=np.uint64)
    out[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = [c.cast("decimal(15,0)") for c in (a, left, right)]
    square = (wide[0] * wide[0]).cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", square.cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(38,0)"))


def _with_parts(length: int, frequent: list[DataFrame]) -> DataFrame:
    """Groups of ``length`` words with phrase, l, r and score of their weakest cut."""
    columns = _word_columns(length)
    out = frequent[length - 1]
    cuts = []
    for k in range(1, length):
        for side, chosen in (("l", columns[:k]), ("r", columns[k:])):
            part = frequent[len(chosen) - 1]
            names = _word_columns(len(chosen))
            looked = part.select("lang", *(F.col(n).alias(c) for n, c in zip(names, chosen, strict=True)), F.col("n").alias(f"{side}{k}"), F.col("phrase").alias(f"{side}{k}_phrase"))
            out = out.join(looked, ["lang", *chosen])
        cuts.append(F.struct(_score(F.col("n"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    weakest = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    phrase = F.concat_ws(" ", "l1_phrase", "r1_phrase")
    return out.select("lang", *columns, "n", phrase.alias("phrase"), weakest.alias("cut")).select("lang", *columns, "n", "phrase", "cut.score", "cut.l", "cut.r")


def _absorbed(length: int, frequent: list[DataFrame], percent: int) -> DataFrame:
    """Groups of ``length`` words with so large a share of occurrences inside one longer candidate."""
    columns = _word_columns(length)
    inside = []
    for longer in range(length + 1, len(frequent) + 1):
        words = _word_columns(longer)
        parts = [F.struct(*(F.col(words[i + j]).alias(c) for j, c in enumerate(columns))) for i in range(longer - length + 1)]
        inside.append(frequent[longer - 1].select("lang", F.col("n").alias("m"), F.explode(F.array(*parts)).alias("part")).select("lang", "part.*", "m"))
    most = reduce(DataFrame.unionByName, inside).groupBy("lang", *columns).agg(F.max("m").alias("m"))
    return frequent[length - 1].join(most, ["lang", *columns]).where(100 * F.col("m") >= percent * F.col("n")).select("lang", *columns)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words per language.

    A phrase of ``a >= least`` occurrences is scored by its weakest cut, a * a / (l * r) in millionths, and
    left out when one longer candidate around it has ``percent`` of its occurrences.
    """
    if longest < 2:
        raise ValueError("a phrase has at least two words")
    blocks = staged(occurrences(docs), "occurrences")
    words = blocks.select("lang", F.explode(F.arrays_zip("words", "spelled", "times")).alias("x"))
    counted = words.groupBy("lang", F.col("x.words").alias("w1"), F.col("x.spelled").alias("phrase")).agg(F.sum("x.times").alias("n"))
    frequent = [staged(counted.where(F.col("n") >= least), "frequent")]
    filters: list[np.ndarray] = []
    ranked = []
    for length in range(2, longest + 1):
        filters.append(_filter_of(frequent[-1], length - 1))
        groups = staged(_count_length(blocks, length, filters, least), "groups")
        frequent.append(groups)
        frequent[-1] = staged(_with_parts(length, frequent), "frequent")
    for length in range(2, longest + 1):
        found = frequent[length - 1]
        if length < longest:
            found = found.join(_absorbed(length, frequent, percent), ["lang", *_word_columns(length)], "left_anti")
        ranked.append(found.select("lang", "phrase", F.col("n").alias("a"), "l", "r", "score"))
    totals = blocks.groupBy("lang").agg(F.sum(F.size("codes")).alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = reduce(DataFrame.unionByName, ranked).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
