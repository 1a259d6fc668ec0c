"""Sub-word vocabulary, encoding, overlapping chunks and masked examples."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold import session
from nearfold.functions.text import BASE_SPECIALS, accent_table, fold_text, words
from nearfold.operators.longest_match import Matcher
from nearfold.operators.pair_index import best_merges

# --- fixed values: piece marker, longest word, ignored label, draw shares ------
CONTINUES = "##"
LONGEST_WORD = 100
IGNORED = -100
MASK_SHARE, RANDOM_SHARE = 0.8, 0.1
#: Words that a task matches at once, and those whose pieces it remembers.
WORDS_AT_ONCE, REMEMBERED = 1 << 18, 1 << 16
# -------------------------------------------------------------------------------


def word_frequency(
    docs: DataFrame,
    specials: Sequence[str] = (),
    min_count: int = 1,
    lowercase: bool = False,
    accents: bool = False,
) -> DataFrame:
    """(word, n) over the whole corpus; counted map-side, so frequent words stay cheap.

    Folding happens on the distinct words and leaves special tokens alone.
    """
    atoms = tuple(specials)
    exploded = docs.select(F.explode(words(F.col("text"), atoms)).alias("word"))
    counts = exploded.groupBy("word").agg(F.count("*").alias("n"))
    if lowercase or accents:
        folded = fold_text(F.col("word"), lowercase, accents)
        counts = counts.withColumn("word", F.when(F.col("word").isin(*atoms), F.col("word")).otherwise(folded))
        counts = counts.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= min_count)


def train_vocabulary(
    counts: DataFrame,
    vocab_size: int,
    min_frequency: int = 2,
    specials: Sequence[str] = BASE_SPECIALS,
) -> DataFrame:
    """(id, token): specials, then every letter alone and as a continuation, then merges.

    ``counts`` is (word, n). Each round takes as many of the best pairs as can be
    merged together without changing the outcome and reads only words that hold one
    of them (see ``pair_index``). Ties go to the pair that sorts first. Only the
    ranked head of the pair list reaches the driver.
    """
    if vocab_size <= 0 or min_frequency <= 0:
        raise ValueError("vocab_size and min_frequency must be positive")
    spark = counts.sparkSession
    plain = counts.filter(~F.col("word").isin(*specials))
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    pieces = F.transform(letters, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(CONTINUES), c)))
    # Pieces are held as " t ##h ##e ": a piece never holds a space.
    # Few bytes but much work per word, hence at least one partition per core.
    spread = plain.repartition(spark.sparkContext.defaultParallelism)
    table = session.staged(
        spread.select(F.concat(F.lit(" "), F.array_join(pieces, " "), F.lit(" ")).alias("pieces"), "n"), "words"
    )
    split = F.filter(F.split("pieces", " "), lambda p: p != "")
    # One letter each so far: as many as the corpus has distinct characters.
    first = [r[0] for r in table.select(F.explode(split).alias("p")).distinct().orderBy("p").collect()]
    continued = [p for p in first if p.startswith(CONTINUES) and len(p) > len(CONTINUES)]
    single = sorted({p for p in first if p not in continued} | {p[len(CONTINUES) :] for p in continued})
    tokens = list(dict.fromkeys([*specials, *single, *continued]))
    merged = best_merges(table, vocab_size - len(tokens), min_frequency, set(tokens), CONTINUES)
    return vocabulary_table(spark, [*tokens, *merged])


def vocabulary_table(spark: SparkSession, tokens: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(tokens)), "id INT, token STRING")


def word_folder(lowercase: bool, accents: bool) -> Callable[[str], str]:
    """``fold_text`` for single words inside a task."""
    table = str.maketrans(*accent_table()) if accents else {}

    def fold(word: str) -> str:
        if accents:
            word = "".join(c for c in word.translate(table) if unicodedata.category(c) != "Mn")
        return word.lower() if lowercase else word

    return fold


def encode(
    docs: DataFrame,
    vocab: DataFrame,
    specials: Sequence[str] = BASE_SPECIALS,
    unknown: str = "[UNK]",
    lowercase: bool = True,
    accents: bool = True,
    longest_word: int | None = LONGEST_WORD,
) -> DataFrame:
    """Add ``input_ids`` to (doc_id, text): pieces of every word in order.

    A word of more than ``longest_word`` letters is unknown as a whole; None sets no limit.
    The vocabulary is broadcast: it does not grow with the corpus but has the size it was
    trained to (``vocab_size``). Words are matched once per task and batch, whatever their count,
    and no token is ever shuffled.
    """
    ids = {r["token"]: r["id"] for r in vocab.select("token", "id").toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast((ids, CONTINUES, unknown))
    atoms = tuple(specials)
    atomic = set(atoms)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    prepared = docs.select(*[f.name for f in kept], words(F.col("text"), atoms).alias("words"))
    fold = word_folder(lowercase, accents)
    schema = T.StructType(kept + [T.StructField("input_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, continues, unknown = shared.value
        matcher, unk = Matcher(table, continues), [table[unknown]]
        memo: dict[str, list[int]] = {}

        def match(word: str) -> list[int]:
            if word in atomic:
                return [table.get(word, unk[0])]
            folded = fold(word)
            too_long = longest_word is not None and len(folded) > longest_word
            return unk if too_long else matcher.split(folded) or ([] if not folded else unk)

        for batch in (part for whole in batches for part in _slices(whole, WORDS_AT_ONCE)):
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten().dictionary_encode()
            matched = []
            for word in flat.dictionary.to_pylist():
                pieces = memo.get(word)
                if pieces is None:
                    if len(memo) >= REMEMBERED:
                        memo.clear()
                    pieces = memo[word] = match(word)
                matched.append(pieces)
            lengths = np.array([len(m) for m in matched] + [0], dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            pool = np.array([i for m in matched for i in m] or [0], dtype=np.int32)
            codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = lengths[codes]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            where = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) + np.repeat(starts[codes], sizes)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out = pa.ListArray.from_arrays(ends[bounds].astype(np.int32), pa.array(pool[where]))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays + [out], names=[f.name for f in kept] + ["input_ids"])

    return prepared.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in order, with at most so many entries in the lists of the last column, or one row at a time."""
    at = batch.column(batch.num_columns - 1).offsets.to_numpy()
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def chunk_tokens(
    encoded: DataFrame,
    max_length: int,
    stride: int,
    cls_id: int,
    sep_id: int,
    special_ids: Sequence[int],
    id_col: str = "doc_id",
) -> DataFrame:
    """(id, chunk_no, input_ids, attention_mask, special_tokens_mask).

    Content windows of ``max_length - 2`` ids overlap by ``stride`` and are
    closed in begin and end markers; a text without tokens gives one such empty
    window. All of it happens inside the row.
    """
    width = max_length - 2
    if not 0 <= stride < width:
        raise ValueError("stride must be at least 0 and below max_length - 2")
    ids = F.col("input_ids")
    last = F.greatest(F.size(ids) - stride - 1, F.lit(0))
    windows = F.transform(
        F.sequence(F.lit(0), last, F.lit(width - stride)),
        lambda start: F.concat(F.array(F.lit(cls_id)), F.slice(ids, start + 1, F.lit(width)), F.array(F.lit(sep_id))),
    )
    chunks = encoded.select(id_col, F.posexplode(windows).alias("chunk_no", "input_ids"))
    return chunks.select(
        id_col,
        "chunk_no",
        "input_ids",
        F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"),
        F.transform("input_ids", lambda i: i.isin(*special_ids).cast("int")).alias("special_tokens_mask"),
    )


def mlm_examples(
    chunks: DataFrame,
    probability: float,
    seed: int,
    mask_id: int,
    vocab_size: int,
    id_col: str = "doc_id",
) -> DataFrame:
    """Add ``masked_ids`` and ``labels``: a seeded hash per token decides.

    Chosen tokens carry their id as label, all others -100; of the chosen, 80 %
    become the mask, 10 % a hashed id, the rest stay. Every token has a digest of its own, of
    which three draws of seven digits are taken: whether, what kind, which other id.
    """
    place = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("chunk_no").cast("string"))

    def masked(ids: pa.Array, special: pa.Array, place: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        at = np.concatenate(([0], np.cumsum(sizes)))
        flat, free = ids.flatten(), pc.fill_null(pc.equal(special.flatten(), 0), False).to_numpy(zero_copy_only=False)
        draws = token_draws(place.to_pylist(), sizes.tolist())
        chosen = free & (draws[:, 0] / DRAWS < probability)
        kind, other = draws[chosen, 1] / DRAWS, draws[chosen, 2] % vocab_size
        own = flat.filter(pa.array(chosen)).to_numpy()
        new = np.where(kind < MASK_SHARE, mask_id, np.where(kind < MASK_SHARE + RANDOM_SHARE, other, own))
        shown = pc.replace_with_mask(flat, pa.array(chosen), pa.array(new, pa.int32()))
        labels = np.full(len(flat), IGNORED, dtype=np.int32)
        labels[chosen] = own
        unknown = ids.is_null()
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), values, mask=unknown) for values in (shown, pa.array(labels))]
        return pa.StructArray.from_arrays(lists, ["masked_ids", "labels"])

    examples = F.arrow_udf(masked, "masked_ids array<int>, labels array<int>")(F.col("input_ids"), F.col("special_tokens_mask"), place)
    return chunks.withColumn("drawn", examples).withColumns({c: F.col("drawn")[c] for c in ("masked_ids", "labels")}).drop("drawn")


#: Seven hexadecimal digits.
DRAWS = 16**7


def token_draws(places: list[str], sizes: list[int]) -> np.ndarray:
    """Three draws below ``DRAWS`` for every token, from the digest of ``place:number``: its digits 1-7, 8-14 and 15-21."""
    numbers = [b":%d" % i for i in range(max(sizes, default=0))]
    digests = []
    for place, size in zip(places, sizes, strict=True):
        start = place.encode()
        digests += [hashlib.md5(start + number).digest() for number in numbers[:size]]
    d = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
    word = lambda first: np.ascontiguousarray(d[:, first : first + 4]).view(">u4")[:, 0].astype(np.int64)
    return np.stack((word(0) >> 4, word(3) & (DRAWS - 1), word(7) >> 4), axis=1)
