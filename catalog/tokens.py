"""Words, vocabulary, encoding, chunks, masked examples and document vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import documents, query
from nearfold.functions.text import BASE_SPECIALS, CONTROL, word_pattern, words
from nearfold.functions.vectors import all_finite
from nearfold.operators.tokens import chunk_tokens, encode, mlm_examples, train_vocabulary, vocabulary_table, word_frequency
from nearfold.plans.embedding import embed_documents
from nearfold.session import staged

MAX_LENGTH, STRIDE = 128, 32
CLS, SEP, MASK = (BASE_SPECIALS.index(t) for t in ("[CLS]", "[SEP]", "[MASK]"))
SPECIAL_IDS = list(range(len(BASE_SPECIALS)))
HASHED_IDS = 30_000

WORDS_SQL = f"regexp_extract_all(regexp_replace(text, '{CONTROL}', '', 'g'), '{word_pattern()}', 1)"


def hashed_ids(text: Column) -> Column:
    """Token ids by hash, for jobs whose result must not depend on a trained vocabulary."""
    return F.transform(
        words(text), lambda w: F.lit(5) + F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % HASHED_IDS
    )


TOKENS_SQL = f"""WITH ids AS (
  SELECT doc_id, list_transform({WORDS_SQL}, lambda w: 5 + CAST(('0x' || substr(md5(w), 1, 4)) AS INT) % {HASHED_IDS}) AS ids FROM documents
), starts AS (
  SELECT doc_id, ids, unnest(generate_series(0, greatest(len(ids) - {STRIDE} - 1, 0), {MAX_LENGTH - 2 - STRIDE})) AS s FROM ids
), chunks AS (
  SELECT doc_id, CAST(s // {MAX_LENGTH - 2 - STRIDE} AS INT) AS chunk_no,
    list_concat([{CLS}], ids[s + 1 : s + {MAX_LENGTH - 2}], [{SEP}]) AS input_ids,
    len(ids[s + 1 : s + {MAX_LENGTH - 2}]) + 2 AS n FROM starts
)"""


def _joined(c: str | Column) -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, " ")


@query("word_frequency", f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS w FROM documents) GROUP BY w HAVING count(*) >= 3")
def word_frequency_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_frequency(documents(spark, sf_dir), min_count=3)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", hashed_ids(F.col("text")).alias("input_ids"))
    return chunk_tokens(docs, MAX_LENGTH, STRIDE, CLS, SEP, SPECIAL_IDS)


@query(
    "chunk_tokens",
    TOKENS_SQL + """
SELECT doc_id, chunk_no, array_to_string(input_ids, ' ') AS input_ids,
  rtrim(repeat('1 ', n)) AS attention_mask, '1 ' || repeat('0 ', n - 2) || '1' AS special_tokens_mask FROM chunks""",
)
def chunk_tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select(
        "doc_id", "chunk_no", *[_joined(c).alias(c) for c in ("input_ids", "attention_mask", "special_tokens_mask")]
    )


@query(
    "mlm_examples",
    TOKENS_SQL + f""", drawn AS (
  SELECT doc_id, chunk_no, list_transform(input_ids, lambda x, i: {{'id': x, 'm': md5('42:' || doc_id || ':' || chunk_no || ':' || (i - 1))}}) AS d
  FROM chunks
), chosen AS (
  SELECT doc_id, chunk_no, list_transform(d, lambda t: {{'id': t.id,
    'chosen': t.id > 4 AND CAST(('0x' || substr(t.m, 1, 7)) AS INT) / 268435456.0::DOUBLE < 0.15::DOUBLE,
    'kind': CAST(('0x' || substr(t.m, 8, 7)) AS INT) / 268435456.0::DOUBLE, 'other': CAST(('0x' || substr(t.m, 15, 7)) AS INT) % {HASHED_IDS}}}) AS d
  FROM drawn
)
SELECT doc_id, chunk_no,
  array_to_string(list_transform(d, lambda t: CASE WHEN NOT t.chosen THEN t.id WHEN t.kind < 0.8::DOUBLE THEN {MASK}
    WHEN t.kind < 0.8::DOUBLE + 0.1::DOUBLE THEN t.other ELSE t.id END), ' ') AS masked_ids,
  array_to_string(list_transform(d, lambda t: CASE WHEN t.chosen THEN t.id ELSE -100 END), ' ') AS labels
FROM chosen""",
)
def mlm_examples_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = mlm_examples(_chunks(spark, sf_dir), 0.15, 42, MASK, HASHED_IDS)
    return examples.select("doc_id", "chunk_no", _joined("masked_ids").alias("masked_ids"), _joined("labels").alias("labels"))


VOCAB_SIZE = 300


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_frequency(documents(spark, sf_dir), BASE_SPECIALS, lowercase=True, accents=True)
    return staged(train_vocabulary(counts, VOCAB_SIZE), "vocabulary")


# --- encoding with a vocabulary that SQL can build too: letters and frequent words --

#: A word is frequent when it makes up at least one in this many, so there are at most that many.
FREQUENT_SHARE = 10_000
BUCKETS = 64


def _frequent_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = staged(
        word_frequency(documents(spark, sf_dir), BASE_SPECIALS, lowercase=True, accents=True)
        .filter(~F.col("word").isin(*BASE_SPECIALS)),
        "counts",
    )
    total = counts.agg(F.sum("n")).head()[0]
    letters = {r[0] for r in counts.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()}
    frequent = {r[0] for r in counts.filter(F.col("n") * FREQUENT_SHARE >= total).select("word").collect()}
    return vocabulary_table(
        spark, [*BASE_SPECIALS, *sorted(letters), *sorted("##" + c for c in letters), *sorted(frequent - letters)]
    )


ENCODE_SQL = f"""WITH RECURSIVE raw AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(text, '{CONTROL}', '', 'g'), '{word_pattern(BASE_SPECIALS)}', 1) AS ws FROM documents
), spoken AS (
  SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS raw FROM raw
), tokens AS (
  SELECT doc_id, i, CASE WHEN raw IN {BASE_SPECIALS!r} THEN raw ELSE lower(strip_accents(raw)) END AS w FROM spoken
), counts AS (
  SELECT w, count(*) AS n FROM tokens WHERE w <> '' AND w NOT IN {BASE_SPECIALS!r} GROUP BY w
), letters AS (
  SELECT DISTINCT unnest(string_split(w, '')) AS c FROM counts
), frequent AS (
  SELECT w FROM counts WHERE n * {FREQUENT_SHARE} >= (SELECT sum(n) FROM counts) AND w NOT IN (SELECT c FROM letters)
), listed AS (
  SELECT unnest([0, 1, 2, 3, 4]) AS id, unnest({list(BASE_SPECIALS)!r}) AS token
  UNION ALL SELECT 4 + row_number() OVER (ORDER BY kind, token), token FROM (
    SELECT 1 AS kind, c AS token FROM letters UNION ALL SELECT 2, '##' || c FROM letters UNION ALL SELECT 3, w FROM frequent)
), vocab AS (
  SELECT CAST(id AS INT) AS id, token FROM listed
), spans AS (
  SELECT w, s, s + l AS e, substr(w, s + 1, l) AS part FROM (
    SELECT w, s, unnest(range(1, length(w) - s + 1)) AS l FROM (SELECT w, unnest(range(0, length(w))) AS s FROM counts WHERE length(w) <= 100))
), longest AS (
  SELECT w, s, max(e) AS e, arg_max(v.id, e) AS id FROM spans JOIN vocab v ON v.token = CASE WHEN s = 0 THEN part ELSE '##' || part END GROUP BY w, s
), walk AS (
  SELECT w, CAST(0 AS BIGINT) AS done, CAST([] AS INT[]) AS ids FROM counts WHERE length(w) <= 100
  UNION ALL SELECT k.w, CAST(l.e AS BIGINT), list_append(k.ids, l.id) FROM walk k JOIN longest l ON l.w = k.w AND l.s = k.done
), pieces AS (
  SELECT c.w, coalesce(k.ids, [1]) AS ids FROM counts c LEFT JOIN (SELECT w, ids FROM walk WHERE done = length(w)) k ON k.w = c.w
  UNION ALL SELECT token, [id] FROM vocab WHERE token IN {BASE_SPECIALS!r}
), encoded AS (
  SELECT r.doc_id, coalesce(flatten(list(p.ids ORDER BY t.i) FILTER (WHERE p.ids IS NOT NULL)), CAST([] AS INT[])) AS ids
  FROM raw r LEFT JOIN tokens t ON t.doc_id = r.doc_id LEFT JOIN pieces p ON p.w = t.w GROUP BY r.doc_id
)"""


#: One merge per step, over all words; a few more steps than pieces, as a merge may make a known piece.
VOCAB_SQL = ENCODE_SQL[: ENCODE_SQL.index("), letters AS (")] + f"""), single AS (
  SELECT DISTINCT unnest(string_split(w, '')) AS c FROM counts
), later AS (
  SELECT DISTINCT unnest(string_split(w[2:], '')) AS c FROM counts WHERE length(w) > 1
), room AS (
  SELECT {VOCAB_SIZE - len(BASE_SPECIALS)} - (SELECT count(*) FROM single) - (SELECT count(*) FROM later) AS n
), train AS (
  SELECT 0 AS step, ' ' || array_to_string(list_transform(string_split(w, ''), lambda c, i: CASE WHEN i = 1 THEN c ELSE '##' || c END), '  ') || ' ' AS p,
    n, CAST(NULL AS VARCHAR) AS made FROM counts
  UNION ALL
  SELECT t.step + 1, replace(t.p, ' ' || b.l || '  ' || b.r || ' ', ' ' || b.l || b.r[3:] || ' '), t.n, b.l || b.r[3:]
  FROM train t, (
    SELECT s[i] AS l, s[i + 1] AS r FROM (
      SELECT s, n, unnest(range(1, len(s))) AS i FROM (SELECT string_split(trim(p), '  ') AS s, n FROM train))
    GROUP BY l, r HAVING sum(n) >= 2 ORDER BY sum(n) DESC, l, r LIMIT 1) b
  WHERE t.step < (SELECT n FROM room) + 10
), merged AS (
  SELECT made AS token, min(step) AS step FROM train WHERE step > 0 GROUP BY made
), listed AS (
  SELECT 0 AS kind, unnest([0, 1, 2, 3, 4]) AS step, unnest({list(BASE_SPECIALS)!r}) AS token
  UNION ALL SELECT 1, 0, c FROM single UNION ALL SELECT 2, 0, '##' || c FROM later
  UNION ALL SELECT 3, step, token FROM merged WHERE token NOT IN (SELECT c FROM single)
)"""


@query(
    "wordpiece_vocab",
    VOCAB_SQL + f"""
SELECT CAST(row_number() OVER (ORDER BY kind, step, token) - 1 AS INT) AS id, token FROM listed QUALIFY id < {VOCAB_SIZE}""",
)
def wordpiece_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir)


@query("wordpiece_encode", ENCODE_SQL + "\nSELECT doc_id, CAST(len(ids) AS INT) AS n_pieces, array_to_string(ids, ' ') AS input_ids FROM encoded")
def wordpiece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(documents(spark, sf_dir), _frequent_vocabulary(spark, sf_dir))
    return encoded.select("doc_id", F.size("input_ids").alias("n_pieces"), _joined("input_ids").alias("input_ids"))


def _bucket_embedder(chunks: DataFrame) -> DataFrame:
    """A user-made embedder: token ids counted per remainder, in one pass over the ids of a batch."""

    def counted(ids: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        cells = np.repeat(np.arange(len(ids)) * BUCKETS, sizes) + ids.flatten().to_numpy() % BUCKETS
        counts = np.bincount(cells, minlength=len(ids) * BUCKETS).astype(np.float64)
        at = pa.array(np.arange(len(ids) + 1) * BUCKETS, pa.int32())
        return pa.ListArray.from_arrays(at, pa.array(counts), mask=ids.is_null())

    counts = F.arrow_udf(counted, "array<double>")("input_ids")
    return chunks.select("doc_id", "chunk_no", counts.alias("vec"), F.size("input_ids").alias("n_tokens"))


@query(
    "embed_documents_hook",
    ENCODE_SQL + f""", starts AS (
  SELECT doc_id, ids, unnest(generate_series(0, greatest(len(ids) - {STRIDE} - 1, 0), {MAX_LENGTH - 2 - STRIDE})) AS s FROM encoded
), chunks AS (
  SELECT doc_id, s, list_concat([{CLS}], ids[s + 1 : s + {MAX_LENGTH - 2}], [{SEP}]) AS ids FROM starts
), sums AS (
  SELECT doc_id, id % {BUCKETS} AS pos, CAST(sum(n) AS DOUBLE) AS x FROM (SELECT doc_id, len(ids) AS n, unnest(ids) AS id FROM chunks) GROUP BY 1, 2
), norms AS (
  SELECT doc_id, sqrt(sum(x * x)) AS norm FROM sums GROUP BY doc_id
)
SELECT s.doc_id, CAST(s.pos AS INT) AS pos, round(s.x / n.norm, 6) AS value FROM sums s JOIN norms n ON n.doc_id = s.doc_id""",
)
def embed_documents_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding job around an embedder of the user's own."""
    vectors = embed_documents(
        documents(spark, sf_dir), _frequent_vocabulary(spark, sf_dir), _bucket_embedder, MAX_LENGTH, STRIDE,
        preprocess=False, specials=BASE_SPECIALS,
    )
    long = vectors.select("doc_id", F.posexplode("embedding").alias("pos", "value")).filter("value <> 0")
    return long.withColumn("value", F.round("value", 6))


@query(
    "embed_documents",
    """SELECT doc_id, CAST(256 AS INT) AS n_dimensions, 1.0::DOUBLE AS norm, true AS all_finite FROM documents""",
)
def embed_documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job with the built-in embedder: what SQL can say of every document's vector, whatever its values."""
    docs = documents(spark, sf_dir)
    found = embed_documents(docs, _vocabulary(spark, sf_dir), max_length=MAX_LENGTH, stride=STRIDE)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return found.select("doc_id", F.size("embedding").alias("n_dimensions"), F.round(F.sqrt(square), 6).alias("norm"), all_finite(F.col("embedding")).alias("all_finite"))
