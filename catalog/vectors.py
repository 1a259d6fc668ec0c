"""Vector hygiene, pooling of hidden states and weighted loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, table
from nearfold.functions.columns import canonical_id, to_flag, to_number
from nearfold.functions.vectors import as_doubles, l2_normalize, vector_from_json
from nearfold.operators import pooling
from nearfold.operators.quality import dedupe_last, filter_id_range, mark_rejects, reject_report
from nearfold.sources.readers import read_vectors
from nearfold.sources.writers import write_vectors
from nearfold.session import scratch_path


def _long(df: DataFrame, *keys: str, vec: str = "embedding") -> DataFrame:
    return df.select(*keys, F.posexplode(as_doubles(F.col(vec))).alias("pos", "value")).withColumn("value", F.round("value", 6))


LONG_SQL = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT CAST(vec_id AS VARCHAR) AS id, CAST(generate_subscripts(e, 1) - 1 AS INT) AS pos, round(unnest(e), 6) AS value FROM v"""


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")


@query("load_embeddings", LONG_SQL)
def load_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as CSV with JSON text and read back."""
    path = scratch_path(spark, "vectors-csv")
    write_vectors(_embeddings(spark, sf_dir), path)
    return _long(read_vectors(spark, path), "id")


@query("embedding_roundtrip", LONG_SQL)
def embedding_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through Parquet arrays."""
    path = scratch_path(spark, "vectors-parquet")
    write_vectors(_embeddings(spark, sf_dir), path, fmt="parquet")
    return _long(read_vectors(spark, path, fmt="parquet"), "id")


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as text; those with a large entry near the front are damaged in one way each."""
    e = F.col("e")
    text = (
        F.when(e[0] > 0.2, F.to_json(F.slice(e, F.lit(1), F.size(e) - 1)))
        .when(e[1] > 0.2, "[]")
        .when(e[2] > 0.2, "nope")
        .when(e[3] > 0.2, "[1.0, NaN]")
        .when(e[4] > 0.2, "[1.0, null]")
        .when(e[5] > 0.2, "[[1.0, 2.0]]")
        .otherwise(F.to_json(e))
    )
    v = table(spark, sf_dir, "embeddings").select("vec_id", as_doubles(F.col("embedding")).alias("e"))
    blank = F.when(e[6] > 0.2, F.lit("  ")).otherwise(F.concat(F.col("vec_id").cast("string"), F.lit(".0")))
    return v.select("vec_id", blank.alias("id"), vector_from_json(text).alias("embedding"))


REJECTS_SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), m AS (
  SELECT vec_id, CASE WHEN e[7] <= 0.2::DOUBLE THEN CAST(vec_id AS VARCHAR) END AS id,
    CASE WHEN e[1] > 0.2::DOUBLE THEN CASE WHEN e[7] > 0.2::DOUBLE THEN 'missing id' ELSE 'wrong dimension' END
         WHEN e[2] > 0.2::DOUBLE THEN 'empty vector' WHEN e[3] > 0.2::DOUBLE THEN 'not a vector'
         WHEN e[4] > 0.2::DOUBLE THEN 'non-finite value' WHEN e[5] > 0.2::DOUBLE THEN 'non-finite value'
         WHEN e[6] > 0.2::DOUBLE THEN 'not a vector' WHEN e[7] > 0.2::DOUBLE THEN 'missing id' END AS reject_reason
  FROM v)"""


@query("validate_vectors", REJECTS_SQL + "\nSELECT vec_id, id, reject_reason FROM m")
def validate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_rejects(_damaged(spark, sf_dir)).select("vec_id", "id", "reject_reason")


@query(
    "reject_report",
    REJECTS_SQL + "\nSELECT coalesce(reject_reason, 'valid') AS outcome, count(*) AS n_rows FROM m GROUP BY 1",
)
def reject_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_report(mark_rejects(_damaged(spark, sf_dir)))


@query(
    "normalize_id",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN o_orderpriority
  ELSE CAST(o_custkey AS VARCHAR) END AS id FROM orders""",
)
def normalize_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids spelled as decimals, with spaces, or as text."""
    key = F.col("o_custkey").cast("string")
    raw = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("  "), key, F.lit(".0")))
        .when(F.col("o_orderstatus") == "O", F.concat(key, F.lit(" ")))
        .otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("\t")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", canonical_id(raw).alias("id"))


@query("id_range_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 100 AND 700")
def id_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return filter_id_range(orders, 100, 700, "o_custkey")


@query(
    "coerce_numeric",
    """SELECT event_id, CASE event_type WHEN 'purchase' THEN round(value, 6) WHEN 'click' THEN round(value, 6)
  WHEN 'view' THEN CAST(user_id AS DOUBLE) END AS number FROM events""",
)
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text among blanks, words, NaN and numbers with a type suffix."""
    kind, value = F.col("event_type"), F.col("value").cast("string")
    raw = (
        F.when(kind == "purchase", F.concat(F.lit("  "), value, F.lit(" ")))
        .when(kind == "click", value)
        .when(kind == "view", F.concat(F.lit("+"), F.col("user_id").cast("string"), F.lit("e0")))
        .when(kind == "signup", "NaN")
        .otherwise(F.concat(F.col("user_id").cast("string"), F.lit("d")))
    )
    return table(spark, sf_dir, "events").select("event_id", F.round(to_number(raw), 6).alias("number"))


@query(
    "coerce_bool",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN true
  WHEN '3-MEDIUM' THEN false WHEN '4-NOT SPECIFIED' THEN false END AS flag FROM orders""",
)
def coerce_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.create_map(
        *[F.lit(x) for pair in {
            "1-URGENT": "Yes", "2-HIGH": " T ", "3-MEDIUM": "0", "4-NOT SPECIFIED": "FALSE", "5-LOW": "maybe"
        }.items() for x in pair]
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", to_flag(spelled[F.col("o_orderpriority")]).alias("flag"))


@query(
    "dedupe_last",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem)
WHERE rn = 1""",
)
def dedupe_last_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    return dedupe_last(lines, ["l_partkey"], ["l_shipdate"]).drop("l_shipdate")


@query(
    "l2_normalize",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), l AS (
  SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), n AS (
  SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS norm FROM l GROUP BY vec_id)
SELECT l.vec_id, CAST(l.i - 1 AS INT) AS pos, round(l.x / n.norm, 6) AS value FROM l JOIN n ON n.vec_id = l.vec_id""",
)
def l2_normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return _long(v.withColumn("embedding", l2_normalize(as_doubles(F.col("embedding")))), "vec_id")


# --- hidden states: each vector is read as 4 layers x 4 tokens x 4 dimensions ----


def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_no, layer, pos, vec, mask): a label is a document, its vectors are chunks."""
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", as_doubles(F.col("embedding")).alias("e"))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.struct(
            F.floor(i / 4).cast("int").alias("layer"), (i % 4).cast("int").alias("pos"), F.slice("e", i * 4 + 1, 4).alias("vec")
        ),
    )
    mask = F.when((F.col("c.pos") == 3) & (F.get("e", 0) < 0), 0).otherwise(1)
    return v.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_no"), "e", F.explode(cells).alias("c")).select(
        "doc_id", "chunk_no", "c.layer", "c.pos", "c.vec", mask.alias("mask")
    )


HIDDEN_SQL = """WITH h AS (
  SELECT label AS doc_id, vec_id AS chunk_no, CAST((i - 1) // 16 AS INT) AS layer, CAST((i - 1) // 4 % 4 AS INT) AS pos,
    CAST((i - 1) % 4 AS INT) AS dim, x, CASE WHEN (i - 1) // 4 % 4 = 3 AND e1 < 0 THEN 0 ELSE 1 END AS mask
  FROM (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS e1, unnest(CAST(embedding AS DOUBLE[])) AS x,
               generate_subscripts(embedding, 1) AS i FROM embeddings)
), mixed AS (
  SELECT doc_id, chunk_no, pos, dim, sum(x * (layer - 0)) / sum(layer - 0) AS x, max(mask) AS mask
  FROM h WHERE layer >= 1 GROUP BY doc_id, chunk_no, pos, dim
), pooled AS (
  SELECT doc_id, chunk_no, dim, sum(x * mask) / greatest(sum(mask), 1) AS x, greatest(sum(mask), 1) AS n_tokens
  FROM mixed GROUP BY doc_id, chunk_no, dim
), combined AS (
  SELECT doc_id, dim, sum(x * n_tokens) / sum(n_tokens) AS x FROM pooled GROUP BY doc_id, dim
)"""


@query(
    "mix_layers",
    HIDDEN_SQL + "\nSELECT doc_id, chunk_no, pos, dim, round(x, 6) AS value, mask FROM mixed",
)
def mix_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last three layers, later ones weighing more."""
    mixed = pooling.mix_layers(hidden_states(spark, sf_dir), "last_n_weighted", 3)
    return mixed.select("doc_id", "chunk_no", "pos", "mask", F.posexplode("vec").alias("dim", "value")).withColumn(
        "value", F.round("value", 6)
    )


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.pool_tokens(pooling.mix_layers(hidden_states(spark, sf_dir), "last_n_weighted", 3))


@query(
    "pool_tokens",
    HIDDEN_SQL + "\nSELECT doc_id, chunk_no, dim, round(x, 6) AS value, CAST(n_tokens AS BIGINT) AS n_tokens FROM pooled",
)
def pool_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _pooled(spark, sf_dir)
        .select("doc_id", "chunk_no", "n_tokens", F.posexplode("vec").alias("dim", "value"))
        .withColumn("value", F.round("value", 6))
    )


@query("combine_chunks", HIDDEN_SQL + "\nSELECT doc_id, dim, round(x, 6) AS value FROM combined")
def combine_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of a label in one weighted mean; a label may hold most of the table."""
    merged = pooling.combine_chunks(_pooled(spark, sf_dir), "token_count")
    return merged.select("doc_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(
    "weighted_perplexity",
    """WITH b AS (SELECT value / 10 AS loss, CAST(json_extract(props, '$.k') AS INT) AS n FROM events), t AS (
  SELECT sum(loss * n) / sum(n) AS loss FROM b WHERE n > 0)
SELECT round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity FROM t""",
)
def weighted_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a batch: its value gives the loss, its property the masked tokens."""
    batches = table(spark, sf_dir, "events").select(
        (F.col("value") / 10).alias("loss"), F.get_json_object("props", "$.k").cast("int").alias("masked_tokens")
    )
    return pooling.weighted_perplexity(batches).select(*[F.round(c, 6).alias(c) for c in ("loss", "perplexity")])
