"""The registered queries of these operators, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm import chat, collocations, fm_index, jaccard, mixing, packing, periods, pii, quality, sampling, sharding, suffix_merge, topk

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # The checksum is that of the text that has arrived in its shard.
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return sharding.shard_by_bytes(docs, 8).select(
        "doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(
    "op10_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    ), ranked AS (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
)
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(_table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


@query(
    "op7_chat_formatting",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        sum(14 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')))::BIGINT
            AS formatted_chars
    FROM turns GROUP BY conv_id
    """,
)
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest_formatted(chat.format_conversations(rows))


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), ["doc_id"])


@query(
    "op1_substring_dedup",
    r"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), windows AS (
        SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
    ), first AS (SELECT s, min(doc_id) AS d FROM windows GROUP BY s),
    gone AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
        FROM windows JOIN first USING (s) WHERE d < doc_id
    ), each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM words)
    SELECT d.doc_id, count(e.p) AS n_words, count(g.p) AS n_removed,
        sha256(coalesce(string_agg(e.x, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL), '')) AS kept_sha256
    FROM documents d LEFT JOIN each e USING (doc_id) LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p
    GROUP BY d.doc_id
    """,
)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.remove_repeated_words(_table(spark, sf_dir, "documents"), with_text=False)


@query("op5_suffix_array_dedup")
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_merge.remove_repeated_bytes(_table(spark, sf_dir, "documents"), with_text=False)


@query(
    "op9_ngram_jaccard_join",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
            WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
    ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
        GROUP BY ALL
    ), links AS MATERIALIZED (
        SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
        WHERE 100 * c >= 75 * (p.n + q.n - c)
    ), reach AS (
        SELECT doc_id AS a, doc_id AS b FROM words
        UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    )
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
    FROM words d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
    """,
)
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "source"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sampled(_table(spark, sf_dir, "documents"), k=2, with_ids=False)


@query("op11_best_fit_packing")
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents whose checksum of doc_id ends in 0 repeat some of their words up to their end."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(checksum % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    split = docs.select("*", words.alias("planted_words"), F.floor(checksum / 10).alias("planted_g"))
    g, n = F.col("planted_g"), F.size("planted_words").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    numbered = split.withColumns({"planted_a": F.when(n > 0, a), "planted_p": F.when(n > 0, p)})
    first = F.slice("planted_words", 1, F.col("planted_a").cast("int"))
    cycle = F.slice("planted_words", F.col("planted_a").cast("int") + 1, F.col("planted_p").cast("int"))
    times = F.ceil((n - F.col("planted_a")) / F.col("planted_p")).cast("int")
    again = F.array_join(F.slice(F.concat(first, F.flatten(F.array_repeat(cycle, times))), 1, n.cast("int")), " ")
    return numbered.withColumn("text", F.when(F.col("planted_p").isNotNull(), again).otherwise(F.col("text"))).select(*docs.columns)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.find_runs(with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])


@query(
    "op13_collocations",
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    spans AS (
        SELECT lang, w[i:i + k - 1] AS s
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS sizes(k))
    ), f AS (SELECT lang, s, count(*) AS c FROM spans GROUP BY ALL),
    totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE len(s) = 1 GROUP BY lang),
    candidates AS MATERIALIZED (SELECT lang, s, c AS a FROM f WHERE len(s) > 1 AND c >= 10),
    cuts AS (
        SELECT lang, s, a, k, s[1:k] AS first, s[k + 1:] AS rest
        FROM (SELECT lang, s, a, unnest(range(1, len(s))) AS k FROM candidates)
    ), scored AS (
        SELECT u.lang, u.s, u.a, u.k, x.c AS l, y.c AS r, ((1000000::HUGEINT * u.a * u.a) // (x.c::HUGEINT * y.c))::BIGINT AS score
        FROM cuts u JOIN f x ON x.lang = u.lang AND x.s = u.first JOIN f y ON y.lang = u.lang AND y.s = u.rest
    ), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1),
    gone AS (
        SELECT DISTINCT p.lang, p.s FROM candidates p
        JOIN (SELECT lang, a, unnest([s[1:2], s[2:3]]) AS s FROM candidates WHERE len(s) = 3) t ON t.lang = p.lang AND t.s = p.s
        WHERE 100 * t.a >= 50 * p.a
    ), kept AS (
        SELECT *, array_to_string(s, ' ') AS phrase FROM weakest ANTI JOIN gone USING (lang, s)
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))
