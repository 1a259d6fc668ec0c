"""The roles the driver's tables play: vectors, clusters, measurements, baselines.

Instruction counts and compile times come from outside tools, so they are drawn
here from a hash of (sample, sequence). The same rules are spelled in SQL below.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import table
from nearfold.operators.clusters import cluster_summary, group_means, own_centre_distance
from nearfold.operators.retrieval import cluster_codes
from nearfold.operators.scaling import Scaler, fit_scaler
from nearfold.plans.retrieval import nearest_clusters
from nearfold.session import staged


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "embedding", F.col("label").alias("cluster")
    )


def base_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of the vectors: what clusters and scaler are made of. The rest are unseen samples."""
    return vectors(spark, sf_dir).filter(F.col("id").cast("bigint") % 5 != 0)


def label_membership(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Base vectors (``whole``: all vectors) of each label with their distance to the label's mean."""
    v = (vectors if whole else base_vectors)(spark, sf_dir)
    return own_centre_distance(v, staged(group_means(v, "cluster"), "label-means"))


def clusters(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The cluster table: size, nearest member, five nearest members."""
    return staged(cluster_summary(staged(label_membership(spark, sf_dir, whole), "membership")), "clusters")


def hex_number(text: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("int")


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four baseline counts per sample, each missing for about one in sixteen, and two build times."""
    ids = vectors(spark, sf_dir).select("id")

    def drawn(name: str, low: int) -> Column:
        seed = F.concat(F.lit(name + ":"), F.col("id"))
        value = (F.lit(low) + hex_number(seed, 1, 4) % 60).cast("bigint")
        return F.when(F.substring(F.md5(seed), 5, 1) != "f", value).alias(f"{name}_count")

    def took(name: str) -> Column:
        return (hex_number(F.concat(F.lit(name + ":"), F.col("id")), 6, 2) / 10.0).alias(f"{name}_ms")

    counts = (drawn("oz", 90), drawn("clang_oz", 85), drawn("gym_oz", 88), drawn("o0", 140))
    return ids.select("id", *counts, took("clang_oz"), took("gym_oz"))


def measured(pairs: DataFrame) -> DataFrame:
    """(id, code_id, count, compile_ms): some pairs failed (0), some were never measured."""
    seed = F.concat_ws(":", "id", "code_id")
    h = hex_number(seed, 1, 4)
    count = F.when(h % 50 == 0, F.lit(0)).otherwise(F.lit(70) + h % 90).cast("bigint")
    return pairs.filter(F.substring(F.md5(seed), 5, 1) != "f").select(
        "id", "code_id", count.alias("count"), (hex_number(seed, 6, 2) / 10.0).alias("compile_ms")
    )


@dataclass
class Setting:
    """Everything the retrieval queries share."""

    vectors: DataFrame
    clusters: DataFrame
    scaler: Scaler
    neighbours: DataFrame
    baselines: DataFrame

    @property
    def rep_codes(self) -> DataFrame:
        return cluster_codes(self.clusters, 1)

    @property
    def top_codes(self) -> DataFrame:
        return cluster_codes(self.clusters, 5)

    @cached_property
    def measurements(self) -> DataFrame:
        """Every sample with every sequence that any of its five clusters offers, as a stored table."""
        offered = self.neighbours.select("id", F.explode("neighbours.cluster_id").alias("cluster_id"))
        pairs = offered.join(self.top_codes, "cluster_id").select("id", F.explode("codes").alias("code_id"))
        return staged(measured(pairs.distinct()), "measurements")


def setting(spark: SparkSession, sf_dir: str, store_neighbours: bool = False) -> Setting:
    """``store_neighbours`` writes the nearest clusters out, for queries that use them repeatedly."""
    v = vectors(spark, sf_dir).select("id", "embedding")
    c = clusters(spark, sf_dir)
    base = base_vectors(spark, sf_dir).select("id", "embedding")
    scaler = fit_scaler(base)
    near = nearest_clusters(base, v, c, scaler=scaler)
    if store_neighbours:
        near = staged(near, "neighbours")
    return Setting(v, c, scaler, near, baselines(spark, sf_dir))


SETTING_SQL = """
WITH v AS (
  SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings
), long AS (
  SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v
), base_long AS (
  SELECT * FROM long WHERE vec_id % 5 <> 0
), label_means AS (
  SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS m FROM base_long GROUP BY label, i) GROUP BY label
), membership AS (
  SELECT v.vec_id, v.id, v.label, list_distance(v.e, m.mean) AS d FROM v JOIN label_means m ON v.label = m.label WHERE v.vec_id % 5 <> 0
), ranked_members AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rn FROM membership
), clusters AS (
  SELECT label AS cluster_id, count(*) AS cluster_size, max(CASE WHEN rn = 1 THEN id END) AS closest_code_id
  FROM ranked_members GROUP BY label
), top_codes AS (
  SELECT label AS cluster_id, CAST(rn - 1 AS INT) AS seq_rank, id AS code_id FROM ranked_members WHERE rn <= 5
), rep_codes AS (
  SELECT * FROM top_codes WHERE seq_rank = 0
), moments AS (
  SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM base_long GROUP BY i
), scaled AS (
  SELECT l.vec_id, CAST(l.vec_id AS VARCHAR) AS id, list((l.x - o.m) / o.s ORDER BY l.i) AS z
  FROM long l JOIN moments o ON l.i = o.i GROUP BY l.vec_id
), reps AS (
  SELECT c.cluster_id, c.closest_code_id, s.z FROM clusters c JOIN scaled s ON s.id = c.closest_code_id
), dist AS (
  SELECT s.vec_id, s.id, r.cluster_id, list_distance(s.z, r.z) AS d FROM scaled s, reps r
), near AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster_id) AS rk FROM dist
), pairs AS (
  SELECT DISTINCT n.id, t.code_id FROM near n JOIN top_codes t ON n.cluster_id = t.cluster_id WHERE n.rk <= 5
), hashed AS (
  SELECT id, code_id, md5(id || ':' || code_id) AS m FROM pairs
), measurements AS (
  SELECT id, code_id,
    CASE WHEN CAST(('0x' || substr(m, 1, 4)) AS INT) % 50 = 0 THEN 0
         ELSE 70 + CAST(('0x' || substr(m, 1, 4)) AS INT) % 90 END AS count,
    CAST(('0x' || substr(m, 6, 2)) AS INT) / 10.0::DOUBLE AS compile_ms
  FROM hashed WHERE substr(m, 5, 1) <> 'f'
), baselines AS (
  SELECT id,
    CASE WHEN substr(md5('oz:' || id), 5, 1) <> 'f'
         THEN 90 + CAST(('0x' || substr(md5('oz:' || id), 1, 4)) AS INT) % 60 END AS oz_count,
    CASE WHEN substr(md5('clang_oz:' || id), 5, 1) <> 'f'
         THEN 85 + CAST(('0x' || substr(md5('clang_oz:' || id), 1, 4)) AS INT) % 60 END AS clang_oz_count,
    CASE WHEN substr(md5('gym_oz:' || id), 5, 1) <> 'f'
         THEN 88 + CAST(('0x' || substr(md5('gym_oz:' || id), 1, 4)) AS INT) % 60 END AS gym_oz_count,
    CASE WHEN substr(md5('o0:' || id), 5, 1) <> 'f'
         THEN 140 + CAST(('0x' || substr(md5('o0:' || id), 1, 4)) AS INT) % 60 END AS o0_count,
    CAST(('0x' || substr(md5('clang_oz:' || id), 6, 2)) AS INT) / 10.0::DOUBLE AS clang_oz_ms,
    CAST(('0x' || substr(md5('gym_oz:' || id), 6, 2)) AS INT) / 10.0::DOUBLE AS gym_oz_ms
  FROM v
)"""

#: The same over all vectors, for queries about the clusters themselves.
WHOLE_SQL = SETTING_SQL.replace(" WHERE vec_id % 5 <> 0", "").replace(" WHERE v.vec_id % 5 <> 0", "")


def base_sql(codes: str) -> str:
    """CTEs up to the base result; ``codes`` is rep_codes or top_codes."""
    return SETTING_SQL + f""", offers AS (
  SELECT n.id, n.cluster_id AS cluster, c.seq_rank, c.code_id,
         CASE WHEN m.count > 0 THEN m.count END AS count, m.compile_ms
  FROM near n JOIN {codes} c ON n.cluster_id = c.cluster_id
  LEFT JOIN measurements m ON m.id = n.id AND m.code_id = c.code_id WHERE n.rk = 1
), offer_cost AS (
  SELECT id, cluster, sum(coalesce(compile_ms, 0)) AS compile_ms FROM offers GROUP BY id, cluster
), offer_best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count, seq_rank) AS pick FROM offers WHERE count > 0)
  WHERE pick = 1
), base AS (
  SELECT c.id, c.cluster, b.code_id AS best_code_id, o.oz_count, b.count AS base_count,
    CASE WHEN o.oz_count > 0 THEN round((1 - b.count / CAST(o.oz_count AS DOUBLE)) * 100.0::DOUBLE, 6) END AS reduction_pct,
    CASE WHEN o.oz_count > 0 THEN b.count / CAST(o.oz_count AS DOUBLE) END AS ratio, c.compile_ms
  FROM offer_cost c LEFT JOIN offer_best b ON b.id = c.id LEFT JOIN baselines o ON o.id = c.id
), thresholds AS (
  SELECT cluster, quantile_cont(reduction_pct, 0.1) AS delta_p10 FROM base WHERE reduction_pct IS NOT NULL GROUP BY cluster
), flagged AS (
  SELECT b.*, t.delta_p10, coalesce(b.reduction_pct < t.delta_p10, false) AS below_p10
  FROM base b LEFT JOIN thresholds t ON t.cluster = b.cluster
)"""


def final_sql(codes: str) -> str:
    """CTEs up to the final result."""
    return base_sql(codes) + f""", extras AS (
  SELECT f.id, n.rk AS cluster_rank, n.cluster_id AS cluster, c.seq_rank, c.code_id,
         CASE WHEN m.count > 0 THEN m.count END AS count, m.compile_ms
  FROM flagged f JOIN near n ON n.id = f.id AND n.rk BETWEEN 2 AND 5
  JOIN {codes} c ON c.cluster_id = n.cluster_id
  LEFT JOIN measurements m ON m.id = f.id AND m.code_id = c.code_id WHERE f.below_p10
), both_sides AS (
  SELECT id, 0 AS cluster_rank, cluster, 0 AS seq_rank, best_code_id AS code_id, base_count AS count FROM flagged WHERE below_p10
  UNION ALL SELECT id, cluster_rank, cluster, seq_rank, code_id, count FROM extras
), picked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count, cluster_rank, seq_rank) AS pick
                 FROM both_sides WHERE count > 0) WHERE pick = 1
), best AS (
  SELECT f.id, coalesce(p.cluster, f.cluster) AS best_cluster, p.code_id AS best_code_id, p.count AS best_count,
    CASE WHEN f.oz_count > 0 THEN (1 - p.count / CAST(f.oz_count AS DOUBLE)) * 100.0::DOUBLE END AS best_reduction_pct,
    (SELECT coalesce(sum(coalesce(x.compile_ms, 0)), 0) FROM extras x WHERE x.id = f.id) AS extras_compile_ms
  FROM flagged f LEFT JOIN picked p ON p.id = f.id WHERE f.below_p10
), best_flagged AS (
  SELECT b.*, t.delta_p10 AS best_delta_p10, coalesce(b.best_reduction_pct < t.delta_p10, false) AS best_below_p10
  FROM best b LEFT JOIN thresholds t ON t.cluster = b.best_cluster
), final AS (
  SELECT f.id, f.cluster, f.best_code_id AS base_code_id, f.oz_count, f.base_count, f.reduction_pct, f.below_p10,
    b.best_cluster, b.best_code_id, b.best_count, b.best_reduction_pct, coalesce(b.best_below_p10, false) AS best_below_p10,
    b.extras_compile_ms,
    CASE WHEN b.best_below_p10 THEN o.o0_count END AS preset_o0_count,
    CASE WHEN b.best_below_p10 THEN o.clang_oz_count END AS preset_clang_oz_count,
    CASE WHEN b.best_below_p10 THEN o.clang_oz_ms END AS preset_clang_oz_ms,
    CASE WHEN b.best_below_p10 THEN o.gym_oz_count END AS preset_cgym_oz_count,
    CASE WHEN b.best_below_p10 THEN o.gym_oz_ms END AS preset_cgym_oz_ms,
    CASE WHEN b.best_below_p10 THEN least(o.clang_oz_count, o.gym_oz_count, o.oz_count) END AS preset_best_oz_count,
    CASE WHEN coalesce(b.best_below_p10, false) THEN 'preset_fallback' WHEN f.below_p10 THEN 'ncs_ok' ELSE 'centroid' END AS category,
    CASE WHEN f.below_p10 THEN b.best_cluster ELSE f.cluster END AS final_cluster,
    CASE WHEN coalesce(b.best_below_p10, false) THEN least(o.clang_oz_count, o.gym_oz_count, o.oz_count)
         WHEN f.below_p10 THEN coalesce(b.best_count, f.base_count) ELSE f.base_count END AS final_count,
    CASE WHEN coalesce(b.best_below_p10, false) THEN 0.0::DOUBLE
         WHEN f.below_p10 THEN coalesce(b.best_reduction_pct, f.reduction_pct) ELSE f.reduction_pct END AS final_reduction_pct
  FROM flagged f LEFT JOIN best_flagged b ON b.id = f.id LEFT JOIN baselines o ON o.id = f.id
)"""
