"""Sources and sinks that exchange tables as files, checked by round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import SETTING_SQL, WHOLE_SQL, base_sql, clusters, setting
from catalog.registry import query, table
from nearfold.operators import evaluation as ev
from nearfold.operators.retrieval import neighbours_from_text, top_clusters_text
from nearfold.session import scratch_path, staged
from nearfold.sources import readers, writers


@query(
    "load_clusters",
    WHOLE_SQL + """
SELECT c.cluster_id, c.cluster_size, c.closest_code_id,
  (SELECT string_agg(t.code_id, ', ' ORDER BY t.seq_rank) FROM top_codes t WHERE t.cluster_id = c.cluster_id) AS top_closest_ids
FROM clusters c""",
)
def load_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "clusters-csv")
    writers.write_cluster_analysis(clusters(spark, sf_dir, whole=True), path)
    return readers.read_clusters(spark, path)


@query(
    "load_top_clusters",
    SETTING_SQL + """
SELECT id, CAST(rk AS INT) AS rank, cluster_id, round(d, 6) AS distance FROM near WHERE rk <= 5""",
)
def load_top_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest clusters as comma lists, written, read and taken apart again."""
    path = scratch_path(spark, "top-csv")
    writers.write_csv(top_clusters_text(setting(spark, sf_dir).neighbours), path)
    back = neighbours_from_text(readers.read_top_clusters(spark, path))
    return back.select("id", F.explode("neighbours").alias("n")).select("id", "n.rank", "n.cluster_id", "n.distance")


@query(
    "load_thresholds",
    base_sql("rep_codes") + "\nSELECT cluster, round(delta_p10, 6) AS delta_p10 FROM thresholds",
)
def load_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = setting(spark, sf_dir, store_neighbours=True)
    base = staged(ev.base_result(s.neighbours, s.rep_codes, s.measurements, s.baselines), "base")
    path = scratch_path(spark, "thresholds-csv")
    writers.write_csv(ev.cluster_thresholds(base), path)
    return readers.read_thresholds(spark, path).withColumn("delta_p10", F.round("delta_p10", 6))


@query("name_map", "SELECT event_id, 'k' AS name, CAST(json_extract(props, '$.k') AS VARCHAR) AS mapped FROM events")
def name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's properties are one JSON object."""
    return readers.name_map(table(spark, sf_dir, "events"), "props", "event_id")


ARTIFACT_SQL = """WITH a AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS program_id, CASE WHEN l_returnflag = 'A' THEN 'Source.c' WHEN l_returnflag = 'R' THEN 'llvm_O0.ll'
    WHEN l_linestatus = 'O' THEN 'llvm_OZ.ll' ELSE 'input.bc' END AS name FROM lineitem
)
SELECT program_id, count(*) FILTER (WHERE name = 'Source.c') > 0 AS has_source, count(*) FILTER (WHERE name = 'llvm_O0.ll') > 0 AS has_o0,
  count(*) FILTER (WHERE name = 'llvm_OZ.ll') > 0 AS has_oz,
  CASE WHEN count(*) FILTER (WHERE name = 'input.bc') > 0 THEN 'Source_' || program_id || '/input.bc'
       WHEN count(*) FILTER (WHERE name = 'llvm_O0.ll') > 0 THEN 'Source_' || program_id || '/llvm_O0.ll' END AS start_path
FROM a GROUP BY program_id"""


@query("artifact_inventory", ARTIFACT_SQL)
def artifact_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for the artefact files of their order."""
    name = (
        F.when(F.col("l_returnflag") == "A", "Source.c")
        .when(F.col("l_returnflag") == "R", "llvm_O0.ll")
        .when(F.col("l_linestatus") == "O", "llvm_OZ.ll")
        .otherwise("input.bc")
    )
    key = F.col("l_orderkey").cast("string")
    files = table(spark, sf_dir, "lineitem").select(
        key.alias("program_id"), name.alias("name"), F.concat(F.lit("Source_"), key, F.lit("/"), name).alias("path")
    )
    return readers.artifact_inventory(files)
