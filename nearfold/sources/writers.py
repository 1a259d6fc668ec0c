"""Writers for the tables that jobs exchange as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.operators.scaling import Scaler, identity_scaler
from nearfold.sources.small_files import write_keyed

CSV = {"header": True, "escape": '"', "quote": '"'}


def write_csv(df: DataFrame, path: str) -> None:
    """Result tables: rosters, base, final and comparison results, elbow scores."""
    df.write.mode("overwrite").csv(path, **CSV)


def write_vectors(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """(id, embedding): Parquet arrays, or CSV with each vector as JSON text."""
    if fmt == "parquet":
        df.select("id", "embedding").write.mode("overwrite").parquet(path)
        return
    write_csv(df.select("id", F.to_json(F.col("embedding").cast("array<double>")).alias("embedding")), path)


def write_assignments(assigned: DataFrame, folder: str, k: int) -> str:
    """(id, cluster, distance_to_centroid) under a name that carries k."""
    path = f"{folder.rstrip('/')}/assignments_k{k}"
    write_csv(assigned.select("id", "cluster", "distance_to_centroid"), path)
    return path


def write_cluster_analysis(summary: DataFrame, path: str, top_n: int = 5) -> None:
    """Cluster summary with the nearest ids as one comma list. Complete
    membership goes to ``write_members``, whose rows stay bounded."""
    listed = F.array_join("top_closest_ids", ", ").alias(f"top_{top_n}_closest_ids")
    write_csv(summary.select("cluster_id", "cluster_size", "closest_code_id", listed), path)


def write_members(segments: DataFrame, path: str) -> None:
    write_csv(segments.select("cluster_id", "segment", F.array_join("member_ids", ", ").alias("all_code_ids")), path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """One token per line; the line number is the id."""
    vocab.orderBy("id").select("token").coalesce(1).write.mode("overwrite").text(path)


def write_config(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sequences(sequences: DataFrame, path: str) -> None:
    """One file ``<benchmark>_seq.txt`` per benchmark, one pass per line, as ``scan_sequences`` reads them."""
    name = F.concat("benchmark", F.lit("_seq.txt")).alias("name")
    write_keyed(sequences.select(name, F.array_join("passes", "\n").alias("text")), path)


def write_model(centres: DataFrame, scaler: Scaler | None, folder: str) -> None:
    """A fitted clustering as two tables: centres, and the scaler they were scaled with."""
    folder = folder.rstrip("/")
    centres.select("cluster_id", "embedding").write.mode("overwrite").parquet(f"{folder}/centres")
    known = scaler or identity_scaler(centres.select(F.size("embedding")).head()[0])
    known.to_table(centres.sparkSession).write.mode("overwrite").parquet(f"{folder}/scaler")


def read_model(spark: SparkSession, folder: str) -> tuple[DataFrame, Scaler]:
    folder = folder.rstrip("/")
    return spark.read.parquet(f"{folder}/centres"), Scaler.from_table(spark.read.parquet(f"{folder}/scaler"))
