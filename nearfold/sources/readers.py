"""Readers: text corpora, vector tables, cluster tables, commands, sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.functions.columns import (
    canonical_id,
    first_present,
    id_from_path,
    natural_order,
    require_columns,
    to_number,
)
from nearfold.functions.text import normalize_text
from nearfold.functions.vectors import as_doubles, vector_from_json
from nearfold.sources.small_files import PACK_BYTES, packed_files

# --- fixed values: accepted column names, file names and formats ---------------
VECTOR_COLUMNS = ("embeddings", "embedding")
CLUSTER_COLUMNS = ("cluster_id", "cluster", "centroid")
TOP_COLUMNS = ("top_5_closest_ids", "top_closest_ids")
SEQUENCE_FILE = r"([^/]+)_seq\.txt$"
ARTIFACTS = ("Source.c", "llvm_O0.ll", "llvm_OZ.ll", "input.bc")
# -------------------------------------------------------------------------------


def read_corpus(
    spark: SparkSession,
    path: str | Sequence[str],
    file_glob: str | None = None,
    id_pattern: str | None = None,
    preprocess: bool = False,
    max_files: int | None = None,
    packed: bool = False,
) -> DataFrame:
    """One row (doc_id, path, text) per file below ``path``, searched recursively.

    ``max_files`` keeps the first files in natural path order; it lists paths
    from file metadata only, before any text is read. No match is an error.
    ``packed`` reads with many small files to a task, where Arrow can open the
    file system; ``read_corpus_parts`` also cuts large files.
    """
    paths = [path] if isinstance(path, str) else list(path)
    listed = file_paths(spark, paths, file_glob)
    if max_files is not None:
        listed = limit_corpus(listed, max_files)
    some = [r["path"] for r in (listed if max_files is not None else listed.limit(1)).collect()]
    if not some:
        raise ValueError(f"no files matched {paths}" + (f" with {file_glob}" if file_glob else ""))
    wanted = (paths, file_glob) if max_files is None else (some, None)
    files = packed_files(spark, *wanted, split=False) if packed else whole_files(spark, *wanted)
    text = normalize_text(F.col("text")) if preprocess else F.col("text")
    return files.select(id_from_path(F.col("path"), id_pattern).alias("doc_id"), "path", text.alias("text"))


def read_corpus_parts(
    spark: SparkSession, path: str | list[str], file_glob: str | None = None, id_pattern: str | None = None, part_bytes: int = PACK_BYTES
) -> DataFrame:
    """(doc_id, path, part, text): files in parts of about ``part_bytes``; a task reads many, so tasks grow with bytes, not with parts."""
    files = packed_files(spark, path, file_glob, max(part_bytes, PACK_BYTES), part_bytes=part_bytes)
    return files.select(id_from_path(F.col("path"), id_pattern).alias("doc_id"), "path", "part", "text")


def file_paths(spark: SparkSession, paths: str | list[str], file_glob: str | None = None) -> DataFrame:
    """(path) of every file at any depth below ``paths``; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    return reader.load(paths).select("path")


def whole_files(spark: SparkSession, paths: str | list[str], file_glob: str | None = None) -> DataFrame:
    """(path, text): one row per file at any depth below ``paths``."""
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    return reader.load(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def limit_corpus(files: DataFrame, n: int, path: str = "path") -> DataFrame:
    """First ``n`` rows in natural path order."""
    if n <= 0:
        raise ValueError("the number of files must be positive")
    return files.orderBy(*natural_order(path)).limit(n)


def _csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``multi_line`` allows line feeds inside quotes, but makes each file one task."""
    return spark.read.csv(path, header=True, escape='"', quote='"', multiLine=multi_line)


def read_vectors(
    spark: SparkSession, path: str, id_col: str = "id", vector_col: str | None = None, fmt: str = "csv"
) -> DataFrame:
    """(id, embedding) from CSV with vectors as JSON text, or from Parquet arrays.

    Unreadable vectors come out NULL, for ``mark_rejects`` to report.
    """
    raw = spark.read.parquet(path) if fmt == "parquet" else _csv_lines(spark, path)
    require_columns(raw, [id_col], path)
    name = vector_col or first_present(raw, VECTOR_COLUMNS)
    require_columns(raw, [name], path)
    vector = F.col(name)
    if dict(raw.dtypes)[name] == "string":
        vector = vector_from_json(vector)
    return raw.select(canonical_id(F.col(id_col)).alias("id"), as_doubles(vector).alias("embedding"))


def _csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """CSV without line breaks inside fields, so that large files are split among tasks."""
    return spark.read.csv(path, header=True, escape='"', quote='"')


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, cluster_size, closest_code_id, top_closest_ids) from a cluster analysis CSV."""
    raw = _csv_lines(spark, path)
    require_columns(raw, ["closest_code_id"], path)
    key = first_present(raw, CLUSTER_COLUMNS)
    top = [c for c in raw.columns if c in TOP_COLUMNS or (c.startswith("top_") and c.endswith("_closest_ids"))]
    listed = F.col(top[0]) if top else F.lit(None).cast("string")
    size = F.col("cluster_size").cast("bigint") if "cluster_size" in raw.columns else F.lit(None).cast("bigint")
    return raw.select(
        to_number(F.col(key)).cast("int").alias("cluster_id"),
        size.alias("cluster_size"),
        canonical_id(F.col("closest_code_id")).alias("closest_code_id"),
        listed.alias("top_closest_ids"),
    )


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, delta_p10); clusters without a threshold are left out."""
    raw = require_columns(_csv_lines(spark, path), ["cluster", "delta_p10"], path)
    return raw.select(
        to_number(F.col("cluster")).cast("int").alias("cluster"), to_number(F.col("delta_p10")).alias("delta_p10")
    ).dropna()


def read_top_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(id, top_5_closest_clusters, top_5_distances), ids kept as text."""
    raw = _csv_lines(spark, path)
    wanted = ["id", "top_5_closest_clusters", "top_5_distances"]
    return require_columns(raw, wanted, path).select(*wanted)


def read_commands(
    spark: SparkSession, path: str, benchmark: str = "benchmark", command: str = "commandline", multi_line: bool = False
) -> DataFrame:
    """(benchmark, commandline) rows; those without a command are skipped."""
    raw = require_columns(_csv(spark, path, multi_line), [benchmark, command], path)
    return raw.select(F.col(benchmark).alias("benchmark"), F.col(command).alias("commandline")).filter("commandline <> ''")


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, mapped) pairs of one JSON object."""
    return name_map(whole_files(spark, path), "text")


def name_map(df: DataFrame, json_col: str, *kept: str) -> DataFrame:
    """(name, mapped) pairs of the JSON object in each row; anything else fails."""
    parsed = df.select(*kept, F.from_json(json_col, "map<string,string>").alias("m"))
    checked = F.when(F.col("m").isNotNull(), F.col("m")).otherwise(
        F.raise_error(F.lit("the name map must be one JSON object")).cast("map<string,string>")
    )
    return parsed.select(*kept, F.explode(checked).alias("name", "mapped"))


def scan_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(code_id, passes) from a folder of ``<code_id>_seq.txt`` files, many of them to a task."""
    return read_sequences(packed_files(spark, path, "*_seq.txt", split=False))


def read_sequences(files: DataFrame) -> DataFrame:
    """(code_id, passes) from (path, text) rows."""
    return files.select(
        F.regexp_extract("path", SEQUENCE_FILE, 1).alias("code_id"),
        F.filter(F.split("text", r"\s+"), lambda t: t != "").alias("passes"),
    )


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(program_id, name, path, length) of every known artefact file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("program_id"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        "path",
        "length",
    ).filter(F.col("name").isin(*ARTIFACTS))


def artifact_inventory(artifacts: DataFrame) -> DataFrame:
    """One row per program: which artefacts it has and which one to start from.

    Bitcode is preferred over unoptimised text; a program with neither has no
    start, and one without its optimised text has no baseline.
    """

    def path_of(name: str):
        return F.max(F.when(F.col("name") == name, F.col("path")))

    wide = artifacts.groupBy("program_id").agg(
        path_of("Source.c").alias("source_path"),
        path_of("llvm_O0.ll").alias("o0_path"),
        path_of("llvm_OZ.ll").alias("oz_path"),
        path_of("input.bc").alias("bc_path"),
    )
    return wide.select(
        "program_id",
        F.col("source_path").isNotNull().alias("has_source"),
        F.col("o0_path").isNotNull().alias("has_o0"),
        F.col("oz_path").isNotNull().alias("has_oz"),
        F.coalesce("bc_path", "o0_path").alias("start_path"),
    )
