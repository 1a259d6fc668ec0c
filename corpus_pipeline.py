"""From raw documents to samples of token ids: five stages, each over all that the one before kept.

Quality rules drop documents, near-duplicate classes keep their first, personal data is masked, sources
are mixed to target weights, and the texts are encoded; ordered by (part, row) the samples are the mixture. Every stage's result is a table in the shared
folder, read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm import jaccard, mixing, pii, quality, sampling
from nearfold.session import staged


#: Text that a task of the last stage works on at once; its executors still hold what earlier stages left.
ENCODE_BYTES = 1024 * 1024


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects (operator 8)."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every near-duplicate class (operator 9)."""
    return jaccard.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind (operator 6)."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture (operator 2)."""
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text, with ids (operator 3), and the text's place in the order of the mixture:
    the number of its file and its row there, as that order is the one in which the table was written."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("int")
    placed = docs.select("*", part.alias("part"), F.col("_metadata.row_index").alias("row"))
    return sampling.sampled(placed, k=2, batch_bytes=ENCODE_BYTES, carried=("part", "row"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
