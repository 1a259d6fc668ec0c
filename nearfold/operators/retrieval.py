"""Representatives, rosters and the candidates a sample's clusters offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.functions.columns import canonical_id
from nearfold.operators.quality import dedupe_last

# --- fixed values: how many neighbours and sequences take part -----------------
NEIGHBOUR_COUNT = 5
SEQUENCES_PER_CLUSTER = 5
# -------------------------------------------------------------------------------


def representative_vectors(clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster_id, closest_code_id, embedding) for representatives that have a vector."""
    reps = clusters.select("cluster_id", canonical_id(F.col("closest_code_id")).alias("closest_code_id"))
    return vectors.select(F.col("id").alias("closest_code_id"), "embedding").join(reps, "closest_code_id").select(
        "cluster_id", "closest_code_id", "embedding"
    )


def missing_representatives(clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """Representatives without a vector.

    The vectors are first cut down to those of representatives; only these few
    take part in the anti-join.
    """
    reps = clusters.select("cluster_id", canonical_id(F.col("closest_code_id")).alias("closest_code_id"))
    ids = vectors.select(F.col("id").alias("closest_code_id"))
    present = ids.join(reps, "closest_code_id", "left_semi")
    return reps.join(present, "closest_code_id", "left_anti")


def sequence_codes(text: Column, representative: Column, limit: int = SEQUENCES_PER_CLUSTER) -> Column:
    """First distinct ids of a comma list; an empty list falls back to the representative."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p))
    ids = F.slice(F.array_distinct(F.filter(parts, lambda p: p != "")), 1, limit)
    return F.when(F.size(ids) > 0, ids).otherwise(F.array(representative))


def cluster_codes(clusters: DataFrame, per_cluster: int, top_col: str = "top_closest_ids") -> DataFrame:
    """(cluster_id, codes): the sequences a cluster contributes, best first.

    With ``per_cluster`` 1 that is the representative alone.
    """
    rep = canonical_id(F.col("closest_code_id"))
    if per_cluster == 1:
        return clusters.select("cluster_id", F.array(rep).alias("codes"))
    listed = F.col(top_col)
    if dict(clusters.dtypes)[top_col] != "string":
        listed = F.array_join(listed, ",")
    return clusters.select("cluster_id", sequence_codes(listed, rep, per_cluster).alias("codes"))


def cluster_candidates(clusters: DataFrame, per_cluster: int = SEQUENCES_PER_CLUSTER) -> DataFrame:
    """Long form (cluster_id, seq_rank, code_id)."""
    codes = cluster_codes(clusters, per_cluster)
    return codes.select("cluster_id", F.posexplode("codes").alias("seq_rank", "code_id"))


def nearest_cluster(neighbours: DataFrame) -> DataFrame:
    first = F.get("neighbours", 0)
    return neighbours.select("id", first["cluster_id"].alias("cluster"), first["distance"].alias("distance"))


def top_clusters_text(neighbours: DataFrame) -> DataFrame:
    """Ids and six-decimal distances of the neighbours as comma lists."""
    ids = F.transform("neighbours", lambda n: n["cluster_id"].cast("string"))
    distances = F.transform("neighbours", lambda n: F.format_string("%.6f", n["distance"]))
    return neighbours.select(
        "id",
        F.array_join(ids, ",").alias("top_5_closest_clusters"),
        F.array_join(distances, ",").alias("top_5_distances"),
    )


def neighbours_from_text(top: DataFrame) -> DataFrame:
    """Read such comma lists back; entries that are no cluster number are dropped."""
    ids = F.filter(
        F.transform(F.split("top_5_closest_clusters", ","), lambda c: F.trim(c)), lambda c: c.rlike("^[0-9]+$")
    )
    distances = F.split("top_5_distances", ",")
    entry = F.transform(
        ids,
        lambda c, i: F.struct(
            (i + 1).cast("int").alias("rank"),
            c.cast("int").alias("cluster_id"),
            F.get(distances, i).try_cast("double").alias("distance"),
        ),
    )
    return top.select(F.col("id").cast("string").alias("id"), entry.alias("neighbours"))


def cluster_roster(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, id) in long form; a cluster without samples has one row with a NULL id.

    The empty clusters come from an anti-join against the *distinct* used ids,
    so the large side is never shuffled by its (possibly very uneven) cluster.
    """
    used = assigned.select(F.col("cluster").alias("cluster_id")).distinct()
    empty = clusters.select("cluster_id").join(used, "cluster_id", "left_anti")
    return assigned.select(F.col("cluster").alias("cluster_id"), "id").unionByName(
        empty.withColumn("id", F.lit(None).cast("string"))
    )


def latest_clusters(clusters: DataFrame, order: list[str]) -> DataFrame:
    """One row per cluster when a table lists some clusters twice: the later row wins."""
    return dedupe_last(clusters, ["cluster_id"], order)
