"""Unseen samples to their final result: nearest clusters, candidates, gated fallback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators import evaluation as ev
from nearfold.operators.joins import HotKeys, hot_keys
from nearfold.operators.nearest import nearest_centres
from nearfold.operators.quality import dedupe_last
from nearfold.operators.retrieval import NEIGHBOUR_COUNT, SEQUENCES_PER_CLUSTER, cluster_codes, representative_vectors
from nearfold.operators.scaling import Scaler, fit_scaler
from nearfold.session import staged
from nearfold.stages import Stages


@dataclass
class Retrieval:
    """``neighbours``, ``base`` and ``final`` in one; ``thresholds`` as given or derived."""

    neighbours: DataFrame
    base: DataFrame
    thresholds: DataFrame
    final: DataFrame

    @property
    def report(self) -> DataFrame:
        return ev.stage_report(self.final)


def nearest_clusters(
    base_vectors: DataFrame, samples: DataFrame, clusters: DataFrame, k: int = NEIGHBOUR_COUNT, scaler: Scaler | None = None
) -> DataFrame:
    """(id, neighbours): the scaler is fit on the base vectors and applied to both sides;
    distances go to each cluster's representative vector."""
    scaler = scaler or fit_scaler(base_vectors)
    return nearest_centres(samples.select("id", "embedding"), representative_vectors(clusters, base_vectors), k, scaler)


def retrieve(
    stages: Stages,
    base_vectors: DataFrame,
    samples: DataFrame,
    clusters: DataFrame,
    measurements: DataFrame,
    baselines: DataFrame,
    thresholds: DataFrame | None = None,
    per_cluster: int = SEQUENCES_PER_CLUSTER,
    k: int = NEIGHBOUR_COUNT,
) -> Retrieval:
    """From vectors to the final result, each stage taken from ``stages`` if nothing it depends on has changed.

    So a run with other thresholds measures no distance again, and one with other samples keeps nothing.
    """
    near = stages.table("neighbours", lambda: nearest_clusters(base_vectors, samples, clusters, k), [base_vectors, samples, clusters], k=k)
    given = [near, clusters, measurements, baselines]
    codes = cluster_codes(clusters, per_cluster)
    hot = hot_clusters(near)
    base = stages.table("base", lambda: ev.base_result(near, codes, measurements, baselines, hot, carry=False), given, per_cluster=per_cluster)
    wanted = ev.cluster_thresholds(base) if thresholds is None else dedupe_last(thresholds.select("cluster", "delta_p10"), ["cluster"], [])
    gates = stages.table("thresholds", lambda: wanted, [base if thresholds is None else thresholds], derived=thresholds is None)
    final = stages.table("final", lambda: ev.final_result(base, codes, gates, measurements, baselines, hot, near), [base, gates, *given], per_cluster=per_cluster)
    return Retrieval(near, base, gates, final)


def hot_clusters(neighbours: DataFrame) -> HotKeys:
    """Clusters with an outsized share of the samples; one pass serves all lookups by cluster."""
    return hot_keys(neighbours.select(F.get("neighbours", 0)["cluster_id"].alias("cluster")), "cluster")


def evaluate(
    neighbours: DataFrame,
    clusters: DataFrame,
    measurements: DataFrame | ev.Scorer,
    baselines: DataFrame,
    thresholds: DataFrame | None = None,
    per_cluster: int = SEQUENCES_PER_CLUSTER,
) -> Retrieval:
    """Base result, gate and fallback for samples whose neighbours are known.

    ``per_cluster`` 1 uses each cluster's representative sequence alone. Without
    ``thresholds`` each cluster's 10th percentile of the base result is used; a
    cluster that is listed twice among given ones keeps its higher threshold.
    The base result and the thresholds are written to the shared folder, as
    both are read more than once.
    """
    codes = cluster_codes(clusters, per_cluster)
    hot = hot_clusters(neighbours)
    base = staged(ev.base_result(neighbours, codes, measurements, baselines, hot, carry=False), "base")
    if thresholds is None:
        thresholds = ev.cluster_thresholds(base)
    else:
        thresholds = dedupe_last(thresholds.select("cluster", "delta_p10"), ["cluster"], [])
    gates = staged(thresholds, "thresholds")
    final = ev.final_result(base, codes, gates, measurements, baselines, hot, neighbours)
    return Retrieval(neighbours, base, gates, final)
