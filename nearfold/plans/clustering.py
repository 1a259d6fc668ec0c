"""Cluster a table of vectors end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from nearfold.operators import clusters as cl
from nearfold.operators.nearest import nearest_centres
from nearfold.operators.quality import accepted, filter_id_range, mark_rejects
from nearfold.operators.scaling import Scaler, scale
from nearfold.session import staged


@dataclass
class Clustering:
    """``centres`` are in scaled space; ``curve`` is None when k was given."""

    k: int
    centres: DataFrame
    inertia: float
    assignments: DataFrame
    summary: DataFrame
    scaler: Scaler | None
    curve: DataFrame | None


def cluster_vectors(
    vectors: DataFrame,
    k: int | None = None,
    k_values: Sequence[int] = (),
    scaling: str = "standard",
    invalid_rows: str = "error",
    low_id: int | None = None,
    high_id: int | None = None,
    top_n: int = 5,
    n_init: int = 10,
    seed: int = 42,
    max_iter: int = 300,
) -> Clustering:
    """Validate, restrict, scale, choose k, fit, assign and summarise.

    Without ``k`` the elbow over ``k_values`` decides; at least three of them
    must be no larger than the number of rows.
    """
    good = accepted(mark_rejects(vectors.select("id", "embedding")), invalid_rows)
    good = filter_id_range(good, low_id, high_id)
    scaled, scaler = scale(good, scaling)
    scaled = staged(scaled, "scaled-vectors")
    n = scaled.count()
    if n == 0:
        raise ValueError("no rows remain after filtering")
    curve = None
    if k is None:
        usable = sorted({int(v) for v in k_values if 1 <= v <= n})
        if len(usable) < 3:
            raise ValueError("choosing k needs at least three values no larger than the number of rows")
        fits = cl.fit_grid(scaled, usable, n_init, seed, max_iter)
        points = sorted((tried, fit[0]) for tried, fit in fits.items())
        curve = vectors.sparkSession.createDataFrame(points, "k INT, inertia DOUBLE")
        k = cl.elbow_k(curve).head()[0]
        centres, inertia = cl.numbered_centres(scaled, *fits[k])
    else:
        centres, inertia = cl.fit_kmeans(scaled, k, n_init, seed, max_iter)
    assigned = staged(cl.assignments(nearest_centres(scaled, centres, 1)), "assignments")
    return Clustering(k, centres, inertia, assigned, cl.cluster_summary(assigned, top_n), scaler, curve)
