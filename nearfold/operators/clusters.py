"""K-means, its deterministic step, inertia curves and cluster summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.functions.columns import by_numeric_id, numeric_id
from nearfold.functions.vectors import as_doubles, distance
from nearfold.operators.fits import fit_models
from nearfold.operators.nearest import (
    BLOCKS_PER_STAGE,
    _matrix,
    _merged,
    _shipped,
    all_but_last,
    centre_blocks,
    nearest_centres,
    received,
    so_far,
    squared_distances,
    tiles,
)
from nearfold.operators.scaling import Scaler
from nearfold.session import staged


def vector_mean(vector: Column, weight: Column | None = None) -> Column:
    """Element-wise (weighted) mean of vectors; combines map-side."""
    v = array_to_vector(as_doubles(vector))
    mean = Summarizer.mean(v) if weight is None else Summarizer.mean(v, weight.cast("double"))
    return vector_to_array(mean)


def group_means(df: DataFrame, group: str, vector_col: str = "embedding") -> DataFrame:
    """One mean vector per group, as a centre table."""
    return df.groupBy(F.col(group).cast("int").alias("cluster_id")).agg(
        vector_mean(F.col(vector_col)).alias("embedding")
    )


def own_centre_distance(df: DataFrame, centres: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """(id, cluster, distance_to_centroid) for a given membership; ``centres`` is best a
    written table, so that its known size decides about a broadcast."""
    c = centres.select(F.col("cluster_id").alias(cluster_col), F.col("embedding").alias("centre"))
    joined = df.join(c, cluster_col)
    return joined.select(
        "id",
        cluster_col,
        distance(as_doubles(F.col("embedding")), F.col("centre")).alias("distance_to_centroid"),
    )


def assignments(neighbours: DataFrame, id_col: str = "id") -> DataFrame:
    first = F.get("neighbours", 0)
    return neighbours.select(
        id_col, first["cluster_id"].alias("cluster"), first["distance"].alias("distance_to_centroid")
    )


def _member_means(vectors: DataFrame, centres: DataFrame, scaler: Scaler | None) -> DataFrame:
    """(cluster_id, moved): mean of the vectors nearest to each centre.

    Each batch sends one partial mean per cluster, so neither vectors nor
    assignments leave the task.
    """
    rows, last = all_but_last(vectors.select("embedding"), centres, 1, scaler, "embedding")
    shared = vectors.sparkSession.sparkContext.broadcast(_shipped(last))

    def run(batches):
        block, mean, deviation = received(shared.value)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch.column(batch.schema.get_field_index("embedding")), block[1].shape[1])
            scaled = x if mean is None else (x - mean) / deviation
            label = _merged(so_far(batch), scaled, block, 1)[0][:, 0]
            order = np.argsort(label, kind="stable")
            found, start, n = np.unique(label[order], return_index=True, return_counts=True)
            means = np.add.reduceat(x[order], start, axis=0) / n[:, None]
            bounds = np.arange(0, means.size + 1, means.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.astype(np.int32)),
                    pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(bounds, pa.array(means.ravel())),
                ],
                names=["cluster_id", "n", "part"],
            )

    parts = rows.mapInArrow(run, "cluster_id INT, n BIGINT, part ARRAY<DOUBLE>")
    return parts.groupBy("cluster_id").agg(vector_mean(F.col("part"), F.col("n")).alias("moved"))


def lloyd(vectors: DataFrame, start: DataFrame, iterations: int, scaler: Scaler | None = None) -> DataFrame:
    """Centres after a fixed number of assign-and-average rounds from ``start``.

    A centre that loses all its members stays where it was. Distances are taken
    in scaled space, while means, which scaling commutes with, are kept as they
    come and scaled at the end. Each round's centres are written to the shared
    folder, so lineage does not grow with the rounds.
    """
    centres = start.select("cluster_id", as_doubles(F.col("embedding")).alias("embedding"))
    for _ in range(iterations):
        moved = _member_means(vectors, centres, scaler)
        centres = staged(
            centres.join(moved, "cluster_id", "left").select(
                "cluster_id", F.coalesce("moved", "embedding").alias("embedding")
            ),
            "centres",
        )
    return centres if scaler is None else centres.withColumn("embedding", scaler.apply(F.col("embedding")))


def inertia_by_k(vectors: DataFrame, centres: DataFrame, scaler: Scaler | None = None) -> DataFrame:
    """(k, inertia) when the first k centres by cluster_id are used.

    Block by block of the centres: each row carries its smallest squared distance so
    far, and each batch sends one partial sum per k.
    """
    rows, offset, curve = vectors.select("embedding"), 0, None
    for number, block in enumerate(centre_blocks(centres, scaler)):
        shared = vectors.sparkSession.sparkContext.broadcast((block.vectors, block.mean, block.deviation))

        def running(batch, shared=shared):
            """Per tile of rows: the running minimum over the block's centres."""
            block_rows, mean, deviation = shared.value
            x = _matrix(batch.column(0), block_rows.shape[1])
            x = x if mean is None else (x - mean) / deviation
            for tile in tiles(len(x), len(block_rows)):
                squared = squared_distances(x[tile], block_rows)
                if batch.num_columns > 1:
                    squared[:, 0] = np.minimum(squared[:, 0], batch.column(1).to_numpy()[tile])
                yield np.minimum.accumulate(squared, axis=1)

        def sums(batches, running=running, offset=offset):
            for batch in batches:
                for least in running(batch):
                    ks = np.arange(1, least.shape[1] + 1, dtype=np.int32) + offset
                    yield pa.RecordBatch.from_arrays([pa.array(ks.astype(np.int32)), pa.array(least.sum(axis=0))], names=["k", "part"])

        def carried(batches, running=running):
            for batch in batches:
                least = [m[:, -1] for m in running(batch)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(least or [np.zeros(0)]))], names=["embedding", "least"])

        part = rows.mapInArrow(sums, "k INT, part DOUBLE").groupBy("k").agg(F.sum("part").alias("inertia"))
        curve = part if curve is None else curve.unionByName(part)
        offset += len(block.ids)
        schema = T.StructType([vectors.schema["embedding"], T.StructField("least", T.DoubleType())])
        rows = rows.mapInArrow(carried, schema)
        if number % BLOCKS_PER_STAGE == BLOCKS_PER_STAGE - 1:
            rows = staged(rows, "least-so-far")
    return curve


def elbow_k(curve: DataFrame) -> DataFrame:
    """One row: the k farthest from the chord between the curve's ends.

    The curve has one row per tried k, so it is folded into a single row and
    worked on there. Fewer than three points fail; a flat curve gives the first k.
    """
    row = curve.agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("k").cast("double").alias("x"), F.col("inertia").cast("double").alias("y")))
        ).alias("p"),
        F.min("inertia").alias("low"),
        F.max("inertia").alias("high"),
    )
    first, last = F.get("p", 0), F.element_at("p", -1)
    x_range, y_range = last["x"] - first["x"], F.col("high") - F.col("low")
    run = F.lit(1.0)
    rise = (last["y"] - first["y"]) / y_range

    def away(p: Column) -> Column:
        x = (p["x"] - first["x"]) / x_range
        y = (p["y"] - first["y"]) / y_range
        return F.struct((F.abs(run * y - rise * x) / F.sqrt(run * run + rise * rise)).alias("d"), (-p["x"]).alias("k"))

    chosen = (
        F.when(F.size("p") < 3, F.raise_error(F.lit("elbow selection needs at least three k values")).cast("double"))
        .when((x_range == 0) | (y_range == 0), first["x"])
        .otherwise(-F.array_max(F.transform("p", away))["k"])
    )
    return row.select(chosen.cast("int").alias("k"))


def fit_kmeans(
    vectors: DataFrame, k: int, n_init: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4
) -> tuple[DataFrame, float]:
    """Best of ``n_init`` seeded fits: (centre table, inertia).

    Clusters are numbered by their smallest member id, because the numbers a
    fit hands out depend on its seed.
    """
    n = vectors.count()
    if not 1 <= k <= n:
        raise ValueError(f"k must lie between 1 and the number of rows ({n}), got {k}")
    return numbered_centres(vectors, *fit_grid(vectors, [k], n_init, seed, max_iter, tol)[k])


def numbered_centres(vectors: DataFrame, inertia: float, found: list[list[float]]) -> tuple[DataFrame, float]:
    """(centre table, inertia) of a fit, clusters numbered by their smallest member id."""
    spark = vectors.sparkSession
    schema = "cluster_id INT, embedding ARRAY<DOUBLE>"
    near = nearest_centres(vectors.select("id", "embedding"), spark.createDataFrame(list(enumerate(found)), schema))
    order = F.struct(numeric_id(F.col("id")).isNull(), numeric_id(F.col("id")), F.col("id"))
    firsts = near.groupBy(F.get("neighbours", 0)["cluster_id"].alias("c")).agg(F.min(order).alias("o"))
    numbered = [(new, found[row["c"]]) for new, row in enumerate(firsts.orderBy("o").collect())]
    return spark.createDataFrame(numbered, schema), inertia


def fit_grid(
    vectors: DataFrame, k_values: Sequence[int], n_init: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4
) -> dict[int, tuple[float, list[list[float]]]]:
    """(inertia, centres) of the best full fit per k; all fits share the scans of the vectors."""
    fits = fit_models(vectors, [(int(k), seed + run) for k in k_values for run in range(n_init)], max_iter, tol)
    best: dict[int, tuple[float, list[list[float]]]] = {}
    for fit in fits:
        if fit.k not in best or fit.cost < best[fit.k][0]:
            best[fit.k] = (fit.cost, fit.centres.tolist())
    return best


def top_members(assigned: DataFrame, n: int) -> DataFrame:
    """The n nearest members per cluster with their rank, ties by id.

    The rank filter is also applied before the shuffle, so at most n rows per
    cluster leave each task however large the cluster is.
    """
    nearest_first = Window.partitionBy("cluster").orderBy("distance_to_centroid", *by_numeric_id("id"))
    return assigned.withColumn("member_rank", F.row_number().over(nearest_first)).filter(F.col("member_rank") <= n)


def cluster_summary(assigned: DataFrame, top_n: int = 5) -> DataFrame:
    """(cluster_id, cluster_size, closest_code_id, top_closest_ids) per non-empty cluster.

    Full membership stays in long form: see ``member_segments``.
    """
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    listed = F.array_sort(F.collect_list(F.struct("member_rank", "id")))
    tops = top_members(assigned, top_n).groupBy("cluster").agg(listed.alias("top"))
    return sizes.join(tops, "cluster").select(
        F.col("cluster").alias("cluster_id"),
        "cluster_size",
        F.get("top", 0)["id"].alias("closest_code_id"),
        F.transform("top", lambda m: m["id"]).alias("top_closest_ids"),
    )


def member_segments(assigned: DataFrame, segment_rows: int = 10_000) -> DataFrame:
    """All member ids per cluster as lists of bounded length.

    (cluster_id, segment, member_ids): a large cluster is spread over many
    segments by id hash, so no row and no task has to hold all of it.
    """
    # Written out, so that it can be broadcast and no row is shuffled by cluster alone.
    sizes = staged(
        assigned.groupBy("cluster").agg(F.ceil(F.count("*") / segment_rows).alias("segments")), "segment-counts"
    )
    spread = assigned.join(sizes, "cluster").withColumn("segment", F.pmod(F.xxhash64("id"), F.col("segments")))
    ordered = F.array_sort(F.collect_list(F.struct(numeric_id(F.col("id")).alias("n"), F.col("id"))))
    return spread.groupBy(F.col("cluster").alias("cluster_id"), "segment").agg(
        F.transform(ordered, lambda m: m["id"]).alias("member_ids")
    )
