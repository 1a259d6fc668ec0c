"""Distances from many vectors to a set of centres.

The centres are cut into blocks of a fixed size, in ascending order of their ids. Each block is
broadcast and meets every sample where it lies: a narrow step merges the block's k nearest into the
sample's best so far. One block is the ordinary case, many are a longer chain of the same steps;
nothing is grouped or joined, so ids may be missing or repeated. Blocks of many centres carry a metric
index, which skips groups of centres that are too far to matter. Rows are worked on in tiles, so no array
in a task exceeds a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.operators import metric_index
from nearfold.operators.metric_index import Index
from nearfold.operators.scaling import Scaler
from nearfold.session import staged

NEIGHBOURS = T.ArrayType(
    T.StructType(
        [
            T.StructField("rank", T.IntegerType()),
            T.StructField("cluster_id", T.IntegerType()),
            T.StructField("distance", T.DoubleType()),
        ]
    )
)

#: Bytes of centre vectors in a block, and of the largest array a task builds over rows and centres.
BLOCK_BYTES = 32 * 1024 * 1024
TILE_BYTES = 32 * 1024 * 1024
#: Blocks after which the best so far is written to the shared folder.
BLOCKS_PER_STAGE = 8


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of one Arrow batch as a float64 matrix, without a Python loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if flat.size != len(column) * dim:
        raise ValueError(f"every vector must have {dim} dimensions")
    return flat.reshape(-1, dim)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact differences, one centre at a time, so that equal points give 0."""
    out = np.empty((x.shape[0], centres.shape[0]))
    for j, centre in enumerate(centres):
        diff = x - centre
        out[:, j] = np.einsum("ij,ij->i", diff, diff)
    return out


def tiles(rows: int, centres: int) -> Iterator[slice]:
    """Stretches of rows whose matrix against the centres stays within TILE_BYTES."""
    step = max(1, TILE_BYTES // (8 * max(centres, 1)))
    for begin in range(0, rows, step):
        yield slice(begin, min(begin + step, rows))


def _best(x: np.ndarray, centres: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and distances of the k nearest centres, ties to the lower index.

    A matrix product rules out all that cannot be among the k nearest, using a
    bound on its rounding error; only the rest are measured exactly and ordered.
    """
    n, k = x.shape[0], min(k, centres.shape[0])
    index, squared = np.empty((n, k), dtype=np.int64), np.empty((n, k))
    cc = np.einsum("ij,ij->i", centres, centres)[None, :]
    for tile in tiles(n, centres.shape[0]):
        part = x[tile]
        xx = np.einsum("ij,ij->i", part, part)[:, None]
        rough = xx + cc - 2.0 * (part @ centres.T)
        slack = 8.0 * np.finfo(np.float64).eps * (x.shape[1] + 4) * (xx + cc.max())
        cut = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + 2.0 * slack
        rows, cols = np.nonzero(rough <= cut)
        exact = np.empty(len(rows))
        step = max(1, TILE_BYTES // (8 * x.shape[1]))
        for begin in range(0, len(rows), step):
            few = slice(begin, begin + step)
            diff = part[rows[few]] - centres[cols[few]]
            exact[few] = np.einsum("ij,ij->i", diff, diff)
        order = np.lexsort((cols, exact, rows))
        first = np.searchsorted(rows, np.arange(len(part)))
        chosen = order[first[:, None] + np.arange(k)]
        index[tile], squared[tile] = cols[chosen], exact[chosen]
    return index, np.sqrt(squared)


def _neighbour_array(ids: np.ndarray, dist: np.ndarray) -> pa.Array:
    n, k = ids.shape
    rank = np.tile(np.arange(1, k + 1, dtype=np.int32), n)
    entry = pa.StructArray.from_arrays(
        [pa.array(rank), pa.array(ids.ravel().astype(np.int32)), pa.array(dist.ravel())],
        fields=[
            pa.field("rank", pa.int32()),
            pa.field("cluster_id", pa.int32()),
            pa.field("distance", pa.float64()),
        ],
    )
    return pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), entry)


#: A block as it is broadcast: ids ascending, vectors, their index if any.
Block = tuple[np.ndarray, np.ndarray, Index | None]


def _merged(so_far: pa.Array | None, x: np.ndarray, block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest among a block and the best of the blocks before it."""
    ids, vectors, index = block
    known_ids = known = None
    if so_far is not None:
        flat = so_far.flatten()
        known_ids = flat.field("cluster_id").to_numpy(zero_copy_only=False).reshape(len(x), -1)
        known = flat.field("distance").to_numpy(zero_copy_only=False).reshape(len(x), -1)
    if index is None or not np.isfinite(x).all():
        order, dist = _best(x, vectors, k)
    else:
        bound = known[:, k - 1] if known is not None and known.shape[1] >= k else None
        order, dist, _ = metric_index.nearest(x, vectors, index, k, _best, bound)
    near = ids[order]
    if known is not None:
        # Places that the bound left empty are infinitely far and never among the first k.
        near, dist = np.hstack((known_ids, near)), np.hstack((known, dist))
        chosen = np.lexsort((near, dist), axis=1)[:, :k]
        near, dist = np.take_along_axis(near, chosen, axis=1), np.take_along_axis(dist, chosen, axis=1)
    return near, dist


class Centres:
    """A block of centres: ids ascending, vectors already scaled, an index if there are many."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scaler: Scaler | None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.mean = np.asarray(scaler.mean) if scaler else None
        self.deviation = np.asarray(scaler.deviation) if scaler else None

    @cached_property
    def block(self) -> Block:
        return self.ids, self.vectors, metric_index.build(self.vectors)


def centre_blocks(
    centres: DataFrame | Centres, scaler: Scaler | None = None, id_col: str = "cluster_id", vector_col: str = "embedding"
) -> Iterator[Centres]:
    """The centres block by block, in ascending order of ids; the driver holds one block at a time.

    A row limit bounds what is fetched, so for a single block one job both checks and collects.
    """
    if isinstance(centres, Centres):
        yield centres
        return
    rows = centres.select(F.col(id_col).cast("int").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    if scaler is not None:
        dim = scaler.dim
    else:
        first = rows.head()
        if first is None:
            raise ValueError("no centres to measure against")
        dim = len(first[1])
    most = max(1, BLOCK_BYTES // (8 * dim))
    found = rows.limit(most + 1).toArrow()
    if found.num_rows == 0:
        raise ValueError("no centres to measure against")
    if found.num_rows <= most:
        parts = [found]
    else:
        rows = staged(rows, "centres")
        n = -(-rows.count() // most)
        # Borders of about equal shares; a block that still comes out larger is only a larger broadcast.
        borders = sorted({int(b) for b in rows.approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n)})
        low = [None, *borders]
        high = [*borders, None]
        kept = [
            (F.lit(True) if a is None else F.col("id") >= a) & (F.lit(True) if b is None else F.col("id") < b)
            for a, b in zip(low, high, strict=True)
        ]
        parts = (rows.filter(k).toArrow() for k in kept)
    for part in parts:
        if part.num_rows:
            vectors = _matrix(part.column(1), dim)
            if scaler is not None:
                vectors = (vectors - np.asarray(scaler.mean)) / np.asarray(scaler.deviation)
            yield Centres(part.column(0).to_numpy(), vectors, scaler)


#: Works on one Arrow batch: (scaled vectors, block, the batch) to added columns.
Kernel = Callable[[np.ndarray, Block, pa.RecordBatch], list[tuple[str, pa.Array]]]


def _shipped(centres: Centres) -> tuple:
    """Plain arrays, because broadcast values are read back before any package code is."""
    ids, vectors, index = centres.block
    return ids, vectors, index and tuple(index), centres.mean, centres.deviation


def received(shipped: tuple) -> tuple[Block, np.ndarray | None, np.ndarray | None]:
    ids, vectors, index, mean, deviation = shipped
    return (ids, vectors, index and Index(*index)), mean, deviation


def map_vectors(
    samples: DataFrame, centres: Centres, kernel: Kernel, added: list[T.StructField], vector_col: str = "embedding", kept: list[str] | None = None
) -> DataFrame:
    """Run ``kernel`` over Arrow batches of samples against a broadcast block.

    The columns ``kept`` are passed through, so this is a narrow step that also works on a
    streaming table.
    """
    names = [c for c in samples.columns if kept is None or c in kept]
    schema = T.StructType([samples.schema[c] for c in names] + added)
    shared = samples.sparkSession.sparkContext.broadcast(_shipped(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, mean, deviation = received(shared.value)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch.column(batch.schema.get_field_index(vector_col)), block[1].shape[1])
            extra = kernel(x if mean is None else (x - mean) / deviation, block, batch)
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                arrays + [a for _, a in extra], names=names + [n for n, _ in extra]
            )

    return samples.mapInArrow(run, schema)


SO_FAR = "__neighbours"


def all_but_last(samples: DataFrame, centres: DataFrame | Centres, k: int, scaler: Scaler | None, vector_col: str) -> tuple[DataFrame, Centres]:
    """Samples with the k nearest of every block but the last (a column SO_FAR if there are any), and the last block."""

    def kernel(x: np.ndarray, block: Block, batch: pa.RecordBatch) -> list[tuple[str, pa.Array]]:
        return [(SO_FAR, _neighbour_array(*_merged(so_far(batch), x, block, k)))]

    last = None
    own = samples.columns
    for number, block in enumerate(centre_blocks(centres, scaler)):
        if last is not None:
            samples = map_vectors(samples, last, kernel, [T.StructField(SO_FAR, NEIGHBOURS)], vector_col, own)
            if number % BLOCKS_PER_STAGE == 0:
                samples = staged(samples, "neighbours-so-far")
        last = block
    return samples, last


def so_far(batch: pa.RecordBatch) -> pa.Array | None:
    at = batch.schema.get_field_index(SO_FAR)
    return None if at < 0 else batch.column(at)


def nearest_centres(
    samples: DataFrame,
    centres: DataFrame | Centres,
    k: int = 1,
    scaler: Scaler | None = None,
    id_col: str = "id",
    vector_col: str = "embedding",
    keep_vector: bool = False,
) -> DataFrame:
    """Add ``neighbours``: the k nearest centres by (distance, cluster_id)."""
    own = [c for c in samples.columns if keep_vector or c != vector_col]
    samples, last = all_but_last(samples, centres, k, scaler, vector_col)

    def kernel(x: np.ndarray, block: Block, batch: pa.RecordBatch) -> list[tuple[str, pa.Array]]:
        return [("neighbours", _neighbour_array(*_merged(so_far(batch), x, block, k)))]

    return map_vectors(samples, last, kernel, [T.StructField("neighbours", NEIGHBOURS)], vector_col, own)


def all_distances(
    samples: DataFrame, centres: DataFrame | Centres, id_col: str = "id", vector_col: str = "embedding", scaler: Scaler | None = None
) -> DataFrame:
    """Long form (id, cluster_id, distance) against every centre, block by block and tile by tile."""
    narrow = samples.select(id_col, vector_col)
    schema = T.StructType([narrow.schema[id_col], T.StructField("cluster_id", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    found = None
    for block in centre_blocks(centres, scaler):
        shared = samples.sparkSession.sparkContext.broadcast((block.ids, block.vectors, block.mean, block.deviation))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors, mean, deviation = shared.value
            for batch in batches:
                x = _matrix(batch.column(1), vectors.shape[1])
                x = x if mean is None else (x - mean) / deviation
                for tile in tiles(len(x), len(ids)):
                    dist = np.sqrt(squared_distances(x[tile], vectors))
                    who = pa.array(np.repeat(np.arange(tile.start, tile.stop), len(ids)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(who), pa.array(np.tile(ids.astype(np.int32), dist.shape[0])), pa.array(dist.ravel())],
                        names=schema.names,
                    )

        part = narrow.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found
