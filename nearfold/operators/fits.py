"""Many k-means fits at once: each scan of the vectors serves every fit that is still open.

Start: per seed a pool of candidates is drawn from all rows in proportion to their squared distance to the pool so
far (a few steps of twice the largest k, by a hash of id and seed, so that a repeated task draws the same rows).
Every candidate is weighted by the rows nearest to it, and the k centres of a fit are chosen from its
seed's pool by weighted seeding. So the start takes the same number of scans for any number of fits.

Rounds: the centres of all open fits stand in one matrix. A task measures its rows against it tile by tile and
sends one mean, count and cost per centre, however many rows it has; Spark merges these. A fit whose centres no longer
move is closed with the centres and the cost of that very scan and leaves the matrix. Fits share a scan while their
centres take up no more than a block (``BLOCK_BYTES``); beyond that a round takes one scan per block.

Scans are many, so each is kept cheap: vectors are kept as the bytes of their doubles, which reach a task as they are and
not number by number, in memory as far as there is room, and the means of the tasks are merged in as few tasks as their
size asks for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.vectors import as_doubles
from nearfold.operators.nearest import BLOCK_BYTES, _matrix, tiles
from nearfold.session import spread, staged

#: Drawing steps of the candidate pools, and most of them when a pool is still smaller than k.
STEPS, MOST_STEPS = 2, 12
#: Bytes of centres merged in one task.
MERGE_BYTES = 256 * 1024
#: Movement below which a centre counts as unmoved; sums differ by rounding with the order of tasks.
STILL = 1e-9


@dataclass
class Fit:
    """One fit; ``cost`` is the sum of squared distances of all rows to ``centres``."""

    k: int
    seed: int
    centres: np.ndarray
    cost: float = np.inf
    rounds: int = 0
    closed: bool = field(default=False, repr=False)


def rough_squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product; rounding may leave tiny negative values, which become 0."""
    squares = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", centres, centres) - 2.0 * (x @ centres.T)
    return np.maximum(squares, 0.0, out=squares)


def _least(x: np.ndarray, matrix: np.ndarray, at: Sequence[int]) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """(part, rows, nearest row of the matrix, squared distance) per tile of x and part at[i]:at[i + 1] of the matrix."""
    for tile in tiles(len(x), len(matrix)):
        squares = rough_squares(x[tile], matrix)
        for part, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            label = squares[:, a:b].argmin(axis=1)
            yield part, tile, label + a, squares[np.arange(len(label)), label + a]


def _packed(vectors: DataFrame) -> DataFrame:
    """(key, embedding), each vector as the bytes of its doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) * flat.itemsize
            bounds = np.concatenate(([0], ends)).astype(np.int32)
            known = column.is_valid().to_numpy(zero_copy_only=False)
            buffers = [pa.py_buffer(np.packbits(known, bitorder="little")), pa.py_buffer(bounds), pa.py_buffer(flat)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(column), buffers)], ["key", "embedding"])

    return vectors.mapInArrow(run, "key long, embedding binary")


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("embedding"))
    width = 8 * dim
    if column.null_count or (pc.binary_length(column).to_numpy() != width).any():
        raise ValueError(f"every vector must have {dim} dimensions")
    if not len(column):
        return np.empty((0, dim))
    fixed = column.cast(pa.binary(width))
    return np.frombuffer(fixed.buffers()[1], np.float64, len(fixed) * dim, fixed.offset * width).reshape(-1, dim)


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A draw from (0, 1) per key, the same wherever and whenever it is made."""
    v = keys.view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
    v ^= v >> np.uint64(31)
    return ((v >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _stack(parts: Sequence[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    return np.concatenate(parts), [0, *np.cumsum([len(p) for p in parts]).tolist()]


def _pool_costs(vectors: DataFrame, pools: list[np.ndarray]) -> list[float]:
    """Per pool, the sum over all rows of the squared distance to the nearest candidate."""
    shared = vectors.sparkSession.sparkContext.broadcast(_stack(pools))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, at = shared.value
        total = np.zeros(len(at) - 1)
        for batch in batches:
            for part, _, _, squares in _least(_vectors(batch, matrix.shape[1]), matrix, at):
                total[part] += squares.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["part", "cost"])

    rows = vectors.mapInArrow(run, "part long, cost double").groupBy("part").agg(F.sum("cost")).collect()
    return [cost for _, cost in sorted(tuple(r) for r in rows)]


def _drawn(vectors: DataFrame, pools: list[np.ndarray], costs: list[float], seeds: Sequence[int], wanted: int, step: int) -> list[np.ndarray]:
    """The pools and about ``wanted`` more rows each, far ones more likely."""
    shared = vectors.sparkSession.sparkContext.broadcast((*_stack(pools), costs))
    seeds = list(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, at, costs = shared.value
        for batch in batches:
            x = _vectors(batch, matrix.shape[1])
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy()
            for part, tile, _, squares in _least(x, matrix, at):
                if costs[part] > 0:
                    taken = np.flatnonzero(_uniform(keys[tile], seeds[part] * 1009 + step) * costs[part] < wanted * squares)
                    flat = x[tile][taken]
                    bounds = np.arange(0, flat.size + 1, matrix.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(taken), part)), pa.array(keys[tile][taken]), pa.ListArray.from_arrays(bounds, pa.array(flat.ravel()))],
                        ["part", "key", "embedding"],
                    )

    table = vectors.mapInArrow(run, "part long, key long, embedding array<double>").orderBy("part", "key", "embedding").toArrow()
    if not table.num_rows:
        return pools
    new, part = _matrix(table.column("embedding"), pools[0].shape[1]), table.column("part").to_numpy()
    return [np.unique(np.concatenate((pool, new[part == i])), axis=0) if (part == i).any() else pool for i, pool in enumerate(pools)]


def _summed(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and sum of the rows per label below k."""
    members = np.bincount(label, minlength=k)
    if k <= x.shape[1]:
        # With few labels a product with 0s and 1s takes less than bringing the rows into order.
        marks = np.zeros((len(x), k))
        marks[np.arange(len(x)), label] = 1.0
        return members, marks.T @ x
    found, sums = np.flatnonzero(members), np.zeros((k, x.shape[1]))
    if len(found):
        sums[found] = np.add.reduceat(x[np.argsort(label, kind="stable")], (np.cumsum(members) - members)[found], axis=0)
    return members, sums


def _scan(vectors: DataFrame, parts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """One pass: members, their mean and the cost, per part of stacked centres. Centres without members keep their place."""
    matrix, at = _stack(parts)
    shared = vectors.sparkSession.sparkContext.broadcast((matrix, at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, at = shared.value
        sums, members, costs = np.zeros_like(matrix), np.zeros(len(matrix), dtype=np.int64), np.zeros(len(matrix))
        for batch in batches:
            x = _vectors(batch, matrix.shape[1])
            for part, tile, label, squares in _least(x, matrix, at):
                a, b = at[part : part + 2]
                n, total = _summed(x[tile], label - a, b - a)
                sums[a:b] += total
                members[a:b] += n
                # With a centre that has members, as only these are sent.
                costs[a + n.argmax()] += squares.sum()
        used = np.flatnonzero(members)
        means = sums[used] / members[used][:, None]
        bounds = np.arange(0, means.size + 1, matrix.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(members[used]), pa.array(costs[used]), pa.ListArray.from_arrays(bounds, pa.array(means.ravel()))],
            ["centre", "n", "cost", "mean"],
        )

    partial = vectors.mapInArrow(run, "centre long, n long, cost double, mean array<double>")
    partial = partial.repartition(1 + matrix.nbytes // MERGE_BYTES, "centre")
    mean = vector_to_array(Summarizer.mean(array_to_vector("mean"), F.col("n").cast("double")))
    # As many rows as there are centres in the matrix, which fits one block.
    table = partial.groupBy("centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), mean.alias("mean")).toArrow()
    where = table.column("centre").to_numpy()
    members, costs, means = np.zeros(len(matrix), dtype=np.int64), np.zeros(len(matrix)), matrix.copy()
    members[where], costs[where] = table.column("n").to_numpy(), table.column("cost").to_numpy()
    filled = table.column("n").to_numpy() > 0
    if filled.any():
        means[where[filled]] = _matrix(table.column("mean"), matrix.shape[1])[filled]
    cut = list(zip(at, at[1:], strict=False))
    return [members[a:b] for a, b in cut], [means[a:b] for a, b in cut], [float(costs[a:b].sum()) for a, b in cut]


def choose(pool: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k candidates by weighted seeding: each next one in proportion to weight times squared distance."""
    draw = np.random.default_rng([seed, k])
    taken = [int(draw.choice(len(pool), p=weight / weight.sum()))]
    least = rough_squares(pool, pool[taken])[:, 0]
    while len(taken) < k:
        chance = weight * least
        # Fewer different candidates than k: the rest repeat one, and stay without members.
        taken.append(int(draw.choice(len(pool), p=chance / chance.sum())) if chance.sum() > 0 else taken[0])
        least = np.minimum(least, rough_squares(pool, pool[taken[-1:]])[:, 0])
        least[taken] = 0.0
    return pool[taken]


def _started(vectors: DataFrame, models: Sequence[tuple[int, int]]) -> list[Fit]:
    seeds = sorted({seed for _, seed in models})
    most = max(k for k, _ in models)
    firsts = vectors.agg(*[F.min_by("embedding", F.xxhash64("key", F.lit(seed))).alias(f"s{i}") for i, seed in enumerate(seeds)]).head()
    pools = [np.frombuffer(first, dtype=np.float64)[None] for first in firsts]
    for step in range(MOST_STEPS):
        if step >= STEPS and min(map(len, pools)) >= most:
            break
        costs = _pool_costs(vectors, pools)
        if not any(costs):
            break
        pools = _drawn(vectors, pools, costs, seeds, 2 * most, step)
    weights = _scan(vectors, pools)[0]
    return [Fit(k, seed, choose(pools[i], weights[i].astype(np.float64), k, seed)) for k, seed in models for i in [seeds.index(seed)]]


def _waves(fits: list[Fit]) -> Iterator[list[Fit]]:
    """Fits that share a scan: as many as a block holds, one at least."""
    wave: list[Fit] = []
    size = 0
    for fit in fits:
        if wave and size + fit.centres.nbytes > BLOCK_BYTES:
            yield wave
            wave, size = [], 0
        wave.append(fit)
        size += fit.centres.nbytes
    if wave:
        yield wave


def fit_models(vectors: DataFrame, models: Sequence[tuple[int, int]], max_iter: int = 300, tol: float = 1e-4) -> list[Fit]:
    """One fit per (k, seed) of ``models`` over ``vectors`` (id, embedding), which must not be empty.

    A fit ends when no centre moves by more than ``tol``, or after ``max_iter`` rounds.
    """
    narrow = staged(_packed(vectors.select(F.xxhash64("id").alias("key"), as_doubles(F.col("embedding")).alias("embedding"))), "fit-vectors")
    wide = spread(narrow)
    if wide is not narrow:
        narrow = staged(wide, "fit-vectors")
    narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _settled(narrow, _started(narrow, models), max_iter, tol)
    finally:
        narrow.unpersist()


def _settled(narrow: DataFrame, fits: list[Fit], max_iter: int, tol: float) -> list[Fit]:
    """The fits after their last rounds."""
    open_ = fits
    while open_:
        for wave in _waves(open_):
            _, moved, costs = _scan(narrow, [f.centres for f in wave])
            for fit, centres, cost in zip(wave, moved, costs, strict=True):
                fit.cost, fit.rounds = cost, fit.rounds + 1
                step = float(np.sqrt(((centres - fit.centres) ** 2).sum(axis=1)).max())
                fit.closed = step <= max(tol, STILL) or fit.rounds > max_iter
                if not fit.closed:
                    fit.centres = centres
        open_ = [f for f in open_ if not f.closed]
    return fits
