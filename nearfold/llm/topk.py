"""Exact top-k by inner product: no-random-access aggregation over sorted lists, block by block.

Every dimension of a block of candidates is a list sorted by value. A query with a positive weight
reads it from the top, one with a negative weight from the bottom; all lists are read in step. After
each stretch a candidate's score lies between a lower bound (what was read, plus the list's far end
for the rest) and an upper bound (what was read, plus the value last read for the rest). A candidate
whose upper bound is under the k-th best lower bound cannot qualify; when few are left, or the lists
are read, the final scores of those left are resolved exactly.

Edge cases: vectors that are null, or hold a null or non-finite component, take no part; vectors of
another length than the query's are no candidates of it. A query id that occurs in several rows is
one query (its smallest vector); repeated candidate rows are candidates each. Ties go to the smaller
id. Fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates, and queries that meet it in one task.
BLOCK_ROWS, QUERY_ROWS = 8192, 2048
#: Queries whose bounds are held at once: TILE x BLOCK_ROWS values.
TILE = 128
#: How far the lists are read before bounds are compared, as shares of their length.
STRETCHES = (1 / 8, 1 / 2)

_RESULT = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): every component as floor(scale * x); unusable vectors are left out."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = F.col("w").isNotNull() & F.forall("w", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), wide.alias("w"))
        .where(usable & F.col("vec_id").isNotNull())
        .select("vec_id", F.transform("w", lambda x: F.floor(x * F.lit(scale))).alias("v"))
    )


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _far_ends(x: np.ndarray, read: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Upper and lower values per entry once ``read`` entries of each list are known, from either end."""
    ordered = np.sort(x, axis=0)
    top, bottom = ordered[-read], ordered[read - 1]  # equal values are read to the end of their run
    upper_top, lower_top = np.maximum(x, top), np.where(x >= top, x, ordered[0])
    upper_bottom, lower_bottom = np.minimum(x, bottom), np.where(x <= bottom, x, ordered[-1])
    return upper_top, lower_top, upper_bottom, lower_bottom


def block_top_k(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query index, candidate index, score) of each query's k best in this block."""
    n = len(x)
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    exact = np.float64 if reach < 2**53 else object  # beyond that, whole numbers of any size
    bounds = [_far_ends(x.astype(np.float64), max(1, int(n * s))) for s in STRETCHES] if n > 4 * k and q.shape[1] and exact is np.float64 else []
    out: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, len(q), TILE):
        part, ids = q[begin : begin + TILE].astype(exact), q_ids[begin : begin + TILE]
        own = ids[:, None] == x_ids[None, :]
        open_to = ~own
        plus, minus = np.maximum(part, 0), np.minimum(part, 0)
        for upper_top, lower_top, upper_bottom, lower_bottom in bounds:
            lower = plus @ lower_top.T + minus @ lower_bottom.T
            lower[own] = -np.inf
            bar = np.partition(lower, n - k, axis=1)[:, n - k]
            upper = plus @ upper_top.T + minus @ upper_bottom.T
            open_to &= upper >= bar[:, None]
            if open_to.sum(axis=1).max() <= 8 * k:
                break
        left = np.flatnonzero(open_to.any(axis=0))
        scores = part @ x[left].astype(exact).T
        for row in range(len(part)):
            mine = np.flatnonzero(open_to[row, left])
            got = scores[row, mine]
            if len(mine) > k and exact is np.float64:
                bar = np.partition(got, len(got) - k)[len(got) - k]
                mine, got = mine[got >= bar], got[got >= bar]
            got = np.array([int(s) for s in got], dtype=object) if exact is object else got.astype(np.int64)
            best = np.lexsort((x_ids[left[mine]], -got))[:k]
            out.append((np.full(len(best), begin + row), left[mine[best]], got[best]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and candidates given as (vec_id, v array<long>)."""
    rows = candidates.count()
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-rows // BLOCK_ROWS))
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("vec_id", "v", F.size("v").alias("dim"), dealt(groups).alias("g"), grid(blocks).alias("b"))
    right = candidates.select("vec_id", "v", F.size("v").alias("dim"), dealt(blocks).alias("b"), grid(groups).alias("g"))

    def meet(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q_ids, x_ids = q["vec_id"].to_numpy(), x["vec_id"].to_numpy()
        qi, xi, score = block_top_k(_matrix(q["v"], q.num_rows), q_ids, _matrix(x["v"], x.num_rows), x_ids, k)
        score = np.clip(score, -(2**63), 2**63 - 1).astype(np.int64) if score.dtype == object else score
        return pa.table({"query_id": q_ids[qi], "vec_id": x_ids[xi], "score": score})

    found = left.groupBy("dim", "b", "g").cogroup(right.groupBy("dim", "b", "g")).applyInArrow(meet, _RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
