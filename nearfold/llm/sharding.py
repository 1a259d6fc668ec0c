"""Balanced shards by histogram sort.

Rows are ordered by (hash of the text, id): equal texts stand together and a hash spreads the rest.
Shards are ranges of that order. The splitters are found before any text moves: probes are laid
between the keys already known to bracket each splitter, the exact bytes below every probe are
counted over all partitions, and the brackets shrink until every splitter is within tolerance. Then
the rows are exchanged once, into the cells of the last probes, and numbered.

Law ``bytes``: every splitter lies within the tolerance of its ideal place, or at the nearest row where
one row alone is larger than that. A group of equal texts is split only where a splitter falls into it.

Edge cases: a null text counts 1 byte (like an empty one) and has the checksum of no bytes; a null id
sorts before all ids. Repeated rows are rows like others; equal keys are split by their order in the
cell. Fewer rows than shards leave shards empty; an empty table gives no rows. Input columns named size,
shard or slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfold.session import staged

#: Probes laid at once between a splitter's brackets.
PROBES = 16
#: Permitted distance of a splitter from its ideal place, as a share of a shard.
TOLERANCE = 0.0005
#: Rows that are numbered together in one window.
CELL_ROWS = 20_000

#: Hashes lie in [0, 2 ** 62), so that their differences are longs too.
_HASH_BITS = 62
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1

Key = tuple[int, int]


def _at_least(key: Key) -> Column:
    """Is the row's key (h, i) at or above this one?"""
    h, i = key
    return (F.col("__h") > h) | ((F.col("__h") == h) & (F.col("__i") >= i))


def _shard(splitters: list[Key]) -> Column:
    return sum((_at_least(s).cast("int") for s in splitters), F.lit(0))


def _cell(brackets: list[tuple[Key, Key]]) -> Column:
    """Cut every bracket evenly, by hash, or by id where its rows share one hash; null outside."""
    cell = F.lit(None).cast("long")
    for n, (low, high) in enumerate(brackets):
        if low[0] == high[0]:
            step = (high[1] - low[1]) // (PROBES + 1) + 1
            part = F.floor((F.col("__i").cast("decimal(20,0)") - low[1]) / step)
        else:
            # Rows of the last hash that are below the border fall into the last part.
            part = F.expr(f"(__h - {low[0]}L) div {(high[0] - low[0]) // (PROBES + 1) + 1}L")
        cell = F.when(_at_least(low) & ~_at_least(high), F.lit(n * 100) + part.cast("long")).otherwise(cell)
    return cell


def find_splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[Key]:
    """Keys at which shards 1, 2, ... begin, for staged ``keys`` (__h, __i, size).

    A bracket (low, high, bytes below low) holds the splitter. Its ends are keys of rows. Each round lays probes into all open
    brackets, counts the bytes between them, and keeps the part in which the ideal place lies. A
    bracket is settled once a known border is within tolerance or only rows of one key are left.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = [total * s // shards for s in range(1, shards)]
    slack = max(1, int(total / shards * tolerance))
    end = ((1 << _HASH_BITS), _LOW)
    bracket = {s: ((0, _LOW), end, 0, end) for s in range(len(targets))}  # and the first key that is surely above it
    best: dict[int, tuple[int, Key]] = {}
    open_ = set(bracket)
    while open_:
        cut = sorted({bracket[s][:2] for s in open_})
        key = F.struct("__h", "__i")
        tally = keys.groupBy(_cell(cut).alias("cell")).agg(F.sum("size").alias("bytes"), F.min(key).alias("a"), F.max(key).alias("b"))
        rows = sorted((r["cell"], r["bytes"], tuple(r["a"]), tuple(r["b"])) for r in tally.where("cell is not null").collect())
        for s in list(open_):
            low, high, under, above = bracket[s]
            mine = [r for r in rows if r[0] // 100 == cut.index((low, high))]
            if not mine:  # an empty table
                best[s] = (0, end)
                open_.discard(s)
                continue
            for n, (_, size, first, last) in enumerate(mine):
                after = mine[n + 1][2] if n + 1 < len(mine) else above
                best[s] = min(best.get(s, (total + 1, end)), (abs(under - targets[s]), first), (abs(under + size - targets[s]), after))
                if under + size >= targets[s] or n + 1 == len(mine):
                    bracket[s] = (first, (last[0], min(last[1], _HIGH - 1) + 1), under, after)
                    if best[s][0] <= slack or first == last:
                        open_.discard(s)
                    break
                under += size
    return [best[s][1] for s in range(len(targets))]


def key_columns(text_col: str = "text", id_col: str = "doc_id") -> dict[str, Column]:
    """The sort key (__h, __i) and the size of a row."""
    return {
        "__h": F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 64 - _HASH_BITS),
        "__i": F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)),
        "size": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1,
    }


def shard_keyed(rows: DataFrame, keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """``rows`` (__h, __i, size and any columns) with ``shard`` and ``slot``; ``keys`` is their staged key table.

    A cell is a stretch of the order inside one shard, of about CELL_ROWS rows; a text with more copies
    than that is cut further by id. Rows are exchanged by cell, numbered in it and shifted by the rows
    of the shard's cells before it.
    """
    splitters = find_splitters(keys, shards, tolerance)
    total = keys.count()
    bits = min(40, max(0, (total // CELL_ROWS).bit_length()))
    hot = (
        keys.groupBy("__h").agg(F.count("*").alias("n"), F.min("__i").alias("__a"), F.max("__i").alias("__b")).where(F.col("n") > CELL_ROWS)
        .select(F.col("__h").alias("__hot"), "__a", ((F.col("__b").cast("double") - F.col("__a") + 1) / F.ceil(F.col("n") / CELL_ROWS)).alias("__w"))
    )

    # Both small tables are written, so that their known size lets them be broadcast and no text moves for them.
    hot = staged(hot, "hot-texts")

    def celled(df: DataFrame) -> DataFrame:
        sub = F.coalesce(F.floor((F.col("__i").cast("double") - F.col("__a")) / F.col("__w")), F.lit(0)).cast("long")
        place = F.shiftright("__h", _HASH_BITS - bits)
        # Within a stretch of hashes the rows below, of and above a hot hash are cells of their own.
        joined = df.join(hot, df["__h"] == F.col("__hot"), "left")
        return joined.withColumns({"shard": _shard(splitters), "__p": place, "__t": F.when(F.col("__hot").isNotNull(), F.col("__h")), "__s": sub}).drop("__hot", "__a", "__w")

    cell = ["shard", "__p", "__t", "__s"]
    sized = celled(keys).groupBy(*cell).agg(F.count("*").alias("n"))
    by_shard = Window.partitionBy("shard").orderBy("__p", F.col("__t").asc_nulls_first(), "__s")
    starts = staged(sized.withColumn("__start", F.sum("n").over(by_shard) - F.col("n")).drop("n"), "shard-cells")
    in_cell = Window.partitionBy(*cell).orderBy("__h", "__i")
    numbered = celled(rows).withColumn("__n", F.row_number().over(in_cell))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in cell]
    return (
        numbered.alias("r").join(starts.alias("s"), on)
        .select(*(F.col(f"r.`{c}`") for c in numbered.columns if c != "slot"), (F.col("s.__start") + F.col("r.__n") - 1).alias("slot"))
        .drop("__p", "__t", "__s", "__n")
    )


def shard_by_bytes(rows: DataFrame, shards: int, text_col: str = "text", id_col: str = "doc_id", tolerance: float = TOLERANCE) -> DataFrame:
    """The rows, all columns, with ``size``, ``shard`` (from 0) and ``slot`` (gapless in its shard)."""
    key = key_columns(text_col, id_col)
    keys = staged(rows.select(*(c.alias(n) for n, c in key.items())), "shard-keys")
    return shard_keyed(rows.withColumns(key), keys, shards, tolerance).drop("__h", "__i")
