"""Lookups by a key that may be very uneven on the large side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most keys that are told apart as hot, and counters of the summary per such key.
MOST_HOT, COUNTERS_PER_KEY = 4096, 16


@dataclass(frozen=True)
class HotKeys:
    """Keys that hold more rows than an even share of a partition, with the parts each is split into.

    At most as many as there are partitions, so the table can always be broadcast.
    """

    kind: T.DataType
    parts: tuple[tuple[object, int], ...]

    def table(self, large: DataFrame) -> DataFrame:
        schema = T.StructType([T.StructField("hot_key", self.kind), T.StructField("hot_parts", T.IntegerType())])
        return F.broadcast(large.sparkSession.createDataFrame(list(self.parts), schema))


def hot_keys(df: DataFrame, key: str) -> HotKeys:
    """One pass that only reads the key: a mergeable summary of frequent items beside the number of rows.

    A NULL counts as a key, since rows without a key meet in one partition too. The summary's counts may be
    a little high or low; they decide how rows are spread, never what is joined.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(2, min(MOST_HOT, partitions))
    summary = F.expr(f"approx_top_k(`{key}`, {most}, {most * COUNTERS_PER_KEY})")
    rows, top = df.agg(F.count("*"), summary).head()
    share = rows / most
    kind = df.schema[key].dataType
    return HotKeys(kind, tuple((item["item"], -int(-item["count"] // share)) for item in top or () if item["count"] > share))


def spread_join(large: DataFrame, lookup: DataFrame, key: str, spread_by: str, hot: HotKeys | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Left join on ``key`` (and the columns ``also``) in which hot keys are split and all others join as they are.

    ``spread_by`` is a column of ``large`` that varies within a key. ``hot`` may come from another table whose
    keys are spread alike; otherwise ``large`` is read once more to find them. Rows of ``lookup`` are
    repeated once per part of their key, that is only for hot ones. Which side is broadcast is left to Catalyst.
    """
    hot = hot if hot is not None else hot_keys(large, key)
    if not hot.parts:
        return large.join(lookup, [key, *also], "left")
    table = hot.table(large)

    def with_parts(df: DataFrame) -> DataFrame:
        return df.join(table, df[key].eqNullSafe(table["hot_key"]), "left").drop("hot_key")

    part: Column = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("hot_parts")).cast("int"), F.lit(0))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("hot_parts", F.lit(1)) - 1))
    salted = with_parts(large).withColumn("hot_part", part).drop("hot_parts")
    repeated = with_parts(lookup).withColumn("hot_part", every).drop("hot_parts")
    return salted.join(repeated, [key, *also, "hot_part"], "left").drop("hot_part")
