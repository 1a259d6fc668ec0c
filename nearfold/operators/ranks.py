"""Exact order statistics that never sort a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfold.session import staged

def group_percentile(df: DataFrame, group: str, value: str, q: float, name: str) -> DataFrame:
    """Linear-interpolated ``q`` quantile of ``value`` per group, exactly.

    Equal values of a group are tallied before the shuffle. The tally is range-partitioned by
    (group, value), so a large group spans many partitions; sums per group and partition tell
    which of them hold the two wanted ranks, and only these are put in order.
    """
    v = F.col(value).cast("double")
    known = df.select(F.col(group).alias("g"), v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    tally = known.groupBy("g", "v").agg(F.count("*").alias("n"))
    # Written out, because the partition numbers must not change between the two uses.
    ranged = staged(tally.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("g", "part").agg(F.sum("n").alias("n"))
    in_group = Window.partitionBy("g")
    before = in_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    target = (F.sum("n").over(in_group) - 1) * F.lit(float(q))
    placed = sums.select("g", "part", "n", target.alias("target"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    wanted = placed.filter(
        (F.col("base") <= F.ceil("target")) & (F.floor("target") < F.col("base") + F.col("n"))
    ).select(F.col("g").alias("wg"), F.col("part").alias("wpart"), "target", "base")
    running = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    # Null-safe, as rows without a group are a group.
    same = F.col("g").eqNullSafe(F.col("wg")) & (F.col("part") == F.col("wpart"))
    ranked = ranged.join(wanted, same).withColumn("seen", F.col("base") + F.coalesce(F.sum("n").over(running), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("seen") <= rank) & (rank < F.col("seen") + F.col("n")), F.col("v")))

    ends = ranked.groupBy("g", "target").agg(at(F.floor("target")).alias("low"), at(F.ceil("target")).alias("high"))
    share = F.col("target") - F.floor("target")
    return ends.select(F.col("g").alias(group), (F.col("low") + (F.col("high") - F.col("low")) * share).alias(name))


def hash_split(df: DataFrame, id_col: str, ratio: float, seed: int) -> DataFrame:
    """Add ``split``: the rows with the smallest seeded hash go to ``validation``.

    Exactly min(n - 1, max(1, floor(n * ratio))) rows do, none when the ratio
    is 0. The cut is found by counting hash prefixes and ordering one prefix
    only, so no global sort takes place and the final step is a plain filter.
    """
    if not 0 <= ratio < 1:
        raise ValueError("the validation ratio must be at least 0 and below 1")
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    marked = df.withColumn("split_mark", F.concat_ws(":", mark, F.col(id_col).cast("string")))
    if ratio == 0:
        return marked.withColumn("split", F.lit("train")).drop("split_mark")
    prefix = F.substring("split_mark", 1, 4)
    counts = marked.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"))
    # At most 16**4 rows, whatever the table holds.
    running = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy()
    wanted = F.least(
        F.col("total") - 1, F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(float(ratio))))
    )
    cell = (
        counts.withColumn("seen", F.sum("n").over(running))
        .withColumn("total", F.sum("n").over(total))
        .withColumn("wanted", wanted)
        .filter((F.col("wanted") > 0) & (F.col("seen") >= F.col("wanted")))
        .orderBy("prefix")
        .select("prefix", (F.col("wanted") - F.col("seen") + F.col("n")).cast("int").alias("take"))
        .head()
    )
    if cell is None:
        return marked.withColumn("split", F.lit("train")).drop("split_mark")
    last = (
        marked.filter(prefix == cell["prefix"]).select("split_mark").orderBy("split_mark").limit(cell["take"])
        .agg(F.max("split_mark")).head()[0]
    )
    split = F.when(F.col("split_mark") <= last, "validation").otherwise("train")
    return marked.withColumn("split", split).drop("split_mark")
