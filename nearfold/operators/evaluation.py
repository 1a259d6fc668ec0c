"""Candidate scores, best-of-k, the gated fallback and its report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.functions.columns import positive
from nearfold.functions.exact import exact_mean
from nearfold.functions.measures import (
    below,
    geomean_pct_from_counts,
    geomean_pct_from_pct,
    raw_reduction_pct,
    reduction_pct,
)
from nearfold.operators.joins import HotKeys, spread_join
from nearfold.operators.ranks import group_percentile
from nearfold.operators.retrieval import NEIGHBOUR_COUNT

# --- fixed values: outcome names and the gate's quantile -----------------------
CENTROID = "centroid"
NCS_OK = "ncs_ok"
PRESET = "preset_fallback"
GATE_QUANTILE = 0.1
# -------------------------------------------------------------------------------

#: A scorer maps candidates (id, code_id, ...) to the same rows plus count and compile_ms.
Scorer = Callable[[DataFrame], DataFrame]


def candidate_scores(candidates: DataFrame, measurements: DataFrame | Scorer) -> DataFrame:
    """Attach ``count`` and ``compile_ms``; an absent or non-positive count is NULL.

    ``measurements`` is either a table keyed by (id, code_id) or a scorer for
    people who measure on the fly.
    """
    if callable(measurements):
        scored = measurements(candidates)
    else:
        # A measurement that says it is not valid is as good as none.
        usable = measurements.filter(F.coalesce("valid", F.lit(True))) if "valid" in measurements.columns else measurements
        table = usable.select(F.col("id").alias("of"), F.col("code_id").alias("with_code"), "count", "compile_ms")
        # Only the id is a join key: what follows by id then needs no further exchange.
        same = F.coalesce(F.col("code_id") == F.col("with_code"), F.lit(False))
        scored = candidates.join(table, (F.col("id") == F.col("of")) & same, "left").drop("of", "with_code")
    return scored.withColumn("count", positive(F.col("count")))


def winner(count: Column, *rest: Column) -> Column:
    """Smallest known count; ties go to whatever sorts first in ``rest``."""
    entry = F.struct(count.alias("count"), *rest)
    return F.min(F.when(count > 0, entry))


def best_of_k(scored: DataFrame, keys: list[str], *carried: str) -> DataFrame:
    """Best candidate, total cost and number tried per key in one map-side combinable aggregate."""
    agg = scored.groupBy(*keys).agg(
        winner(F.col("count"), F.col("cluster_rank"), F.col("seq_rank"), F.col("cluster"), F.col("code_id")).alias("w"),
        F.sum(F.coalesce("compile_ms", F.lit(0.0))).alias("compile_ms"),
        F.count("*").alias("n_tried"),
        *[F.first(c).alias(c) for c in carried],
    )
    return agg.select(
        *keys,
        F.col("w.count").alias("best_count"),
        F.col("w.cluster").alias("best_cluster"),
        F.col("w.code_id").alias("best_code_id"),
        "compile_ms",
        "n_tried",
        *carried,
    )


def best_baseline(*counts: Column) -> Column:
    """Smallest positive of the available baselines; NULL when none is."""
    return F.least(*[positive(c) for c in counts]) if len(counts) > 1 else positive(counts[0])


#: For callers that know of no cluster with an outsized share of the samples.
NONE_HOT = HotKeys(T.IntegerType(), ())


def base_result(
    neighbours: DataFrame, codes: DataFrame, measurements: DataFrame | Scorer, baselines: DataFrame, hot: HotKeys = NONE_HOT, carry: bool = True
) -> DataFrame:
    """Apply the assigned cluster's sequences to every sample and keep the best.

    ``codes`` holds one list per cluster: a single code gives the zero-shot
    result, several give best-of-k. Samples whose cluster has no usable
    sequence stay, with NULLs. Sample ids are unique. ``hot`` clusters are split in the lookups, here
    and below. Without ``carry`` the neighbours are left behind, for the fallback to
    look up for the few samples that need them.
    """
    carried = ["neighbours"] if carry else []
    first = F.get("neighbours", 0)
    assigned = neighbours.select("id", first["cluster_id"].alias("cluster"), *carried)
    offers = spread_join(assigned, codes.withColumnRenamed("cluster_id", "cluster"), "cluster", "id", hot).select(
        "id",
        "cluster",
        *carried,
        F.lit(1).alias("cluster_rank"),
        F.posexplode_outer("codes").alias("seq_rank", "code_id"),
    )
    # A sample has one cluster; grouped by id alone the rows stay where the join has put them, and in its order.
    best = best_of_k(candidate_scores(offers, measurements), ["id"], "cluster", *carried)
    joined = best.join(baselines.select("id", positive(F.col("oz_count")).alias("oz_count")), "id", "left")
    count = F.col("best_count")
    return joined.select(
        "id",
        "cluster",
        "best_code_id",
        "oz_count",
        count.alias("base_count"),
        reduction_pct(count, F.col("oz_count")).alias("reduction_pct"),
        F.when(F.col("oz_count") > 0, count / F.col("oz_count")).alias("ratio"),
        "compile_ms",
        *carried,
    )


def cluster_thresholds(base: DataFrame, quantile: float = GATE_QUANTILE) -> DataFrame:
    """(cluster, delta_p10): the gate is that quantile of the cluster's reductions."""
    return group_percentile(base, "cluster", "reduction_pct", quantile, "delta_p10")


def flag_below(base: DataFrame, thresholds: DataFrame, hot: HotKeys = NONE_HOT) -> DataFrame:
    """Attach the assigned cluster's threshold and the ``below_p10`` flag."""
    joined = spread_join(base, thresholds.select("cluster", "delta_p10"), "cluster", "id", hot)
    return joined.withColumn("below_p10", below(F.col("reduction_pct"), F.col("delta_p10")))


def fallback_candidates(ncs: DataFrame, codes: DataFrame, hot: HotKeys = NONE_HOT) -> DataFrame:
    """Neighbours 2 to 5 of the gated samples with each cluster's sequences."""
    extras = F.filter("neighbours", lambda n: n["rank"].between(2, NEIGHBOUR_COUNT))
    ranked = ncs.select("id", F.explode(extras).alias("n")).select(
        "id", F.col("n.rank").alias("cluster_rank"), F.col("n.cluster_id").alias("cluster")
    )
    return spread_join(ranked, codes.withColumnRenamed("cluster_id", "cluster"), "cluster", "id", hot).select(
        "id", "cluster_rank", "cluster", F.posexplode_outer("codes").alias("seq_rank", "code_id")
    )


def fallback_best(ncs: DataFrame, scored_extras: DataFrame, thresholds: DataFrame, hot: HotKeys = NONE_HOT) -> DataFrame:
    """Winner over the base candidate (rank 0) and the extras, tested against the winner's threshold."""
    base = ncs.select(
        "id",
        F.lit(0).alias("cluster_rank"),
        "cluster",
        F.lit(0).alias("seq_rank"),
        F.col("best_code_id").alias("code_id"),
        F.col("base_count").alias("count"),
        F.lit(0.0).alias("compile_ms"),
        "oz_count",
        F.col("cluster").alias("assigned"),
    )
    extras = scored_extras.select(
        "id",
        "cluster_rank",
        "cluster",
        "seq_rank",
        "code_id",
        "count",
        "compile_ms",
        F.lit(None).cast("bigint").alias("oz_count"),
        F.lit(None).cast("int").alias("assigned"),
    )
    both = base.unionByName(extras)
    picked = both.groupBy("id").agg(
        winner(F.col("count"), F.col("cluster_rank"), F.col("seq_rank"), F.col("cluster"), F.col("code_id")).alias("w"),
        F.sum(F.coalesce("compile_ms", F.lit(0.0))).alias("extras_compile_ms"),
        F.max("oz_count").alias("oz_count"),
        F.max("assigned").alias("assigned"),
    )
    best = picked.select(
        "id",
        F.coalesce("w.cluster", "assigned").alias("best_cluster"),
        F.col("w.code_id").alias("best_code_id"),
        F.col("w.count").alias("best_count"),
        raw_reduction_pct(F.col("w.count"), F.col("oz_count")).alias("best_reduction_pct"),
        "extras_compile_ms",
    )
    return flag_best(best, thresholds, hot)


def flag_best(best: DataFrame, thresholds: DataFrame, hot: HotKeys = NONE_HOT) -> DataFrame:
    gates = thresholds.select(F.col("cluster").alias("best_cluster"), F.col("delta_p10").alias("best_delta_p10"))
    return spread_join(best, gates, "best_cluster", "id", hot).withColumn(
        "best_below_p10", below(F.col("best_reduction_pct"), F.col("best_delta_p10"))
    )


#: What is known of a sample's preset builds: name in the result, column of the baselines, type.
PRESETS = (
    ("preset_o0_count", "o0_count", "bigint"),
    ("preset_clang_oz_count", "clang_oz_count", "bigint"),
    ("preset_clang_oz_ms", "clang_oz_ms", "double"),
    ("preset_cgym_oz_count", "gym_oz_count", "bigint"),
    ("preset_cgym_oz_ms", "gym_oz_ms", "double"),
)


def preset_builds(baselines: DataFrame) -> DataFrame:
    """(id, preset_*): counts (NULL unless positive), build times (0 unless known) and the best of the -Oz counts.

    ``baselines`` may lack the columns of builds that were not made.
    """
    def known(column: str, kind: str) -> Column:
        value = F.col(column) if column in baselines.columns else F.lit(None)
        return positive(value.cast(kind)) if kind == "bigint" else F.coalesce(value.cast(kind), F.lit(0.0))

    best = best_baseline(*(F.col(c) for c in ("clang_oz_count", "gym_oz_count", "oz_count") if c in baselines.columns))
    return baselines.select("id", *(known(c, kind).alias(name) for name, c, kind in PRESETS), best.cast("bigint").alias("preset_best_oz_count"))


def outcome(flagged: DataFrame) -> DataFrame:
    """Add category and final_*; expects base, best_* and preset_* columns."""
    best_below = F.coalesce("best_below_p10", F.lit(False))
    under = F.coalesce("below_p10", F.lit(False))
    chosen = (
        F.when(
            best_below,
            F.struct(
                F.lit(PRESET).alias("category"),
                F.coalesce("best_cluster", "cluster").alias("final_cluster"),
                F.col("preset_best_oz_count").alias("final_count"),
                F.lit(0.0).alias("final_reduction_pct"),
            ),
        )
        .when(
            under,
            F.struct(
                F.lit(NCS_OK).alias("category"),
                F.coalesce("best_cluster", "cluster").alias("final_cluster"),
                F.coalesce("best_count", "base_count").cast("bigint").alias("final_count"),
                F.coalesce("best_reduction_pct", "reduction_pct").alias("final_reduction_pct"),
            ),
        )
        .otherwise(
            F.struct(
                F.lit(CENTROID).alias("category"),
                F.col("cluster").alias("final_cluster"),
                F.col("base_count").cast("bigint").alias("final_count"),
                F.col("reduction_pct").alias("final_reduction_pct"),
            )
        )
    )
    return flagged.withColumn("chosen", chosen).select(*flagged.columns, "chosen.*")


def final_result(
    base: DataFrame,
    codes: DataFrame,
    thresholds: DataFrame,
    measurements: DataFrame | Scorer,
    baselines: DataFrame,
    hot: HotKeys = NONE_HOT,
    neighbours: DataFrame | None = None,
) -> DataFrame:
    """The whole gated fallback.

    Only samples below their threshold are exploded, joined and aggregated; all
    others go straight to the output without a shuffle. The preset columns are
    known for samples that end with a preset. ``base`` is read twice, so pass a
    written table; if it does not carry the neighbours, they are given apart.
    """
    flagged = flag_below(base, thresholds, hot)
    ncs = flagged.filter("below_p10")
    rest = flagged.filter(~F.col("below_p10"))
    near = ncs if neighbours is None else ncs.select("id").join(neighbours.select("id", "neighbours"), "id")
    extras = candidate_scores(fallback_candidates(near, codes, hot), measurements)
    best = fallback_best(ncs, extras, thresholds, hot)
    presets = [*(name for name, _, _ in PRESETS), "preset_best_oz_count"]
    worked = ncs.withColumnRenamed("best_code_id", "base_code_id").join(best, "id", "left").join(preset_builds(baselines), "id", "left")
    worked = worked.withColumns({c: F.when(F.col("best_below_p10"), F.col(c)) for c in presets})
    none = {c: F.lit(None).cast(kind) for c, _, kind in PRESETS} | {
        "preset_best_oz_count": F.lit(None).cast("bigint"),
        "best_cluster": F.lit(None).cast("int"),
        "best_code_id": F.lit(None).cast("string"),
        "best_count": F.lit(None).cast("bigint"),
        "best_reduction_pct": F.lit(None).cast("double"),
        "extras_compile_ms": F.lit(None).cast("double"),
        "best_below_p10": F.lit(False),
    }
    quiet = rest.withColumnRenamed("best_code_id", "base_code_id").withColumns(none)
    columns = [
        "id", "cluster", "base_code_id", "oz_count", "base_count", "reduction_pct", "below_p10",
        "best_cluster", "best_code_id", "best_count", "best_reduction_pct", "best_below_p10",
        "extras_compile_ms", *presets,
    ]
    return outcome(quiet.select(columns).unionByName(worked.select(columns)))


def category_counts(final: DataFrame) -> DataFrame:
    return final.groupBy("category").agg(F.count("*").alias("n_rows"))


def stage_report(final: DataFrame) -> DataFrame:
    """Tidy (metric, value) table from a single aggregate over the final result."""
    ncs = F.col("below_p10")
    metrics = {
        "ncs_count": F.count_if(ncs),
        "preset_fallback_count": F.count_if(F.col("best_below_p10")),
        "category_centroid": F.count_if(F.col("category") == CENTROID),
        "category_ncs_ok": F.count_if(F.col("category") == NCS_OK),
        "category_preset_fallback": F.count_if(F.col("category") == PRESET),
        "gm_base": geomean_pct_from_counts(F.col("base_count"), F.col("oz_count")),
        "gm_ncs": geomean_pct_from_counts(F.when(ncs, F.col("base_count")), F.col("oz_count")),
        "gm_ncs_best": geomean_pct_from_counts(F.when(ncs, F.col("best_count")), F.col("oz_count")),
        "gm_final": geomean_pct_from_pct(F.col("final_reduction_pct")),
        "extras_compile_ms": F.coalesce(F.sum("extras_compile_ms"), F.lit(0.0)),
        "preset_clang_oz_ms": F.coalesce(F.sum("preset_clang_oz_ms"), F.lit(0.0)),
        "preset_cgym_oz_ms": F.coalesce(F.sum("preset_cgym_oz_ms"), F.lit(0.0)),
    }
    row = final.agg(*[c.cast("double").alias(name) for name, c in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "value")


def metric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, n_values, mean_value) per column over its known values."""
    sums = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[exact_mean(F.col(c).cast("double")).alias(f"m_{c}") for c in columns],
    )
    entries = [
        F.struct(F.lit(c).alias("metric"), F.col(f"n_{c}").alias("n_values"), F.col(f"m_{c}").alias("mean_value"))
        for c in columns
    ]
    return sums.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


