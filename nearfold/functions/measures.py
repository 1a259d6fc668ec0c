"""Reduction percentages and geometric means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfold.functions.exact import exact_mean

# --- fixed value: decimals kept in a stored reduction -------------------------
STORED_DECIMALS = 6
# -------------------------------------------------------------------------------


def known_number(c: Column) -> Column:
    """NaN and NULL are the same thing here: missing."""
    value = c.cast("double")
    return F.when(~F.isnan(value), value)


def raw_reduction_pct(count: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, (1 - count / baseline) * 100.0)


def reduction_pct(count: Column, baseline: Column) -> Column:
    return F.round(raw_reduction_pct(count, baseline), STORED_DECIMALS)


def below(value: Column, threshold: Column) -> Column:
    """Strictly below; a missing side is never below."""
    return F.coalesce(known_number(value) < known_number(threshold), F.lit(False))


def geomean_ratio(ratio: Column) -> Column:
    """Geometric mean over the positive finite ratios; NULL without any. Equal for rows in any order."""
    value = known_number(ratio)
    usable = (value > 0) & (value < float("inf"))
    return F.exp(exact_mean(F.when(usable, F.ln(value))))


def geomean_pct_from_counts(count: Column, baseline: Column) -> Column:
    both = (count > 0) & (baseline > 0)
    return (1 - geomean_ratio(F.when(both, count / baseline))) * 100.0


def geomean_pct_from_pct(pct: Column) -> Column:
    return (1 - geomean_ratio(1 - known_number(pct) / 100.0)) * 100.0
