"""Vector predicates and arithmetic on ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed value: smallest norm a vector is divided by ------------------------
NORM_FLOOR = 1e-12
# -------------------------------------------------------------------------------


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def all_finite(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def l2_normalize(v: Column) -> Column:
    """The norm is bound to a name of its own: inside a lambda it would be summed up again for every element."""
    norm = lambda w: F.greatest(F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x)), F.lit(NORM_FLOOR))
    bound = F.transform(F.array(v), lambda w: F.struct(w.alias("vector"), norm(w).alias("norm")))
    return F.transform(bound, lambda b: F.transform(b["vector"], lambda x: x / b["norm"]))[0]


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def vector_from_json(text: Column) -> Column:
    """Parse ``[1.5, 2]``; anything that is not one flat list of numbers gives NULL.

    A missing element gives a NULL entry, which the validity check then rejects.
    """
    return F.from_json(F.when(text.rlike(r"^\s*\["), text), "array<double>")
