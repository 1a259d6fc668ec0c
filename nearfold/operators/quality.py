"""Row validity, rejection reports, range filters and last-write-wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.functions.columns import by_numeric_id, canonical_id, numeric_id
from nearfold.functions.vectors import all_finite


def reference_dimension(df: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> int:
    """Length of the valid vector with the smallest id: the one all others must match."""
    valid = (F.size(vector_col) > 0) & all_finite(F.col(vector_col)) & F.col(id_col).isNotNull()
    order = F.struct(numeric_id(F.col(id_col)).isNull(), numeric_id(F.col(id_col)), F.col(id_col))
    row = df.filter(valid).agg(F.min_by(F.size(vector_col), order)).head()
    if row is None or row[0] is None:
        raise ValueError("no valid vectors")
    return row[0]


def mark_rejects(
    df: DataFrame, id_col: str = "id", vector_col: str = "embedding", dim: int | None = None
) -> DataFrame:
    """Canonical ids plus a ``reject_reason`` that is NULL for good rows."""
    df = df.withColumn(id_col, canonical_id(F.col(id_col)))
    dim = dim or reference_dimension(df, id_col, vector_col)
    vector = F.col(vector_col)
    reason = (
        F.when(vector.isNull(), "not a vector")
        .when(F.size(vector) == 0, "empty vector")
        .when(~all_finite(vector), "non-finite value")
        .when(F.col(id_col).isNull(), "missing id")
        .when(F.size(vector) != dim, "wrong dimension")
    )
    return df.withColumn("reject_reason", reason)


def accepted(df: DataFrame, policy: str = "error") -> DataFrame:
    """Good rows of a marked table: ``skip`` drops the others, ``error`` fails on the first."""
    if policy == "skip":
        return df.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    if policy != "error":
        raise ValueError(f"unknown invalid-row policy: {policy}")
    stop = F.raise_error(F.concat(F.lit("invalid row: "), F.col("reject_reason")))
    checked = F.when(F.col("reject_reason").isNotNull(), stop.cast("boolean")).otherwise(F.lit(True))
    return df.filter(checked).drop("reject_reason")


def reject_report(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("outcome")).agg(
        F.count("*").alias("n_rows")
    )


def filter_id_range(
    df: DataFrame, low: int | None = None, high: int | None = None, id_col: str = "id"
) -> DataFrame:
    """Inclusive bounds on numeric ids; a text id fails the job once a bound is set.

    A ``BIGINT`` id column is compared as it is, so the bounds reach the scan.
    """
    if low is None and high is None:
        return df
    number: Column = F.col(id_col)
    if dict(df.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        parsed = numeric_id(number)
        number = F.when(parsed.isNotNull(), parsed).otherwise(
            F.raise_error(F.concat(F.lit("id range needs numeric ids: "), F.coalesce(number, F.lit("NULL"))))
            .cast("bigint")
        )
    if low is not None:
        df = df.filter(number >= low)
    if high is not None:
        df = df.filter(number <= high)
    return df


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the row that sorts last per key.

    An aggregate rather than a window: each input partition keeps one row per
    key before the shuffle, so a key with very many rows stays cheap. The
    remaining columns break ties, which makes the choice repeatable.
    """
    rest = [c for c in df.columns if c not in keys]
    marks = [F.col(o) if isinstance(o, str) else o for o in order]
    winner = F.max(
        F.struct(*[m.alias(f"order_{i}") for i, m in enumerate(marks)], *[F.col(c) for c in rest])
    ).alias("winner")
    picked = df.groupBy(*keys).agg(winner)
    return picked.select(*[F.col(c) if c in keys else F.col(f"winner.{c}").alias(c) for c in df.columns])


def sort_by_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.orderBy(*by_numeric_id(id_col))
