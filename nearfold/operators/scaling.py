"""Per-dimension standard scaling with the population deviation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.functions.vectors import as_doubles


@dataclass(frozen=True)
class Scaler:
    """Mean and deviation per dimension; a constant dimension divides by 1."""

    mean: tuple[float, ...]
    deviation: tuple[float, ...]

    @property
    def dim(self) -> int:
        return len(self.mean)

    def apply(self, vector: Column) -> Column:
        centre = F.array(*[F.lit(m) for m in self.mean])
        spread = F.array(*[F.lit(d) for d in self.deviation])
        shifted = F.zip_with(as_doubles(vector), centre, lambda x, m: x - m)
        return F.zip_with(shifted, spread, lambda x, d: x / d)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, m, d) for i, (m, d) in enumerate(zip(self.mean, self.deviation))]
        return spark.createDataFrame(rows, "pos INT, mean DOUBLE, deviation DOUBLE")

    @staticmethod
    def from_table(df: DataFrame) -> "Scaler":
        rows = sorted(df.select("pos", "mean", "deviation").collect())
        return Scaler(tuple(r[1] for r in rows), tuple(r[2] for r in rows))


def fit_scaler(df: DataFrame, vector_col: str = "embedding") -> Scaler:
    """One pass over the vectors; each task sends one summary row, never vectors."""
    vector = array_to_vector(as_doubles(F.col(vector_col)))
    summary = Summarizer.metrics("count", "mean", "variance").summary(vector)
    row = df.agg(summary.alias("s")).select("s.count", "s.mean", "s.variance").head()
    n = row[0]
    if not n:
        raise ValueError("cannot fit a scaler on no rows")
    # Summarizer divides by n - 1; the population variance divides by n.
    spread = [math.sqrt(max(v, 0.0) * (n - 1) / n) for v in row[2]]
    return Scaler(tuple(float(m) for m in row[1]), tuple(s if s > 0.0 else 1.0 for s in spread))


def identity_scaler(dim: int) -> Scaler:
    return Scaler((0.0,) * dim, (1.0,) * dim)


def scale(df: DataFrame, method: str = "standard", vector_col: str = "embedding") -> tuple[DataFrame, Scaler | None]:
    """Fit and apply in one call; ``none`` leaves the vectors as they are."""
    if method == "none":
        return df, None
    if method != "standard":
        raise ValueError(f"unknown scaling method: {method}")
    scaler = fit_scaler(df, vector_col)
    return df.withColumn(vector_col, scaler.apply(F.col(vector_col))), scaler
