"""Sums that are equal to the last bit however rows are dealt."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from nearfold.functions.exact import exact_mean, exact_sum
from nearfold.functions.measures import geomean_pct_from_counts, geomean_ratio
from nearfold.operators.evaluation import metric_summary
from nearfold.operators.pooling import weighted_perplexity

RNG = random.Random(31)
VALUES = {
    "ordinary": [RNG.gauss(0, 1) for _ in range(3000)],
    "wide": [RNG.choice([-1, 1]) * 10.0 ** RNG.uniform(-12, 12) for _ in range(3000)],
    "cancelling": [v for _ in range(1000) for v in [RNG.uniform(0, 1e9)] for v in (v, -v, 1e-9)],
    "tiny": [RNG.uniform(-1e-20, 1e-20) for _ in range(500)],
}


def dealt(df, parts, seed):
    return df.orderBy(F.xxhash64("i", F.lit(seed))).repartition(parts, F.col("i"))


@pytest.mark.parametrize("name", sorted(VALUES))
def test_equal_bits_in_any_number_of_partitions(spark, name):
    df = spark.createDataFrame(list(enumerate(VALUES[name])), "i int, x double")
    found = {tuple(dealt(df, parts, parts).agg(exact_sum(F.col("x")), exact_mean(F.col("x"))).head()) for parts in (1, 7, 211)}
    assert len(found) == 1
    total, mean = found.pop()
    want = math.fsum(VALUES[name])
    assert abs(total - want) <= 4 * math.ulp(want) + len(VALUES[name]) * 2.0**-105
    assert mean == total / len(VALUES[name])


def test_missing_infinite_and_large_values(spark):
    def total(values):
        return spark.createDataFrame([(v,) for v in values], "x double").agg(exact_sum(F.col("x"))).head()[0]

    assert total([]) is None and total([None, None]) is None
    assert total([None, 1.5, -2.5]) == -1.0 and total([0.0]) == 0.0
    assert total([1e300, 1.0]) == 1e300 and total([math.inf, 1.0]) == math.inf
    assert math.isnan(total([math.nan, 1.0])) and math.isnan(total([math.inf, -math.inf]))
    assert total([2.0**44, 2.0**-52, -(2.0**44)]) == 2.0**-52


def test_measures_do_not_depend_on_partitions(spark):
    rows = [(i, RNG.randrange(1, 10**6), RNG.randrange(1, 10**6), RNG.uniform(0, 9), RNG.randrange(5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "i int, n long, b long, loss double, masked_tokens int")
    seen = set()
    for parts in (1, 7, 211):
        some = dealt(df, parts, 3 * parts)
        one = some.agg(geomean_ratio(F.col("n") / F.col("b")), geomean_pct_from_counts(F.col("n"), F.col("b"))).head()
        seen.add((*one, *weighted_perplexity(some).head(), *(tuple(r) for r in metric_summary(some, ["n", "loss"]).orderBy("metric").collect())))
    assert len(seen) == 1
    want = math.exp(math.fsum(math.log(n / b) for _, n, b, _, _ in rows) / len(rows))
    assert next(iter(seen))[0] == pytest.approx(want, rel=1e-13)
