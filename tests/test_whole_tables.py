"""Queries that once left out rows of their tables read all of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES

DIM = 4


@pytest.fixture(scope="module")
def clusters_dir(spark, tmp_path_factory):
    """Two labels; in each the vector with an id divisible by 5 lies nearest to the mean of all."""
    path = str(tmp_path_factory.mktemp("vectors"))
    spread = {5: 0.0, 6: 1.0, 7: -1.0, 8: 2.0, 9: -2.0, 10: 0.0, 11: 3.0, 12: -3.0, 13: 4.0, 14: -4.0}
    rows = [(i, [x + 100.0 * (i // 10)] * DIM, i // 10) for i, x in spread.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def _rows(spark, name, path, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, path).select(*columns).collect())


def test_representatives_of_all_vectors(spark, clusters_dir):
    found = QUERIES["representative_vectors"](spark, clusters_dir).where("pos = 0")
    assert sorted(tuple(r) for r in found.select("cluster_id", "closest_code_id").collect()) == [(0, "5"), (1, "10")]


@pytest.mark.parametrize("name", ["cluster_summary", "load_clusters"])
def test_clusters_of_all_vectors(spark, clusters_dir, name):
    assert _rows(spark, name, clusters_dir, "cluster_id", "cluster_size", "closest_code_id") == [(0, 5, "5"), (1, 5, "10")]


def test_members_of_all_vectors(spark, clusters_dir):
    assert _rows(spark, "cluster_members", clusters_dir, "cluster_id", "n_members", "first_id") == [(0, 5, 5), (1, 5, 10)]


@pytest.mark.parametrize("name, key, member", [("cluster_top_n", "cluster", "id"), ("cluster_candidates", "cluster_id", "code_id")])
def test_best_of_all_vectors(spark, clusters_dir, name, key, member):
    found = QUERIES[name](spark, clusters_dir).groupBy(key).agg(F.sort_array(F.collect_set(F.col(member).cast("int"))).alias("ids"))
    assert {r[0]: r["ids"] for r in found.collect()} == {0: [5, 6, 7, 8, 9], 1: [10, 11, 12, 13, 14]}
