"""The metric index against the plain kernel, and fits that share their scans."""

from __future__ import annotations

import numpy as np
import pytest

from nearfold.operators import fits as ft
from nearfold.operators import metric_index as mi
from nearfold.operators import nearest as nn
from tests.test_invariants import found, vectors

RNG = np.random.default_rng(21)


def cloud(n: int, d: int, kind: str) -> np.ndarray:
    if kind == "grid":
        return RNG.integers(0, 4, (n, d)).astype(float)
    if kind == "clustered":
        return (np.random.default_rng(3).normal(size=(40, d)) * 5)[RNG.integers(40, size=n)] + RNG.normal(size=(n, d)) / 3
    return RNG.normal(size=(n, d))


@pytest.mark.parametrize("dense", [0.0, 0.5, 2.0])
@pytest.mark.parametrize(("m", "d", "kind", "k"), [(300, 3, "grid", 5), (300, 8, "normal", 5), (900, 16, "clustered", 3), (700, 2, "grid", 1), (256, 4, "clustered", 40), (300, 2, "clustered", 300)])
def test_index_equals_the_plain_kernel(monkeypatch, m, d, kind, k, dense):
    monkeypatch.setattr(mi, "DENSE", dense)
    centres, x = cloud(m, d, kind), cloud(400, d, kind)
    centres[5] = centres[9]
    x[:20] = centres[:20]
    want, dist = nn._best(x, centres, k)
    for pair_bytes in (32 << 20, 20_000):
        monkeypatch.setattr(mi, "PAIR_BYTES", pair_bytes)
        index = mi.build(centres)
        assert sorted(index.members.tolist()) == list(range(m))
        got = mi.nearest(x, centres, index, k, nn._best)
        assert (got[0] == want).all() and (got[1] == dist).all()
        bound = dist[:, -1] * 0.7 + 1e-9
        near, far, _ = mi.nearest(x, centres, index, k, nn._best, bound)
        inside = dist <= bound[:, None] * (1 - 1e-9)
        assert (near[inside] == want[inside]).all() and (far[inside] == dist[inside]).all()


def test_index_skips_far_groups():
    centres, x = cloud(5_000, 16, "clustered"), cloud(500, 16, "clustered")
    _, _, measured = mi.nearest(x, centres, mi.build(centres), 5, nn._best)
    assert measured < 0.1 * len(x) * len(centres)


def test_index_of_equal_and_odd_centres():
    same = np.ones((300, 4))
    got = mi.nearest(same[:3], same, mi.build(same), 2, nn._best)
    assert got[0].tolist() == [[0, 1]] * 3 and (got[1] == 0).all()
    assert mi.build(np.ones((10, 2))) is None
    odd = same.copy()
    odd[7, 1] = np.inf
    assert mi.build(odd) is None


def test_indexed_blocks_in_spark(spark, monkeypatch):
    centres, x = cloud(600, 6, "clustered"), cloud(200, 6, "clustered")
    plain = found(nn.nearest_centres(vectors(spark, x), vectors(spark, centres, "cluster_id"), 4))
    monkeypatch.setattr(mi, "LEAST_CENTRES", 10_000)
    assert found(nn.nearest_centres(vectors(spark, x), vectors(spark, centres, "cluster_id"), 4)) == plain
    monkeypatch.setattr(mi, "LEAST_CENTRES", 32)
    monkeypatch.setattr(nn, "BLOCK_BYTES", 10_000)
    assert found(nn.nearest_centres(vectors(spark, x), vectors(spark, centres, "cluster_id"), 4)) == plain


def cost_of(x: np.ndarray, centres: np.ndarray) -> float:
    return float(((x[:, None] - centres[None]) ** 2).sum(-1).min(1).sum())


def test_fits_settle_where_lloyd_does(spark):
    x = cloud(500, 5, "clustered")
    fits = ft.fit_models(vectors(spark, x).repartition(3), [(3, 1), (3, 2), (7, 1), (1, 9)], tol=0.0)
    assert [(f.k, f.seed) for f in fits] == [(3, 1), (3, 2), (7, 1), (1, 9)]
    for f in fits:
        assert f.cost == pytest.approx(cost_of(x, f.centres), rel=1e-9)
        label = ((x[:, None] - f.centres[None]) ** 2).sum(-1).argmin(1)
        means = np.array([x[label == j].mean(0) for j in range(f.k)])
        assert np.allclose(means, f.centres, atol=1e-7)
    assert np.allclose(fits[3].centres[0], x.mean(0))


def test_one_scan_serves_all_fits(spark, monkeypatch):
    x = cloud(300, 4, "clustered")
    scans = []
    scan = ft._scan
    monkeypatch.setattr(ft, "_scan", lambda v, parts: scans.append(len(parts)) or scan(v, parts))
    fits = ft.fit_models(vectors(spark, x), [(k, s) for k in (2, 4, 8) for s in range(3)])
    # One for the pools' weights, then one a round; settled fits drop out.
    assert len(scans) == 1 + max(f.rounds for f in fits)
    assert scans[1] == 9 and scans[1:] == sorted(scans[1:], reverse=True)
    again = ft.fit_models(vectors(spark, x).repartition(5), [(4, 1)])[0]
    alone = [f for f in fits if (f.k, f.seed) == (4, 1)][0]
    assert again.k == alone.k and again.cost <= 1.5 * alone.cost
    monkeypatch.setattr(ft, "BLOCK_BYTES", 100)
    apart = ft.fit_models(vectors(spark, x), [(k, s) for k in (2, 4, 8) for s in range(3)])
    assert [round(f.cost, 6) for f in apart] == [round(f.cost, 6) for f in fits]


def test_fits_of_few_different_rows(spark):
    x = np.repeat(np.array([[0.0, 0.0], [3.0, 4.0]]), 20, axis=0)
    two, five = ft.fit_models(vectors(spark, x), [(2, 1), (5, 1)])
    assert two.cost == 0 and five.cost == 0
    assert len(np.unique(five.centres, axis=0)) == 2
    one = ft.fit_models(vectors(spark, x[:1]), [(1, 4)])[0]
    assert one.centres.tolist() == [[0.0, 0.0]] and one.cost == 0


def test_fits_keep_rare_far_rows(spark):
    """Seeding in proportion to distance finds a group of one in a thousand."""
    x = np.vstack([RNG.normal(size=(2_000, 3)), RNG.normal(size=(2, 3)) + 500.0])
    best = min(ft.fit_models(vectors(spark, x), [(3, s) for s in range(3)]), key=lambda f: f.cost)
    assert best.cost < cost_of(x, x[:3]) / 10


def test_scans_move_bytes_and_let_go(spark, monkeypatch):
    """Rounds read vectors as bytes from memory, merge few centres in one task, and leave nothing in memory behind."""
    x = cloud(300, 4, "clustered")
    seen = []
    scan = ft._scan
    monkeypatch.setattr(ft, "_scan", lambda v, parts: seen.append((v, v.schema["embedding"].dataType.typeName(), v.storageLevel.useMemory)) or scan(v, parts))
    ft.fit_models(vectors(spark, x), [(2, 1), (4, 1)])
    assert {(kind, held) for _, kind, held in seen} == {("binary", True)}
    assert not seen[0][0].storageLevel.useMemory


def test_scan_with_an_empty_first_centre(spark):
    x = cloud(50, 3, "clustered")
    rows = ft._packed(vectors(spark, x).selectExpr("xxhash64(id) AS key", "embedding"))
    far = np.full((1, 3), 1e6)
    members, means, costs = ft._scan(rows, [np.vstack([far, x[:1]]), np.vstack([x[:1], far])])
    assert [m.tolist() for m in members] == [[0, 50], [50, 0]]
    assert np.array_equal(means[0][0], far[0]) and np.allclose(means[0][1], x.mean(0)) and np.allclose(means[1][0], x.mean(0))
    assert costs == pytest.approx([cost_of(x, x[:1])] * 2)


def test_sums_by_marks_are_those_by_order():
    x, label = cloud(400, 5, "clustered"), RNG.integers(0, 5, 400)
    label[label == 3] = 4
    few, many = ft._summed(x, label, 5), ft._summed(x, label, 90)
    assert few[0].tolist() == many[0][:5].tolist() == np.bincount(label, minlength=5).tolist() and not many[0][5:].any()
    for j in range(5):
        assert np.allclose(few[1][j], x[label == j].sum(0)) and np.allclose(many[1][j], x[label == j].sum(0))
    assert not many[1][5:].any()


def test_packed_vectors_come_back(spark):
    rows = [(1, [1.5, -2.0]), (2, [float("inf"), 0.0]), (3, [0.25, 1e-300])]
    packed = ft._packed(spark.createDataFrame(rows, "key long, embedding array<double>").coalesce(1)).toArrow()
    batch = packed.combine_chunks().to_batches()[0]
    assert ft._vectors(batch, 2).tolist() == [v for _, v in rows]
    assert ft._vectors(batch.slice(1, 2), 2).tolist() == [v for _, v in rows[1:]]
    assert ft._vectors(batch.slice(3), 2).shape == (0, 2)
    with pytest.raises(ValueError):
        ft._vectors(batch, 3)
    for odd in ([1.0], None):
        bad = ft._packed(spark.createDataFrame([(1, [1.0, 2.0]), (2, odd)], "key long, embedding array<double>").coalesce(1)).toArrow()
        with pytest.raises(ValueError):
            ft._vectors(bad.combine_chunks().to_batches()[0], 2)
