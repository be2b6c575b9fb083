import random

import numpy as np
import pytest

from granary.errors import InvalidParameter, NotFitted
from granary.plans import linkage as L


def table(spark, x):
    return spark.createDataFrame([(i, None if r is None else [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>").repartition(3)


def kruskal(edges):
    up, out = {}, []

    def find(i):
        while up.get(i, i) != i:
            i = up[i]
        return i

    for h, u, v in sorted(edges):
        a, b = find(u), find(v)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((u, v, h))
    return sorted(out), find


def distances(x):
    return [(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), i, j) for j in range(len(x)) for i in range(j)]


@pytest.mark.parametrize(("dims", "chunk"), [(1, 256), (2, 7), (3, 40)])
def test_equals_brute_force(spark, monkeypatch, dims, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    rng = np.random.default_rng(dims)
    x = np.vstack([rng.normal(c, 0.2, (40, dims)) for c in (-1, 0, 1.3)])
    height = 0.7
    model = L.SingleLinkage(height).fit(table(spark, x))
    edges = [e for e in distances(x) if e[0] <= height]
    want, _ = kruskal(edges)
    got = sorted(map(tuple, model.linkage().collect()))
    assert [e[:2] for e in got] == [e[:2] for e in want] and np.allclose([e[2] for e in got], [e[2] for e in want])
    for cut in (0.1, 0.3, height):
        _, find = kruskal([e for e in edges if e[0] <= cut])
        assert {r.row_id: r.cluster for r in model.cut_tree(cut).collect()} == {i: find(i) for i in range(len(x))}


def test_equal_and_odd_rows(spark):
    x = [[0, 0], [0, 0], [-0.0, 0], [0.5, 0], None, [float("nan"), 0], [5, 5]]
    model = L.SingleLinkage(1.0).fit(table(spark, x))
    assert sorted(map(tuple, model.linkage().collect())) == [(0, 1, 0.0), (0, 2, 0.0), (0, 3, 0.5)]
    assert sorted(map(tuple, model.cut_tree(0.0).collect())) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 5), (6, 6)]
    assert sorted(map(tuple, model.cut_tree(1.0).collect()))[3] == (3, 0)
    with pytest.raises(InvalidParameter):
        model.cut_tree(2.0)
    with pytest.raises(NotFitted):
        L.SingleLinkage(1.0).linkage()
    with pytest.raises(InvalidParameter):
        L.SingleLinkage(0.0)
    empty = L.SingleLinkage(1.0).fit(table(spark, []))
    assert empty.linkage().count() == empty.cut_tree(0.5).count() == 0


def test_forest_of_any_edges(spark):
    """Ties among the heights, repeated edges, loops, and several trees."""
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(4))) for _ in range(150)] + [(100, 101, 1.0), (5, 5, 0.0)]
    got = sorted(map(tuple, L.spanning_forest(spark.createDataFrame(edges + edges[:20], "u long, v long, height double")).collect()))
    assert got == kruskal({(h, min(u, v), max(u, v)) for u, v, h in edges if u != v})[0]
    assert L.spanning_forest(spark.createDataFrame([], "u long, v long, height double")).count() == 0


def test_rounds_and_one_task_agree(spark, monkeypatch):
    """Ties in plenty, with tasks that reduce what they hold again and again: rounds of jobs, one task, and Kruskal."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (150, 2)) / 4
    edges = [e for e in distances(x) if e[0] <= 0.6]
    want, find = kruskal(edges)
    for few, held in ((0, 40), (10, 300), (L.FEW, L.HELD)):
        monkeypatch.setattr(L, "FEW", few)
        monkeypatch.setattr(L, "HELD", held)
        model = L.SingleLinkage(0.6).fit(table(spark, x))
        assert sorted(h for _, _, h in model.linkage().collect()) == [h for _, _, h in sorted(want, key=lambda e: e[2])]
        assert {r.row_id: r.cluster for r in model.cut_tree(0.6).collect()} == {i: find(i) for i in range(len(x))}


def test_few_edges_take_few_jobs(spark):
    """A fit and its cuts over few points: rounds of jobs took over a hundred."""
    rng = np.random.default_rng(6)
    points = table(spark, rng.normal(0, 1, (300, 3)))
    spark.sparkContext.setJobGroup("linkage", "linkage")
    try:
        model = L.SingleLinkage(0.8).fit(points)
        assert all(model.cut_tree(h).count() == 300 for h in (0.3, 0.5, 0.8))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("linkage")) < 80
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
