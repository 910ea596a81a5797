"""Ward merges against always taking the cheapest pair, and the invariants of clustering-feature trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cluster, hierarchy


def greedy(x, weights):
    """(kept, gone, height) of always merging the cheapest pair."""
    clusters = {i: (x[i], float(weights[i])) for i in range(len(x))}
    out = []
    while len(clusters) > 1:
        ids = sorted(clusters)
        c, n = np.array([clusters[i][0] for i in ids]), np.array([clusters[i][1] for i in ids])
        cost = ((c[:, None] - c[None]) ** 2).sum(axis=2) * n[:, None] * n[None] / (n[:, None] + n[None])
        np.fill_diagonal(cost, np.inf)
        i, j = sorted(np.unravel_index(cost.argmin(), cost.shape))
        out.append((ids[i], ids[j], cost[i, j]))
        total = n[i] + n[j]
        clusters[ids[i]] = ((n[i] * c[i] + n[j] * c[j]) / total, total)
        del clusters[ids[j]]
    return out


def groups(labels):
    found = {}
    for row, label in labels:
        found.setdefault(label, set()).add(row)
    return {frozenset(v) for v in found.values()}


def cut_brute(n, merges, k):
    parent = list(range(n))
    for a, b, _ in merges[: n - k]:
        parent = [a if p == b else p for p in parent]
    return groups(enumerate(parent))


def as_points(spark, x, weights):
    rows = [(i, v.tolist(), float(w)) for i, (v, w) in enumerate(zip(x, weights))]
    return spark.createDataFrame(rows, "row_id bigint, vec array<double>, n double").repartition(3)


@pytest.mark.parametrize("cell", [1_000, 25])
def test_merges_are_those_of_the_cheapest_pair(spark, cell):
    rng = np.random.default_rng(2)
    x, weights = rng.normal(size=(120, 3)), rng.integers(1, 5, 120)
    points = as_points(spark, x, weights)
    merges = hierarchy.ward_merges(points, cell).persist()
    want = greedy(x, weights)
    got = sorted((r.height, r.kept, r.gone) for r in merges.collect())
    assert [g[1:] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[0] for g in got], [w[2] for w in want])
    assert merges.agg(F.max("n")).first()[0] == weights.sum()
    for k in (1, 2, 9, 119, 120, 500):
        labels = [(r.row_id, r.cluster) for r in hierarchy.cut(points, merges, k).collect()]
        assert groups(labels) == cut_brute(120, want, min(k, 120))
        assert all(min(g) in {c for _, c in labels} for g in groups(labels))


def test_merging_in_one_cell_respects_the_bounds():
    x = np.array([[0.0], [1.0], [1.5], [9.0]])
    one = np.ones(4)

    def run(bounds, partner):
        return hierarchy.merge_inside(np.arange(4), x, one, 0 * one, np.array(bounds), np.array(partner))

    # 1 and 2 are nearest, but something outside is nearer to 2: 0 and 1 stay apart too
    ids, _, _, _, merges = run([np.inf, np.inf, 0.05, np.inf], [1, 2, 77, 2])
    assert merges == [] and list(ids) == [0, 1, 2, 3]
    # told to be nearest to each other they merge whatever the bounds say
    _, centres, weights, _, merges = run([0.0, 0.125, 0.125, 0.0], [1, 2, 1, 2])
    assert merges == [(1, 2, 0.125, 2.0)] and list(weights) == [1, 2, 1] and centres[1, 0] == 1.25


def test_copies_and_ties(spark):
    x = np.array([[0.0], [0.0], [4.0], [4.0], [8.0], [8.0], [100.0]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, vec array<double>")
    for cell in (1_000, 2):
        labels = [(r.row_id, r.cluster) for r in cluster.hierarchical(df, 2, cell_clusters=cell).collect()]
        assert groups(labels) == {frozenset(range(6)), frozenset([6])}
        assert {r.cluster for r in cluster.hierarchical(df, 10, cell_clusters=cell).collect()} == {0, 1, 2, 3}


def test_no_rows_reach_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rows = []
    collect = DataFrame.collect

    def counted(self):
        out = collect(self)
        rows.append(len(out))
        return out

    monkeypatch.setattr(DataFrame, "collect", counted)
    df = spark.range(400).select(F.col("id").alias("row_id"), F.array(F.sqrt("id"), (F.col("id") * 7 % 31).cast("double")).alias("vec"))
    cluster.hierarchical(df, 5)
    assert not rows or max(rows) <= 16


@pytest.mark.parametrize("threshold, branching", [(0.3, 4), (0.05, 3), (2.0, 50)])
def test_feature_tree_invariants(threshold, branching):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    tree = hierarchy.FeatureTree(3, threshold, branching)
    for v in x:
        tree.insert(1.0, v, float(v @ v))
    nodes = tree.nodes()
    assert all(len(n.n) <= branching for n in nodes)
    assert all(len(n.children) == (0 if n.leaf else len(n.n)) for n in nodes)
    for node in nodes:
        for i, child in enumerate(node.children):
            n, total, squares = child.summary()
            assert n == node.n[i] and np.allclose(total, node.total[i]) and np.isclose(squares, node.squares[i])
    entries = tree.entries()
    assert sum(e[0] for e in entries) == 600 and np.allclose(np.sum([e[1] for e in entries], axis=0), x.sum(axis=0))
    assert all(hierarchy.radius(*e) <= threshold + 1e-9 for e in entries)


def test_entries_of_several_trees(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 2))
    squares = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)
    points = as_points(spark, x, np.ones(500)).withColumn("squares", squares)
    for cell in (80, 1_000):
        entries = hierarchy.feature_entries(points, 0.4, 5, cell).collect()
        assert sum(r.n for r in entries) == 500 and len({r.row_id for r in entries}) == len(entries) < 500
        spread = [r.squares / r.n - float(np.square(r.vec).sum()) for r in entries]
        assert max(spread) <= 0.4**2 + 1e-9
        again = hierarchy.feature_entries(points.repartition(7), 0.4, 5, cell).collect()
        assert {(r.row_id, r.n) for r in again} == {(r.row_id, r.n) for r in entries}


def test_nearest_cluster_by_products_is_that_of_exact_costs():
    rng = np.random.default_rng(5)
    # far from the origin, many equal costs, weights of all sizes
    x, weights = 1e3 + rng.integers(0, 4, (300, 3)).astype(float), rng.integers(1, 1_000, 300).astype(float)
    ids = rng.permutation(300)
    cell = rng.integers(0, 5, 300)
    for barred in (np.eye(300, dtype=bool), cell[:, None] == cell[None], np.ones((300, 300), bool)):
        cost, low, high = hierarchy.nearest_by_ward(x, weights, x, weights, barred, ids, ids)
        exact = np.where(barred, np.inf, hierarchy.ward_costs(x, weights, x, weights))
        assert np.array_equal(cost, exact.min(axis=1))
        for i in np.flatnonzero(np.isfinite(cost)):
            pairs = [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in np.flatnonzero(exact[i] == cost[i])]
            assert (low[i], high[i]) == min(pairs)


def test_few_clusters_are_compared_in_many_tiles(spark, monkeypatch):
    sizes = []
    join = hierarchy.block_join

    def spied(*args, **kwargs):
        sizes.append((kwargs.get("query_block"), kwargs.get("point_block")))
        return join(*args, **kwargs)

    monkeypatch.setattr(hierarchy, "block_join", spied)
    monkeypatch.setattr(hierarchy, "LEAST_BLOCK", 16, raising=False)
    x = np.random.default_rng(1).normal(size=(200, 2))
    merges = hierarchy.ward_merges(as_points(spark, x, np.ones(200)), 60)
    assert merges.count() == 199
    assert sizes[0] == (34, 34)


def test_many_dimensions_take_few_rounds(spark, monkeypatch):
    calls = []
    join = hierarchy.block_join
    monkeypatch.setattr(hierarchy, "block_join", lambda *args, **kwargs: calls.append(1) or join(*args, **kwargs))
    # in many dimensions most rows are nearest to a few large clusters, so few pairs are nearest to each other
    x = np.random.default_rng(7).normal(size=(240, 24))
    merges = hierarchy.ward_merges(as_points(spark, x, np.ones(240)), 24)
    got = sorted((r.height, r.kept, r.gone) for r in merges.collect())
    assert [g[1:] for g in got] == [w[:2] for w in greedy(x, np.ones(240))]
    assert len(calls) <= 5


def test_the_cheapest_pairs_below_a_limit():
    rng = np.random.default_rng(8)
    # far from the origin, with equal costs, and many outdated clusters at once
    for x in (1e3 + rng.normal(size=(130, 5)), rng.integers(0, 5, (130, 2)).astype(float)):
        x = np.unique(x, axis=0)
        weights = rng.integers(1, 9, len(x)).astype(float)
        start = np.arange(len(x)), x, weights, np.zeros(len(x))
        ids, _, left, _, merges = hierarchy.merge_below(*start, np.inf)
        heights = [h for _, _, h in greedy(x, weights)]
        assert list(ids) == [0] and left[0] == weights.sum()
        assert np.allclose(np.sort([m[2] for m in merges]).sum(), np.sum(heights), rtol=0.05)
        limit = float(np.median(heights))
        ids, centres, left, _, some = hierarchy.merge_below(*start, limit)
        assert some == merges[: len(some)] and len(ids) + len(some) == len(x)
        cost = hierarchy.ward_costs(centres, left, centres, left)
        np.fill_diagonal(cost, np.inf)
        assert all(m[2] < limit for m in some) and cost.min() >= limit * (1 - 1e-9)
