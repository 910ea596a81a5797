"""Random-projection trees against the exact neighbour join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import neighbors, projection
from test_neighbors import brute, found, frame, same


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, (40, 24))
    return centres[rng.integers(0, 40, 3000)] + rng.normal(0, 0.5, (3000, 24))


def test_bounds_are_below_all_distances(spark, clustered):
    forest = projection.fit(frame(spark, clustered), trees=2, leaf_rows=100)
    assert forest.depth == 5
    home = forest.leaves(clustered)
    d2 = ((clustered[:50, None] - clustered[None]) ** 2).sum(axis=2)
    for t in range(2):
        assert (np.bincount(home[:, t], minlength=32) > 0).all()
        assert (forest.bounds(clustered[:50], t)[:, home[:, t]] <= d2 + 1e-9).all()


def test_all_leaves_give_the_exact_join(spark, clustered):
    x = clustered[:400].copy()
    x[100:140] = x[0]
    got = projection.knn_by_trees(frame(spark, x), frame(spark, x), 5, probes=10**6, leaf_rows=30, exclude_self=True)
    # copies beyond the first k + 1 ids cannot be answers; the exact join says which
    want = neighbors.knn(frame(spark, x), frame(spark, x), 5, exclude_self=True)
    assert found(got) == found(want)
    same(found(got), brute(x, x, 5))


def test_recall_is_reached_with_few_leaves(spark, clustered):
    points = frame(spark, clustered)
    forest = projection.fit(points, trees=2, leaf_rows=50)
    probes = projection.probes_for(forest, points, points, 10, 0.9, exclude_self=True)
    assert 2 * probes <= forest.n_leaves / 2
    got = projection.knn_by_trees(points, points, 10, 0.9, leaf_rows=50, exclude_self=True)
    seen = projection.measured_recall(got, points, points, 10, exclude_self=True).first()
    assert seen.n_queries == 3000 and seen.n_sought == 30000 and seen.recall >= 0.9
    some = projection.measured_recall(got, points, points, 10, exclude_self=True, rows=100).first()
    assert some.n_queries == 100 and some.recall >= 0.85


def test_edges(spark, clustered):
    points = frame(spark, clustered[:50])
    none = points.where("false")
    assert projection.knn_by_trees(points, none, 3).count() == 0 == projection.knn_by_trees(none, points, 3).count()
    assert projection.measured_recall(projection.knn_by_trees(points, none, 3), points, none, 3).first().recall is None
    equal = frame(spark, np.ones((300, 4)))
    got = found(projection.knn_by_trees(equal, equal, 3, leaf_rows=10))
    assert len(got) == 300 and all([j for j, _ in v] == [0, 1, 2] for v in got.values())
    broken = spark.createDataFrame([(7, [1.0, None]), (8, None)], "row_id bigint, vec array<double>")
    two = frame(spark, [[0.0, 0.0], [1.0, 1.0]])
    with pytest.raises(ValueError, match="missing or infinite"):
        projection.knn_by_trees(two, two.union(broken), 1)
    assert found(projection.knn_by_trees(two.union(broken), two.union(broken), 1, missing="drop")) == {0: [(0, 0.0)], 1: [(1, 0.0)]}


def test_a_query_comes_once_for_leaves_side_by_side(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, vec array<double>").repartition(3)
    forest = projection.fit(df, 2, leaf_rows=10)
    probes, k = 9, 4
    rows = projection._visiting(df, forest, probes, 16).groupBy("row_id").count().agg(F.max("count")).first()[0]
    assert rows <= 2 * -(-forest.n_leaves // 16) and forest.n_leaves == 64
    own = forest.leaves(x)
    want = set()
    for q in range(600):
        met = set()
        for t in range(2):
            near = np.argpartition(forest.bounds(x[[q]], t), probes - 1, axis=1)[0, :probes]
            met |= set(np.flatnonzero(np.isin(own[:, t], near))) - {q}
        ids = sorted(met, key=lambda i: (((x[i] - x[q]) ** 2).sum() ** 0.5, i))[:k]
        want |= {(q, int(i)) for i in ids}
    for at_once in (1, 100, 8_192):
        projection.BUNDLE_ROWS, kept = at_once, projection.BUNDLE_ROWS
        try:
            found = projection.knn_by_trees(df, df, k, probes=probes, leaf_rows=10, exclude_self=True)
            assert {(r.row_id, r.neighbor_id) for r in found.collect()} == want
        finally:
            projection.BUNDLE_ROWS = kept


def test_neighbours_of_all_leaves_are_shuffled_once(spark, clustered, monkeypatch):
    # several partitions of tasks, as larger tables have
    monkeypatch.setattr(neighbors, "PARTITION_PAIRS", 1_000)
    monkeypatch.setattr(projection, "BUNDLE_ROWS", 60)
    points = frame(spark, clustered[:300])
    got = projection.knn_by_trees(points, points, 5, probes=2, leaf_rows=30, exclude_self=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    merging = plan[: plan.index("FlatMapCoGroupsInPandas")]
    assert merging.count("Exchange") == 1
    same(found(got), found(projection.knn_by_trees(points.repartition(5), points, 5, probes=2, leaf_rows=30, exclude_self=True)))
