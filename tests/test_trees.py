"""Exact trees beside trees grown by hand; the same tree wherever its nodes are finished."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import classify, trees


def data(n=300, d=4, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, d)) / 4.0
    y = ((x[:, 0] > 1.2).astype(int) + (x[:, 1] + x[:, 2] > 3).astype(int)) % classes
    flip = rng.random(n) < 0.15
    return x, np.where(flip, rng.integers(0, classes, n), y)


def table(spark, x, y):
    rows = [(i, *map(float, v), f"c{c}") for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id bigint, " + ", ".join(f"x{j} double" for j in range(x.shape[1])) + ", label string").repartition(3)


def impurity(y, w, criterion, k):
    p = np.bincount(y, w, k) / w.sum()
    return 1 - (p * p).sum() if criterion == "gini" else -(p[p > 0] * np.log(p[p > 0])).sum()


def by_hand(x, y, w, k, criterion, depth, node=1, allowed=None):
    """{node: (attribute, threshold)} by trying every midpoint with the textbook impurity."""
    out = {}
    if depth == 0 or len(set(y)) < 2:
        return out
    best = None
    attributes = [a for a in range(x.shape[1]) if len(set(x[:, a])) > 1]
    for a in sorted(allowed(node, attributes) if allowed else attributes):
        values = np.unique(x[:, a])
        for low, high in zip(values, values[1:]):
            left = x[:, a] < high
            cost = sum(w[s].sum() * impurity(y[s], w[s], criterion, k) for s in (left, ~left))
            if best is None or cost < best[0] - 1e-9:
                best = (cost, a, (low + high) / 2, left)
    if best is None:
        return out
    _, a, cut, left = best
    out[node] = (a, cut)
    out |= by_hand(x[left], y[left], w[left], k, criterion, depth - 1, 2 * node, allowed)
    return out | by_hand(x[~left], y[~left], w[~left], k, criterion, depth - 1, 2 * node + 1, allowed)


def cuts(model, tree=0):
    return {r.node: (r.attribute, r.threshold) for r in model.nodes.where((F.col("attribute") >= 0) & (F.col("tree") == tree)).collect()}


FEATURES = ["x0", "x1", "x2", "x3"]


@pytest.mark.parametrize("criterion, depth", [("gini", 4), ("entropy", 3)])
@pytest.mark.parametrize("task_rows", [trees.TASK_ROWS, 40])
def test_tree_tries_every_midpoint(spark, criterion, depth, task_rows):
    x, y = data()
    df = table(spark, x, y)
    classes = classify.classes_of(df, "label")
    model = trees.fit_trees(df, FEATURES, classify.class_index("label", classes), classes, criterion, depth, task_rows=task_rows)
    assert cuts(model) == by_hand(x, y, np.ones(len(y)), 3, criterion, depth)
    leaves = model.nodes.where("attribute < 0")
    assert leaves.agg(F.sum(F.aggregate("counts", F.lit(0.0), lambda s, c: s + c))).first()[0] == len(y)


def test_forest_does_not_depend_on_where_nodes_are_finished(spark):
    x, y = data(seed=3)
    df = table(spark, x, y)
    classes = classify.classes_of(df, "label")
    weight = classify.bootstrap_weight(0, "row_id", F.col("tree"))
    models = [trees.fit_trees(df, FEATURES, classify.class_index("label", classes), classes, "gini", 4, weight, 3, 2, 0, n) for n in (10_000, 60)]
    weights = {(r.row_id, r.tree): r.w for r in df.withColumn("tree", F.explode(F.array(*map(F.lit, range(3))))).select("row_id", "tree", weight.alias("w")).collect()}
    for t in range(3):
        w = np.array([float(weights[i, t]) for i in range(len(y))])
        own = w > 0

        def allowed(node, attributes):
            return sorted(attributes, key=lambda a: hashlib.md5(f"0:{t}:{node}:{a}".encode()).hexdigest())[:2]

        want = by_hand(x[own], y[own], w[own], 3, "gini", 4, allowed=allowed)
        assert cuts(models[0], t) == want and cuts(models[1], t) == want


def test_predictions_by_join_equal_those_in_memory(spark, monkeypatch):
    x, y = data(200)
    df = table(spark, x, y)
    model = classify.fit_forest(df, FEATURES, "label", "row_id", n_estimators=3, max_depth=5)
    queries = df.withColumn("x1", F.when(F.col("row_id") % 7 != 0, F.col("x1")))
    walked = {r.row_id: r for r in model.predict(queries).collect()}
    shares = {r.row_id: r.probability for r in model.predict_probability(queries).collect()}
    monkeypatch.setattr(trees, "BROADCAST_NODES", 0)
    joined = {r.row_id: r for r in model.predict(queries).collect()}
    assert walked == joined and len(walked) == 200
    assert all((r.prediction is None) == (i % 7 == 0) for i, r in walked.items())
    for r in model.predict_probability(queries).collect():
        assert (shares[r.row_id] is None and r.probability is None) or np.allclose(shares[r.row_id], r.probability)


def test_a_deep_tree_learns_all_rows_that_differ(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 4))
    y = rng.integers(0, 2, 150)
    df = table(spark, x, y)
    model = classify.fit_tree(df, FEATURES, "label")
    assert model.predict(df).where("prediction <> label").isEmpty()


def test_awkward_rows(spark):
    rows = [(1, 1.0, "a"), (2, 1.0, "b"), (3, 1.0, "b"), (4, None, "a"), (5, float("nan"), "a"), (6, 9.0, None), (7, math.inf, "c"), (8, -math.inf, "c")]
    df = spark.createDataFrame(rows, "row_id bigint, x double, label string")
    model = classify.fit_tree(df, ["x"], "label")
    got = {r.row_id: r.prediction for r in model.predict(df).collect()}
    # one side of a cut at infinity holds all finite values
    assert got[1] == got[2] == "b" and got[4] is None and got[5] is None and got[7] == "c" and got[8] == "c"
    one = classify.fit_tree(df.where("label = 'b'"), ["x"], "label")
    assert {r.prediction for r in one.predict(df.where("x = 1")).collect()} == {"b"}
    with pytest.raises(ValueError, match="criterion"):
        classify.fit_tree(df, ["x"], "label", criterion="other")


@pytest.mark.parametrize("ranges", [2, 5])
def test_large_nodes_take_few_passes_whatever_the_ranges(spark, monkeypatch, ranges):
    x, y = data(200)
    df = table(spark, x, y)
    classes = classify.classes_of(df, "label")
    cut, calls = trees.cut_lineage, []
    monkeypatch.setattr(trees, "cut_lineage", lambda rows: calls.append(1) or cut(rows))
    monkeypatch.setattr(trees, "VALUE_RANGES", ranges, raising=False)
    model = trees.fit_trees(df, FEATURES, classify.class_index("label", classes), classes, "gini", 2, task_rows=20)
    assert cuts(model) == by_hand(x, y, np.ones(len(y)), 3, "gini", 2)
    # four tables a level (totals, value counts, cuts, rows), before them the rows twice and after them the last totals and the nodes
    assert len(calls) <= 4 * 3 + 4


def test_the_plan_of_a_deep_tree_has_no_join_for_each_level(spark):
    # the best cut takes one row off at a time, so a level has one large node
    x = np.array([[float(2**i)] for i in range(16)])
    df = spark.createDataFrame([(i, float(v[0]), i % 2) for i, v in enumerate(x)], "row_id bigint, x0 double, y int")
    rows = df.select(F.lit(0).alias("tree"), "y", F.lit(1.0).alias("w"), F.array("x0").alias("vec"))
    growth = trees.Growth(2, "gini", 30, None, 0)
    nodes = trees.grow_trees(rows, growth, task_rows=3)
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 1
    want = {r[:4] for r in growth.grow(0, 1, x, np.arange(16) % 2, np.ones(16))}
    assert {(r.tree, r.node, r.attribute, r.threshold) for r in nodes.collect()} == want and len(want) > 20
