"""Hand-computed values on tiny tables."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import encode, mining, scale, score, select
from millrace.operators.reduce import fit_pca
from millrace.plans import experiments

NUMBERS = ("a", "b", "c")


def column(df, c):
    return [r[c] for r in df.orderBy("id").select("id", c).collect()]


def test_correlations(golden):
    pairs = {(r.col_i, r.col_j): r.abs_corr for r in select.correlation_pairs(golden, NUMBERS).collect()}
    assert pairs[("a", "b")] == pytest.approx(0.99705, abs=1e-5)
    assert pairs[("a", "c")] == pytest.approx(0.085714, abs=1e-6)
    assert pairs[("b", "c")] == pytest.approx(0.06647, abs=1e-5)
    wide = {(r.col_i, r.col_j): r.abs_corr for r in select.correlation_pairs(golden, NUMBERS, narrow=0).collect()}
    assert wide == pytest.approx(pairs)
    assert select.drop_correlated(golden, NUMBERS, 0.9) == ["b"]


def test_drop_correlated_counts_every_pair(spark):
    # x correlates with both others, which do not correlate above the threshold
    rows = [(i, float(i % 7), float(i % 7 + 2 * (i % 5)), float(i % 5)) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, u double, x double, w double")
    assert select.drop_correlated(df, ["u", "x", "w"], 0.5) == ["x"]


def test_scaling(golden):
    assert column(scale.fit_minmax(golden, ["b"]).transform(golden), "b") == pytest.approx(
        [0, 0.181818, 0.363636, 0.545455, 0.727273, 1], abs=1e-6
    )
    assert column(scale.fit_standard(golden, ["a"]).transform(golden), "a") == pytest.approx(
        [-1.46385, -0.87831, -0.29277, 0.29277, 0.87831, 1.46385], abs=1e-5
    )
    assert column(scale.fit_robust(golden, ["b"]).transform(golden), "b") == pytest.approx([-1, -0.6, -0.2, 0.2, 0.6, 1.2])


def test_scaling_degenerate_columns(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, None)], "id int, k double, z double")
    for fit in (scale.fit_minmax, scale.fit_standard, scale.fit_robust):
        out = fit(df, ["k", "z"]).transform(df)
        assert column(out, "k") == [0.0, 0.0]
        assert column(out, "z") == [None, None]


def test_scores(golden):
    anova = {s.feature: s for s in select.anova_scores(golden, NUMBERS, "y")}
    assert [anova[c].score for c in NUMBERS] == pytest.approx([13.5, 11.645161, 0.038462], abs=1e-6)
    chi2 = [s.score for s in select.chi2_scores(golden, NUMBERS, "y")]
    assert chi2 == pytest.approx([3.857143, 8.395349, 0.047619], abs=1e-6)
    regression = select.regression_scores(golden, NUMBERS, "y")
    assert [s.score for s in regression] == pytest.approx([13.5, 11.645161, 0.038462], abs=1e-6)
    # F(1, 4) = 13.5 and chi-square(1) = 3.841459 have these tail probabilities
    assert anova["a"].p_value == pytest.approx(0.021312, abs=1e-5)
    assert select.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert select.best(list(anova.values()), 2) == ["a", "b"]


def test_equal_scores_keep_the_later_column():
    scores = [select.Score(n, i, 1.0, None) for i, n in enumerate("xyz")] + [select.Score("none", 3, None, None)]
    assert select.best(scores, 2) == ["y", "z"]


def test_bins(golden, spark):
    binned, _ = encode.discretize(golden, ["c"], 3, "cut")
    assert column(binned, "c") == [2, 0, 1, 0, 2, 1]
    assert encode.quantile_edges(golden, ["b"], 3)["b"] == pytest.approx([5.333333, 8.666667], abs=1e-6)
    flat = spark.createDataFrame([(i, 4.0, float(i > 1), 0.0 if i < 9 else 1.0) for i in range(10)], "id int, k double, z double, m double")
    binned, edges = encode.discretize(flat, ["k", "z", "m"], 3, "cut")
    assert set(column(binned, "k")) == {1} and set(edges) == {"k"}
    assert encode.quantile_edges(flat, ["m"], 4)["m"] == []


def test_items(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 2, 0.0), (3, None, 1.0)], "id int, size int, flag double")
    items = [r.items for r in df.select("id", encode.items_of(["size"], ["flag"]).alias("items")).orderBy("id").collect()]
    assert items == [["size_0", "flag"], ["size_2"], ["flag"]]
    wide = encode.one_hot(df, {"size": [0, 1, 2]}, ["flag"]).orderBy("id").collect()
    assert [tuple(r) for r in wide] == [(1, 1, 0, 0, 1), (2, 0, 0, 1, 0), (3, 0, 0, 0, 1)]


def test_classification_metrics(spark):
    cells = {(0, 0): 3, (0, 1): 1, (1, 0): 2, (1, 1): 4}
    m = score.metrics_of(cells)
    assert m["accuracy"] == m["precision"] == m["recall"] == m["f1"] == pytest.approx(0.7)
    assert m["kappa"] == pytest.approx(0.4)
    assert (m["ref_sensitivity"], m["ref_specificity"], m["cost"]) == pytest.approx((0.6, 0.8, 0.7))
    assert (m["tpr"], m["tnr"]) == pytest.approx((0.666667, 0.75), abs=1e-6)
    rows = [k for k, n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    assert score.auc(df, "label", "prediction").first()[0] == pytest.approx(0.708333, abs=1e-6)
    assert {(r.label, r.prediction): r.n for r in score.confusion_matrix(df, "label", "prediction").collect()} == cells
    assert score.classification_metrics(df, "label", "prediction")[()]["kappa"] == pytest.approx(0.4)


def test_one_class_only():
    m = score.metrics_of({(1, 1): 5})
    assert m["accuracy"] == 1.0 and m["kappa"] is None and m["cost"] is None


def test_adjusted_rand(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2])), "label int, cluster int")
    assert score.adjusted_rand(df, "label", "cluster").first()[0] == pytest.approx(0.242424, abs=1e-6)
    renamed = df.withColumn("cluster", 10 - F.col("cluster") * 3)
    assert score.adjusted_rand(renamed, "cluster", "label").first()[0] == pytest.approx(0.242424, abs=1e-6)
    same = score.information_scores(df, "cluster", "cluster").first()
    assert same["normalized_mutual_info"] == same["v_measure"] == pytest.approx(1.0)


def test_silhouette(spark):
    rows = list(zip(range(5), [[0.0], [1.0], [10.0], [12.0], [20.0]], [0, 0, 1, 1, 1]))
    df = spark.createDataFrame(rows, "row_id bigint, vec array<double>, cluster int")
    found = [r.silhouette for r in score.silhouette_rows(df, "cluster").orderBy("row_id").collect()]
    assert found == pytest.approx([0.928571, 0.923077, 0.368421, 0.565217, 0.538462], abs=1e-6)
    assert score.silhouette(df, "cluster").first()[0] == pytest.approx(0.66475, abs=1e-5)
    # exact copies count as rows of their own
    doubled = df.unionByName(df.withColumn("row_id", F.col("row_id") + 100))
    one_by_one = score.silhouette(doubled.withColumn("vec", F.col("vec")), "cluster", query_block=2, point_block=2).first()[0]
    values = [0.0, 0.0, 1.0, 1.0, 10.0, 10.0, 12.0, 12.0, 20.0, 20.0]
    groups = [0] * 4 + [1] * 6
    total = 0.0
    for i, (x, g) in enumerate(zip(values, groups)):
        a = [abs(x - y) for j, (y, h) in enumerate(zip(values, groups)) if h == g and j != i]
        b = [abs(x - y) for y, h in zip(values, groups) if h != g]
        a, b = sum(a) / len(a), sum(b) / len(b)
        total += (b - a) / max(a, b)
    assert one_by_one == pytest.approx(total / 10)
    alone = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 1), (3, [2.0], 1)], "row_id bigint, vec array<double>, cluster int")
    assert {r.row_id: r.silhouette for r in score.silhouette_rows(alone, "cluster").collect()}[1] == 0.0


def test_rules(spark):
    baskets = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "c"],), (["a", "b"],), (["c"],)], "items array<string>")
    itemsets = mining.frequent_itemsets(baskets, "items", 0.5).persist()
    rules = {
        ("".join(r.antecedent), "".join(r.consequent)): (r.support, r.confidence, r.lift, r.antecedent_len)
        for r in mining.association_rules(itemsets, "lift", min_lift=1.2).collect()
    }
    assert set(rules) == {("a", "b"), ("b", "a"), ("a", "bc"), ("b", "ac"), ("ac", "b"), ("bc", "a")}
    assert all(r[2] == pytest.approx(4 / 3) for r in rules.values())
    assert rules[("a", "b")][:2] == pytest.approx((0.75, 1.0))
    assert rules[("a", "bc")][:2] == pytest.approx((0.5, 2 / 3))
    assert rules[("bc", "a")][:2] == pytest.approx((0.5, 1.0)) and rules[("bc", "a")][3] == 2
    summary = mining.rule_summary(mining.association_rules(itemsets, "lift", min_lift=1.2)).first()
    assert summary.n_rules == 6 and summary.avg_lift == pytest.approx(4 / 3)


def test_support_schedule():
    s = mining.support_schedule(0.35)
    assert len(s) == 34 and s[:3] == pytest.approx([0.315, 0.2835, 0.25515]) and s[-1] == pytest.approx(0.009734, abs=1e-6)


@pytest.mark.parametrize("wanted", [1, 3, 7, 8, 10_000])
def test_decreasing_support_matches_one_pass_per_threshold(spark, wanted):
    rows = [([c for k, c in enumerate("abcdefgh") if i % (k + 2) == 0],) for i in range(60)]
    df = spark.createDataFrame(rows, "items array<string>")
    found, support = mining.frequent_itemsets_decreasing(df, "items", 0.35, wanted)
    expected = None
    for s in mining.support_schedule(0.35):
        n = mining.frequent_itemsets(df, "items", s).count()
        expected = (s, n)
        if n >= wanted:
            break
    assert (support, found.count()) == expected


def test_sweep_order():
    variations = [
        {"name": "p", "subName": "weights", "values": ["uniform", "distance"]},
        {"name": "p", "subName": "k", "values": [1, 5]},
    ]
    configs = experiments.grid({"c": "KNN"}, experiments.ordered(variations, ["k", "weights"]))
    assert [(c["p"]["k"], c["p"]["weights"]) for c in configs] == [
        (1, "uniform"), (1, "distance"), (5, "uniform"), (5, "distance"),
    ]


def test_pca(golden):
    import numpy as np

    fitted = fit_pca(golden, NUMBERS, 2)
    got = np.array([list(r) for r in fitted.transform(golden).orderBy("id").select("`Component 0`", "`Component 1`").collect()])
    x = np.array([r[1:4] for r in [(1, 1, 2, 5), (2, 2, 4, 1), (3, 3, 6, 4), (4, 4, 8, 2), (5, 5, 10, 6), (6, 6, 13, 3)]], float)
    x -= x.mean(axis=0)
    v = np.linalg.svd(x, full_matrices=False)[2][:2]
    v *= np.sign(v[np.arange(2), np.abs(v).argmax(axis=1)])[:, None]
    assert got == pytest.approx(x @ v.T)


def test_adjusted_mutual_info(spark):
    from millrace.operators.score import _log_factorial

    import math

    assert list(_log_factorial([0, 1, 5, 20, 1000])) == pytest.approx([math.lgamma(n + 1) for n in (0, 1, 5, 20, 1000)])
    # all labelings of the same shape average to zero
    import itertools

    labels = [0, 0, 0, 1, 1]
    values = []
    for chosen in itertools.combinations(range(5), 2):
        clusters = [int(i in chosen) for i in range(5)]
        cells = {}
        for pair in zip(labels, clusters):
            cells[pair] = cells.get(pair, 0) + 1
        rows, cols = {0: 3, 1: 2}, {0: 3, 1: 2}
        values.append(sum(n / 5 * math.log(5 * n / rows[a] / cols[b]) for (a, b), n in cells.items()))
    emi = sum(values) / len(values)
    h = -(0.6 * math.log(0.6) + 0.4 * math.log(0.4))
    df = spark.createDataFrame(list(zip(labels, [1, 0, 0, 1, 0])), "label int, cluster int")
    mi = score.information_scores(df, "label", "cluster").first().mutual_info
    for chunk in (1, 100):
        got = score.adjusted_mutual_info(df, "label", "cluster", chunk).first()[0]
        assert got == pytest.approx((mi - emi) / (h - emi))
    same = df.withColumn("cluster", F.col("label") + 7)
    assert score.adjusted_mutual_info(same, "label", "cluster").first()[0] == pytest.approx(1.0)
