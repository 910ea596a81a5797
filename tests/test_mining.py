"""Apriori beside FP-growth and counting by hand; rules grown level by level beside all splits."""

from itertools import combinations

import numpy as np
import pytest

from millrace.operators import mining


def baskets(seed, n=300, width=9):
    rng = np.random.default_rng(seed)
    return [[f"i{j:02d}" for j in rng.permutation(width)[: rng.integers(0, width)]] + (["i00"] if k % 2 else []) for k in range(n)]


def as_table(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "items array<string>").repartition(3)


def counted(rows, least):
    out = {}
    for row in rows:
        for size in range(1, len(set(row)) + 1):
            for c in combinations(sorted(set(row)), size):
                out[c] = out.get(c, 0) + 1
    return {c: n for c, n in out.items() if n >= least}


@pytest.mark.parametrize("seed, support", [(0, 0.05), (1, 0.2), (2, 0.6), (3, 0.99)])
def test_apriori_counts_all_frequent_sets(spark, seed, support):
    rows = baskets(seed)
    got = {tuple(r.itemset): (r.freq, r.support) for r in mining.apriori(as_table(spark, rows), "items", support).collect()}
    want = counted(rows, int(np.ceil(support * len(rows))))
    assert {c: n for c, (n, _) in got.items()} == want
    assert all(s == pytest.approx(n / len(rows)) for n, s in got.values())


def test_apriori_equals_fp_growth(spark):
    rows = [sorted(set(r)) for r in baskets(5)]
    table = as_table(spark, rows).persist()
    both = [{(tuple(r.itemset), r.freq, r.support) for r in mining.frequent_itemsets(table, "items", 0.1, alg=a).collect()} for a in ("fpgrowth", "apriori")]
    assert both[0] == both[1] and both[0]


def test_apriori_of_awkward_tables(spark):
    assert mining.apriori(as_table(spark, []), "items", 0.1).collect() == []
    rows = spark.createDataFrame([(None,), ([],), (["a", None, "a"],), (["a", "b"],)], "items array<string>")
    got = {tuple(r.itemset): r.freq for r in mining.apriori(rows, "items", 0.5).collect()}
    assert got == {("a",): 2}


MEASURES = {
    "confidence": lambda s, a, c: s / a,
    "lift": lambda s, a, c: s / a / c,
    "leverage": lambda s, a, c: s - a * c,
    "conviction": lambda s, a, c: float("inf") if s >= a else (1 - c) / (1 - s / a),
    "support": lambda s, a, c: s,
    "antecedent_support": lambda s, a, c: a,
}


@pytest.mark.parametrize("metric, least", [("confidence", 0.6), ("lift", 1.01), ("lift", 0.0), ("leverage", 0.01), ("leverage", -0.5), ("conviction", 1.05), ("support", 0.1), ("antecedent_support", 0.3)])
def test_rules_are_all_splits_that_meet_the_metric(spark, metric, least):
    rows = baskets(7, 120, 7)
    sets = counted(rows, 6)
    table = spark.createDataFrame([(list(c), n / len(rows)) for c, n in sets.items()], "itemset array<string>, support double")
    got = {(tuple(r.antecedent), tuple(r.consequent)) for r in mining.association_rules(table, metric, least, least).collect()}
    want, near = set(), set()
    for c, n in sets.items():
        for size in range(1, len(c)):
            for y in combinations(c, size):
                x = tuple(i for i in c if i not in y)
                value = MEASURES[metric](n / len(rows), sets[x] / len(rows), sets[y] / len(rows))
                if value >= least:
                    want.add((x, y))
                if abs(value - least) < 1e-12:
                    near.add((x, y))
    assert got - near == want - near and want


def test_a_long_itemset_grows_no_masks(spark):
    items = [f"i{j:02d}" for j in range(40)]
    # the whole set, its largest subsets, and the single items
    sets = [(items, 0.5)] + [(items[:j] + items[j + 1 :], 0.5 + j / 100) for j in range(40)] + [([i], 0.9) for i in items]
    table = spark.createDataFrame(sets, "itemset array<string>, support double")
    got = {(r.consequent[0], round(r.confidence, 9)) for r in mining.association_rules(table, "confidence", 0.9).collect()}
    assert got == {(items[j], round(0.5 / (0.5 + j / 100), 9)) for j in range(40) if 0.5 / (0.5 + j / 100) >= 0.9}


def test_rules_of_tables_without_pairs(spark):
    assert mining.association_rules(spark.createDataFrame([(["a"], 0.5)], "itemset array<string>, support double")).collect() == []
    assert mining.association_rules(spark.createDataFrame([], "itemset array<string>, support double")).collect() == []
