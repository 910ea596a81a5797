"""Exact ranks and quotas on skewed data, with the counting rounds forced."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import ordering


def skewed(n=4_000, seed=1):
    rng = random.Random(seed)
    # a third of all rows share one value of one group
    rows = []
    for i in range(n):
        g = "hot" if i % 3 else "cold"
        v = 0.0 if i % 3 == 1 else rng.choice([rng.gauss(0, 1), rng.expovariate(0.001), 1e12 * rng.random()])
        rows.append((i, g, v))
    return rows


@pytest.mark.parametrize("leaf_rows", [1, 50, 1_000_000])
def test_order_statistics(spark, leaf_rows):
    rows = skewed()
    df = spark.createDataFrame(rows, "row_id bigint, g string, v double")
    bounds = ordering.group_bounds(df, "g", "v")
    ranks = {g: [0, 1, b.n // 3, b.n // 2, b.n - 1] for g, b in bounds.items()}
    found = ordering.order_statistics(df, "g", "v", bounds, ranks, leaf_rows)
    for g in bounds:
        values = sorted(v for _, h, v in rows if h == g)
        for r in ranks[g]:
            assert found[(g, r)].value == values[r]
            assert found[(g, r)].rows_up_to == sum(v <= values[r] for v in values)


@pytest.mark.parametrize("leaf_rows", [1, 1_000_000])
def test_order_statistics_of_large_keys(spark, leaf_rows):
    keys = [(1 << 62) + i * i for i in range(300)] + [-(1 << 62) - 3 * i for i in range(300)]
    df = spark.createDataFrame([(0, k) for k in keys], "g int, k bigint")
    bounds = ordering.group_bounds(df, "g", "k")
    found = ordering.order_statistics(df, "g", "k", bounds, {0: range(0, 600, 37)}, leaf_rows)
    assert [found[(0, r)].value for r in range(0, 600, 37)] == sorted(keys)[0:600:37]


@pytest.mark.parametrize("leaf_rows", [7, 1_000_000])
def test_quantiles(spark, leaf_rows):
    rows = [(v, None if i % 5 == 0 else float(i % 11), float("nan") if i % 2 else -v) for i, (_, _, v) in enumerate(skewed(600))]
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn("none", F.lit(None).cast("double"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = ordering.exact_quantiles(df, ["a", "b", "c", "none"], probs, leaf_rows)
    for i, c in enumerate("abc"):
        values = [r[i] for r in rows if r[i] is not None and not math.isnan(r[i])]
        assert found[c] == pytest.approx(np.quantile(values, probs))
    assert found["none"] == [None] * len(probs)


@pytest.mark.parametrize("leaf_rows", [3, 1_000_000])
def test_smallest_per_group_with_equal_keys(spark, leaf_rows):
    rows = [(i, "hot" if i % 3 else "cold", i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id bigint, g string, key bigint")
    quota = {"hot": 101, "cold": 0}
    got = {r.row_id for r in ordering.smallest_per_group(df, "g", "key", "row_id", quota, leaf_rows).collect()}
    hot = sorted((k, i) for i, g, k in rows if g == "hot")[:101]
    assert got == {i for _, i in hot}
    whole = ordering.smallest_per_group(df, "g", "key", "row_id", {"hot": 10_000}, leaf_rows).count()
    assert whole == 900


def test_running_counts(spark):
    rows = [(g, float(v), n) for g in ("x", "y") for v, n in zip(range(200), [1_000_000] + [i % 5 + 1 for i in range(199)])]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double, n bigint").repartition(7)
    for descending in (False, True):
        got = {(r.g, r.v): r.n_before for r in ordering.running_counts(df, "g", "v", ["n"], descending).collect()}
        for g in ("x", "y"):
            total = 0
            for v, n in sorted(((v, n) for h, v, n in rows if h == g), reverse=descending):
                assert got[(g, v)] == total
                total += n


def test_join_unique_spreads_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else str(i)) for i in range(300)], "row_id bigint, k string")
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    plain = ordering.join_unique(rows, lookup, ["k"], "n")
    split = ordering.join_unique(rows, lookup, ["k"], "n", hot_rows=10)
    key = lambda df: sorted((r.row_id, r.k, r.n, r.first) for r in df.collect())
    assert key(plain) == key(split) and len(key(split)) == 300
    assert "BroadcastHashJoin" in split._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot_rows", [20, 10_000])
def test_grouped_quantiles(spark, hot_rows):
    rows = [(i % 2, "hot" if i % 3 else f"k{i % 30}", v) for i, (_, _, v) in enumerate(skewed(900))]
    df = spark.createDataFrame(rows, "a int, b string, v double")
    got = {(r.a, r.b): (r.n, r.q) for r in ordering.grouped_quantiles(df, ["a", "b"], "v", [0.25, 0.5, 0.9], hot_rows).collect()}
    keys = {(a, b) for a, b, _ in rows}
    assert set(got) == keys
    for key in keys:
        values = [v for a, b, v in rows if (a, b) == key]
        assert got[key][0] == len(values) and got[key][1] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.9])))
