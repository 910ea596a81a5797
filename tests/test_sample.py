"""Balancing, splits and folds."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import clean, impute, neighbors, sample


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def unbalanced(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "big" if i % 10 else "small", *map(float, rng.normal(size=2))) for i in range(400)]
    rows += [(1000 + i, "twins", 1.0, 2.0) for i in range(9)] + [(2000, "one", 5.0, 5.0)]
    return spark.createDataFrame(rows, "row_id bigint, label string, x double, y double").persist()


def test_fold_sizes_follow_the_label_sorted_order(spark):
    assert sample.fold_sizes([7, 5], 3) == [[3, 2, 2], [1, 2, 2]]
    df = spark.createDataFrame([(i, 0 if i < 7 else 1) for i in range(12)], "row_id bigint, y int")
    got = sample.stratified_folds(df.repartition(5), "y", "row_id", 3).collect()
    sizes = Counter((r.fold, r.y) for r in got)
    assert [sizes[(f, c)] for f in range(3) for c in range(2)] == [3, 1, 2, 2, 2, 2]
    # contiguous blocks in key order
    assert [r.fold for r in sorted(got) if r.y == 0] == [0, 0, 0, 1, 1, 2, 2]


def reference_folds(labels, k):
    """Positions dealt round robin in label-sorted order, then handed out in blocks per class."""
    order = sorted(set(labels), key=labels.index)
    coded = sorted(order.index(c) for c in labels)
    out = [None] * len(labels)
    for i, c in enumerate(order):
        blocks = [f for f in range(k) for _ in range(coded[f::k].count(i))]
        for j, f in zip([j for j, l in enumerate(labels) if l == c], blocks):
            out[j] = f
    return out


@given(st.lists(st.sampled_from("abc"), min_size=3, max_size=60), st.integers(2, 6))
@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
def test_folds_partition_the_rows(spark, labels, k):
    df = spark.createDataFrame(list(enumerate(labels)), "row_id bigint, label string")
    got = sorted(sample.stratified_folds(df, "label", "row_id", k).select("row_id", "fold").collect())
    assert [r.fold for r in got] == reference_folds(labels, k)


def test_split_size_and_stability(spark):
    df = spark.range(1_003).withColumnRenamed("id", "row_id")
    once = rows_of(sample.train_test_split(df.repartition(3), "row_id"))
    again = rows_of(sample.train_test_split(df.repartition(11), "row_id"))
    assert once == again and sum(t for _, t in once) == 301
    limited = sample.train_test_split(df, "row_id", limit=100)
    assert sorted(Counter(r.is_test for r in limited.collect()).items()) == [(False, 100), (True, 301)]
    assert rows_of(limited.where("is_test")) == [r for r in once if r[1]]


def test_undersample(unbalanced):
    caps = {"big": 50, "small": 1_000, "twins": 3}
    got = sample.random_undersample(unbalanced, "label", "row_id", caps)
    assert Counter(r.label for r in got.collect()) == {"big": 50, "small": 40, "twins": 3, "one": 1}
    assert rows_of(got) == rows_of(sample.random_undersample(unbalanced.repartition(9), "label", "row_id", caps))
    assert not set(rows_of(got)) - set(rows_of(unbalanced))
    even = sample.random_undersample(unbalanced.where("label <> 'one'"), "label", "row_id")
    assert Counter(r.label for r in even.collect()) == {"big": 9, "small": 9, "twins": 9}


@pytest.mark.parametrize("chunk", [10_000, 7])
def test_smote(unbalanced, chunk):
    df = unbalanced.where("label <> 'one'")
    grown = sample.smote(df, ["x", "y"], "label", "row_id", chunk=chunk)
    rows = grown.collect()
    assert Counter(r.label for r in rows) == {"big": 360, "small": 360, "twins": 360}
    assert len({r.row_id for r in rows}) == len(rows)
    assert {tuple(r)[:4] for r in rows if not r.synthetic} == set(rows_of(df))
    small = np.array([(r.x, r.y) for r in rows if r.label == "small" and not r.synthetic])
    for r in rows:
        if r.synthetic and r.label == "twins":
            assert (r.x, r.y) == (1.0, 2.0)
        if r.synthetic and r.label == "small":
            # on the segment between two rows of the class
            p = np.array([r.x, r.y])
            a, b = small[:, None, :], small[None, :, :]
            off = np.linalg.norm(p - a, axis=2) + np.linalg.norm(p - b, axis=2) - np.linalg.norm(a - b, axis=2)
            assert off.min() < 1e-9
    again = sample.smote(df.repartition(7), ["x", "y"], "label", "row_id", chunk=chunk)
    assert {r.row_id: r.x for r in rows} == pytest.approx({r.row_id: r.x for r in again.collect()})


def test_smote_of_any_keys(spark, unbalanced):
    plain = sample.smote(unbalanced, ["x", "y"], "label", "row_id").where("synthetic")
    for shift in (2**63 - 2002, -5000, -(2**62)):
        moved = unbalanced.withColumn("row_id", F.col("row_id") + F.lit(shift))
        grown = sample.smote(moved, ["x", "y"], "label", "row_id")
        keys = [r.row_id for r in grown.collect()]
        assert len(set(keys)) == len(keys) and grown.where("synthetic").count() == plain.count()
        assert max(r.row_id for r in grown.where("synthetic").collect()) < min(0, shift)
    with pytest.raises(ValueError, match="no room"):
        sample.smote(unbalanced.withColumn("row_id", F.col("row_id") + F.lit(-(2**63))), ["x", "y"], "label", "row_id")


def test_smote_of_a_single_row_and_targets(unbalanced):
    grown = sample.smote(unbalanced, ["x", "y"], "label", "row_id", targets={"one": 4, "big": 10})
    counts = Counter(r.label for r in grown.collect())
    assert counts == {"big": 360, "small": 40, "twins": 9, "one": 4}
    assert {(r.x, r.y) for r in grown.where("label = 'one'").collect()} == {(5.0, 5.0)}


def test_smote_asks_for_fewer_vectors_a_task(unbalanced, monkeypatch):
    asked, look_up = [], sample.knn
    monkeypatch.setattr(sample, "knn", lambda *a, **k: asked.append(k["query_block"]) or look_up(*a, **k))
    sample.smote(unbalanced, ["x", "y"], "label", "row_id")
    assert asked == [sample.VECTOR_QUERIES] and asked[0] < neighbors.QUERY_BLOCK


def test_combined(unbalanced):
    out = sample.combined(unbalanced, ["x", "y"], "label", "row_id", {"big": 60, "small": 60, "twins": 5, "one": 2})
    assert Counter(r.label for r in out.collect()) == {"big": 60, "small": 60, "twins": 5, "one": 2}


def test_cluster_centroids(unbalanced):
    df = unbalanced.where("label in ('big', 'small')")
    out = sample.cluster_centroids(df, ["x", "y"], "label", "row_id", k=12)
    assert Counter(r.label for r in out.collect()) == {"big": 12, "small": 12}
    kept = sample.cluster_centroids(df, ["x", "y"], "label", "row_id")
    assert set(rows_of(kept.where("label = 'small'"))) == set(rows_of(df.where("label = 'small'")))


def test_cluster_centroids_in_blocks(unbalanced):
    df = unbalanced.where("label in ('big', 'small')")
    out = sample.cluster_centroids(df, ["x", "y"], "label", "row_id", block_rows=60).collect()
    assert Counter(r.label for r in out) == {"big": 40, "small": 40}
    assert len({r.row_id for r in out}) == 80
    # the centres keep the spread of the class, not just its middle
    big = np.array([(r.x, r.y) for r in out if r.label == "big"])
    assert np.all(big.std(axis=0) > 0.5) and np.all(np.abs(big.mean(axis=0)) < 0.5)


def test_shares_of_centres():
    assert sample._quotas([10, 10, 1], 7) == [4, 3, 0]
    assert sum(sample._quotas([3, 5, 900, 17], 101)) == 101


def test_imputation(spark):
    rows = [(1, 4.0, 2.0), (2, None, 1.0), (3, 4.0, float("nan")), (4, 9.0, 1.0), (5, 9.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    frequent = impute.impute(df, ["a", "b"], "most_frequent").orderBy("id").collect()
    assert frequent[1].a == 4.0 and frequent[2].b == 1.0
    median = impute.impute(df, ["a", "b"], "median").orderBy("id").collect()
    assert median[1].a == 6.5 and median[2].b == 1.5
    assert impute.impute(df, ["a"], "").orderBy("id").collect()[1].a is None


@pytest.mark.parametrize("fraction,n", [(0.1, 12), (0.0, 0), (1.0, 123)])
def test_head_fraction(spark, fraction, n):
    df = spark.range(123).select((F.col("id") * 7 + 5).alias("row_id")).repartition(6)
    got = [r[0] for r in rows_of(clean.head_fraction(df, "row_id", fraction))]
    assert got == [i * 7 + 5 for i in range(n)]


def test_cleaning(spark):
    df = spark.createDataFrame([("na", "1", 0), ("2.5", "x", 3)], "a string, b string, y int")
    out = clean.label_to_boolean(clean.text_to_numbers(clean.sentinel_to_null(df), ["a", "b"]), "y")
    assert rows_of(out.na.fill(-1.0)) == [(-1.0, 1.0, False), (2.5, -1.0, True)]
    assert clean.name_last_column(df).columns == ["a", "b", "class"]
    profile = {r.attribute: r.n_missing for r in clean.missing_profile(out).collect()}
    assert profile == {"a": 1, "b": 1, "y": 0}
    assert tuple(clean.total_missing(out).first()) == (2, 2)
