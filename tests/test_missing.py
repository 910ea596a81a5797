"""Missing and infinite values, and equal answers on both sides of former limits."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.catalog import groups
from millrace.functions import ordering
from millrace.operators import bayes, classify, cluster, neighbors, sample, select
from millrace.session import keep, scope
from millrace.sources import runs

INF = math.inf


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=2)], "ab"[i % 2]) for i in range(60)]
    return spark.createDataFrame(rows, "row_id bigint, vec array<double>, label string")


@pytest.mark.parametrize("bad", [None, math.nan, INF])
def test_neighbours_refuse_or_leave_out_missing_values(spark, points, bad):
    gaps = points.withColumn("vec", F.when(F.col("row_id") % 9 == 0, F.array(F.col("row_id").cast("double"), F.lit(bad).cast("double"))).otherwise(F.col("vec")))
    with pytest.raises(ValueError, match=r"7 reference rows.*\[0, 7\]"):
        neighbors.knn(points, gaps, 3)
    with pytest.raises(ValueError, match="7 query rows"):
        neighbors.knn(gaps, points, 3)
    got = neighbors.knn(gaps, gaps, 3, exclude_self=True, missing="drop").collect()
    want = neighbors.knn(*[points.where("row_id % 9 <> 0")] * 2, 3, exclude_self=True).collect()
    assert sorted(got) == sorted(want) and len(got) == 53 * 3
    with pytest.raises(ValueError):
        neighbors.knn(points, points, 1, missing="ignore")


def test_missing_class_is_not_the_empty_class(spark, points):
    odd = points.withColumn("label", F.when(F.col("row_id") < 10, "").when(F.col("row_id") < 20, F.lit(None)).otherwise("x"))
    near = neighbors.knn(odd, odd, 9, group="label", exclude_self=True).collect()
    part = lambda i: min(i // 10, 2)
    assert all(part(r.row_id) == part(r.neighbor_id) for r in near)


def test_rows_without_a_label_stay(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(50)], "row_id bigint, label string")
    folds = sample.stratified_folds(df, "label", "row_id", 4).collect()
    assert len(folds) == 50 and all((r.fold is None) == (r.label is None) for r in folds)
    assert sample.random_undersample(df, "label", "row_id", caps={}).count() == 50
    assert sample.random_undersample(df, "label", "row_id", caps={"a": 3, "b": 0}).groupBy("label").count().orderBy("label").collect() == [(None, 10), ("a", 3)]


@pytest.mark.parametrize("leaf", [5, 10**6])
def test_order_statistics_with_infinities_and_huge_ranges(spark, leaf):
    values = [INF] * 40 + [-INF] * 30 + [1e308, -1e308, 5e-324, 0.0, -5e-324] + [i / 7 for i in range(200)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    ranks = [0, 29, 30, 31, 32, 33, 100, len(values) - 41, len(values) - 40, len(values) - 1]
    found = ordering.order_statistics(df, "g", "v", ordering.group_bounds(df, "g", "v"), {"g": ranks}, leaf_rows=leaf)
    ordered = sorted(values)
    assert {r: found["g", r].value for r in ranks} == {r: ordered[r] for r in ranks}
    assert all(found["g", r].rows_up_to == sum(v <= ordered[r] for v in values) for r in ranks)
    assert ordering.exact_quantiles(df, ["v"], [0.0, 0.5, 1.0], leaf)["v"] == [-INF, statistics.median(values), INF]


def test_correlations_are_pairwise_at_any_width(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6)) + 1e6
    x[:, 5] = 7.0
    rows = [[None if rng.random() < 0.2 else float(v) for v in row] for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(6)))
    cols = df.columns
    few, many = ({(r.col_i, r.col_j): r.abs_corr for r in select.correlation_pairs(df, cols, narrow=n).collect()} for n in (40, 2))
    assert set(few) == set(many) and len(few) == 10
    assert all(few[p] == pytest.approx(many[p], rel=1e-7) for p in few)


@pytest.mark.parametrize("bad", [None, math.nan])
def test_bayes_gives_no_class_to_a_missing_feature_on_either_path(spark, monkeypatch, bad):
    rows = [(i, float(i % 7), float(i % 3), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, y int")
    model = bayes.fit_gaussian(df, ["a", "b"], "y")
    asked = df.withColumn("b", F.when(F.col("row_id") % 4 == 0, F.lit(bad).cast("double")).otherwise(F.col("b")))

    def answers():
        got = asked.select("row_id", model.prediction().alias("p"), model.probabilities().alias("q")).orderBy("row_id").collect()
        return [(r.row_id, r.p, r.q and [round(v, 9) for v in r.q]) for r in got]

    narrow = answers()
    monkeypatch.setattr(bayes, "GENERATED_TERMS", 0)
    assert answers() == narrow
    assert all((p is None) == (i % 4 == 0) and (q is None) == (i % 4 == 0) for i, p, q in narrow)


def test_bagging_averages_probabilities(spark):
    df = spark.createDataFrame([(i, float(i), i % 3 == 0) for i in range(60)], "row_id bigint, a double, y boolean")
    for base in ("naiveBays", "KNN"):
        model = classify.fit_bagging(df, ["a"], "y", "row_id", base, n_estimators=3)
        got = model.predict(df)
        assert got.columns == [*df.columns, "prediction"] and got.count() == 60
    model = classify.fit_bagging(df, ["a"], "y", "row_id", "naiveBays", n_estimators=4)
    shares = model.predict_probability(df).join(model.predict(df).select("row_id", "prediction"), "row_id").collect()
    members = [{r.row_id: r.q for r in df.select("row_id", m.probabilities().alias("q")).collect()} for m in model.models]
    for r in shares:
        mean = [sum(m[r.row_id][j] for m in members) / 4 for j in range(2)]
        assert r.probability == pytest.approx(mean) and r.prediction == (mean[1] > mean[0])


def test_votes_meet_in_one_aggregation(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(30)], "row_id bigint, a double, y int")
    members = [{"name": "KNN", "n_neighbors": k} for k in (1, 3, 5)]
    model = classify.fit_voting(df, ["a"], "y", "row_id", members)
    text = model.predict(df)._jdf.queryExecution().optimizedPlan().toString()
    # a member looks at the rows, not at the other members' answers
    assert text.count("FlatMapCoGroupsInPandas") == 3


def test_mini_batches_use_all_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 2) * 10 + i * 1e-3, 0.0]) for i in range(400)], "row_id bigint, vec array<double>")
    seen = []
    sums = cluster._batch_sums

    def counted(rows, centres):
        out = sums(rows, centres)
        seen.append(sum(n for n, _ in out.values()))
        return out

    monkeypatch.setattr(cluster, "_batch_sums", counted)
    out, cost = cluster.mini_batch_kmeans(df, 2, batch_rows=10, max_iter=3, max_batches=4)
    assert sum(seen[:4]) == 400 and len(seen) % 4 == 0
    assert out.groupBy("cluster").count().count() == 2 and cost < 400


def test_mini_batches_with_tasks_that_meet_no_row(spark):
    rows = [(i, [float(i % 2) * 10 + i * 1e-3, 0.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "row_id bigint, vec array<double>").repartition(24)
    out, cost = cluster.mini_batch_kmeans(df, 2, batch_rows=4)
    found = {r.row_id: r.cluster for r in out.collect()}
    assert len(found) == 12 and all(found[i] == found[i % 2] for i in found) and found[0] != found[1]
    assert cost == pytest.approx(sum((2 * k - 5) ** 2 * 1e-6 for k in range(6)) * 2, rel=0.05)
    assert cluster._batch_sums(df.where("row_id < 0"), np.zeros((2, 2))) == {}


def test_groups_apart_are_found_in_files_split_finer_than_their_rows(spark, tmp_path):
    texts = spark.createDataFrame([(i, "word " * i, 5 * i) for i in range(1, 17)], "doc_id bigint, text string, n_chars int")
    texts.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    texts.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    # a file has one group of rows: of its splits, all but one come without a row
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        found = {r.row_id: r.cluster for r in groups.mini_batch_kmeans_apart(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {i: (i - 1) % 4 for i in range(1, 17)}


def test_ward_is_the_same_in_one_and_in_several_cells(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [20, 0], [0, 20], [20, 20]])
    rows = [(i, [float(v) for v in centres[i % 4] + rng.normal(size=2)]) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id bigint, vec array<double>")
    answers = [{r.row_id: r.cluster for r in cluster.hierarchical(df, 4, cell_clusters=m).collect()} for m in (1_000, 199, 40)]
    assert all(a == answers[0] for a in answers) and answers[0] == {i: i % 4 for i in range(200)}


def test_spectral_looks_neighbours_up_once(spark, points, monkeypatch):
    ran = []
    look_up = cluster.knn

    def counted(*a, **k):
        met = spark.sparkContext.accumulator(0)
        ran.append(met)

        def meet(batches):
            met.add(1)
            yield from batches

        found = look_up(*a, **k).coalesce(1)
        return found.mapInPandas(meet, found.schema)

    monkeypatch.setattr(cluster, "knn", counted)
    cluster.spectral(points, 2, n_neighbors=5).collect()
    assert [met.value for met in ran] == [1]


def test_unsettled_iterations_raise(spark, points):
    with pytest.raises(RuntimeError, match="did not settle"):
        cluster.gaussian_mixture(points, 3, max_iter=1, tol=0.0)
    with pytest.raises(RuntimeError, match="did not settle"):
        cluster.spectral(points, 2, n_neighbors=5, max_iter=1)


def test_runs_with_half_a_record_stay(spark):
    configs = spark.createDataFrame([("a", 1), ("b", 2)], "run string, k int")
    metrics = spark.createDataFrame([("a", 0.5), ("c", 0.7)], "run string, accuracy double")
    got = runs.unify(configs, metrics).orderBy("run").collect()
    assert [tuple(r) for r in got] == [("a", 1, 0.5), ("b", 2, None), ("c", None, 0.7)]


def test_scope_releases_tables(spark):
    spark.catalog.clearCache()
    with scope():
        df = keep(spark.range(10))
        df.count()
        assert df.is_cached
    assert not df.is_cached
