"""Classifiers, clusterings, scores, jobs and experiments."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import bayes, classify, cluster, results, sample, score, select
from millrace.plans import experiments, jobs
from millrace.spec import TableSpec

FEATURES = ("x", "y")
SPEC = TableSpec("row_id", FEATURES, "label")


def blobs(seed=0, n=60, centres=((0, 0), (6, 0), (0, 6)), names=("p", "q", "r")):
    rng = np.random.default_rng(seed)
    points = [(c, rng.normal(m, 1.0, 2)) for c, m in zip(names, centres) for _ in range(n)]
    rng.shuffle(points)
    return [(i, str(c), float(p[0]), float(p[1])) for i, (c, p) in enumerate(points)]


@pytest.fixture(scope="module")
def rows():
    return blobs()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, label string, x double, y double").persist()


@pytest.fixture(scope="module")
def vectors(table):
    return table.select("row_id", F.array("x", "y").alias("vec"), "label")


def numpy_bayes(train, test):
    x = np.array([r[2:] for r in train])
    labels = sorted({r[1] for r in train})
    eps = 1e-9 * x.var(axis=0).max()
    out = []
    for r in test:
        scores = []
        for c in labels:
            part = np.array([t[2:] for t in train if t[1] == c])
            v = part.var(axis=0) + eps
            m = part.mean(axis=0)
            scores.append(math.log(len(part) / len(train)) - 0.5 * np.sum(np.log(2 * np.pi * v) + (np.array(r[2:]) - m) ** 2 / v))
        e = np.exp(np.array(scores) - max(scores))
        out.append((labels[int(np.argmax(scores))], e / e.sum()))
    return out


@pytest.mark.parametrize("limit", [0, 10_000])
def test_bayes(table, rows, monkeypatch, limit):
    monkeypatch.setattr(bayes, "GENERATED_TERMS", limit)
    model = classify.fit_bayes(table, FEATURES, "label")
    want = numpy_bayes(rows, rows)
    got = model.predict(table).orderBy("row_id").collect()
    assert [r.prediction for r in got] == [w[0] for w in want]
    probabilities = model.predict_probability(table).orderBy("row_id").collect()
    assert np.array([r.probability for r in probabilities]) == pytest.approx(np.array([w[1] for w in want]))


def test_bayes_folds_equal_one_fit_per_fold(table):
    folds = sample.stratified_folds(table, "label", "row_id", 4).persist()
    once = {r.row_id: r.prediction for r in bayes.cross_validated(folds, FEATURES, "label").collect()}
    for f in range(4):
        model = classify.fit_bayes(folds.where(F.col("fold") != f), FEATURES, "label")
        assert all(once[r.row_id] == r.prediction for r in model.predict(folds.where(F.col("fold") == f)).collect())


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_nearest_neighbors(spark, table, rows, weights):
    test = blobs(seed=1, n=15)
    df = spark.createDataFrame(test, table.schema)
    # one test row coincides with a training row
    df = df.unionByName(table.where("row_id = 3").withColumn("row_id", F.lit(900).cast("bigint")))
    test = test + [(900, *rows[3][1:])]
    model = classify.fit_knn(table, FEATURES, "label", "row_id", 7, weights)
    got = {r.row_id: r.prediction for r in model.predict(df).collect()}
    shares = {r.row_id: r.probability for r in model.predict_probability(df).collect()}
    for r in test:
        d = [(math.dist(r[2:], t[2:]), t[0], t[1]) for t in rows]
        near = sorted(d)[:7]
        if weights == "uniform":
            w = [1.0] * 7
        elif near[0][0] == 0:
            w = [float(n[0] == 0) for n in near]
        else:
            w = [1 / n[0] for n in near]
        votes = {c: sum(v for v, n in zip(w, near) if n[2] == c) for c in "pqr"}
        assert got[r[0]] == max(sorted(votes), key=lambda c: votes[c])
        assert shares[r[0]] == pytest.approx([votes[c] / sum(votes.values()) for c in "pqr"])


@pytest.mark.parametrize(
    "name,params",
    [
        ("decisionTree", {"max_depth": 5}),
        ("randomForest", {"n_estimators": 8, "max_depth": 5}),
        ("ensembleBagging", {"base_estimator": "decisionTree", "n_estimators": 5, "max_depth": 5}),
        ("ensembleBagging", {"base_estimator": "naiveBays", "n_estimators": 5}),
        ("ensembleBagging", {"base_estimator": "KNN", "n_estimators": 3, "n_neighbors": 3}),
        ("ensembleVoting", {"members": [{"name": "KNN"}, {"name": "naiveBays"}, {"name": "decisionTree", "max_depth": 4}]}),
        ("ensembleVoting", {"members": [{"name": "KNN"}, {"name": "decisionTree", "max_depth": 4}], "voting": "soft", "weights": [1, 3]}),
    ],
)
def test_classifiers_separate_blobs(spark, table, name, params):
    model = classify.CLASSIFIERS[name](table, FEATURES, "label", "row_id", **params)
    test = spark.createDataFrame(blobs(seed=5), table.schema)
    scored = model.predict(test)
    assert scored.count() == 180
    assert scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] > 0.95


def test_bootstrap_weights(spark):
    df = spark.range(20_000).select(classify.bootstrap_weight(0, "id", F.lit(1)).alias("w"))
    mean, var = df.agg(F.avg("w"), F.var_pop("w")).first()
    assert mean == pytest.approx(1.0, abs=0.03) and var == pytest.approx(1.0, abs=0.05)


def test_majority_prefers_the_lowest_label_when_equal(spark):
    df = spark.createDataFrame([("b", "a", "c"), ("c", "c", "a")], "m string, n string, o string")
    got = df.select(classify.majority([F.col(c) for c in "mno"], [1.0, 1.0, 1.0], ["a", "b", "c"]).alias("v")).collect()
    assert [r.v for r in got] == ["a", "c"]
    got = df.select(classify.majority([F.col(c) for c in "mno"], [1.0, 1.0, 2.5], ["a", "b", "c"]).alias("v")).collect()
    assert [r.v for r in got] == ["c", "a"]


def agreement(vectors, clusters):
    return score.adjusted_rand(vectors.join(clusters, "row_id"), "label", "cluster").first()[0]


def test_clusterings_find_blobs(vectors):
    found, inertia = cluster.kmeans(vectors, 3)
    assert agreement(vectors, found) > 0.95
    assert agreement(vectors, cluster.gaussian_mixture(vectors, 3)[0]) > 0.95
    assert agreement(vectors, cluster.hierarchical(vectors, 3)) > 0.95
    assert agreement(vectors, cluster.birch(vectors, 3, threshold=0.5)) > 0.9
    assert agreement(vectors, cluster.birch(vectors, 3, threshold=0.5, branching=4, cell_rows=30)) > 0.9
    assert agreement(vectors, cluster.spectral(vectors, 3, n_neighbors=10)) > 0.95
    batch, cost = cluster.mini_batch_kmeans(vectors, 3, batch_rows=60, max_iter=9, seed=1)
    assert batch.count() == 180 and cost >= inertia * 0.999


def test_mixture_follows_expectation_maximisation(vectors, rows):
    found, bound = cluster.gaussian_mixture(vectors, 3)
    x = np.array([r[2:] for r in rows])
    label = np.array([r.cluster for r in found.orderBy("row_id").collect()])
    # start from the same partition and repeat the textbook steps until nothing moves
    r = np.eye(3)[label]
    for _ in range(200):
        n = r.sum(axis=0)
        means = (r.T @ x) / n[:, None]
        logs = np.empty((len(x), 3))
        for j in range(3):
            y = x - means[j]
            c = (r[:, j, None] * y).T @ y / n[j] + 1e-6 * np.eye(2)
            logs[:, j] = np.log(n[j] / len(x)) - 0.5 * np.log(np.linalg.det(2 * np.pi * c)) - 0.5 * np.einsum("ni,ij,nj->n", y, np.linalg.inv(c), y)
        r = np.exp(logs - logs.max(axis=1, keepdims=True))
        total = r.sum(axis=1, keepdims=True)
        best = float((np.log(total) + logs.max(axis=1, keepdims=True)).mean())
        r /= total
    assert bound == pytest.approx(best, abs=5e-3)


def test_leading_vectors(spark):
    rng = np.random.default_rng(8)
    a = rng.random((30, 30)) * (rng.random((30, 30)) < 0.3)
    a = a + a.T + np.eye(30)
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(30) if a[i, j]], "src bigint, dst bigint, s double")
    nodes = spark.range(30)
    got = cluster._leading_vectors(edges, nodes, 2, 40, 1e-9, 0).orderBy("id").collect()
    x = np.array([r.x for r in got])
    values, vectors_ = np.linalg.eigh(a)
    for j in range(2):
        v = x[:, j] / np.linalg.norm(x[:, j])
        assert abs(v @ vectors_[:, -1 - j]) > 0.999


def test_roc_matches_pair_counting(spark):
    rng = np.random.default_rng(2)
    rows = [(int(y), float(np.round(rng.normal(y, 1.5), 1))) for y in rng.integers(0, 2, 300)]
    df = spark.createDataFrame(rows, "label int, score double").repartition(5)
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert score.auc(df, "label", "score").first()[0] == pytest.approx(wins / len(pos) / len(neg))
    curve = score.roc_curve(df, "label", "score").orderBy("fpr", "tpr").collect()
    assert tuple(curve[0])[1:] == (0.0, 0.0) and tuple(curve[-1])[1:] == (1.0, 1.0)


def test_fold_summary(spark):
    rows = [("m", i, v) for i, v in enumerate([None, 2.0, None, 4.0])] + [("k", i, float(i)) for i in range(3)]
    rows += [("nan", 0, float("nan")), ("nan", 1, 1.0)]
    got = {r.metric: (r["mean"], r.fold_values) for r in score.fold_summary(spark.createDataFrame(rows, "metric string, fold int, value double")).collect()}
    assert got == {"m": (None, [2.0, 2.0, 2.0, 4.0]), "k": (1.0, [0.0, 1.0, 2.0]), "nan": (None, [1.0, 1.0])}


def test_squared_silhouette_is_linear_variant(vectors):
    found, _ = cluster.kmeans(vectors, 3)
    value = score.silhouette_squared(vectors.join(found, "row_id"), "cluster")
    assert 0.7 < value <= 1.0


def test_job_names_resolve_and_return():
    config = {"classifier": "KNN", "rescaler": "normalize", "kFold": 3, "featureFunction": "chi2"}
    bound = jobs.resolve(config)
    assert bound["classifier"] is classify.fit_knn and bound["kFold"] == 3
    assert jobs.names_of(bound) == config


@pytest.mark.parametrize(
    "config",
    [
        {"classifier": "KNN", "rescaler": "standardize", "classifierParams": {"n_neighbors": 3}},
        {"classifier": "naiveBays", "PCA": True, "percComponentsPCA": 1.0, "balancingStrategy": "randUndersample"},
        {"classifier": "decisionTree", "featureFunction": "f_classif", "featuresToKeepPercentage": 1.0, "classifierParams": {"max_depth": 4}},
        {"classifier": "naiveBays", "featureFunction": "PCA", "featuresToKeepPercentage": 1.0, "balancingStrategy": "clusterCentroidsUnderSample", "balancingParams": {"k": 20}},
        {"classifier": "naiveBays", "balancingStrategy": "smote", "rescaler": "normalize", "numTrainingPoints": 90},
    ],
)
def test_classification_job_holdout(table, config):
    [result] = jobs.classification_folds(table, SPEC, config)
    assert result["accuracy"] > 0.9 and result["accuracyTrain"] > 0.9


def test_classification_job_folds(spark, table):
    config = {"classifier": "naiveBays", "dataSplitMethod": "kfold", "kFold": 3, "correlationThreshold": 0.99}
    results_ = jobs.classification_folds(table, SPEC, config)
    assert len(results_) == 3
    out = {r.metric: r for r in jobs.classification_job(table, SPEC, config, "r1").collect()}
    assert out["accuracy"].run == "r1" and len(out["accuracy"].fold_values) == 3
    assert out["accuracy"]["mean"] == pytest.approx(np.mean([r["accuracy"] for r in results_]))
    assert jobs.cost(results_) == pytest.approx(np.mean([r["cost"] for r in results_]))


def test_correlated_columns_leave_train_and_test(spark, rows):
    df = spark.createDataFrame([(*r, r[2] * 2 + 1) for r in rows], "row_id bigint, label string, x double, y double, z double")
    spec = TableSpec("row_id", ("x", "y", "z"), "label")
    [result] = jobs.classification_folds(df, spec, {"classifier": "naiveBays", "correlationThreshold": 0.9})
    assert result["dropedCols"] == ["z"]


@pytest.mark.parametrize("name,params", [("kmeans", {"n_clusters": 3}), ("dbscan", {"eps": 0.15, "min_samples": 4})])
def test_clustering_job(table, name, params):
    found, metrics = jobs.clustering_job(table, SPEC, {"rescaler": "normalize", "clusterFunction": name, "clusterParams": params, "silhouette": "euclidean"})
    assert found.count() == 180 and metrics["ad_rand_score"] > 0.5 and metrics["silhouette"] > 0.4
    assert ("inertia" in metrics) == (name == "kmeans")


def test_clustering_job_gives_the_distance_curve(table):
    curve, _ = jobs.clustering_job(table, SPEC, {"epsP": True})
    values = [r.distance for r in curve.collect()]
    assert values == sorted(values) and len(values) == 180


def test_mining_job(table):
    config = {"featureFunction": "chi2", "nFeatures": 2, "miningParams": {"min_patterns": 10, "min_lift": 1.0, "type": "qcut"}}
    rules = jobs.mining_job(table, SPEC, config).collect()
    assert rules and all(r.lift >= 1.0 for r in rules)
    for r in rules:
        assert r.confidence == pytest.approx(r.support / r.antecedent_support)


def test_trial_values(spark):
    ranges = {
        "i": {"int": [1, 4]},
        "u": {"uniform": [0.0, 0.1]},
        "l": {"loguniform": [1e-3, 1e3]},
        "d": {"discrete": [0.0, 1.0, 0.25]},
        "c": {"categorical": ["a", "b"]},
    }
    trials = experiments.trial_values(spark, ranges, 200)
    assert trials == experiments.trial_values(spark, ranges, 200)
    assert {t["i"] for t in trials} == {1, 2, 3, 4} and {t["c"] for t in trials} == {"a", "b"}
    assert {t["d"] for t in trials} == {0.0, 0.25, 0.5, 0.75, 1.0}
    assert all(0 <= t["u"] < 0.1 and 1e-3 <= t["l"] <= 1e3 for t in trials)
    assert 60 < sum(t["l"] < 1 for t in trials) < 140


def test_search_maximises(spark):
    out = experiments.search(spark, {"x": {"uniform": [0.0, 1.0]}}, lambda p: -abs(p["x"] - 0.3), 20)
    rows = out.collect()
    best = max(rows, key=lambda r: r.value)
    assert len(rows) == 20 and [r.best for r in rows] == [r.value == best.value for r in rows]


def test_learning_curves_agree(table):
    fast = experiments.bayes_learning_curve(table, FEATURES, "label", "row_id", sizes=(0.3, 1.0), folds=3).orderBy("size").collect()
    slow = experiments.learning_curve(table, classify.fit_bayes, FEATURES, "label", "row_id", sizes=(0.3, 1.0), folds=3)
    for f in fast:
        part = [r for r in slow.collect() if r["size"] == f["size"]]
        assert f.test_mean == pytest.approx(np.mean([r.test_score for r in part]))
        assert f.train_std == pytest.approx(np.std([r.train_score for r in part]))


def test_nearest_learning_curve_agrees_with_single_models(table):
    sizes = (0.05, 0.4, 1.0)
    fast = experiments.nearest_learning_curve(table, FEATURES, "label", "row_id", 7, sizes=sizes, folds=3).orderBy("size").collect()
    fit = lambda *a: classify.fit_knn(*a, n_neighbors=7)
    slow = experiments.learning_curve(table, fit, FEATURES, "label", "row_id", sizes=sizes, folds=3).collect()
    assert [f["size"] for f in fast] == list(sizes)
    for f in fast:
        part = [r for r in slow if r["size"] == f["size"]]
        assert f.test_mean == pytest.approx(np.mean([r.test_score for r in part]))
        assert f.train_std == pytest.approx(np.std([r.train_score for r in part]))


def test_bagged_neighbours_deepen_and_take_any_key(spark, table):
    # keys near the end of the range, and so many neighbours that first lists run short
    far = table.withColumn("row_id", F.lit(2**62) + F.col("row_id"))
    one = classify.fit_bagging(table, FEATURES, "label", "row_id", "KNN", n_estimators=3, n_neighbors=5)
    drawn = [{r.row_id for r in table.where(classify.bootstrap_weight(0, "row_id", F.lit(t)) > 0).collect()} for t in range(3)]
    assert len(set(map(frozenset, drawn))) == 3
    probability = {r.row_id: r.probability for r in one.predict_probability(table).collect()}
    assert len(probability) == table.count() and all(abs(sum(p) - 1) < 1e-9 for p in probability.values())
    many = classify.fit_bagging(far, FEATURES, "label", "row_id", "KNN", n_estimators=2, n_neighbors=table.count())
    assert many.predict(far).count() == table.count()


def test_nearest_by_trees_votes_like_the_exact_join(table):
    exact = classify.fit_knn(table, FEATURES, "label", "row_id")
    trees = classify.fit_knn(table, FEATURES, "label", "row_id", recall=0.95)
    a, b = ({r.row_id: r.prediction for r in m.predict(table).collect()} for m in (exact, trees))
    assert a.keys() == b.keys() and sum(a[i] == b[i] for i in a) >= 0.95 * len(a)
    with pytest.raises(ValueError, match="recall"):
        classify.fit_knn(table, FEATURES, "label", "row_id", recall=1.5)


def test_best_points_flags_equal_distances(spark):
    rows = [("r", float(v), 0.0) for v in (9, 9, 8, 8, 7, 6)] + [("s", 1.0, 0.0)]
    got = results.best_points(spark.createDataFrame(rows, "run string, a double, b double"), "a", "b")
    flags = Counter((r.run, r.distance, r.place) for r in got.collect())
    assert flags == {("r", 9.0, "best"): 2, ("r", 8.0, "best"): 2, ("r", 7.0, "second"): 1, ("r", 6.0, ""): 1, ("s", 1.0, "best"): 1}


@pytest.mark.parametrize("hot_rows", [4, 10_000])
def test_box_summary(spark, hot_rows):
    lists = spark.createDataFrame([("r", 1, "[1.0, 2.0, 3.0, 4.0, 100.0]"), ("r", 2, "[5.0, null]")], "run string, x int, v string")
    got = {r.x: tuple(r)[2:] for r in results.box_summary(results.box_values(lists, "x", "v"), ["run", "x"], hot_rows=hot_rows).collect()}
    assert got == {1: (1.0, 2.0, 3.0, 4.0, 4.0), 2: (5.0, 5.0, 5.0, 5.0, 5.0)}


def test_spearman_averages_equal_ranks(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, 200), rng.normal(size=200)
    y = y + x
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "row_id bigint, a double, b double")

    def ranks(v):
        return np.array([np.sum(v < u) + (np.sum(v == u) + 1) / 2 for u in v])

    want = np.corrcoef(ranks(x), ranks(y))[0, 1]
    assert select.spearman_pairs(df, "row_id", ["a", "b"]).first().rho == pytest.approx(want)


def test_mixed_selection_ranks_by_p_value(spark):
    rows = [(i, float(i % 2), float(i % 3), float((i // 2) % 2), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id int, same double, other double, flag double, y int")
    scores = select.mixed_scores(df, ["other"], ["same", "flag"], "y")
    assert scores[0].feature == "same" and scores[0].p_value < 1e-6


def test_spearman_of_column_blocks_and_missing_values(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 9, (80, 5)).astype(float)
    x[:, 3] = 2.0
    x[rng.random((80, 5)) < 0.2] = np.nan
    cols = [f"c{j}" for j in range(5)]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, " + ", ".join(f"{c} double" for c in cols))
    ranks = np.full(x.shape, np.nan)
    for j in range(5):
        there = np.flatnonzero(~np.isnan(x[:, j]))
        ranks[there, j] = [(x[there, j] < v).sum() + ((x[there, j] == v).sum() + 1) / 2 for v in x[there, j]]
    want = {}
    for i in range(5):
        for j in range(i + 1, 5):
            both = ~np.isnan(ranks[:, i]) & ~np.isnan(ranks[:, j])
            a, b = ranks[both, i], ranks[both, j]
            want[cols[i], cols[j]] = None if a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]
    for width in (256, 2):
        got = {(r.col_i, r.col_j): r.rho for r in select.spearman_pairs(df, "row_id", cols, width).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in want.items())


@pytest.mark.parametrize("width", [256, 2])
def test_spearman_hands_plain_arrays_to_python(spark, monkeypatch, width):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(-i)) for i in range(40)], "row_id bigint, a double, b double, c double")
    given, through = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **k: given.append(self.schema.simpleString()) or through(self, *a, **k))
    assert select.spearman_pairs(df, "row_id", ["a", "b", "c"], width).count() == 3
    assert len(given) == 1 and "struct" not in given[0].removeprefix("struct")
