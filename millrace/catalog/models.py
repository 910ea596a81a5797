"""Queries: classifiers, their votes, and the classification job."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import fixtures as fx
from millrace.catalog import statements as st
from millrace.catalog.registry import query, r6, rounded
from millrace.operators import bayes, classify, impute, neighbors, projection, sample, score
from millrace.plans import jobs
from millrace.session import new_path
from millrace.sources import models as stored

DOC_COLS = fx.DOCS.features
METRIC_OUT = ", ".join(st.r(m, m) for m in st.METRIC_NAMES)


def metric_rows(spark, metrics, key="fold int"):
    """One row per group with the classification scores."""
    fields = ", ".join([key, *[f"{m} double" for m in st.METRIC_NAMES]])
    rows = [(*k, *[v[m] for m in st.METRIC_NAMES]) for k, v in sorted(metrics.items())]
    return rounded(spark.createDataFrame(rows, fields), *st.METRIC_NAMES)


def embedding_split(spark, sf, vector=False):
    df = fx.embeddings(spark, sf) if vector else fx.embeddings_wide(spark, sf)
    marked = sample.train_test_split(df, "row_id").persist()
    return marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")


def doc_split(spark, sf):
    marked = sample.train_test_split(fx.doc_features(spark, sf), "row_id").persist()
    return marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")


# --- nearest neighbours --------------------------------------------------------------


@query(
    f"WITH {fx.EMB_SQL}, {st.knn_cte('emb', 'emb', 5)} "
    f"SELECT row_id, neighbor_id, {st.r('distance', 'distance')}, CAST(rank AS INTEGER) AS rank FROM near"
)
def nearest_neighbor_join(spark, sf):
    emb = fx.embeddings(spark, sf)
    return rounded(neighbors.knn(emb, emb, 5, exclude_self=True), "distance")


@query(
    f"WITH {fx.EMB_SQL}, {st.knn_cte('emb', 'emb', 3, same='label')} "
    f"SELECT row_id, neighbor_id, {st.r('distance', 'distance')}, CAST(rank AS INTEGER) AS rank FROM near"
)
def nearest_neighbor_join_within_class(spark, sf):
    emb = fx.embeddings(spark, sf)
    return rounded(neighbors.knn(emb, emb, 3, group="label", exclude_self=True), "distance")


@query(
    f"""WITH {fx.DOCS_SQL}, kept AS (SELECT row_id, [n_chars, n_lines] AS vec FROM docs_f WHERE row_id % 7 <> 0),
{st.knn_cte('kept', 'kept', 4)}
SELECT row_id, neighbor_id, {st.r('distance', 'distance')}, CAST(rank AS INTEGER) AS rank FROM near"""
)
def nearest_join_with_missing(spark, sf):
    """Rows with a missing value neither ask nor answer."""
    docs = fx.doc_features(spark, sf).persist()
    gaps = docs.withColumn("n_lines", F.when(F.col("row_id") % 7 != 0, F.col("n_lines")))
    vectors = gaps.select("row_id", F.array("n_chars", "n_lines").alias("vec"))
    return rounded(neighbors.knn(vectors, vectors, 4, exclude_self=True, missing="drop"), "distance")


@query()
def nearest_by_trees_recall(spark, sf):
    """Share of the ten nearest rows that random-projection trees find when asked for nine in ten."""
    emb = fx.embeddings(spark, sf).persist()
    found = projection.knn_by_trees(emb, emb, 10, recall=0.9, leaf_rows=64, exclude_self=True)
    return projection.measured_recall(found, emb, emb, 10, exclude_self=True)


@query(f"WITH {fx.EMB_SQL}, {st.knn_cte('emb', 'emb', 1)} SELECT row_id, {st.r('distance', 'distance')} FROM near")
def nearest_distance_curve(spark, sf):
    """Distance to the closest other row, ascending: the elbow gives eps."""
    return rounded(neighbors.nearest_distance_curve(fx.embeddings(spark, sf)), "distance")


def knn_votes_sql(k: int, weights: str) -> str:
    return f"""WITH {fx.EMB_SQL}, {st.split_cte('emb')}, train AS (SELECT * FROM marked WHERE NOT is_test),
test AS (SELECT * FROM marked WHERE is_test), {st.knn_cte('test', 'train', k, carry='label', not_self=False)},
{st.vote_cte('label', weights)} SELECT v.row_id, t.label, v.prediction FROM votes v JOIN test t ON t.row_id = v.row_id"""


def _knn(spark, sf, k, weights):
    train, test = embedding_split(spark, sf)
    model = classify.fit_knn(train, fx.EMB_FEATURES, "label", "row_id", k, weights)
    return model.predict(test).select("row_id", "label", "prediction")


@query(knn_votes_sql(5, "uniform"))
def classify_nearest_uniform(spark, sf):
    return _knn(spark, sf, 5, "uniform")


@query(knn_votes_sql(20, "distance"))
def classify_nearest_by_distance(spark, sf):
    return _knn(spark, sf, 20, "distance")


# --- naive Bayes ------------------------------------------------------------------------


def bayes_holdout_cte(src: str, cols, label: str) -> str:
    """pred(row_id, label, prediction, p) of the rows of marked(...) that are tests."""
    stats = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in cols)
    eps = "1e-9 * greatest(" + ", ".join(f"var_pop({c})" for c in cols) + ")"
    ll = " + ".join(
        f"-0.5 * ln(2 * pi() * (v_{c} + eps)) - (t.{c} - m_{c}) * (t.{c} - m_{c}) / (2 * (v_{c} + eps))" for c in cols
    )
    return f"""st_ AS (SELECT {label} AS c, count(*) AS n, {stats} FROM marked WHERE NOT is_test GROUP BY {label}),
tot_ AS (SELECT count(*) AS n_all, {eps} AS eps FROM marked WHERE NOT is_test),
ll_ AS (SELECT t.row_id, t.{label} AS label, c, ln(n * 1.0 / n_all) + {ll} AS score FROM marked t, st_, tot_ WHERE is_test),
p_ AS (SELECT *, exp(score - max(score) OVER (PARTITION BY row_id)) AS e FROM ll_),
prob_ AS (SELECT row_id, label, c, score, e / sum(e) OVER (PARTITION BY row_id) AS p FROM p_),
pred AS (SELECT row_id, label, c AS prediction, p FROM
  (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, c) AS rn FROM prob_) WHERE rn = 1)"""


@query(
    f"WITH {fx.EMB_WIDE_SQL}, {st.split_cte('emb_wide')}, {bayes_holdout_cte('emb_wide', fx.EMB_FEATURES, 'label')} "
    "SELECT row_id, label, prediction FROM pred"
)
def classify_bayes(spark, sf):
    train, test = embedding_split(spark, sf)
    model = classify.fit_bayes(train, fx.EMB_FEATURES, "label")
    return model.predict(test).select("row_id", "label", "prediction")


@query(
    f"WITH {fx.DOCS_SQL}, {st.split_cte('docs_f')}, {bayes_holdout_cte('docs_f', DOC_COLS, 'quality')} "
    f"SELECT row_id, {st.r('p', 'top_probability')} FROM pred"
)
def bayes_probabilities(spark, sf):
    train, test = doc_split(spark, sf)
    scored = classify.fit_bayes(train, DOC_COLS, "quality").predict_probability(test)
    return scored.select("row_id", r6(F.array_max("probability"), "top_probability"))


@query(
    f"""WITH {fx.FILLED_SQL}, {st.folds_cte('filled', 'label', 5, 't.price, t.month, t.day, t.priority')},
{st.bayes_folds_cte(fx.ORDERS.features, 'label', 5)}, {st.metrics_cte()} SELECT grp AS fold, {METRIC_OUT} FROM metrics"""
)
def classify_orders_by_fold(spark, sf):
    """Orders: impute, min-max scale on the training folds, stratified folds, naive Bayes, scores per fold."""
    orders = impute.impute(fx.orders_features(spark, sf), ["price"], "median")
    folds = sample.stratified_folds(orders, "label", "row_id", 5)
    predicted = bayes.cross_validated(folds, fx.ORDERS.features, "label", rescaled=True)
    return metric_rows(spark, score.classification_metrics(predicted, "label", "prediction", ["fold"]))


# --- trees, forests, ensembles --------------------------------------------------------------


def doc_predictions(spark, sf, name, **params):
    train, test = doc_split(spark, sf)
    model = classify.CLASSIFIERS[name](train, DOC_COLS, "quality", "row_id", **params)
    return model.predict(test).select("row_id", F.col("quality").alias("label"), "prediction")


def doc_trees_sql(depth, criterion="gini", trees=1, subset=None, weight="1"):
    """row_id and mean class shares of the test documents."""
    return f"""{fx.DOCS_SQL}, {st.split_cte('docs_f')}, train_ AS (SELECT * FROM marked WHERE NOT is_test), test_ AS (SELECT * FROM marked WHERE is_test),
{st.trees_cte('train_', 'test_', DOC_COLS, 'quality', (0, 1), depth, criterion, trees, weight, subset)},
mean_ AS (SELECT row_id, sum(p0) / {trees} AS m0, sum(p1) / {trees} AS m1 FROM share_ GROUP BY row_id)"""


def doc_trees_predicted(**params):
    best = st.best_class(["m0", "m1"], (0, 1))
    return f"WITH {doc_trees_sql(**params)} SELECT row_id, quality AS label, {best} AS prediction FROM mean_ JOIN test_ USING (row_id)"


BOOTSTRAP = st.boot_weight_sql(0, "row_id", "tree")


@query(doc_trees_predicted(depth=2))
def classify_shallow_tree(spark, sf):
    return doc_predictions(spark, sf, "decisionTree", max_depth=2)


@query(
    f"WITH {doc_trees_sql(depth=3)} SELECT row_id, {st.r('m0', 'p_poor')}, {st.r('m1', 'p_good')} FROM mean_"
)
def tree_probabilities(spark, sf):
    train, test = doc_split(spark, sf)
    model = classify.fit_tree(train, DOC_COLS, "quality", max_depth=3)
    found = model.predict_probability(test)
    return found.select("row_id", r6(F.col("probability")[0], "p_poor"), r6(F.col("probability")[1], "p_good"))


@query(doc_trees_predicted(depth=9, criterion="entropy"))
def classify_tree(spark, sf):
    return doc_predictions(spark, sf, "decisionTree", criterion="entropy", max_depth=9)


@query(doc_trees_predicted(depth=8, trees=20, subset=2, weight=BOOTSTRAP))
def classify_forest(spark, sf):
    return doc_predictions(spark, sf, "randomForest", n_estimators=20, max_depth=8)


@query(doc_trees_predicted(depth=8, trees=10, weight=BOOTSTRAP))
def classify_bagged_trees(spark, sf):
    return doc_predictions(spark, sf, "ensembleBagging", base_estimator="decisionTree", n_estimators=10, max_depth=8)


def _bagged_bayes_sql(t: int = 10) -> str:
    mean = ", ".join(f"sum(w * {c}) / sum(w) AS m_{c}" for c in DOC_COLS)
    var = ", ".join(f"sum(w * (d.{c} - m_{c}) * (d.{c} - m_{c})) / sum(w) AS v_{c}" for c in DOC_COLS)
    ll = " + ".join(
        f"-0.5 * ln(2 * pi() * (v_{c} + eps)) - (t.{c} - m.m_{c}) * (t.{c} - m.m_{c}) / (2 * (v_{c} + eps))" for c in DOC_COLS
    )
    w = st.boot_weight_sql(0, "row_id", "rep")
    return f"""WITH {fx.DOCS_SQL}, {st.split_cte('docs_f')},
drawn AS (SELECT * FROM (SELECT *, {w} AS w FROM marked, range({t}) r(rep) WHERE NOT is_test) WHERE w > 0),
m AS (SELECT rep, quality AS c, sum(w) AS n, {mean} FROM drawn GROUP BY rep, quality),
v AS (SELECT d.rep, d.quality AS c, {var} FROM drawn d JOIN m ON m.rep = d.rep AND m.c = d.quality GROUP BY d.rep, d.quality),
ma AS (SELECT rep, sum(w) AS n_all, {mean} FROM drawn GROUP BY rep),
ea AS (SELECT d.rep, 1e-9 * greatest({', '.join(f'sum(w * (d.{c} - m_{c}) * (d.{c} - m_{c})) / sum(w)' for c in DOC_COLS)}) AS eps
       FROM drawn d JOIN ma ON ma.rep = d.rep GROUP BY d.rep),
ll AS (SELECT m.rep, t.row_id, t.quality AS label, m.c, ln(n * 1.0 / n_all) + {ll} AS score
       FROM marked t, m JOIN v ON v.rep = m.rep AND v.c = m.c JOIN ma ON ma.rep = m.rep JOIN ea ON ea.rep = m.rep WHERE is_test),
top AS (SELECT *, max(score) OVER (PARTITION BY rep, row_id) AS most FROM ll),
p AS (SELECT row_id, label, c, exp(score - most) / sum(exp(score - most)) OVER (PARTITION BY rep, row_id) AS p FROM top)
SELECT row_id, label, c AS prediction FROM (
  SELECT row_id, label, c, row_number() OVER (PARTITION BY row_id ORDER BY round(sum(p) / {t}, 9) DESC, c) AS rn FROM p GROUP BY row_id, label, c) WHERE rn = 1"""


@query(_bagged_bayes_sql())
def classify_bagged_bayes(spark, sf):
    return doc_predictions(spark, sf, "ensembleBagging", base_estimator="naiveBays", n_estimators=10)


DOC_VEC = "[" + ", ".join(DOC_COLS) + "]"


def _bagged_nearest_sql(replicates: int = 3, k: int = 5) -> str:
    parts, votes = [], []
    for t in range(replicates):
        w = st.boot_weight_sql(0, "row_id", str(t))
        parts.append(
            f"""drawn{t} AS (SELECT row_id * 16 + unnest(range(w)) AS row_id, vec, quality
              FROM (SELECT *, {DOC_VEC} AS vec, {w} AS w FROM marked WHERE NOT is_test) WHERE w > 0),
{st.knn_cte('test', f'drawn{t}', k, carry='quality', not_self=False, out=f'near{t}')}"""
        )
        votes.append(f"SELECT row_id, quality AS c, count(*) / {k}.0 AS p FROM near{t} GROUP BY row_id, quality")
    return f"""WITH {fx.DOCS_SQL}, {st.split_cte('docs_f')}, test AS (SELECT *, {DOC_VEC} AS vec FROM marked WHERE is_test), {', '.join(parts)},
won AS (SELECT row_id, c AS prediction, row_number() OVER (PARTITION BY row_id ORDER BY round(sum(p), 9) DESC, c) AS rn
        FROM ({' UNION ALL '.join(votes)}) GROUP BY row_id, c)
SELECT w.row_id, t.quality AS label, w.prediction FROM won w JOIN test t ON t.row_id = w.row_id WHERE rn = 1"""


@query(_bagged_nearest_sql())
def classify_bagged_nearest(spark, sf):
    return doc_predictions(spark, sf, "ensembleBagging", base_estimator="KNN", n_estimators=3, n_neighbors=5)


VOTE_MEMBERS = [{"name": "KNN one", "n_neighbors": 1}, {"name": "KNN nine", "n_neighbors": 9, "weights": "distance"}, {"name": "naiveBays"}]


@query(
    f"""WITH {fx.DOCS_SQL}, {st.split_cte('docs_f')}, train AS (SELECT *, {DOC_VEC} AS vec FROM marked WHERE NOT is_test),
test AS (SELECT *, {DOC_VEC} AS vec FROM marked WHERE is_test), {st.knn_cte('test', 'train', 9, carry='quality', not_self=False)},
near1 AS (SELECT * FROM near WHERE rank = 1), {st.vote_cte('quality', 'uniform', 'near1', 'v1')}, {st.vote_cte('quality', 'distance', 'near', 'v9')},
{bayes_holdout_cte('docs_f', DOC_COLS, 'quality')},
ballots AS (SELECT row_id, prediction, 1.0 AS w FROM v1 UNION ALL SELECT row_id, prediction, 2.0 FROM v9
            UNION ALL SELECT row_id, prediction, 1.0 FROM pred),
won AS (SELECT row_id, prediction, row_number() OVER (PARTITION BY row_id ORDER BY sum(w) DESC, prediction) AS rn FROM ballots GROUP BY row_id, prediction)
SELECT w.row_id, t.quality AS label, w.prediction FROM won w JOIN test t ON t.row_id = w.row_id WHERE rn = 1"""
)
def vote_hard(spark, sf):
    return doc_predictions(spark, sf, "ensembleVoting", members=VOTE_MEMBERS, weights=(1.0, 2.0, 1.0))


@query(
    f"""WITH {fx.DOCS_SQL}, {st.split_cte('docs_f')}, train AS (SELECT *, {DOC_VEC} AS vec FROM marked WHERE NOT is_test),
test AS (SELECT *, {DOC_VEC} AS vec FROM marked WHERE is_test), {st.knn_cte('test', 'train', 9, carry='quality', not_self=False)},
{bayes_holdout_cte('docs_f', DOC_COLS, 'quality')},
share AS (SELECT row_id, quality AS c, count(*) / 9.0 AS p FROM near GROUP BY row_id, quality
          UNION ALL SELECT row_id, c, p FROM prob_),
won AS (SELECT row_id, c, row_number() OVER (PARTITION BY row_id ORDER BY round(sum(p), 9) DESC, c) AS rn FROM share GROUP BY row_id, c)
SELECT w.row_id, t.quality AS label, w.c AS prediction FROM won w JOIN test t ON t.row_id = w.row_id WHERE rn = 1"""
)
def vote_soft(spark, sf):
    members = [{"name": "KNN", "n_neighbors": 9}, {"name": "naiveBays"}]
    return doc_predictions(spark, sf, "ensembleVoting", members=members, voting="soft")


@query(
    f"""WITH {doc_trees_sql(depth=6)}, {bayes_holdout_cte('docs_f', DOC_COLS, 'quality')},
ballot AS (SELECT row_id, c, p FROM prob_ UNION ALL SELECT row_id, 0, 2.0 * m0 FROM mean_ UNION ALL SELECT row_id, 1, 2.0 * m1 FROM mean_),
won AS (SELECT row_id, c, row_number() OVER (PARTITION BY row_id ORDER BY round(sum(p), 9) DESC, c) AS rn FROM ballot GROUP BY row_id, c)
SELECT w.row_id, t.quality AS label, CAST(w.c AS INTEGER) AS prediction FROM won w JOIN test_ t ON t.row_id = w.row_id WHERE rn = 1"""
)
def vote_soft_with_tree(spark, sf):
    members = [{"name": "naiveBays"}, {"name": "decisionTree", "max_depth": 6}]
    return doc_predictions(spark, sf, "ensembleVoting", members=members, voting="soft", weights=(1.0, 2.0))


SMALL_FOREST = doc_trees_predicted(depth=5, trees=5, subset=2, weight=BOOTSTRAP)


@query(f"SELECT row_id, prediction AS after, prediction AS before FROM ({SMALL_FOREST})")
def model_saved_and_loaded(spark, sf):
    """A fitted forest written to the shared folder, loaded again and applied."""
    train, test = doc_split(spark, sf)
    fitted = classify.fit_forest(train, DOC_COLS, "quality", "row_id", n_estimators=5, max_depth=5)
    path = new_path(spark, "model")
    stored.save_model(spark, fitted, path)
    again = stored.load_model(spark, path)
    old = fitted.predict(test).select("row_id", F.col("prediction").alias("before"))
    return again.predict(test).select("row_id", F.col("prediction").alias("after")).join(old, "row_id").where("before = after")


@query(
    f"WITH {fx.EMB_WIDE_SQL}, {st.split_cte('emb_wide')}, {bayes_holdout_cte('emb_wide', fx.EMB_FEATURES, 'label')} "
    "SELECT row_id, label, prediction FROM pred"
)
def bayes_model_saved_and_loaded(spark, sf):
    """Predictions of a model that went through the shared storage."""
    train, test = embedding_split(spark, sf)
    path = new_path(spark, "model")
    stored.save_model(spark, classify.fit_bayes(train, fx.EMB_FEATURES, "label"), path)
    return stored.load_model(spark, path).predict(test).select("row_id", "label", "prediction")


# --- the composed job --------------------------------------------------------------------------


@query(
    f"""WITH {fx.DOCS_SQL}, {st.folds_cte('docs_f', 'quality', 3, ', '.join('t.' + c for c in DOC_COLS))},
{st.bayes_folds_cte(DOC_COLS, 'quality', 3)}, {st.metrics_cte()},
long AS ({' UNION ALL '.join(f"SELECT grp, '{m}' AS metric, {m} AS value FROM metrics" for m in st.METRIC_NAMES)}),
fill AS (SELECT *, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY metric ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (PARTITION BY metric ORDER BY grp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM long)
SELECT 'bayes' AS run, metric, CASE WHEN count(value) = count(*) THEN {st.r('avg(value)', 'x').replace(' AS x', '')} END AS mean,
       string_agg(CAST(round(filled, 4) AS VARCHAR), ';' ORDER BY grp) AS fold_values
FROM fill GROUP BY metric"""
)
def classification_job_folds(spark, sf):
    """Three folds, min-max scaled, naive Bayes: mean and values of every score."""
    config = {"classifier": "naiveBays", "rescaler": "normalize", "dataSplitMethod": "kfold", "kFold": 3}
    out = jobs.classification_job(fx.doc_features(spark, sf), fx.DOCS, config, "bayes")
    text = F.array_join(F.transform("fold_values", lambda v: F.round(v, 4).cast("string")), ";")
    return out.where("metric <> 'accuracyTrain'").select("run", "metric", r6("mean"), text.alias("fold_values"))


def holdout_scores(spark, sf, config):
    result = jobs.classification_folds(fx.doc_features(spark, sf), fx.DOCS, config)[0]
    rows = [(m, None if result[m] is None else float(result[m])) for m in (*st.METRIC_NAMES, "accuracyTrain")]
    return rounded(spark.createDataFrame(rows, "metric string, value double"), "value")


@query()
def classification_job_oversampled_tree(spark, sf):
    """Holdout: SMOTE on the training part, robust scaling, features by ANOVA F, a tree."""
    return holdout_scores(
        spark,
        sf,
        {
            "balancingStrategy": "smote",
            "rescaler": "standardizeRobust",
            "featureFunction": "f_classif",
            "featuresToKeepPercentage": 0.75,
            "classifier": "decisionTree",
            "classifierParams": {"max_depth": 9},
        },
    )


@query()
def classification_job_components_nearest(spark, sf):
    """Holdout: undersampling before the split, standardised components, nearest neighbours."""
    return holdout_scores(
        spark,
        sf,
        {
            "balancingStrategy": "randUndersample",
            "balance_before_split": True,
            "rescaler": "standardize",
            "PCA": True,
            "percComponentsPCA": 0.7,
            "classifier": "KNN",
            "classifierParams": {"n_neighbors": 5, "weights": "distance"},
        },
    )


@query()
def classification_job_decorrelated_forest(spark, sf):
    """Holdout: correlated features dropped, a random forest."""
    return holdout_scores(
        spark,
        sf,
        {
            "nanStrategy": "median",
            "correlationThreshold": 0.9,
            "classifier": "randomForest",
            "classifierParams": {"n_estimators": 10, "max_depth": 6},
        },
    )
