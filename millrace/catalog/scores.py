"""Queries: prediction scores, result tables and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import fixtures as fx
from millrace.catalog import statements as st
from millrace.catalog.models import METRIC_OUT, embedding_split, metric_rows
from millrace.catalog.registry import query, r6, rounded
from millrace.functions.hashing import uniform_sql
from millrace.operators import neighbors, results, score
from millrace.plans import experiments
from millrace.session import new_path
from millrace.sources import csv, runs

DOC_COLS = fx.DOCS.features

# A fixed rule as the classifier: documents with few digits count as good.
RULE_SQL = f"""{fx.DOCS_SQL}, pred AS (SELECT row_id, 0 AS grp, quality AS label, CAST(n_digits * 100 < n_chars AS INTEGER) AS prediction,
  n_spaces / n_chars AS score FROM docs_f)"""


def rule_predictions(spark, sf):
    return fx.doc_features(spark, sf).select(
        "row_id",
        F.col("quality").alias("label"),
        (F.col("n_digits") * 100 < F.col("n_chars")).cast("int").alias("prediction"),
        (F.col("n_spaces") / F.col("n_chars")).alias("score"),
    )


@query(
    f"""WITH {RULE_SQL}, c AS (SELECT label AS c FROM pred UNION SELECT prediction FROM pred)
SELECT a.c AS label, b.c AS prediction, count(p.row_id) AS n FROM c a CROSS JOIN c b
LEFT JOIN pred p ON p.label = a.c AND p.prediction = b.c GROUP BY a.c, b.c"""
)
def confusion_matrix(spark, sf):
    return score.confusion_matrix(rule_predictions(spark, sf), "label", "prediction")


@query(f"WITH {RULE_SQL}, {st.metrics_cte()} SELECT grp, {METRIC_OUT} FROM metrics")
def classification_scores(spark, sf):
    """Accuracy, micro and macro scores, kappa, both kinds of sensitivity and specificity, cost."""
    predicted = rule_predictions(spark, sf).withColumn("grp", F.lit(0))
    return metric_rows(spark, score.classification_metrics(predicted, "label", "prediction", ["grp"]), "grp int")


def roc_sql(by: str) -> str:
    return f"""cnt_ AS (SELECT {by} AS threshold, sum(label) AS p, sum(1 - label) AS n FROM pred GROUP BY {by}),
roc_ AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, p, n FROM cnt_ WINDOW w AS (ORDER BY threshold DESC)),
roc AS (SELECT threshold, tp / (SELECT sum(p) FROM cnt_) AS tpr, fp / (SELECT sum(n) FROM cnt_) AS fpr,
               n * (tp - p / 2) / ((SELECT sum(p) FROM cnt_) * (SELECT sum(n) FROM cnt_)) AS area FROM roc_)"""


@query(
    f"""WITH {RULE_SQL}, {roc_sql('prediction')} SELECT {st.r('fpr', 'fpr')}, {st.r('tpr', 'tpr')} FROM roc
        UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE"""
)
def roc_of_predictions(spark, sf):
    """The three-point curve of hard predictions."""
    return rounded(score.roc_curve(rule_predictions(spark, sf), "label", "prediction").select("fpr", "tpr"), "fpr", "tpr")


@query(f"WITH {RULE_SQL}, {roc_sql('score')} SELECT {st.r('threshold', 'threshold')}, {st.r('fpr', 'fpr')}, {st.r('tpr', 'tpr')} FROM roc")
def roc_of_scores(spark, sf):
    points = score.roc_points(rule_predictions(spark, sf), "label", "score")
    return rounded(points.select("threshold", "fpr", "tpr"), "threshold", "fpr", "tpr")


@query(
    f"""WITH {RULE_SQL}, {roc_sql('score')}, hard AS (SELECT (SELECT sum(label * prediction) / sum(label) FROM pred) AS tpr,
  (SELECT sum((1 - label) * prediction) / sum(1 - label) FROM pred) AS fpr)
SELECT (SELECT round(sum(area), 6) FROM roc) AS auc_scores, round((1 + tpr - fpr) / 2, 6) AS auc_predictions FROM hard"""
)
def area_under_curve(spark, sf):
    predicted = rule_predictions(spark, sf).persist()
    soft, hard = (score.auc(predicted, "label", s).first()[0] for s in ("score", "prediction"))
    return rounded(spark.createDataFrame([(soft, hard)], "auc_scores double, auc_predictions double"), "auc_scores", "auc_predictions")


FOLD_VALUES_SQL = """s_ AS (SELECT event_type AS metric, CAST(hour(ts) AS INTEGER) AS fold, sum(value) AS s FROM events GROUP BY ALL),
v AS (SELECT metric, fold, CASE WHEN s > avg(s) OVER (PARTITION BY metric) THEN s END AS value FROM s_)"""


@query(
    f"""WITH {FOLD_VALUES_SQL}, f AS (SELECT *, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY metric ORDER BY fold
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER (PARTITION BY metric ORDER BY fold
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM v)
SELECT metric, CASE WHEN count(value) = count(*) THEN round(avg(value), 6) END AS mean,
       string_agg(CAST(CAST(round(filled, 0) AS BIGINT) AS VARCHAR), ';' ORDER BY fold) AS fold_values FROM f GROUP BY metric"""
)
def fold_summary(spark, sf):
    """Mean that a missing fold makes missing; gaps filled forward, then backward."""
    events = fx.table(spark, sf, "events")
    sums = events.groupBy(F.col("event_type").alias("metric"), F.hour("ts").alias("fold")).agg(F.sum("value").alias("s"))
    means = sums.groupBy("metric").agg(F.avg("s").alias("m"))
    values = sums.join(means, "metric").select("metric", "fold", F.when(F.col("s") > F.col("m"), F.col("s")).alias("value"))
    text = F.array_join(F.transform("fold_values", lambda v: F.round(v, 0).cast("bigint").cast("string")), ";")
    return score.fold_summary(values).select("metric", r6("mean"), text.alias("fold_values"))


# --- result tables ---------------------------------------------------------------------------

RESULTS_SQL = """res AS (SELECT o_orderpriority AS run, CAST(month(o_orderdate) AS INTEGER) AS month,
  avg(o_totalprice) / 1000 AS y0, stddev_pop(o_totalprice) / 1000 AS y1 FROM orders GROUP BY ALL)"""


def result_table(spark, sf):
    return (
        fx.table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("run"), F.month("o_orderdate").alias("month"))
        .agg((F.avg("o_totalprice") / 1000).alias("y0"), (F.stddev_pop("o_totalprice") / 1000).alias("y1"))
    )


@query(f"WITH {RESULTS_SQL} SELECT run, month, {st.r('y0', 'y0')}, {st.r('y1', 'y1')} FROM res")
def result_series(spark, sf):
    return rounded(results.series(result_table(spark, sf), "month", ["y0", "y1"]), "y0", "y1")


@query(
    f"""WITH {RESULTS_SQL}, d AS (SELECT *, sqrt(y0 * y0 + y1 * y1) AS distance FROM res),
k AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY distance DESC) AS rank FROM d)
SELECT run, month, {st.r('distance', 'distance')}, CASE WHEN rank <= 3 THEN 'best' WHEN rank <= 5 THEN 'second' ELSE '' END AS place FROM k"""
)
def best_points(spark, sf):
    out = results.best_points(result_table(spark, sf), "y0", "y1")
    return out.select("run", "month", r6("distance"), "place")


@query(f"WITH {RESULTS_SQL} SELECT run, {st.r('y0', 'x')}, {st.r('y1', 'y')}, CAST(month AS VARCHAR) AS label FROM res")
def point_table(spark, sf):
    return rounded(results.point_table(result_table(spark, sf), "y0", "y1", "month"), "x", "y")


@query(
    """WITH v AS (SELECT event_type AS run, CAST(hour(ts) AS INTEGER) AS x, CAST(ts AS DATE) AS d, round(sum(value), 2) AS value FROM events GROUP BY ALL),
q AS (SELECT run, x, quantile_cont(value, 0.25) AS q1, median(value) AS m, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY run, x)
SELECT v.run, v.x, round(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(any_value(q1), 6) AS q1,
       round(any_value(m), 6) AS median, round(any_value(q3), 6) AS q3, round(max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)), 6) AS high
FROM v JOIN q ON q.run = v.run AND q.x = v.x GROUP BY v.run, v.x"""
)
def box_summary(spark, sf):
    """Quartiles and whiskers of values kept as list text, one list per run and x."""
    daily = (
        fx.table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("run"), F.hour("ts").alias("x"), F.col("ts").cast("date").alias("d"))
        .agg(F.round(F.sum("value"), 2).alias("value"))
    )
    # one value per day in a list
    lists = daily.groupBy("run", "x").agg(F.to_json(F.collect_list("value")).alias("values"))
    out = results.box_summary(results.box_values(lists, "x", "values"), ["run", "x"])
    return rounded(out, "low", "q1", "median", "q3", "high")


@query(
    f"WITH {fx.DOCS_SQL} "
    + " UNION ALL ".join(
        f"SELECT row_id, '{a}' AS col_i, '{b}' AS col_j, {a} AS x, {b} AS y FROM docs_f"
        for i, a in enumerate(DOC_COLS)
        for b in DOC_COLS[i + 1 :]
    )
)
def column_pairs(spark, sf):
    return results.column_pairs(fx.doc_features(spark, sf).select("row_id", *DOC_COLS), "row_id")


# --- experiments ---------------------------------------------------------------------------------

SWEEP_VARIATIONS = [
    {"name": "classifierParams", "subName": "weights", "values": ["uniform", "distance"]},
    {"name": "classifierParams", "subName": "n_neighbors", "values": [1, 5, 15]},
]
SWEEP_PRIORITY = ["n_neighbors", "weights"]


def sweep_configs():
    return experiments.grid({"classifier": "KNN"}, experiments.ordered(SWEEP_VARIATIONS, SWEEP_PRIORITY))


def sweep_sql(ks) -> str:
    """swept(grp, label, prediction) with one group per configuration."""
    top = max(ks)
    parts, votes = [], []
    for k in ks:
        parts.append(f"near{k} AS (SELECT * FROM near WHERE rank <= {k})")
        for w in ("uniform", "distance"):
            parts.append(st.vote_cte("label", w, f"near{k}", f"v_{w}_{k}"))
            votes.append(f"SELECT {k} AS k, '{w}' AS w, row_id, prediction FROM v_{w}_{k}")
    return f"""{fx.EMB_SQL}, {st.split_cte('emb')}, train AS (SELECT * FROM marked WHERE NOT is_test), test AS (SELECT * FROM marked WHERE is_test),
{st.knn_cte('test', 'train', top, carry='label', not_self=False)}, {', '.join(parts)},
swept AS (SELECT k || '|' || w AS grp, k, w, t.label, v.prediction FROM ({' UNION ALL '.join(votes)}) v JOIN test t ON t.row_id = v.row_id)"""


SWEPT_SQL = f"WITH {sweep_sql([1, 5, 15])}, {st.metrics_cte('swept')}"


def swept(spark, sf, ks, weights=("uniform", "distance")):
    """Metrics per (k, weights) from one neighbour join of the largest k."""
    train, test = embedding_split(spark, sf, vector=True)
    near = neighbors.knn(test, train, max(ks), carry="label").persist()
    predicted = experiments.neighbor_sweep(
        near, "label", test.select("row_id", F.col("label").alias("truth")), ks, weights
    )
    return score.classification_metrics(predicted, "truth", "prediction", ["n_neighbors", "weights"])


@query(
    f"""{SWEPT_SQL} SELECT CAST(split_part(grp, '|', 1) AS INTEGER) AS n_neighbors, split_part(grp, '|', 2) AS weights,
{st.r('accuracy', 'accuracy')}, {st.r('kappa', 'kappa')}, {st.r('f1_macro', 'f1_macro')} FROM metrics"""
)
def sweep_neighbors(spark, sf):
    """Every combination of k and weights."""
    metrics = swept(spark, sf, [1, 5, 15])
    configs = [c["classifierParams"] for c in sweep_configs()]
    rows = [
        (c["n_neighbors"], c["weights"], *[metrics[(c["n_neighbors"], c["weights"])][m] for m in ("accuracy", "kappa", "f1_macro")])
        for c in configs
    ]
    out = spark.createDataFrame(rows, "n_neighbors int, weights string, accuracy double, kappa double, f1_macro double")
    return rounded(out, "accuracy", "kappa", "f1_macro")


@query(
    f"""{SWEPT_SQL} SELECT 'KNN' AS classifier, CAST(split_part(grp, '|', 1) AS BIGINT) AS n_neighbors, split_part(grp, '|', 2) AS weights,
{st.r('accuracy', 'accuracy')} FROM metrics"""
)
def unify_runs(spark, sf):
    """One configuration and one metrics record per run written as JSON, joined into one table and CSV."""
    metrics = swept(spark, sf, [1, 5, 15])
    configs = {f"run{i}": c for i, c in enumerate(sweep_configs())}
    base = new_path(spark, "sweep")
    runs.write_records(spark, configs, f"{base}/config")
    rows = []
    for run, c in configs.items():
        p = c["classifierParams"]
        rows.append((run, metrics[(p["n_neighbors"], p["weights"])]["accuracy"]))
    runs.write_metrics(spark.createDataFrame(rows, "run string, accuracy double"), f"{base}/metrics")
    runs.unify_to_csv(spark, f"{base}/config", f"{base}/metrics", f"{base}/output")
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{base}/output")
    return back.select("classifier", F.col("n_neighbors").cast("bigint").alias("n_neighbors"), "weights", r6("accuracy"))


TRIALS = 30
KS = list(range(1, 11))


@query(
    f"""WITH {sweep_sql(KS)}, acc AS (SELECT k, w, avg((label = prediction)::INTEGER) AS value FROM swept GROUP BY k, w),
t AS (SELECT CAST(id AS INTEGER) AS trial, CAST(1 + floor({uniform_sql('0:n_neighbors', 'id')} * 10) AS INTEGER) AS k,
      CASE WHEN floor({uniform_sql('0:weights', 'id')} * 2) = 0 THEN 'uniform' ELSE 'distance' END AS w FROM range({TRIALS}) r(id))
SELECT trial, CAST(t.k AS VARCHAR) AS n_neighbors, t.w AS weights, {st.r('value', 'value')}, value = max(value) OVER () AS best
FROM t JOIN acc ON acc.k = t.k AND acc.w = t.w"""
)
def random_search(spark, sf):
    """Thirty reproducible draws of k and weights, the best accuracy marked; the trials go through CSV."""
    metrics = swept(spark, sf, KS)
    ranges = {"n_neighbors": {"int": [1, 10]}, "weights": {"categorical": ["uniform", "distance"]}}
    trials = experiments.search(
        spark, ranges, lambda p: metrics[(p["n_neighbors"], p["weights"])]["accuracy"], TRIALS
    )
    path = new_path(spark, "trials")
    csv.write_results(trials, path)
    back = spark.read.schema(trials.schema).option("header", True).csv(path)
    return rounded(back, "value")


@query()
def sweep_classifiers(spark, sf):
    """Tree, naive Bayes, nearest neighbours and forest with the same holdout, one row each."""
    from millrace.plans.jobs import classification_folds

    docs = fx.doc_features(spark, sf).persist()
    configs = [
        {"classifier": "decisionTree", "classifierParams": {"max_depth": 30}},
        {"classifier": "naiveBays"},
        {"classifier": "KNN", "classifierParams": {"n_neighbors": 20, "weights": "distance"}},
        {"classifier": "randomForest", "classifierParams": {"n_estimators": 20, "max_depth": 10}},
    ]
    found = experiments.run_all(configs, lambda c: classification_folds(docs, fx.DOCS, {**c, "rescaler": "normalize"})[0])
    rows = [(c["classifier"], r["accuracy"], r["kappa"], r["accuracyTrain"]) for c, r in zip(configs, found)]
    out = spark.createDataFrame(rows, "classifier string, accuracy double, kappa double, accuracy_train double")
    return rounded(out, "accuracy", "kappa", "accuracy_train")


def _learning_curve_sql(sizes=(0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in DOC_COLS)
    ll = " + ".join(
        f"-0.5 * ln(2 * pi() * (v_{c} + eps)) - (t.{c} - m_{c}) * (t.{c} - m_{c}) / (2 * (v_{c} + eps))" for c in DOC_COLS
    )
    values = ", ".join(f"({i}, CAST({s} AS DOUBLE))" for i, s in enumerate(sizes))
    return f"""WITH {fx.DOCS_SQL}, {st.folds_cte('docs_f', 'quality', folds, ', '.join('t.' + c for c in DOC_COLS))},
u AS (SELECT *, {uniform_sql('0:curve', 'row_id')} AS u FROM folds),
model AS (SELECT i, size, CAST(f AS INTEGER) AS f FROM (VALUES {values}) s(i, size), range({folds}) r(f)),
tr AS (SELECT m.i, m.f, u.* FROM u JOIN model m ON u.fold <> m.f AND (u.u < m.size OR m.size = 1.0)),
st AS (SELECT i, f, quality AS c, count(*) AS n, {stats} FROM tr GROUP BY i, f, quality),
tot AS (SELECT i, f, count(*) AS n_all, 1e-9 * greatest({', '.join(f'var_pop({c})' for c in DOC_COLS)}) AS eps FROM tr GROUP BY i, f),
ask AS (SELECT i, f, 'train' AS part, row_id, quality, {', '.join(DOC_COLS)} FROM tr
        UNION ALL SELECT m.i, m.f, 'test', row_id, quality, {', '.join(DOC_COLS)} FROM u JOIN model m ON u.fold = m.f),
ll AS (SELECT t.i, t.f, part, row_id, quality, c, ln(n * 1.0 / n_all) + {ll} AS score
       FROM ask t JOIN st ON st.i = t.i AND st.f = t.f JOIN tot ON tot.i = t.i AND tot.f = t.f),
hit AS (SELECT i, f, part, avg((c = quality)::INTEGER) AS accuracy FROM (
          SELECT *, row_number() OVER (PARTITION BY i, f, part, row_id ORDER BY score DESC, c) AS rn FROM ll) WHERE rn = 1 GROUP BY i, f, part),
both_ AS (SELECT i, part, avg(accuracy) AS m, stddev_pop(accuracy) AS s FROM hit GROUP BY i, part)
SELECT (SELECT any_value(size) FROM model WHERE model.i = a.i) AS size, {st.r('a.m', 'train_mean')}, {st.r('a.s', 'train_std')},
       {st.r('b.m', 'test_mean')}, {st.r('b.s', 'test_std')}
FROM both_ a JOIN both_ b ON a.i = b.i AND a.part = 'train' AND b.part = 'test'"""


@query(_learning_curve_sql())
def learning_curve(spark, sf):
    out = experiments.bayes_learning_curve(fx.doc_features(spark, sf), DOC_COLS, "quality", "row_id")
    return rounded(out, "train_mean", "train_std", "test_mean", "test_std")


def _nearest_curve_sql(k: int = 5, sizes=(0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5) -> str:
    vec = "[" + ", ".join(f"t.{c}" for c in DOC_COLS) + "]"
    values = ", ".join(f"({i}, CAST({s} AS DOUBLE))" for i, s in enumerate(sizes))
    return f"""WITH {fx.DOCS_SQL}, {st.folds_cte('docs_f', 'quality', folds, f'{vec} AS vec')},
u AS (SELECT *, {uniform_sql('0:curve', 'row_id')} AS u FROM folds),
model AS (SELECT i, size, CAST(f AS INTEGER) AS f FROM (VALUES {values}) s(i, size), range({folds}) r(f)),
d AS (SELECT q.row_id, q.fold AS q_fold, q.u AS q_u, q.quality AS truth, p.row_id AS near_id, p.fold, p.u, p.quality, list_distance(q.vec, p.vec) AS d
      FROM u q, u p),
near AS (SELECT * FROM (
           SELECT m.i, m.f, d.*, row_number() OVER (PARTITION BY m.i, m.f, row_id ORDER BY d, near_id) AS rn
           FROM d JOIN model m ON d.fold <> m.f AND (d.u < m.size OR m.size = 1.0)
           WHERE d.q_fold = m.f OR d.q_u < m.size OR m.size = 1.0) WHERE rn <= {k}),
won AS (SELECT i, f, q_fold, truth, quality AS c, row_number() OVER (PARTITION BY i, f, row_id ORDER BY count(*) DESC, quality) AS rn
        FROM near GROUP BY i, f, row_id, q_fold, truth, quality),
hit AS (SELECT i, f, q_fold = f AS test, avg((c = truth)::INTEGER) AS accuracy FROM won WHERE rn = 1 GROUP BY i, f, q_fold = f),
both_ AS (SELECT i, test, avg(accuracy) AS m, stddev_pop(accuracy) AS s FROM hit GROUP BY i, test)
SELECT (SELECT any_value(size) FROM model WHERE model.i = a.i) AS size, {st.r('a.m', 'train_mean')}, {st.r('a.s', 'train_std')},
       {st.r('b.m', 'test_mean')}, {st.r('b.s', 'test_std')}
FROM both_ a JOIN both_ b ON a.i = b.i AND NOT a.test AND b.test"""


@query(_nearest_curve_sql())
def learning_curve_nearest(spark, sf):
    """Accuracy of five nearest neighbours over growing training sets, from one neighbour join."""
    out = experiments.nearest_learning_curve(fx.doc_features(spark, sf), DOC_COLS, "quality", "row_id")
    return rounded(out, "train_mean", "train_std", "test_mean", "test_std")
