"""Queries: sources, cleaning, imputation, scaling, binning, feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import fixtures as fx
from millrace.catalog import statements as st
from millrace.catalog.registry import query, r6, rounded
from millrace.operators import clean, encode, impute, reduce, scale, select
from millrace.plans.jobs import variable_analysis
from millrace.session import new_path
from millrace.sources import csv

ORDER_COLS = ("price", "month", "day", "priority")


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def per_column(cols, template: str, rest: str = "", sep: str = " UNION ALL ") -> str:
    return sep.join(template.replace("{c}", c) + rest for c in cols)


# --- sources -----------------------------------------------------------------


@query(
    f"""WITH {fx.ORDERS_SQL} SELECT row_id, {r('price', 'price')}, {r('month', 'month')}, label <> 'F' AS class
        FROM orders_f"""
)
def csv_two_header_lines(spark, sf):
    """Orders written as text below two header lines with 'na' cells, read back and cleaned."""
    path = new_path(spark, "two-header")
    orders = fx.orders_features(spark, sf)
    text = orders.select(
        F.concat_ws(
            ",",
            F.col("row_id").cast("string"),
            F.coalesce(F.col("price").cast("string"), F.lit("na")),
            F.col("month").cast("string"),
            F.when(F.col("label") != "F", "1").otherwise("0"),
        ).alias("value")
    )
    titles = spark.createDataFrame([(",Amounts,Dates,",), ("id,price,month,class",)], "value string").coalesce(1)
    titles.write.text(f"{path}/head")
    text.write.text(f"{path}/rows")
    raw = csv.read_two_header_csv(spark, f"{path}/*", header_file=f"{path}/head")
    numbers = clean.text_to_numbers(clean.sentinel_to_null(raw), ["price", "month", "class"])
    out = clean.label_to_boolean(numbers, "class")
    return rounded(out.select(F.col("id").cast("bigint").alias("row_id"), "price", "month", "class"), "price", "month")


@query(
    f"""WITH {fx.ORDERS_SQL} SELECT row_id, {r('price', 'price')}, CAST(priority AS BIGINT) AS class FROM orders_f"""
)
def csv_headerless(spark, sf):
    """The same without header: positional names, the last column renamed to the label."""
    path = new_path(spark, "headerless")
    orders = fx.orders_features(spark, sf).select(
        "row_id", F.coalesce(F.col("price").cast("string"), F.lit("na")).alias("price"), F.col("priority").cast("int")
    )
    orders.write.csv(path, header=False)
    raw = clean.name_last_column(csv.read_headerless_csv(spark, path, 3), "class")
    numbers = clean.text_to_numbers(clean.sentinel_to_null(raw), ["1"])
    return numbers.select(
        F.col("0").cast("bigint").alias("row_id"), r6("1", "price"), F.col("class").cast("bigint").alias("class")
    )


MONTHLY_SQL = """SELECT o_orderpriority AS run, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n,
       avg(o_totalprice) AS mean_price, max(o_totalprice) AS max_price FROM orders GROUP BY ALL"""


def monthly(spark, sf):
    return (
        fx.table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("run"), F.month("o_orderdate").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("o_totalprice").alias("mean_price"),
            F.max("o_totalprice").alias("max_price"),
        )
    )


@query(f"SELECT month, sum(n)::BIGINT AS n, {r('max(max_price)', 'max_price')} FROM ({MONTHLY_SQL}) GROUP BY month")
def results_csv(spark, sf):
    """A result table written with its row index first and read back."""
    path = new_path(spark, "results")
    table = monthly(spark, sf).groupBy("month").agg(F.sum("n").alias("n"), F.max("max_price").alias("max_price"))
    csv.write_results(table.select((F.col("month") - 1).alias("_c0"), "month", "n", "max_price"), path)
    back = csv.read_results(spark, path)
    return back.select("month", F.col("n").cast("bigint").alias("n"), r6("max_price"))


@query(f"SELECT run, month, CAST(n AS BIGINT) AS n, {r('mean_price', 'mean_price')} FROM ({MONTHLY_SQL})")
def results_per_directory(spark, sf):
    """One result table per sub-directory, read together with the directory each row came from."""
    path = new_path(spark, "runs")
    out = monthly(spark, sf).select((F.col("month") - 1).alias("index"), "run", "month", "n", "mean_price")
    out.write.partitionBy("run").option("header", True).csv(path)
    back = csv.read_results_per_run(spark, path, "*.csv")
    return back.select(
        F.regexp_replace("run", "^run=", "").alias("run"), "month", F.col("n").cast("bigint").alias("n"), r6("mean_price")
    )


# --- cleaning and profiling ----------------------------------------------------


@query(
    """SELECT o_orderkey AS row_id, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
       ELSE o_orderpriority END AS priority, o_orderstatus AS status FROM orders"""
)
def sentinel_to_null(spark, sf):
    orders = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")
    )
    return clean.sentinel_to_null(orders, "4-NOT SPECIFIED")


@query(f"WITH {fx.DOCS_SQL} SELECT row_id, quality <> 0 AS quality, CAST(toxic <> 0 AS INTEGER) AS toxic FROM docs_f")
def label_to_boolean_and_int(spark, sf):
    docs = fx.doc_features(spark, sf).select("row_id", "quality", "toxic")
    return clean.label_to_int(clean.label_to_boolean(clean.label_to_boolean(docs, "quality"), "toxic"), "toxic")


@query(f"WITH {fx.ORDERS_SQL} SELECT row_id, {', '.join(r(c, c) for c in ORDER_COLS)}, label FROM orders_f")
def split_label_and_join_back(spark, sf):
    """Features and label as two tables, joined again on the row key."""
    orders = fx.orders_features(spark, sf)
    x = clean.features_of(orders, "row_id", "label")
    y = clean.label_of(orders, "row_id", "label")
    return rounded(x.join(y, "row_id", "left"), *ORDER_COLS)


@query(
    """SELECT o_orderkey AS row_id, round(o_totalprice, 6) AS price FROM orders
       ORDER BY o_orderkey LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM orders)"""
)
def head_fraction(spark, sf):
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), r6("o_totalprice", "price"))
    return clean.head_fraction(orders, "row_id", 0.10)


@query(f"WITH {fx.ORDERS_SQL} SELECT row_id, {r('price', 'price')}, {r('day', 'day')} FROM orders_f")
def keep_and_drop_columns(spark, sf):
    orders = fx.orders_features(spark, sf)
    masked = clean.keep_columns(orders, [True, False, True, False, True, True])
    return rounded(clean.drop_columns(masked, ["priority"]), "price", "day")


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders")
def numeric_columns(spark, sf):
    orders = fx.table(spark, sf, "orders")
    return rounded(orders.select(*clean.numeric_columns(orders)), "o_totalprice")


def null_counts(cols) -> str:
    return per_column(
        cols,
        "SELECT '{c}' AS attribute, count(*) - count({c}) AS n_missing, "
        "round((count(*) - count({c})) * 1.0 / count(*), 6) AS fraction FROM orders_f",
    )


@query(
    f"WITH {fx.ORDERS_SQL}, m AS ({null_counts(ORDER_COLS)}) SELECT attribute, n_missing, CAST(fraction AS DOUBLE) AS fraction FROM m "
    "ORDER BY fraction DESC, attribute LIMIT 10"
)
def missing_profile(spark, sf):
    return rounded(clean.missing_profile(fx.orders_features(spark, sf), ORDER_COLS), "fraction")


@query(
    f"WITH {fx.ORDERS_SQL}, m AS ({null_counts(ORDER_COLS)}) SELECT CAST(sum(n_missing) AS BIGINT) AS n_missing, "
    "count(*) FILTER (WHERE n_missing > 0) AS n_columns FROM m"
)
def columns_with_missing(spark, sf):
    return clean.total_missing(fx.orders_features(spark, sf), ORDER_COLS)


def _profile_sql() -> str:
    cells = [
        "SELECT 'table' AS item, 'rows' AS measure, count(*) * 1.0 AS value FROM customer",
        "SELECT 'table', 'columns', 5.0",
        "SELECT 'table', 'size', count(*) * 5.0 FROM customer",
        "SELECT 'type', 'bigint', 1.0",
        "SELECT 'type', 'int', 1.0",
        "SELECT 'type', 'double', 1.0",
        "SELECT 'type', 'string', 2.0",
        "SELECT 'class', c_mktsegment, count(*) * 1.0 FROM customer GROUP BY c_mktsegment",
    ]
    for c in ("c_custkey", "c_nationkey", "c_acctbal"):
        for name, fn in (("count", "count"), ("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            cells.append(f"SELECT '{c}', '{name}', CAST({fn}({c}) AS DOUBLE) FROM customer")
        for share in (25, 50, 75):
            cells.append(f"SELECT '{c}', '{share}%', CAST(quantile_cont(CAST({c} AS DOUBLE), {share / 100}) AS DOUBLE) FROM customer")
    return "SELECT item, measure, CAST(round(value, 4) AS DOUBLE) AS value FROM (" + " UNION ALL ".join(cells) + ")"


@query(_profile_sql())
def frame_profile(spark, sf):
    out = clean.frame_profile(fx.table(spark, sf, "customer"), "c_mktsegment")
    return out.withColumn("value", F.round("value", 4))


@query(
    f"WITH {fx.FILLED_SQL} "
    + per_column(ORDER_COLS, "SELECT row_id, '{c}' AS attribute, round({c}, 6) AS x FROM filled")
)
def unpivot_features(spark, sf):
    filled = impute.impute(fx.orders_features(spark, sf), ["price"], "median").drop("label")
    return rounded(filled.unpivot(["row_id"], list(ORDER_COLS), "attribute", "x"), "x")


DENSITY_GRID = (-0.5, 1.5, 21)


@query(
    f"""WITH {fx.PARTS_SQL}, s AS (
  SELECT (size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()) AS size,
         (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) AS price FROM parts_f),
long AS (SELECT 'size' AS attribute, size AS v FROM s UNION ALL SELECT 'price', price FROM s),
grid AS (SELECT CAST(i AS INTEGER) AS point, -0.5 + i * 0.1 AS x FROM range(21) t(i))
SELECT attribute, point, {r('CAST(x AS DOUBLE)', 'x')},
       {r("avg(exp(-0.5 * ((x - v) / 0.2) * ((x - v) / 0.2)) / (0.2 * sqrt(2 * pi())))", 'density')}
FROM long, grid GROUP BY attribute, point, x"""
)
def feature_density(spark, sf):
    parts = fx.part_features(spark, sf)
    scaled = scale.fit_minmax(parts, ["size", "price"]).transform(parts)
    lo, hi, points = DENSITY_GRID
    return rounded(clean.density(scaled, ["size", "price"], 0.2, lo, hi, points), "x", "density")


def anova_cells(cols, src: str, label: str) -> str:
    """One (feature, score) row per column."""
    out = []
    for i, c in enumerate(cols):
        out.append(
            f"""SELECT '{c}' AS feature, {i} AS position,
  (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score
  FROM (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM {src}) AS g FROM {src} GROUP BY {label})"""
        )
    return " UNION ALL ".join(out)


def corr_cells(cols, src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_i, '{b}' AS col_j, {i} AS i, {j} AS j, abs(corr({a}, {b})) AS abs_corr FROM {src}"
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
        if i < j
    )


def dropped_sql(src_pairs: str, threshold: float) -> str:
    """Columns to drop, given pairs(col_i, col_j, abs_corr)."""
    return f"""over_ AS (SELECT col_i, col_j FROM {src_pairs} WHERE abs_corr > {threshold}),
freq AS (SELECT c, count(*) AS f FROM (SELECT col_i AS c FROM over_ UNION ALL SELECT col_j FROM over_) GROUP BY c),
dropped AS (SELECT DISTINCT CASE WHEN a.f > b.f THEN col_i ELSE col_j END AS c
            FROM over_ JOIN freq a ON a.c = col_i JOIN freq b ON b.c = col_j)"""


DOC_COLS = fx.DOCS.features


@query(
    f"""WITH {fx.DOCS_SQL}, pairs AS ({corr_cells(DOC_COLS, 'docs_f')}), {dropped_sql('pairs', 0.94)},
scores AS (SELECT * FROM ({anova_cells(DOC_COLS, 'docs_f', 'quality')}) WHERE feature NOT IN (SELECT c FROM dropped)),
best AS (SELECT feature FROM scores ORDER BY score DESC NULLS LAST, position DESC LIMIT 2),
long AS ({per_column(DOC_COLS, "SELECT row_id, '{c}' AS attribute, ({c} - (SELECT min({c}) FROM docs_f)) / nullif((SELECT max({c}) - min({c}) FROM docs_f), 0) AS x FROM docs_f")})
SELECT row_id, attribute, round(x, 6) AS x FROM long WHERE attribute IN (SELECT feature FROM best)"""
)
def variable_analysis_job(spark, sf):
    """Decorrelate, keep the best by ANOVA F, min-max scale, unpivot."""
    docs = fx.doc_features(spark, sf).persist()
    return rounded(variable_analysis(docs, fx.DOCS, k=2, max_corr=0.94), "x")


# --- imputation ------------------------------------------------------------------


@query(
    f"""WITH {fx.ORDERS_SQL}, odd AS (SELECT row_id, CASE WHEN priority = 1 THEN 'Infinity'::DOUBLE
  WHEN priority = 2 AND month = 1 THEN '-Infinity'::DOUBLE ELSE price END AS price FROM orders_f),
done AS (SELECT row_id, coalesce(price, (SELECT median(price) FROM odd)) AS price FROM odd)
SELECT row_id, CASE WHEN NOT isinf(price) THEN round(price, 6) END AS price FROM done"""
)
def impute_median_with_infinity(spark, sf):
    """The median over values some of which are infinite; those are shown as NULL."""
    infinite = F.when(F.col("priority") == 1, float("inf")).when((F.col("priority") == 2) & (F.col("month") == 1), float("-inf"))
    odd = fx.orders_features(spark, sf).withColumn("price", F.coalesce(infinite, F.col("price")))
    out = impute.impute(odd, ["price"], "median").select("row_id", "price")
    return rounded(out.withColumn("price", F.when(F.abs("price") != float("inf"), F.col("price"))), "price")


@query(f"WITH {fx.FILLED_SQL} SELECT row_id, {r('price', 'price')}, {r('month', 'month')} FROM filled")
def impute_median(spark, sf):
    out = impute.impute(fx.orders_features(spark, sf), ["price", "month"], "median")
    return rounded(out.select("row_id", "price", "month"), "price", "month")


@query(
    """WITH e AS (SELECT event_id AS row_id, CASE WHEN event_type <> 'error' THEN round(value) END AS value FROM events)
SELECT row_id, round(coalesce(value, (SELECT value FROM e WHERE value IS NOT NULL GROUP BY value
                                      ORDER BY count(*) DESC, value LIMIT 1)), 6) AS value FROM e"""
)
def impute_most_frequent(spark, sf):
    events = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("event_type") != "error", F.round("value")).alias("value"),
    )
    return rounded(impute.impute(events, ["value"], "most_frequent"), "value")


@query(f"WITH {fx.ORDERS_SQL} SELECT row_id, {r('price', 'price')} FROM orders_f")
def impute_none(spark, sf):
    return rounded(impute.impute(fx.orders_features(spark, sf), ["price"], "").select("row_id", "price"), "price")


# --- scaling ---------------------------------------------------------------------


def _scaled_sql(centre: str, spread: str) -> str:
    cols = [
        r(
            f"({c} - (SELECT {centre.replace('{c}', c)} FROM lineitem)) / nullif((SELECT {spread.replace('{c}', c)} FROM lineitem), 0)",
            c,
        )
        for c in fx.LINE_FEATURES
    ]
    return f"SELECT l_returnflag, {', '.join(cols)} FROM lineitem"


@query(_scaled_sql("min({c})", "max({c}) - min({c})"))
def scale_minmax(spark, sf):
    lines = fx.lineitem(spark, sf)
    return rounded(scale.fit_minmax(lines, fx.LINE_FEATURES).transform(lines), *fx.LINE_FEATURES)


@query(_scaled_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, sf):
    lines = fx.lineitem(spark, sf)
    return rounded(scale.fit_standard(lines, fx.LINE_FEATURES).transform(lines), *fx.LINE_FEATURES)


@query(_scaled_sql("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def scale_robust(spark, sf):
    lines = fx.lineitem(spark, sf)
    return rounded(scale.fit_robust(lines, fx.LINE_FEATURES).transform(lines), *fx.LINE_FEATURES)


def is_test_sql(src: str, seed: int = 420, share: float = 0.3) -> str:
    from millrace.functions.hashing import hash_key_sql

    return f"""marked AS (SELECT *, row_number() OVER (ORDER BY {hash_key_sql(seed, 'row_id')}, row_id)
      <= ceil({share} * (SELECT count(*) FROM {src})) AS is_test FROM {src})"""


@query(
    f"""WITH {fx.DOCS_SQL}, {is_test_sql('docs_f')},
fit AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) - min({c}) AS w_{c}' for c in DOC_COLS)} FROM marked WHERE NOT is_test)
SELECT row_id, is_test, {', '.join(r(f'({c} - lo_{c}) / w_{c}', c) for c in DOC_COLS)} FROM marked, fit"""
)
def scale_fit_train_apply_test(spark, sf):
    """Min-max statistics of the training rows applied to both parts."""
    from millrace.operators.sample import train_test_split

    marked = train_test_split(fx.doc_features(spark, sf), "row_id").select("row_id", "is_test", *DOC_COLS)
    train, test = marked.where("NOT is_test"), marked.where("is_test")
    train, test = scale.rescale(train, DOC_COLS, "normalize", test)
    return rounded(clean.union_by_name([train, test]), *DOC_COLS)


# --- binning and encoding ----------------------------------------------------------


def cut_sql(c: str, src: str, n: int = 3) -> str:
    lo, hi = f"(SELECT min({c}) FROM {src})", f"(SELECT max({c}) FROM {src})"
    return "CAST(" + " + ".join(
        f"({c} > {lo} + {i} * (({hi} - {lo}) / {n}))::INTEGER" for i in range(1, n)
    ) + " AS INTEGER)"


def qcut_sql(c: str, src: str, n: int = 3) -> str:
    return "CAST(" + " + ".join(
        f"({c} > (SELECT quantile_cont({c}, {i}.0 / {n}) FROM {src}))::INTEGER" for i in range(1, n)
    ) + " AS INTEGER)"


@query(
    f"WITH {fx.PARTS_SQL} SELECT row_id, {cut_sql('size', 'parts_f')} AS size, {cut_sql('price', 'parts_f')} AS price, "
    "standard FROM (SELECT row_id, size, price, CAST(standard AS DOUBLE) AS standard FROM parts_f)"
)
def bin_equal_width(spark, sf):
    parts = fx.part_features(spark, sf)
    return encode.discretize(parts.drop("brand"), fx.PARTS.features, 3, "cut")[0]


@query(
    f"""SELECT l_returnflag, {', '.join(f"{qcut_sql(c, 'lineitem', 4)} AS {c}" for c in fx.LINE_FEATURES)} FROM lineitem"""
)
def bin_quantile(spark, sf):
    return encode.discretize(fx.lineitem(spark, sf), fx.LINE_FEATURES, 4, "qcut")[0]


@query(
    f"""WITH {fx.PARTS_SQL} SELECT attribute, is_binary FROM ("""
    + per_column(
        fx.PARTS.features,
        "SELECT '{c}' AS attribute, (min({c}) = 0 AND max({c}) = 1 AND count(*) FILTER (WHERE {c} NOT IN (0, 1)) = 0 "
        "AND count(*) = count({c})) AS is_binary FROM parts_f",
    )
    + ")"
)
def binary_column_test(spark, sf):
    found = encode.binary_columns(fx.part_features(spark, sf), fx.PARTS.features)
    return spark.createDataFrame([(c, c in found) for c in fx.PARTS.features], "attribute string, is_binary boolean")


@query(
    f"""WITH {fx.PARTS_SQL}, b AS (SELECT row_id, {cut_sql('size', 'parts_f')} AS s, {cut_sql('price', 'parts_f')} AS p, standard FROM parts_f)
SELECT row_id, {', '.join(f'(s = {i})::INTEGER AS size_{i}, (p = {i})::INTEGER AS price_{i}' for i in range(3))},
       CAST(standard AS INTEGER) AS standard FROM b"""
)
def one_hot_columns(spark, sf):
    parts = fx.part_features(spark, sf).drop("brand")
    binned, edges = encode.discretize(parts, fx.PARTS.features, 3, "cut")
    return encode.one_hot(binned, {c: range(len(e) + 1) for c, e in edges.items()}, ["standard"])


@query(
    f"""WITH {fx.PARTS_SQL} SELECT row_id, 'size_' || {cut_sql('size', 'parts_f')} || ',price_' || {cut_sql('price', 'parts_f')}
  || CASE WHEN standard = 1 THEN ',standard' ELSE '' END AS items FROM parts_f"""
)
def one_hot_items(spark, sf):
    parts = fx.part_features(spark, sf)
    binned, edges = encode.discretize(parts, fx.PARTS.features, 3, "cut")
    items = encode.items_of(list(edges), ["standard"])
    return binned.select("row_id", F.array_join(items, ",").alias("items"))


# --- feature selection ---------------------------------------------------------------


def scores_out(spark, scores):
    return select.scores_frame(spark, scores).select("feature", r6("score"))


@query(
    f"SELECT feature, {r('score', 'score')} FROM ({anova_cells(fx.LINE_FEATURES, 'lineitem', 'l_returnflag')})"
)
def anova_scores(spark, sf):
    return scores_out(spark, select.anova_scores(fx.lineitem(spark, sf), fx.LINE_FEATURES, "l_returnflag"))


def chi2_cells(cols, src: str, label: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, sum((o - t * p) * (o - t * p) / (t * p)) AS score
  FROM (SELECT sum({c}) AS o, count(*) * 1.0 / (SELECT count(*) FROM {src}) AS p, (SELECT sum({c}) FROM {src}) AS t
        FROM {src} GROUP BY {label})"""
        for c in cols
    )


@query(f"WITH {fx.DOCS_SQL} SELECT feature, {r('score', 'score')} FROM ({chi2_cells(DOC_COLS, 'docs_f', 'quality')})")
def chi2_scores(spark, sf):
    return scores_out(spark, select.chi2_scores(fx.doc_features(spark, sf), DOC_COLS, "quality"))


@query(
    "SELECT feature, round(r * r / (1 - r * r) * (n - 2), 6) AS score FROM ("
    + per_column(
        fx.LINE_FEATURES[1:],
        "SELECT '{c}' AS feature, corr({c}, l_quantity) AS r, count(*) AS n FROM lineitem",
    )
    + ")"
)
def regression_scores(spark, sf):
    return scores_out(spark, select.regression_scores(fx.lineitem(spark, sf), fx.LINE_FEATURES[1:], "l_quantity"))


@query(
    f"""WITH {fx.EMB_WIDE_SQL}, s AS ({anova_cells(fx.EMB_FEATURES, 'emb_wide', 'label')}),
k AS (SELECT feature, row_number() OVER (ORDER BY score DESC NULLS LAST, position DESC) <= 16 AS kept, position FROM s)
SELECT feature, kept FROM k"""
)
def select_fraction(spark, sf):
    """A quarter of the embedding dimensions by ANOVA F; the rest reported as dropped."""
    kept, dropped = select.best_fraction(fx.embeddings_wide(spark, sf), fx.EMB_FEATURES, "label", "f_classif", 0.25)
    return spark.createDataFrame(
        [(f, True) for f in kept] + [(f, False) for f in dropped], "feature string, kept boolean"
    )


def _mixed_sql() -> str:
    """Both tails have finite sums because the 24 degrees of freedom between 25 brands are even."""
    f_rows = anova_cells(["size", "price"], "parts_f", "brand")
    chi2_rows = chi2_cells(["standard"], "parts_f", "brand")
    return f"""WITH {fx.PARTS_SQL}, d AS (SELECT count(DISTINCT brand) - 1 AS d1, count(*) - count(DISTINCT brand) AS d2 FROM parts_f),
f AS (SELECT feature, score, d1, d2 / 2.0 AS a, d2 / (d2 + d1 * score) AS x FROM ({f_rows}), d),
c AS (SELECT feature, score, d1 FROM ({chi2_rows}), d)
SELECT feature, {r('any_value(score)', 'score')},
       {r('sum(exp(a * ln(x) + j * ln(1 - x) + lgamma(a + j) - lgamma(a) - lgamma(j + 1)))', 'p_value')}
FROM (SELECT feature, score, a, x, unnest(range(CAST(d1 // 2 AS BIGINT))) AS j FROM f) GROUP BY feature
UNION ALL SELECT feature, {r('any_value(score)', 'score')}, {r('sum(exp(-score / 2 + j * ln(score / 2) - lgamma(j + 1)))', 'p_value')}
FROM (SELECT feature, score, unnest(range(CAST(d1 // 2 AS BIGINT))) AS j FROM c) GROUP BY feature"""


@query(_mixed_sql())
def select_mixed(spark, sf):
    """0/1 features by chi-square and numeric ones by ANOVA F, ranked by p-value."""
    parts = fx.part_features(spark, sf)
    scores = select.mixed_scores(parts, ["size", "price"], ["standard"], "brand")
    return select.scores_frame(spark, scores).select("feature", r6("score"), r6("p_value"))


@query(
    f"WITH {fx.EMB_WIDE_SQL}, p AS ({corr_cells(fx.EMB_FEATURES, 'emb_wide')}) "
    f"SELECT col_i, col_j, {r('abs_corr', 'abs_corr')} FROM p ORDER BY p.abs_corr DESC, col_i, col_j LIMIT 100"
)
def top_correlations(spark, sf):
    return rounded(select.top_correlations(fx.embeddings_wide(spark, sf), fx.EMB_FEATURES, 100), "abs_corr")


@query(f"SELECT col_i, col_j, {r('abs_corr', 'abs_corr')} FROM ({corr_cells(fx.LINE_FEATURES, 'lineitem')})")
def correlation_pairs(spark, sf):
    return rounded(select.correlation_pairs(fx.lineitem(spark, sf), fx.LINE_FEATURES), "abs_corr")


@query(
    f"WITH {fx.DOCS_SQL}, pairs AS ({corr_cells(DOC_COLS, 'docs_f')}), {dropped_sql('pairs', 0.5)} "
    f"SELECT f.c AS feature, d.c IS NOT NULL AS dropped FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in DOC_COLS)}) f(c) "
    "LEFT JOIN dropped d ON d.c = f.c"
)
def drop_correlated(spark, sf):
    dropped = select.drop_correlated(fx.doc_features(spark, sf), DOC_COLS, 0.5)
    return spark.createDataFrame([(c, c in dropped) for c in DOC_COLS], "feature string, dropped boolean")


def _rank_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"


@query(
    f"WITH {fx.DOCS_SQL}, k AS (SELECT row_id, {', '.join(_rank_sql(c) for c in DOC_COLS)} FROM docs_f) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS col_i, '{b}' AS col_j, {r(f'corr({a}, {b})', 'rho')} FROM k"
        for i, a in enumerate(DOC_COLS)
        for b in DOC_COLS[i + 1 :]
    )
)
def spearman_matrix(spark, sf):
    return rounded(select.spearman_pairs(fx.doc_features(spark, sf), "row_id", DOC_COLS), "rho")


@query(
    f"""WITH {fx.EMB_WIDE_SQL}, l AS (UNPIVOT (SELECT row_id, {', '.join(fx.EMB_FEATURES)} FROM emb_wide)
  ON {', '.join(fx.EMB_FEATURES)} INTO NAME c VALUE x),
r AS (SELECT row_id, c, rank() OVER (PARTITION BY c ORDER BY x) + (count(*) OVER (PARTITION BY c, x) - 1) / 2 AS k FROM l)
SELECT a.c AS col_i, b.c AS col_j, {st.r('corr(a.k, b.k)', 'rho')} FROM r a JOIN r b ON a.row_id = b.row_id
AND list_position({list(fx.EMB_FEATURES)!r}, a.c) < list_position({list(fx.EMB_FEATURES)!r}, b.c) GROUP BY a.c, b.c"""
)
def spearman_of_embeddings(spark, sf):
    """All pairs of the vector components."""
    return rounded(select.spearman_pairs(fx.embeddings_wide(spark, sf), "row_id", fx.EMB_FEATURES), "rho")


# --- principal components ----------------------------------------------------------------


def _components_out(df, names):
    return df.select("row_id", *[r6(f"`{n}`", n.replace(" ", "_").lower()) for n in names])


@query()
def pca_components(spark, sf):
    wide = fx.embeddings_wide(spark, sf).persist()
    fitted = reduce.fit_pca(wide, fx.EMB_FEATURES, 5)
    return _components_out(fitted.transform(wide), fitted.names)


@query()
def pca_train_test(spark, sf):
    """Fitted on the training rows, applied to training and test rows."""
    from millrace.operators.sample import train_test_split

    marked = train_test_split(fx.embeddings_wide(spark, sf), "row_id").persist()
    fitted = reduce.fit_pca_fraction(marked.where("NOT is_test"), fx.EMB_FEATURES, 0.125)
    both = fitted.transform(marked)
    return both.select("row_id", "is_test", *[r6(f"`{n}`", n.replace(" ", "_").lower()) for n in fitted.names])


@query()
def pca_standardized(spark, sf):
    docs = fx.doc_features(spark, sf).persist()
    fitted = reduce.fit_pca_fraction(docs, DOC_COLS, 0.7, standardize=True)
    return _components_out(fitted.transform(docs), fitted.names)


def _pca_sql(a: str, b: str, fitted: str) -> str:
    """Both components of two columns by the closed form of a 2 x 2 covariance; the larger loading is positive."""
    return f"""m_ AS (SELECT avg({a}) AS ma, avg({b}) AS mb, var_pop({a}) AS va, var_pop({b}) AS vb, covar_pop({a}, {b}) AS c FROM {fitted}),
e_ AS (SELECT *, (va + vb + sqrt((va - vb) * (va - vb) + 4 * c * c)) / 2 AS top FROM m_),
u_ AS (SELECT *, c / sqrt(c * c + (top - va) * (top - va)) AS x, (top - va) / sqrt(c * c + (top - va) * (top - va)) AS y FROM e_),
s_ AS (SELECT ma, mb, x * sign(CASE WHEN abs(x) >= abs(y) THEN x ELSE y END) AS x0, y * sign(CASE WHEN abs(x) >= abs(y) THEN x ELSE y END) AS y0,
         -y * sign(CASE WHEN abs(y) >= abs(x) THEN -y ELSE x END) AS x1, x * sign(CASE WHEN abs(y) >= abs(x) THEN -y ELSE x END) AS y1 FROM u_)"""


_SCORES = ", ".join(
    f"round(({{a}} - ma) * x{i} + ({{b}} - mb) * y{i}, 4) + 0.0 AS component_{i}" for i in (0, 1)
)


def _rounded_components(df, names):
    return df.select("row_id", *[(F.round(f"`{n}`", 4) + 0.0).alias(n.replace(" ", "_").lower()) for n in names])


@query(
    f"WITH {fx.DOCS_SQL}, {_pca_sql('n_spaces', 'n_digits', 'docs_f')} "
    f"SELECT row_id, {_SCORES.format(a='n_spaces', b='n_digits')} FROM docs_f, s_"
)
def pca_of_two_features(spark, sf):
    docs = fx.doc_features(spark, sf).select("row_id", "n_spaces", "n_digits").persist()
    fitted = reduce.fit_pca(docs, ("n_spaces", "n_digits"), 2)
    return _rounded_components(fitted.transform(docs), fitted.names)


@query(
    f"WITH {fx.DOCS_SQL}, {st.split_cte('docs_f')}, train AS (SELECT * FROM marked WHERE NOT is_test), "
    f"{_pca_sql('n_lines', 'n_digits', 'train')} SELECT row_id, {_SCORES.format(a='n_lines', b='n_digits')} FROM docs_f, s_"
)
def pca_of_two_features_train_test(spark, sf):
    """Fitted on the training rows, applied to all."""
    from millrace.operators.sample import train_test_split

    docs = fx.doc_features(spark, sf).select("row_id", "n_lines", "n_digits")
    marked = train_test_split(docs, "row_id").persist()
    fitted = reduce.fit_pca(marked.where("NOT is_test").drop("is_test"), ("n_lines", "n_digits"), 2)
    return _rounded_components(fitted.transform(marked.drop("is_test")), fitted.names)


def centred_moment_sql() -> str:
    """Total variance of the standardised features that the components must keep."""
    return " + ".join(f"var_pop({c}) / nullif(var_pop({c}), 0)" for c in DOC_COLS)


@query(f"WITH {fx.DOCS_SQL} SELECT round({centred_moment_sql()}, 6) AS total_variance, count(*) AS n FROM docs_f")
def pca_total_variance(spark, sf):
    """All components of the standardised features keep their whole variance."""
    docs = fx.doc_features(spark, sf).persist()
    fitted = reduce.fit_pca(docs, DOC_COLS, len(DOC_COLS), standardize=True)
    scores = fitted.transform(docs)
    total = sum((F.var_pop(f"`{n}`") for n in fitted.names), F.lit(0.0))
    return scores.agg(r6(total, "total_variance"), F.count(F.lit(1)).alias("n"))
