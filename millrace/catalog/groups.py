"""Queries: clusterings and their scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.catalog import fixtures as fx
from millrace.catalog import statements as st
from millrace.catalog.registry import query, r6, rounded
from millrace.functions.vectors import as_array
from millrace.operators import cluster, density, hierarchy, reduce, scale, score
from millrace.plans import jobs

DOC_COLS = fx.DOCS.features
EPS, MIN_SAMPLES = 0.03, 4

SCALED_SQL = f"""scaled AS (SELECT row_id, quality AS label, [
  {', '.join(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())' for c in DOC_COLS)}] AS vec FROM docs_f)"""


def scaled_docs(spark, sf):
    docs = fx.doc_features(spark, sf).persist()
    scaled = scale.fit_minmax(docs, DOC_COLS).transform(docs)
    return scaled.select("row_id", as_array(DOC_COLS).alias("vec"), F.col("quality").alias("label"))


def size_of(clusters):
    """(cluster, n) of a clustering."""
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def kmeans(spark, sf):
    clusters, inertia = cluster.kmeans(fx.embeddings(spark, sf).persist(), 10)
    return clusters.withColumn("inertia", F.round(F.lit(inertia), 6))


VARIANCES = " + ".join(f"var_pop(vec[{i + 1}])" for i in range(fx.EMBEDDING_DIMS))


@query(f"WITH {fx.EMB_SQL} SELECT count(*) AS n, {st.r(f'count(*) * ({VARIANCES})', 'total')} FROM emb")
def kmeans_inertia_and_spread(spark, sf):
    """The inertia and the spread between the centres add up to the total sum of squares."""
    emb = fx.embeddings(spark, sf).persist()
    clusters, inertia = cluster.kmeans(emb, 10)
    dims = range(fx.EMBEDDING_DIMS)
    centres = emb.join(clusters, "row_id").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col("vec")[i]).alias(f"m{i}") for i in dims]
    )
    whole = emb.agg(*[F.avg(F.col("vec")[i]) for i in dims]).first()
    gap = sum(((F.col(f"m{i}") - F.lit(whole[i])) ** 2 for i in dims), F.lit(0.0))
    return centres.agg(F.sum("n").alias("n"), r6(F.sum(F.col("n") * gap) + F.lit(inertia), "total"))


@query()
def mini_batch_kmeans(spark, sf):
    clusters, inertia = cluster.mini_batch_kmeans(fx.embeddings(spark, sf), 10, batch_rows=256, max_iter=10)
    return clusters.withColumn("inertia", F.round(F.lit(inertia), 6))


@query()
def gaussian_mixture(spark, sf):
    return cluster.gaussian_mixture(scaled_docs(spark, sf), 3)[0]


@query()
def hierarchical(spark, sf):
    return cluster.hierarchical(fx.embeddings(spark, sf), 10)


WARD_SQL = """RECURSIVE cl(k, id, x, y, n, members) AS (
  SELECT (SELECT count(*) FROM supplier), s_suppkey, s_acctbal / 1000, CAST(s_nationkey AS DOUBLE), 1.0::DOUBLE, [s_suppkey] FROM supplier
  UNION ALL
  SELECT * FROM (
    WITH pair AS (SELECT a.id AS i, b.id AS j, a.n * b.n / (a.n + b.n) * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS cost
                  FROM cl a JOIN cl b ON a.id < b.id AND a.k > 1 ORDER BY cost, i, j LIMIT 1)
    SELECT k - 1, CASE WHEN id = j THEN i ELSE id END AS id2, sum(x * n) / sum(n), sum(y * n) / sum(n), sum(n), flatten(list(members))
    FROM cl, pair GROUP BY k, id2))"""


def suppliers(spark, sf):
    place = F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double"))
    return fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), place.alias("vec"))


@query(
    f"""WITH {WARD_SQL} SELECT unnest(members) AS row_id, dense_rank() OVER (ORDER BY id) - 1 AS cluster FROM cl WHERE k = 6"""
)
def hierarchical_suppliers(spark, sf):
    """All merges of the suppliers, cut at six clusters."""
    return cluster.hierarchical(suppliers(spark, sf), 6)


@query(
    f"""WITH {WARD_SQL}, size AS (SELECT k, sum(len(members) * (len(members) - 1) / 2) AS pairs,
  sum(n * (x * x + y * y)) AS between_ FROM cl GROUP BY k)
SELECT CAST(a.k AS BIGINT) AS clusters_left, {st.r('b.between_ - a.between_', 'height')}
FROM size a JOIN size b ON b.k = a.k + 1 WHERE a.k <= 12"""
)
def ward_history(spark, sf):
    """The growth of the sum of squares by each of the last merges."""
    points = suppliers(spark, sf).withColumn("n", F.lit(1.0))
    last = hierarchy.ward_merges(points).orderBy(F.col("height").desc(), F.col("n").desc()).limit(12)
    return last.select(F.row_number().over(Window.orderBy(F.col("height").desc())).cast("bigint").alias("clusters_left"), r6("height"))


@query()
def birch(spark, sf):
    return cluster.birch(scaled_docs(spark, sf), 3, threshold=0.05)


@query()
def spectral(spark, sf):
    return cluster.spectral(scaled_docs(spark, sf), 3, n_neighbors=8)


@query()
def mean_shift(spark, sf):
    return density.mean_shift(scaled_docs(spark, sf), 0.25, max_iter=40, bin_seeding=True)[0]


# --- groups that lie far apart: every method has to find just these -----------------------------

APART_SQL = f"""WITH {fx.DOCS_SQL}, s AS (SELECT row_id, row_id % 4 AS g FROM docs_f),
f AS (SELECT g, row_number() OVER (ORDER BY min(row_id)) - 1 AS cluster FROM s GROUP BY g)
SELECT row_id, CAST(cluster AS BIGINT) AS cluster FROM s JOIN f USING (g)"""


def apart(spark, sf):
    """Four groups of documents, a hundred units from each other and about one wide."""
    g = F.col("row_id") % 4
    x = 100.0 * (g % 2) + F.col("n_chars") / (F.col("n_chars") + 1000)
    y = 100.0 * F.floor(g / 2) + F.col("n_lines") / (F.col("n_lines") + 10)
    return fx.doc_features(spark, sf).select("row_id", F.array(x, y.cast("double")).alias("vec")).persist()


def numbered(clusters):
    """Clusters numbered by their first row."""
    firsts = clusters.groupBy("cluster").agg(F.min("row_id").alias("first"))
    order = F.array_sort(F.collect_list("first"))
    place = F.array_position(firsts.select(order).scalar(), F.col("first")) - 1
    return clusters.join(firsts, "cluster").select("row_id", place.alias("cluster"))


@query(APART_SQL)
def kmeans_apart(spark, sf):
    return numbered(cluster.kmeans(apart(spark, sf), 4)[0])


@query(APART_SQL)
def mini_batch_kmeans_apart(spark, sf):
    return numbered(cluster.mini_batch_kmeans(apart(spark, sf), 4, batch_rows=64)[0])


@query(APART_SQL)
def gaussian_mixture_apart(spark, sf):
    return numbered(cluster.gaussian_mixture(apart(spark, sf), 4)[0])


@query(APART_SQL)
def hierarchical_apart(spark, sf):
    return numbered(cluster.hierarchical(apart(spark, sf), 4))


@query(APART_SQL)
def birch_apart(spark, sf):
    return numbered(cluster.birch(apart(spark, sf), 4, threshold=0.25))


@query(APART_SQL)
def spectral_apart(spark, sf):
    return numbered(cluster.spectral(apart(spark, sf), 4, n_neighbors=12))


@query(APART_SQL)
def mean_shift_apart(spark, sf):
    return numbered(density.mean_shift(apart(spark, sf), 10.0)[0])


DBSCAN_SQL = f"""{fx.DOCS_SQL}, {SCALED_SQL},
pair AS (SELECT a.row_id AS a, b.row_id AS b FROM scaled a, scaled b WHERE list_distance(a.vec, b.vec) <= {EPS}),
core AS (SELECT a AS row_id FROM pair GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
link AS (SELECT a, b FROM pair WHERE a IN (SELECT row_id FROM core) AND b IN (SELECT row_id FROM core)),
reach AS (SELECT row_id AS a, row_id AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a AS row_id, min(b) AS c FROM reach GROUP BY a),
num AS (SELECT c, dense_rank() OVER (ORDER BY c) - 1 AS k FROM (SELECT DISTINCT c FROM comp)),
member AS (SELECT row_id, c FROM comp UNION ALL
           SELECT a, min(c) FROM pair JOIN comp ON comp.row_id = b WHERE a NOT IN (SELECT row_id FROM core) GROUP BY a),
found AS (SELECT s.row_id, coalesce(k, -1)::BIGINT AS cluster, s.row_id IN (SELECT row_id FROM core) AS is_core
          FROM scaled s LEFT JOIN member m ON m.row_id = s.row_id LEFT JOIN num ON num.c = m.c)"""


@query(f"WITH RECURSIVE {DBSCAN_SQL} SELECT row_id, cluster, is_core FROM found")
def dbscan(spark, sf):
    return density.dbscan(scaled_docs(spark, sf), EPS, MIN_SAMPLES)


@query(f"WITH RECURSIVE {DBSCAN_SQL} SELECT f.row_id, label FROM found f JOIN scaled s ON s.row_id = f.row_id WHERE cluster = 0")
def rows_of_one_cluster(spark, sf):
    docs = scaled_docs(spark, sf)
    return docs.join(density.dbscan(docs, EPS, MIN_SAMPLES), "row_id").where("cluster = 0").select("row_id", "label")


@query()
def cluster_view(spark, sf):
    """Three components of every row beside its cluster."""
    wide = fx.embeddings_wide(spark, sf).persist()
    fitted = reduce.fit_pca(wide, fx.EMB_FEATURES, 3)
    clusters = cluster.hierarchical(fx.embeddings(spark, sf), 10)
    view = fitted.transform(wide.drop("label")).join(clusters, "row_id")
    return view.select("row_id", "cluster", *[r6(f"`{n}`", n.replace(" ", "_").lower()) for n in fitted.names])


def metrics_frame(spark, metrics):
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double"), "value")


@query()
def clustering_job_kmeans(spark, sf):
    config = {
        "rescaler": "normalize",
        "featureFunction": "f_classif",
        "featuresToKeepPercentage": 0.25,
        "clusterFunction": "kmeans",
        "clusterParams": {"n_clusters": 10},
        "silhouette": "euclidean",
    }
    return metrics_frame(spark, jobs.clustering_job(fx.embeddings_wide(spark, sf), fx.EMB, config)[1])


@query()
def clustering_job_density(spark, sf):
    config = {
        "balancingStrategy": "randUndersample",
        "rescaler": "normalize",
        "PCA": True,
        "numComponents": 2,
        "clusterFunction": "dbscan",
        "clusterParams": {"eps": EPS, "min_samples": MIN_SAMPLES},
        "silhouette": "euclidean",
    }
    return metrics_frame(spark, jobs.clustering_job(fx.doc_features(spark, sf), fx.DOCS, config)[1])


# --- scores of given clusterings ---------------------------------------------------------------

GIVEN_SQL = "SELECT o_orderkey, o_orderstatus AS label, CAST(floor(o_totalprice / 60000) AS BIGINT) AS cluster FROM orders"


def given(spark, sf):
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("label"), F.floor(F.col("o_totalprice") / 60000).alias("cluster")
    )


@query(
    f"""WITH g AS ({GIVEN_SQL}), t AS (SELECT label, cluster, count(*) * 1.0::DOUBLE AS n FROM g GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY label)) AS a,
             (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY cluster)) AS b, (SELECT sum(n) FROM t) AS n)
SELECT {st.r('(i - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2))', 'ad_rand_score')} FROM s"""
)
def adjusted_rand_index(spark, sf):
    return rounded(score.adjusted_rand(given(spark, sf), "label", "cluster"), "ad_rand_score")


INFO = "mutual_info normalized_mutual_info homogeneity completeness v_measure".split()


@query(
    f"""WITH g AS ({GIVEN_SQL}), t AS (SELECT label, cluster, count(*) * 1.0::DOUBLE AS n FROM g GROUP BY ALL),
a AS (SELECT label, sum(n) AS a FROM t GROUP BY label), b AS (SELECT cluster, sum(n) AS b FROM t GROUP BY cluster),
z AS (SELECT sum(n) AS z FROM t),
m AS (SELECT (SELECT sum(n / z * ln(n * z / (a * b))) FROM t JOIN a ON a.label = t.label JOIN b ON b.cluster = t.cluster, z) AS mi,
             (SELECT -sum(a / z * ln(a / z)) FROM a, z) AS ha, (SELECT -sum(b / z * ln(b / z)) FROM b, z) AS hb)
SELECT {st.r('mi', 'mutual_info')}, {st.r('mi / ((ha + hb) / 2)', 'normalized_mutual_info')}, {st.r('mi / ha', 'homogeneity')},
       {st.r('mi / hb', 'completeness')}, {st.r('2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb)', 'v_measure')} FROM m"""
)
def information_scores(spark, sf):
    return rounded(score.information_scores(given(spark, sf), "label", "cluster"), *INFO)


@query(
    f"""WITH {fx.DOCS_SQL}, g AS (SELECT quality AS label, CAST(floor(ln(n_chars)) AS BIGINT) AS cluster FROM docs_f),
t AS (SELECT label, cluster, count(*) * 1.0::DOUBLE AS n FROM g GROUP BY ALL), z AS (SELECT sum(n) AS z FROM t),
a AS (SELECT label, sum(n) AS a FROM t GROUP BY label), b AS (SELECT cluster, sum(n) AS b FROM t GROUP BY cluster),
e AS (SELECT sum(n / z * ln(z * n / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(z - a + 1) + lgamma(z - b + 1) - lgamma(z + 1)
        - lgamma(n + 1) - lgamma(a - n + 1) - lgamma(b - n + 1) - lgamma(z - a - b + n + 1))) AS emi
      FROM (SELECT a, b, z, unnest(range(CAST(greatest(1, a + b - z) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1))::DOUBLE AS n FROM a, b, z)),
m AS (SELECT (SELECT sum(n / z * ln(n * z / (a * b))) FROM t JOIN a ON a.label = t.label JOIN b ON b.cluster = t.cluster, z) AS mi,
             (SELECT -sum(a / z * ln(a / z)) FROM a, z) AS ha, (SELECT -sum(b / z * ln(b / z)) FROM b, z) AS hb)
SELECT {st.r('(mi - emi) / ((ha + hb) / 2 - emi)', 'adjusted_mutual_info')} FROM m, e"""
)
def adjusted_mutual_info(spark, sf):
    """Quality classes against length classes of the documents."""
    docs = fx.doc_features(spark, sf).withColumn("cluster", F.floor(F.ln("n_chars")))
    return rounded(score.adjusted_mutual_info(docs, "quality", "cluster"), "adjusted_mutual_info")


def silhouette_sql(distance: str) -> str:
    return f"""mean_ AS (SELECT a.row_id, a.label AS own, b.label AS other, sum({distance}) AS total, count(*) AS size
          FROM emb a, emb b GROUP BY ALL),
ab_ AS (SELECT row_id, own, max(CASE WHEN own = other THEN total / nullif(size - 1, 0) END) AS a,
               min(CASE WHEN own <> other THEN total / size END) AS b FROM mean_ GROUP BY row_id, own),
sil AS (SELECT row_id, own, coalesce((b - a) / greatest(a, b), 0) AS s FROM ab_)"""


@query(
    f"WITH {fx.EMB_SQL}, {silhouette_sql('list_distance(a.vec, b.vec)')} "
    f"SELECT row_id, CAST(own AS BIGINT) AS cluster, {st.r('s', 'silhouette')} FROM sil"
)
def silhouette_of_rows(spark, sf):
    return rounded(score.silhouette_rows(fx.embeddings(spark, sf), "label").drop("n"), "silhouette")


@query(f"WITH {fx.EMB_SQL}, {silhouette_sql('list_distance(a.vec, b.vec)')} SELECT {st.r('avg(s)', 'silhouette')} FROM sil")
def silhouette(spark, sf):
    return rounded(score.silhouette(fx.embeddings(spark, sf), "label"), "silhouette")


@query(
    f"WITH {fx.EMB_SQL}, {silhouette_sql('list_distance(a.vec, b.vec) * list_distance(a.vec, b.vec)')} "
    f"SELECT {st.r('avg(s)', 'silhouette_squared')} FROM sil"
)
def silhouette_squared(spark, sf):
    """The linear-time variant on squared distances."""
    value = score.silhouette_squared(fx.embeddings(spark, sf), "label")
    return spark.createDataFrame([(round(value, 6),)], "silhouette_squared double")
