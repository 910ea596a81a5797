"""Queries: class balancing, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import fixtures as fx
from millrace.catalog import statements as st
from millrace.catalog.registry import query, rounded
from millrace.operators import sample

DOC_COLS = fx.DOCS.features
DOC_OUT = ", ".join(st.r(c, c) for c in DOC_COLS)


@query(f"WITH {fx.DOCS_SQL} SELECT quality, count(*) AS n FROM docs_f GROUP BY quality")
def class_counts(spark, sf):
    return sample.class_counts(fx.doc_features(spark, sf), "quality")


@query(f"WITH {fx.DOCS_SQL} SELECT row_id, quality FROM docs_f")
def not_balanced(spark, sf):
    return sample.not_balanced(fx.doc_features(spark, sf).select("row_id", "quality"))


SMALLEST = "(SELECT min(n) FROM (SELECT count(*) AS n FROM docs_f GROUP BY quality))"


@query(f"WITH {fx.DOCS_SQL}, {st.undersample_cte('docs_f', 'quality', SMALLEST)} SELECT row_id, quality, {DOC_OUT} FROM sampled")
def undersample_to_smallest(spark, sf):
    docs = fx.doc_features(spark, sf).select("row_id", "quality", *DOC_COLS)
    return rounded(sample.random_undersample(docs, "quality", "row_id"), *DOC_COLS)


CAPS = {"F": 4_000, "O": 4_500}


@query(
    f"""WITH {fx.ORDERS_SQL}, {st.undersample_cte('orders_f', 'label', "CASE label WHEN 'F' THEN 4000 WHEN 'O' THEN 4500 ELSE 1000000000000 END")}
        SELECT row_id, label FROM sampled"""
)
def undersample_to_class_caps(spark, sf):
    """Per-class caps; a class without a cap stays whole."""
    return sample.random_undersample(fx.orders_features(spark, sf).select("row_id", "label"), "label", "row_id", CAPS)


@query(
    f"""WITH {fx.DOCS_SQL}, {st.undersample_cte('docs_f', 'quality', SMALLEST)},
a AS (SELECT quality, count(*) AS n_before FROM docs_f GROUP BY quality), b AS (SELECT quality, count(*) AS n_after FROM sampled GROUP BY quality)
SELECT a.quality, n_before, n_after FROM a LEFT JOIN b ON a.quality = b.quality"""
)
def frequency_report(spark, sf):
    docs = fx.doc_features(spark, sf).select("row_id", "quality")
    return sample.frequency_report(docs, sample.random_undersample(docs, "quality", "row_id"), "quality")


LARGEST = "(SELECT max(n) FROM count_)"


@query(f"WITH {fx.DOCS_SQL}, {st.smote_cte('docs_f', DOC_COLS, 'quality', LARGEST)} SELECT row_id, quality, {DOC_OUT}, synthetic FROM grown")
def smote(spark, sf):
    """Synthetic rows between near rows of the smaller class until the classes are equal."""
    docs = fx.doc_features(spark, sf).persist()
    return rounded(sample.smote(docs, DOC_COLS, "quality", "row_id"), *DOC_COLS)


@query(
    f"WITH {fx.EMB_SQL}, {fx.EMB_WIDE_SQL}, {st.smote_cte('emb_wide', fx.EMB_FEATURES, 'label', LARGEST)} "
    f"SELECT row_id, label, {', '.join(st.r(c, c) for c in fx.EMB_FEATURES)}, synthetic FROM grown"
)
def smote_many_classes(spark, sf):
    wide = fx.embeddings_wide(spark, sf).persist()
    out = sample.smote(wide, fx.EMB_FEATURES, "label", "row_id")
    return rounded(out, *fx.EMB_FEATURES)


TARGET = "greatest(n, 200)"


@query(
    f"""WITH {fx.DOCS_SQL}, {st.smote_cte('docs_f', DOC_COLS, 'quality', TARGET)}, {st.undersample_cte('grown', 'quality', '200')}
SELECT row_id, quality, {DOC_OUT}, synthetic FROM sampled"""
)
def balance_combined(spark, sf):
    """Smaller classes grown and larger ones cut to the same target."""
    docs = fx.doc_features(spark, sf).persist()
    out = sample.combined(docs, DOC_COLS, "quality", "row_id", {0: 200, 1: 200})
    return rounded(out.select("row_id", "quality", *DOC_COLS, "synthetic"), *DOC_COLS)


@query(f"WITH {fx.DOCS_SQL}, s AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM docs_f GROUP BY quality)) SELECT DISTINCT quality, n FROM docs_f, s")
def cluster_centroid_counts(spark, sf):
    """Class sizes after the larger class gave way to its cluster centres."""
    docs = fx.doc_features(spark, sf).persist()
    return sample.class_counts(sample.cluster_centroids(docs, DOC_COLS, "quality", "row_id"), "quality")


@query()
def cluster_centroids(spark, sf):
    docs = fx.doc_features(spark, sf).persist()
    return rounded(sample.cluster_centroids(docs, DOC_COLS, "quality", "row_id"), *DOC_COLS)


@query(f"WITH {fx.ORDERS_SQL}, {st.split_cte('orders_f')} SELECT row_id, label, is_test FROM marked")
def train_test_split(spark, sf):
    return sample.train_test_split(fx.orders_features(spark, sf).select("row_id", "label"), "row_id")


@query(f"WITH {fx.ORDERS_SQL}, {st.folds_cte('orders_f', 'label', 5, 't.month')} SELECT row_id, label, fold FROM folds")
def stratified_folds(spark, sf):
    return sample.stratified_folds(fx.orders_features(spark, sf).select("row_id", "label"), "label", "row_id", 5)


GAPS_SQL = "gaps AS (SELECT row_id, month, CASE WHEN priority <> 4 THEN label END AS label FROM orders_f)"


@query(
    f"""WITH {fx.ORDERS_SQL}, {GAPS_SQL}, named AS (SELECT * FROM gaps WHERE label IS NOT NULL), {st.folds_cte('named', 'label', 5, 't.month')}
SELECT row_id, label, fold FROM folds UNION ALL SELECT row_id, label, NULL FROM gaps WHERE label IS NULL"""
)
def folds_with_missing_labels(spark, sf):
    """Rows without a label stay, in no fold."""
    orders = fx.orders_features(spark, sf).withColumn("label", F.when(F.col("priority") != 4, F.col("label")))
    return sample.stratified_folds(orders.select("row_id", "label"), "label", "row_id", 5)


@query(
    f"""WITH {fx.DOCS_SQL}, {st.folds_cte('docs_f', 'quality', 7, 't.toxic')}
SELECT fold, quality, count(*) AS n FROM folds GROUP BY fold, quality"""
)
def fold_class_counts(spark, sf):
    folds = sample.stratified_folds(fx.doc_features(spark, sf).select("row_id", "quality"), "quality", "row_id", 7)
    return folds.groupBy("fold", "quality").agg(F.count(F.lit(1)).alias("n"))
