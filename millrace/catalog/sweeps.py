"""Queries: sweeps and searches that run whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import fixtures as fx
from millrace.catalog import statements as st
from millrace.catalog.registry import query, r6, rounded
from millrace.functions.hashing import uniform_sql
from millrace.plans import experiments
from millrace.session import new_path

DOC_COLS = fx.DOCS.features
BAYES = {"classifier": "naiveBays", "dataSplitMethod": "kfold"}


def job_sql(k: int, scaled: bool, columns: str) -> str:
    """Columns over the folds' metrics of a naive Bayes job."""
    return f"""(WITH {fx.DOCS_SQL}, {st.folds_cte('docs_f', 'quality', k, ', '.join('t.' + c for c in DOC_COLS))},
{st.bayes_folds_cte(DOC_COLS, 'quality', k, scaled)}, {st.metrics_cte()} SELECT {columns} FROM metrics)"""


@query(
    " UNION ALL ".join(
        f"SELECT CAST({k} AS BIGINT) AS \"kFold\", {'NULL' if not scaled else repr('normalize')} AS rescaler, accuracy, cost FROM "
        + job_sql(k, scaled, f"{st.r('avg(accuracy)', 'accuracy')}, {st.r('avg(cost)', 'cost')}")
        for k in (2, 3)
        for scaled in (False, True)
    )
)
def sweep_job(spark, sf):
    """Four classification jobs, their records written, read back and unified."""
    variations = [{"name": "kFold", "values": [2, 3]}, {"name": "rescaler", "values": ["", "normalize"]}]
    table = experiments.sweep(
        fx.doc_features(spark, sf), fx.DOCS, BAYES, variations, ["rescaler", "kFold"], new_path(spark, "sweep"), levels=[1]
    )
    return table.select(F.col("kFold").cast("bigint").alias("kFold"), F.nullif("rescaler", F.lit("")).alias("rescaler"), r6("accuracy"), r6("cost"))


TRIALS = 6


@query(
    f"""WITH cost_ AS ({' UNION ALL '.join(f"SELECT {k} AS k, value FROM {job_sql(k, True, 'avg(f1_macro) AS value')}" for k in (2, 3, 4))}),
t AS (SELECT CAST(id AS INTEGER) AS trial, 2 + CAST(floor({uniform_sql('0:kFold', 'id')} * 3) AS INTEGER) AS k FROM range({TRIALS}) r(id)),
v AS (SELECT trial, k, value FROM t JOIN cost_ USING (k))
SELECT trial, CAST(k AS VARCHAR) AS "kFold", {st.r('value', 'value')}, value = max(value) OVER () AS best FROM v"""
)
def search_job(spark, sf):
    """Random search over the number of folds of a whole job."""
    config = {**BAYES, "rescaler": "normalize", "kFold": {"optimize": {"int": [2, 4]}}}
    found = experiments.search_job(
        fx.doc_features(spark, sf), fx.DOCS, config, TRIALS, objective=lambda results: experiments.mean_metrics(results)["f1_macro"]
    )
    return rounded(found, "value")
