"""Scores of predictions and clusterings."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ordering import running_counts
from millrace.operators.neighbors import approx_sq, block_join, matrix, row_chunks


def confusion_counts(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, prediction, n) for the pairs that occur."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n) for all pairs of occurring classes, with zeros."""
    counts = confusion_counts(df, label, prediction).collect()
    classes = sorted({r["label"] for r in counts} | {r["prediction"] for r in counts})
    cells = {(r["label"], r["prediction"]): r["n"] for r in counts}
    kind = dict(df.dtypes)[label]
    return df.sparkSession.createDataFrame(
        [(a, b, cells.get((a, b), 0)) for a in classes for b in classes],
        f"label {kind}, prediction {kind}, n bigint",
    )


def _ratio(a: float, b: float) -> float | None:
    return a / b if b else None


def metrics_of(cells: dict[tuple, int]) -> dict[str, float | None]:
    """All classification scores from confusion counts {(label, prediction): n}.

    ``ref_sensitivity`` and ``ref_specificity`` are the precisions of the first
    and second class; ``tpr`` and ``tnr`` are the textbook rates of the second
    class.  ``cost`` is the mean of the first two.
    """
    classes = sorted({c for pair in cells for c in pair})
    n = sum(cells.values())
    hit = sum(cells.get((c, c), 0) for c in classes)
    true = {c: sum(v for (a, _), v in cells.items() if a == c) for c in classes}
    said = {c: sum(v for (_, b), v in cells.items() if b == c) for c in classes}
    accuracy = _ratio(hit, n)
    expected = sum(true[c] * said[c] for c in classes) / (n * n) if n else None
    kappa = None if not n or expected == 1 else (accuracy - expected) / (1 - expected)
    recalls = [(cells.get((c, c), 0) / true[c]) if true[c] else 0.0 for c in classes]
    precisions = [(cells.get((c, c), 0) / said[c]) if said[c] else 0.0 for c in classes]
    f1s = [2 * p * r / (p + r) if p + r else 0.0 for p, r in zip(precisions, recalls)]
    c0, c1 = (classes + [None, None])[:2]
    two = c1 is not None
    c00, c01 = cells.get((c0, c0), 0), cells.get((c0, c1), 0)
    c10, c11 = cells.get((c1, c0), 0), cells.get((c1, c1), 0)
    sensitivity = _ratio(c00, c00 + c10) if two else None
    specificity = _ratio(c11, c11 + c01) if two else None
    return {
        "accuracy": accuracy,
        "precision": accuracy,
        "recall": accuracy,
        "f1": accuracy,
        "kappa": kappa,
        "precision_macro": float(np.mean(precisions)) if classes else None,
        "recall_macro": float(np.mean(recalls)) if classes else None,
        "f1_macro": float(np.mean(f1s)) if classes else None,
        "ref_sensitivity": sensitivity,
        "ref_specificity": specificity,
        "tpr": _ratio(c11, c11 + c10) if two else None,
        "tnr": _ratio(c00, c00 + c01) if two else None,
        "cost": None if sensitivity is None or specificity is None else (sensitivity + specificity) / 2,
    }


def classification_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> dict[tuple, dict]:
    """Scores per value of ``by``; only the confusion counts reach the driver."""
    cells: dict[tuple, dict[tuple, int]] = {}
    for r in confusion_counts(df, label, prediction, by).collect():
        cells.setdefault(tuple(r[b] for b in by), {})[(r["label"], r["prediction"])] = r["n"]
    return {key: metrics_of(c) for key, c in cells.items()}


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr, area) per distinct score, highest first.

    ``area`` is the share of the trapezoid area that the threshold adds; its sum
    is the area under the curve.
    """
    positive = F.col(label).cast("int")
    counts = (
        df.groupBy(F.lit(0).alias("g_"), F.col(score).cast("double").alias("threshold"))
        .agg(F.sum(positive).cast("bigint").alias("pos"), F.sum(1 - positive).cast("bigint").alias("neg"))
    )
    placed = running_counts(counts, "g_", "threshold", ["pos", "neg"], descending=True)
    totals = placed.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")).first()
    p, n = float(totals["all_pos"] or 0) or None, float(totals["all_neg"] or 0) or None
    all_pos, all_neg = F.lit(p).cast("double"), F.lit(n).cast("double")
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    return placed.select(
        "threshold",
        tp.cast("bigint").alias("tp"),
        fp.cast("bigint").alias("fp"),
        (tp / all_pos).alias("tpr"),
        (fp / all_neg).alias("fpr"),
        (F.col("neg") * (F.col("pos_before") + F.col("pos") / 2.0) / (all_pos * all_neg)).alias("area"),
    )


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(fpr, tpr) points from (0, 0) to (1, 1)."""
    points = roc_points(df, label, score).select("threshold", "fpr", "tpr")
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(points)


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    return roc_points(df, label, score).agg(F.sum("area").alias("auc"))


def fold_summary(values: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """(run..., metric, mean, values) of a long table (run..., fold, metric, value).

    The mean is missing when any fold is; in the list gaps are filled forward,
    then backward.  A list has one entry per fold.
    """
    forward = Window.partitionBy(*run, "metric").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*run, "metric").orderBy("fold").rowsBetween(0, Window.unboundedFollowing)
    v = F.when(~F.isnan("value"), F.col("value"))
    filled = F.coalesce(F.last(v, ignorenulls=True).over(forward), F.first(v, ignorenulls=True).over(backward))
    return (
        values.withColumns({"v_": v, "filled_": filled})
        .groupBy(*run, "metric")
        .agg(
            F.when(F.count("v_") == F.count(F.lit(1)), F.avg("v_")).alias("mean"),
            F.transform(F.sort_array(F.collect_list(F.struct("fold", "filled_"))), lambda s: s["filled_"]).alias(
                "fold_values"
            ),
        )
    )


def _pairs(n) -> F.Column:
    return n * (n - 1) / 2.0


def contingency(df: DataFrame, label: str, cluster: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )


def _margins(cells: DataFrame, value: Callable[[F.Column], F.Column]) -> dict[str, float]:
    """Sums of ``value(n)`` over the cells, the label totals and the cluster totals, and n itself."""
    sums = (
        cells.groupingSets([["label", "cluster"], ["label"], ["cluster"], []], "label", "cluster")
        .agg(F.grouping_id().alias("kind"), F.sum("n").alias("n"))
        .groupBy("kind")
        .agg(F.sum(value(F.col("n"))).alias("s"), F.max("n").alias("n"))
        .collect()
    )
    found = {r["kind"]: r for r in sums}
    return {"cells": found[0]["s"], "labels": found[1]["s"], "clusters": found[2]["s"], "n": found[3]["n"]}


def adjusted_rand(df: DataFrame, label: str, cluster: str) -> DataFrame:
    m = _margins(contingency(df, label, cluster), _pairs)
    expected = m["labels"] * m["clusters"] / (m["n"] * (m["n"] - 1) / 2.0) if m["n"] > 1 else 0.0
    top = (m["labels"] + m["clusters"]) / 2.0
    value = 1.0 if top == expected else (m["cells"] - expected) / (top - expected)
    return df.sparkSession.createDataFrame([(value,)], "ad_rand_score double")


def information_scores(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """Mutual information, its normalised form, homogeneity, completeness and V-measure.

    All follow from the entropies of the cells, the labels and the clusters.
    """
    m = _margins(contingency(df, label, cluster), lambda n: n * F.ln(n))
    joint, h_label, h_cluster = (
        max(0.0, math.log(m["n"]) - m[k] / m["n"]) for k in ("cells", "labels", "clusters")
    )
    mi = max(0.0, h_label + h_cluster - joint)

    def share(whole: float) -> float:
        return mi / whole if whole > 0 else 1.0

    homogeneity, completeness = share(h_label), share(h_cluster)
    both = homogeneity + completeness
    row = (mi, share((h_label + h_cluster) / 2), homogeneity, completeness, 2 * homogeneity * completeness / both if both else 0.0)
    return df.sparkSession.createDataFrame(
        [row],
        "mutual_info double, normalized_mutual_info double, homogeneity double, completeness double, v_measure double",
    )


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! by Stirling's series, shifted to where it is exact to rounding."""
    x = np.asarray(n, dtype=np.float64) + 1.0
    shift = np.zeros_like(x)
    for _ in range(10):
        small = x < 10.0
        shift = np.where(small, shift + np.log(x), shift)
        x = np.where(small, x + 1.0, x)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def adjusted_mutual_info(df: DataFrame, label: str, cluster: str, chunk: int = 200_000) -> DataFrame:
    """Mutual information corrected for chance.

    The expectation sums over every possible cell count of every pair of class
    and cluster sizes; those counts are spread over the tasks in chunks.
    """
    spark = df.sparkSession
    sizes = (
        contingency(df, label, cluster)
        .groupingSets([["label"], ["cluster"]], "label", "cluster")
        .agg(F.grouping_id().alias("kind"), F.sum("n").cast("bigint").alias("n"))
        .groupBy("kind", "n")
        .agg(F.count(F.lit(1)).alias("times"))
        .collect()
    )
    rows, cols = ([(r["n"], r["times"]) for r in sizes if r["kind"] == k] for k in (1, 2))
    total = sum(n * t for n, t in rows)
    if not total:
        return spark.createDataFrame([(1.0,)], "adjusted_mutual_info double")
    # the driver holds the distinct sizes (at most about the root of twice the rows), the tasks their product
    blocks = math.ceil(len(cols) / 64)
    left = spark.createDataFrame([(a, s) for a, s in rows], "a bigint, s bigint")
    right = spark.createDataFrame([(b, t, i % blocks) for i, (b, t) in enumerate(cols)], "b bigint, t bigint, block int")
    pairs = (
        left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .join(right, "block")
        .select("a", "b", (F.col("s") * F.col("t")).cast("double").alias("times"))
    )
    first = F.greatest(F.lit(1), F.col("a") + F.col("b") - total).cast("bigint")
    last = F.least("a", "b")
    chunks = pairs.select("*", F.explode(F.sequence(first, F.greatest(first, last), F.lit(chunk).cast("bigint"))).alias("lo"))
    chunks = chunks.withColumn("hi", F.least(last, F.col("lo") + chunk - 1)).repartition("a", "b", "lo")

    def expected(batches):
        for pdf in batches:
            out = 0.0
            for a, b, times, lo, hi in pdf.itertuples(index=False):
                n = np.arange(lo, hi + 1, dtype=np.float64)
                fixed = _log_factorial(np.array([a, b, total - a, total - b])).sum() - float(_log_factorial(np.array([total]))[0])
                free = sum(_log_factorial(m) for m in (n, a - n, b - n, total - a - b + n))
                out += times * float((n / total * (np.log(total * n) - math.log(a) - math.log(b)) * np.exp(fixed - free)).sum())
            yield pd.DataFrame({"e": [out]})

    emi = chunks.mapInPandas(expected, "e double").agg(F.sum("e")).first()[0] or 0.0
    scores = information_scores(df, label, cluster).first()
    mi = scores["mutual_info"]
    h = [-sum(t * n / total * math.log(n / total) for n, t in side) for side in (rows, cols)]
    top = sum(h) / 2 - emi
    value = 1.0 if len(rows) == len(cols) == 1 and rows[0][1] == cols[0][1] == 1 else (mi - emi) / top if top else 0.0
    return spark.createDataFrame([(value,)], "adjusted_mutual_info double")


def silhouette_rows(df: DataFrame, cluster: str, query_block: int = 16_384, point_block: int = 16_384) -> DataFrame:
    """(row_id, cluster, n, silhouette): Euclidean silhouette of each distinct (vector, cluster).

    ``df`` carries ``row_id``, ``vec`` and the cluster; ``row_id`` of the result
    is the first of the ``n`` equal rows.  Every distance counts, so the work is
    quadratic; the tasks exchange one sum per row and cluster, never a distance.
    """
    points = df.groupBy(F.col("vec").cast("array<double>").alias("vec"), F.col(cluster).cast("bigint").alias("c_")).agg(
        F.count(F.lit(1)).alias("n_"), F.min("row_id").alias("row_id")
    )

    def sums(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame()
        a, b = matrix(q["vec"]), matrix(p["vec"])
        # reference rows by cluster: a cluster's distances are one run of columns
        order = np.argsort(p["c_"].to_numpy(), kind="stable")
        b, weight = b[order], p["n_"].to_numpy()[order]
        clusters, first = np.unique(p["c_"].to_numpy()[order], return_index=True)
        parts = [
            np.add.reduceat(np.sqrt(approx_sq(a[part], b)[0]) * weight, first, axis=1) for part in row_chunks(len(a), len(b))
        ]
        total = np.vstack(parts)
        return pd.DataFrame(
            {
                "row_id": np.repeat(q["row_id"].to_numpy(), len(clusters)),
                "other": np.tile(clusters, len(a)),
                "total": total.ravel(),
            }
        )

    found, _ = block_join(
        points,
        points,
        sums,
        "row_id bigint, other bigint, total double",
        point_extra=["c_", "n_"],
        query_block=query_block,
        point_block=point_block,
    )
    own = points.select("row_id", F.col("c_").alias("own"), F.col("n_").alias("copies"))
    sizes = points.groupBy(F.col("c_").alias("other")).agg(F.sum("n_").alias("size"))
    means = (
        found.groupBy("row_id", "other")
        .agg(F.sum("total").alias("total"))
        .join(sizes, "other")
        .join(own, "row_id")
        .groupBy("row_id", "own", "copies")
        .agg(
            F.max(F.when((F.col("own") == F.col("other")) & (F.col("size") > 1), F.col("total") / F.when(F.col("size") > 1, F.col("size") - 1))).alias("a"),
            F.min(F.when(F.col("own") != F.col("other"), F.col("total") / F.col("size"))).alias("b"),
        )
    )
    top = F.greatest("a", "b")
    value = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(
        F.coalesce((F.col("b") - F.col("a")) / F.nullif(top, F.lit(0.0)), F.lit(0.0))
    )
    return means.select("row_id", F.col("own").alias("cluster"), F.col("copies").alias("n"), value.alias("silhouette"))


def silhouette(df: DataFrame, cluster: str, **blocks) -> DataFrame:
    """Mean Euclidean silhouette over all rows."""
    rows = silhouette_rows(df, cluster, **blocks)
    return rows.agg((F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).alias("silhouette"))


def silhouette_squared(df: DataFrame, cluster: str) -> float:
    """Silhouette on squared Euclidean distances: one linear pass, for tables of any size."""
    vectors = df.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"), F.col(cluster).cast("int").alias("prediction"))
    return ClusteringEvaluator().evaluate(vectors)
