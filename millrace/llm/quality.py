"""Quality scores by a regularised quadratic discriminant over transformed text statistics.

Class means and covariances come from moments that Spark adds up over all
labelled rows; the driver sees two rows of sums.  Covariances shrink towards the
diagonal of the pooled one, are factored once, and a score is the difference of
two Gaussian log densities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import as_bytes, crc_fold, stored
from millrace.llm.textstats import text_stats

SHRINKAGE = 0.1
THRESHOLD = 0.3
FOLDS = 5
#: No feature's pooled variance counts as less.
LEAST_VARIANCE = 1e-6


def features(s: str = "s_") -> dict[str, Column]:
    c = lambda name: F.col(f"{s}.{name}").cast("double")
    words, chars, lines = (F.greatest(c(n), F.lit(1.0)) for n in ("n_words", "word_chars", "n_lines"))
    return {
        "length": F.log1p(c("n_words")),
        "word_length": F.log1p(c("word_chars") / words),
        "symbols": F.sqrt(c("n_symbols") / chars),
        "upper": F.sqrt(c("n_upper") / chars),
        "digits": F.sqrt(c("n_digits") / chars),
        "marks": F.sqrt(c("n_marks") / chars),
        "exclaims": F.sqrt(c("n_exclaims") / words),
        "repeated_lines": F.sqrt(c("n_dup_lines") / lines),
        "repeated_words": F.sqrt(c("n_repeat_words") / words),
        # words that differ, on the scale on which natural text falls with length
        "variety": F.log1p(c("n_distinct")) / F.log1p(words + 1),
        "long_words": F.sqrt(F.least(c("n_long") / chars, F.lit(1.0))),
    }


FEATURES = tuple("length word_length symbols upper digits marks exclaims repeated_lines repeated_words variety long_words".split())


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of both classes, and the log odds of class 1."""

    mean: np.ndarray
    inverse_factor: np.ndarray
    log_det: np.ndarray
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.inverse_factor[k].T
            density.append(-0.5 * ((z * z).sum(axis=1) + self.log_det[k]))
        odds = np.clip(density[1] - density[0] + self.log_odds, -700, 700)
        return 1 / (1 + np.exp(-odds))


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant | float:
    """From counts, sums and sums of products per class; a constant score if a class has fewer than two rows."""
    if min(n) < 2:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    mean = sums / n[:, None]
    scatter = products - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = np.maximum(np.diag(scatter.sum(axis=0)) / n.sum(), LEAST_VARIANCE)
    inverses, log_dets = [], []
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * scatter[k] / n[k] + shrinkage * np.diag(pooled))
        inverses.append(np.linalg.inv(factor))
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(mean, np.stack(inverses), np.array(log_dets), float(np.log(n[1] / n[0])))


def moments(rows: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products of the features for labels 0 and 1."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    got = (
        rows.where(F.col(label).isin(0, 1))
        .groupBy(F.col(label).cast("int").alias("label"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(f).alias(f"s{k}") for k, f in enumerate(FEATURES)],
            *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs],
        )
        .collect()
    )
    n, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in got:
        k = r["label"]
        n[k] = r["n"]
        sums[k] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            products[k, i, j] = products[k, j, i] = r[f"p{i}_{j}"]
    return n, sums, products


def scorer(model: Discriminant | float):
    @F.arrow_udf(T.DoubleType())
    def run(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
        return pa.array(np.full(len(x), model) if isinstance(model, float) else model.scores(x))

    return run


def scored(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    folds: int = FOLDS, threshold: float = THRESHOLD, shrinkage: float = SHRINKAGE,
) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier) and predicted per row of ``docs``.

    Learns from all labelled rows outside the held-out fold.  Null texts count as
    empty and are scored; rows with a null id are scored and teach nothing; labels
    other than 0 and 1 are not used, and an id labelled twice teaches twice; with
    fewer than two rows of a class the score is the share of label 1 (0.5 without
    labels).  Other columns are not read.
    """
    counted = docs.select(F.col(doc_id).alias("doc_id"), text_stats(as_bytes(text)).alias("s_"))
    rows = stored(
        counted.select("doc_id", (crc_fold("doc_id", folds) == 0).alias("held_out"), *[c.alias(n) for n, c in features().items()]),
        "features",
    )
    taught = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label_"))
    model = discriminant(*moments(rows.where(~F.col("held_out")).join(taught, "doc_id"), "label_"), shrinkage)
    score = scorer(model)(*[F.col(f) for f in FEATURES])
    return rows.select("doc_id", "held_out", score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
