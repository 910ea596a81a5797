"""Document rates whose expected domain totals of tokens match target weights.

A naive Bayes classifier learnt from the labelled table gives every document a
posterior over the domains.  Rates minimise the squared misfit of the expected
domain totals (and, lightly, the distance from one) over nonnegative rates: each
step moves along the misfit's gradient, scaled by the Gram matrix of the documents
whose rate is not zero, and projects on nonnegative rates.  A step is one
aggregation over all documents; only sums over domains reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_side, stored, whole

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}
#: Labelled rows that the classifier learns from, about and at most a few standard deviations more; picked by a hash of the id.
SAMPLE = 20_000
#: Words looked at for each domain: those whose document rate differs most from that of the rest.
WORDS_EACH = 16
#: Documents of the sample that must hold such a word.
LEAST_DF = 5
STEPS = 30
#: Weight of staying near rate one, and the misfit (a share of all tokens) at which the search ends.
PULL, TOLERANCE = 1e-4, 1e-9


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 1, "good").when(F.col(quality) == 0, "poor")


def _measured(rows: DataFrame, text: Column, *carried: Column) -> DataFrame:
    """carried, n_tokens, words_ (distinct) and x0..x2, the measures that the classifier takes for normal."""
    split = rows.select(*carried, F.length(text).alias("chars_"), F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), "").alias("all_"))
    split = split.withColumn("words_", F.array_distinct("all_"))
    n, chars = F.size("all_").cast("double"), F.col("chars_").cast("double")
    return split.withColumns(
        {
            "n_tokens": F.size("all_").cast("bigint"),
            "x0": F.log1p(n),
            "x1": F.log1p(chars / F.greatest(n, F.lit(1.0))),
            "x2": F.log1p(F.size("words_").cast("double")) / F.log1p(F.greatest(n, F.lit(1.0)) + 1),
        }
    ).drop("chars_", "all_")


MEASURES = ("x0", "x1", "x2")


class Classifier:
    """Naive Bayes: presence of chosen words and normal measures, by domain."""

    def __init__(self, prior: np.ndarray, words: Mapping[str, np.ndarray], mean: np.ndarray, variance: np.ndarray) -> None:
        self.prior, self.words, self.mean, self.variance = prior, words, mean, variance

    def posteriors(self) -> list[Column]:
        """A column for each domain, from words_ and the measures."""
        k = len(self.prior)
        constant = np.log(self.prior) - 0.5 * np.log(self.variance).sum(axis=1)
        logs: list[Column] = []
        if self.words:
            constant = constant + sum(np.log1p(-p) for p in self.words.values())
            gain = {w: np.log(p) - np.log1p(-p) for w, p in self.words.items()}
            table = F.create_map(*[x for w, g in gain.items() for x in (F.lit(w), F.struct(*[F.lit(float(v)).alias(f"g{i}") for i, v in enumerate(g)]))])
            present = F.array_intersect("words_", F.array(*[F.lit(w) for w in gain]))
            zero = F.struct(*[F.lit(0.0).alias(f"g{i}") for i in range(k)])
            met = F.aggregate(
                F.transform(present, lambda w: table[w]),
                zero,
                lambda a, g: F.struct(*[(a[f"g{i}"] + g[f"g{i}"]).alias(f"g{i}") for i in range(k)]),
            )
        for i in range(k):
            c = F.lit(float(constant[i]))
            for j, x in enumerate(MEASURES):
                c = c - F.pow(F.col(x) - F.lit(float(self.mean[i, j])), 2) / F.lit(float(2 * self.variance[i, j]))
            logs.append(c + F.col("met_")[f"g{i}"] if self.words else c)
        self.met = met if self.words else F.lit(None)
        return logs


def learn(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, sample: int) -> Classifier | None:
    """The classifier, or None without a labelled document."""
    named = labels.select(F.col(doc_id).alias("id_"), domain_of().alias("domain_")).where(
        F.col("id_").isNotNull() & F.col("domain_").isNotNull()
    )
    share = min(1.0, sample / max(named.count(), 1))
    picked = named.where(F.pmod(F.xxhash64("id_"), F.lit(1 << 20)) < int(share * (1 << 20)))
    taught = docs.select(F.col(doc_id).alias("id_"), whole(text).alias("text_")).join(small_side(picked), "id_")
    rows = stored(_measured(taught, F.col("text_"), F.col("domain_")), "taught")
    sums = {
        r["domain_"]: r
        for r in rows.groupBy("domain_")
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m_{x}") for x in MEASURES], *[F.var_pop(x).alias(f"v_{x}") for x in MEASURES])
        .collect()
    }
    if not sums:
        return None
    n = np.array([sums[d]["n"] if d in sums else 0 for d in DOMAINS], float)
    mean = np.array([[sums[d][f"m_{x}"] if d in sums else 0.0 for x in MEASURES] for d in DOMAINS])
    variance = np.array([[sums[d][f"v_{x}"] if d in sums else 1.0 for x in MEASURES] for d in DOMAINS]) + 1e-3
    spread = rows.select("domain_", F.explode("words_").alias("word")).groupBy("word")
    counts = spread.agg(F.count(F.lit(1)).alias("df"), *[F.count(F.when(F.col("domain_") == d, 1)).alias(d) for d in DOMAINS])
    counts = stored(counts.where(F.col("df") >= LEAST_DF), "wordcounts")
    words: dict[str, np.ndarray] = {}
    for k, d in enumerate(DOMAINS):
        if not 0 < n[k] < n.sum():
            continue
        differ = F.abs(F.col(d) / F.lit(n[k]) - (F.col("df") - F.col(d)) / F.lit(n.sum() - n[k]))
        for r in counts.orderBy(differ.desc(), "word").limit(WORDS_EACH).collect():
            words[r["word"]] = (np.array([r[x] for x in DOMAINS]) + 0.5) / (n + 1)
    return Classifier((n + 1) / (n + 1).sum(), words, mean, variance)


def posteriors(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, sample: int) -> DataFrame:
    """doc_id, n_tokens and p_<domain> per row of ``docs``."""
    model = learn(docs, labels, doc_id, text, sample)
    rows = _measured(docs, whole(text), F.col(doc_id).alias("doc_id"))
    if model is None:
        return rows.select("doc_id", "n_tokens", *[F.lit(1 / len(DOMAINS)).alias(f"p_{d}") for d in DOMAINS])
    logs = model.posteriors()
    rows = rows.withColumn("met_", model.met).select("doc_id", "n_tokens", *[c.alias(f"l_{d}") for c, d in zip(logs, DOMAINS)])
    top = F.greatest(*[F.col(f"l_{d}") for d in DOMAINS])
    rows = rows.select("doc_id", "n_tokens", *[F.exp(F.col(f"l_{d}") - top).alias(f"e_{d}") for d in DOMAINS])
    total = sum((F.col(f"e_{d}") for d in DOMAINS[1:]), F.col(f"e_{DOMAINS[0]}"))
    return rows.select("doc_id", "n_tokens", *[(F.col(f"e_{d}") / total).alias(f"p_{d}") for d in DOMAINS])


def rate(z: np.ndarray) -> Column:
    """max(0, 1 + p . z)"""
    c = F.lit(1.0)
    for d, v in zip(DOMAINS, z):
        c = c + F.col(f"p_{d}") * F.lit(float(v))
    return F.greatest(c, F.lit(0.0))


def fit(rows: DataFrame, target: np.ndarray, pull: float = PULL, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(z, misfit by domain as a share of all tokens) for shares ``target`` of all tokens.

    Raises if the misfit's gradient does not vanish in ``steps`` steps.
    """
    k = len(DOMAINS)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    p = [F.col(f"p_{d}") for d in DOMAINS]

    def look(z: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        r, n = F.col("r_"), F.col("n_tokens").cast("double")
        got = rows.withColumn("r_", rate(z)).agg(
            F.sum(n).alias("n"),
            F.sum(n * r * r).alias("q"),
            *[F.sum(n * r * p[i]).alias(f"a{i}") for i in range(k)],
            *[F.sum(F.when(r > 0, n * p[i] * p[j])).alias(f"m{i}_{j}") for i, j in pairs],
        ).first()
        n = got["n"] or 0.0
        if not n:
            return 0.0, np.zeros(k), np.eye(k), 0.0
        gram = np.zeros((k, k))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = (got[f"m{i}_{j}"] or 0.0) / n
        misfit = np.array([got[f"a{i}"] / n for i in range(k)]) - target
        value = 0.5 * got["q"] / n - z @ target + 0.5 * pull * z @ z
        return n, misfit, gram, value

    z = np.zeros(k)
    n, misfit, gram, value = look(z)
    if not n:
        return z, misfit
    for _ in range(steps):
        gradient = misfit + pull * z
        if np.abs(gradient).max() <= tolerance:
            return z, misfit
        step = np.linalg.solve(gram + pull * np.eye(k), gradient)
        size = 1.0
        while True:
            n, misfit_, gram_, value_ = look(z - size * step)
            if value_ <= value - 1e-4 * size * gradient @ step + 1e-13 or size < 1e-3:
                break
            size /= 2
        z, misfit, gram, value = z - size * step, misfit_, gram_, value_
    if np.abs(misfit + pull * z).max() > 1e3 * tolerance:
        raise RuntimeError(f"rates did not settle in {steps} steps: misfit {misfit.tolist()}")
    return z, misfit


def mixed(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    targets: Mapping[str, float] = TARGETS, sample: int = SAMPLE,
) -> DataFrame:
    """doc_id, n_tokens, p_<domain> and rate per row of ``docs``.

    ``targets`` are weights of the domains good, poor and toxic; they are taken as
    shares of the documents' tokens.  Null texts count as empty: no tokens, but a
    posterior and a rate; repeated rows and null ids are rows like others; labels
    that are null teach nothing; without labels all posteriors are equal; an empty
    table gives no rows.  Other columns are not read.
    """
    weights = np.array([float(targets.get(d, 0.0)) for d in DOMAINS])
    if (weights < 0).any() or not math.isfinite(weights.sum()) or weights.sum() <= 0:
        raise ValueError("target weights must be nonnegative, one of them positive")
    rows = stored(posteriors(docs, labels, doc_id, text, sample), "posteriors")
    z, _ = fit(rows, weights / weights.sum())
    return rows.withColumn("rate", rate(z))
