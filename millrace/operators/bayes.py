"""Gaussian naive Bayes from additive class moments.

Counts, means and variances of disjoint parts of a table pool exactly, so one
grouped aggregation serves every fold, every training size and every bootstrap
replicate; scoring is plain arithmetic inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTHING = 1e-9
GENERATED_TERMS = 200


@dataclass(frozen=True)
class Moments:
    label: object
    part: tuple
    weight: float
    mean: tuple[float, ...]
    var: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]


def class_moments(
    df: DataFrame, features: Sequence[str], label: str, parts: Sequence[str] = (), weight: str | None = None
) -> list[Moments]:
    """Moments per (parts, class); features must not be missing."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = [F.sum(w).alias("w_")]
    # weighted sums of squares lose digits far from zero, so they are taken about the mean
    about = df.agg(*[F.avg(f).alias(f) for f in features]).first() if weight else {}
    for f in features:
        x = F.col(f).cast("double")
        if weight:
            moved = x - F.lit(float(about[f] or 0.0))
            centre = F.sum(w * moved) / F.sum(w)
            mean = centre + F.lit(float(about[f] or 0.0))
            var = F.sum(w * moved * moved) / F.sum(w) - centre * centre
        else:
            mean, var = F.avg(x), F.var_pop(x)
        cells.append(F.struct(mean.alias("m"), var.alias("v"), F.min(x).alias("lo"), F.max(x).alias("hi")).alias(f))
    rows = df.where(F.col(label).isNotNull()).groupBy(*parts, label).agg(*cells).collect()
    return [
        Moments(
            r[label],
            tuple(r[p] for p in parts),
            float(r["w_"]),
            tuple(r[f]["m"] for f in features),
            tuple(max(0.0, r[f]["v"]) for f in features),
            tuple(r[f]["lo"] for f in features),
            tuple(r[f]["hi"] for f in features),
        )
        for r in rows
        if r["w_"]
    ]


def _pooled(parts: Sequence[Moments], d: int) -> tuple[float, list[float], list[float]]:
    n = sum(p.weight for p in parts)
    mean = [sum(p.weight * p.mean[j] for p in parts) / n for j in range(d)]
    var = [sum(p.weight * (p.var[j] + (p.mean[j] - mean[j]) ** 2) for p in parts) / n for j in range(d)]
    return n, mean, var


def _sum(terms: Sequence[str]) -> str:
    # balanced, so that wide sums do not nest deeply
    if len(terms) == 1:
        return terms[0]
    half = len(terms) // 2
    return f"({_sum(terms[:half])} + {_sum(terms[half:])})"


@dataclass(frozen=True)
class GaussianModel:
    features: tuple[str, ...]
    classes: tuple
    log_prior: tuple[float, ...]
    mean: tuple[tuple[float, ...], ...]
    var: tuple[tuple[float, ...], ...]

    def log_likelihoods(self) -> list[str]:
        """One SQL expression per class."""
        out = []
        for prior, means, variances in zip(self.log_prior, self.mean, self.var):
            const = prior - 0.5 * sum(math.log(2.0 * math.pi * v) for v in variances)
            terms = [f"{const!r}D"]
            for f, m, v in zip(self.features, means, variances):
                terms.append(f"({-0.5 / v!r}D * (`{f}` - ({m!r}D)) * (`{f}` - ({m!r}D)))")
            out.append(_sum(terms))
        return out

    def _scores(self) -> str:
        """SQL for the likelihoods of all classes, NULL where a feature is missing."""
        total = _sum([f"CAST(`{f}` AS DOUBLE)" for f in self.features])
        return f"IF(isnan({total}), NULL, array({', '.join(self.log_likelihoods())}))"

    def class_index(self) -> str:
        """SQL for the 0-based most likely class, the first one when equal."""
        scores = self._scores()
        return f"CAST(array_position({scores}, array_max({scores})) - 1 AS INT)"

    @property
    def wide(self) -> bool:
        # beyond this many terms the generated code no longer compiles
        return len(self.classes) * len(self.features) > GENERATED_TERMS

    def _vectorised(self, reduce: Callable[[np.ndarray], list], kind: str) -> Column:
        """Scores whole Arrow batches of rows."""
        prior, mean, var = np.array(self.log_prior), np.array(self.mean), np.array(self.var)
        const = prior - 0.5 * np.log(2.0 * np.pi * var).sum(axis=1)

        @F.pandas_udf(kind)
        def scored(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
            known = ~np.isnan(x).any(axis=1)
            logs = np.column_stack([k - 0.5 * ((x[known] - m) ** 2 / v).sum(axis=1) for k, m, v in zip(const, mean, var)])
            out = np.full(len(x), None, dtype=object)
            for at, value in zip(np.flatnonzero(known), reduce(logs) if known.any() else []):
                out[at] = value
            return pd.Series(out)

        return scored(*[F.col(f).cast("double") for f in self.features])

    def prediction(self) -> Column:
        index = self._vectorised(lambda logs: logs.argmax(axis=1), "int") if self.wide else F.expr(self.class_index())
        return F.get(F.array(*[F.lit(c) for c in self.classes]), index)

    def probabilities(self) -> Column:
        if self.wide:

            def shares(logs):
                e = np.exp(logs - logs.max(axis=1, keepdims=True))
                return list(e / e.sum(axis=1, keepdims=True))

            return self._vectorised(shares, "array<double>")
        logs = F.expr(self._scores())
        known = F.forall(logs, lambda x: x.isNotNull())
        shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
        total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
        return F.when(known, F.transform(shifted, lambda x: x / total))


def model_from(moments: Iterable[Moments], features: Sequence[str], rescaled: bool = False) -> GaussianModel:
    """Pools the moments into a model.

    ``rescaled`` gives the model that min-max scaled features would give; scaling
    only matters for the smoothing term, so the rows themselves stay as they are.
    """
    moments = list(moments)
    d = len(features)
    n, _, total_var = _pooled(moments, d)
    if rescaled:
        spread = [(max(m.high[j] for m in moments) - min(m.low[j] for m in moments)) or 1.0 for j in range(d)]
    else:
        spread = [1.0] * d
    eps = SMOOTHING * max(total_var[j] / spread[j] ** 2 for j in range(d)) or SMOOTHING
    classes = sorted({m.label for m in moments})
    prior, means, variances = [], [], []
    for c in classes:
        weight, mean, var = _pooled([m for m in moments if m.label == c], d)
        prior.append(math.log(weight / n))
        means.append(tuple(mean))
        variances.append(tuple(v + eps * spread[j] ** 2 for j, v in enumerate(var)))
    return GaussianModel(tuple(features), tuple(classes), tuple(prior), tuple(means), tuple(variances))


def fit_gaussian(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None) -> GaussianModel:
    return model_from(class_moments(df, features, label, weight=weight), features)


def cross_validated(
    df: DataFrame, features: Sequence[str], label: str, fold: str = "fold", rescaled: bool = False
) -> DataFrame:
    """Adds ``prediction`` of the model fitted on all other folds; one pass fits them all."""
    moments = class_moments(df, features, label, [fold])
    folds = sorted({m.part[0] for m in moments})
    prediction = None
    for f in folds:
        model = model_from([m for m in moments if m.part[0] != f], features, rescaled)
        here = F.col(fold) == F.lit(f)
        prediction = F.when(here, model.prediction()) if prediction is None else prediction.when(here, model.prediction())
    return df.withColumn("prediction", prediction)
