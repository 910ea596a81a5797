"""Rescaling: statistics from one table, applied to any table with the same columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.ordering import exact_quantiles
from millrace.functions.vectors import present


@dataclass(frozen=True)
class Scaling:
    """x -> (x - centre) / spread; a spread of zero counts as one."""

    centre: dict[str, float | None]
    spread: dict[str, float | None]

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, centre in self.centre.items():
            spread = self.spread[c] or 1.0
            out[c] = (present(c) - F.lit(centre).cast("double")) / F.lit(float(spread))
        return df.withColumns(out)


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> Scaling:
    row = df.agg(
        *[F.min(present(c)).alias(f"lo_{c}") for c in cols], *[F.max(present(c)).alias(f"hi_{c}") for c in cols]
    ).first()
    lo = {c: row[f"lo_{c}"] for c in cols}
    return Scaling(lo, {c: None if lo[c] is None else row[f"hi_{c}"] - lo[c] for c in cols})


def fit_standard(df: DataFrame, cols: Sequence[str]) -> Scaling:
    """Mean and population standard deviation."""
    row = df.agg(
        *[F.avg(present(c)).alias(f"m_{c}") for c in cols],
        *[F.stddev_pop(present(c)).alias(f"s_{c}") for c in cols],
    ).first()
    return Scaling({c: row[f"m_{c}"] for c in cols}, {c: row[f"s_{c}"] for c in cols})


def fit_robust(df: DataFrame, cols: Sequence[str]) -> Scaling:
    """Median and interquartile range."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    return Scaling(
        {c: q[c][1] for c in cols}, {c: None if q[c][1] is None else q[c][2] - q[c][0] for c in cols}
    )


RESCALERS = {"normalize": fit_minmax, "standardize": fit_standard, "standardizeRobust": fit_robust}


def rescale(train: DataFrame, cols: Sequence[str], rescaler: str, *others: DataFrame) -> list[DataFrame]:
    """Fits on the first table and transforms it and all the others."""
    scaling = RESCALERS[rescaler](train, cols)
    return [scaling.transform(t) for t in (train, *others)]
