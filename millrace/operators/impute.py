"""Filling missing values with a statistic of the column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.ordering import exact_quantiles, long_form
from millrace.functions.vectors import present


@dataclass(frozen=True)
class Filling:
    values: dict[str, float | None]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: F.coalesce(present(c), F.lit(v).cast("double")) for c, v in self.values.items()}
        )


def fit_median(df: DataFrame, cols: Sequence[str]) -> Filling:
    return Filling({c: q[0] for c, q in exact_quantiles(df, cols, [0.5]).items()})


def fit_most_frequent(df: DataFrame, cols: Sequence[str]) -> Filling:
    """The commonest value; the smallest of equally common ones."""
    counts = long_form(df, cols).groupBy("attribute", "x").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("attribute").agg(F.max(F.struct("n", (-F.col("x")).alias("neg"))).alias("top"))
    found = {r["attribute"]: -r["top"]["neg"] for r in best.collect()}
    return Filling({c: found.get(c) for c in cols})


def fit_none(df: DataFrame, cols: Sequence[str]) -> Filling:
    return Filling({c: None for c in cols})


STRATEGIES = {"median": fit_median, "most_frequent": fit_most_frequent, "": fit_none}


def impute(df: DataFrame, cols: Sequence[str], strategy: str) -> DataFrame:
    return STRATEGIES[strategy](df, cols).transform(df)
