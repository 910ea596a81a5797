"""Array columns of doubles as feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_array(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def as_doubles(array_col: str) -> Column:
    return F.col(array_col).cast("array<double>")


def with_ml_vector(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(as_array(features)))


def spread(df: DataFrame, array_col: str, names: Sequence[str]) -> DataFrame:
    """One column per array element, replacing the array."""
    kept = [c for c in df.columns if c != array_col]
    return df.select(*kept, *[F.col(array_col)[i].alias(n) for i, n in enumerate(names)])


def present(column: str | Column) -> Column:
    """The value as DOUBLE with NaN read as missing."""
    c = F.col(column) if isinstance(column, str) else column
    c = c.cast("double")
    return F.when(~F.isnan(c), c)
