"""Cleaning, projection and profiling of raw tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.ordering import exact_quantiles, group_bounds, order_statistics


def sentinel_to_null(df: DataFrame, marker: str = "na") -> DataFrame:
    """Text cells equal to the marker become NULL in every column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(F.col(c) != marker, F.col(c)) for c in texts}) if texts else df


def text_to_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """DOUBLE columns; text that is no number becomes NULL instead of failing."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols}) if cols else df


def label_to_boolean(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, F.col(label) != 0)


def label_to_int(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, F.col(label).cast("int"))


def name_last_column(df: DataFrame, name: str = "class") -> DataFrame:
    return df.withColumnRenamed(df.columns[-1], name)


def features_of(df: DataFrame, row_id: str, label: str) -> DataFrame:
    return df.drop(label).select(row_id, *[c for c in df.columns if c not in (row_id, label)])


def label_of(df: DataFrame, row_id: str, label: str) -> DataFrame:
    return df.select(row_id, label)


def keep_columns(df: DataFrame, mask: Sequence[bool]) -> DataFrame:
    return df.select(*[c for c, keep in zip(df.columns, mask, strict=True) if keep])


def drop_columns(df: DataFrame, dropped: Sequence[str]) -> DataFrame:
    return df.drop(*dropped)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def head_fraction(df: DataFrame, row_id: str, fraction: float = 0.10) -> DataFrame:
    """The first ``int(fraction * n)`` rows in key order.

    Found as a key range, so it stays a pushed-down filter and no task sorts or
    holds the head.
    """
    keyed = df.select(F.lit(0).alias("g"), F.col(row_id).alias("v"))
    bounds = group_bounds(keyed, "g", "v")
    n = int(bounds[0].n * fraction) if bounds else 0
    if n == 0:
        return df.limit(0)
    cut = order_statistics(keyed, "g", "v", bounds, {0: [n - 1]})[(0, n - 1)].value
    return df.where(F.col(row_id) <= F.lit(cut))


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None, top: int | None = 10) -> DataFrame:
    """Missing count and fraction per column, largest fraction first."""
    names = list(cols or df.columns)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def missing(c):
        return (F.col(c).isNull() | F.isnan(c)) if c in floats else F.col(c).isNull()

    one = df.agg(
        F.count(F.lit(1)).alias("n_"),
        *[F.coalesce(F.sum(missing(c).cast("bigint")), F.lit(0)).alias(c) for c in names],
    )
    out = one.unpivot(["n_"], names, "attribute", "n_missing").select(
        "attribute", "n_missing", (F.col("n_missing") / F.col("n_")).alias("fraction")
    )
    if top is None:
        return out
    return out.orderBy(F.col("fraction").desc(), "attribute").limit(top)


def total_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Number of missing cells, and of columns with at least one."""
    return missing_profile(df, cols, top=None).agg(
        F.sum("n_missing").alias("n_missing"), F.count_if(F.col("n_missing") > 0).alias("n_columns")
    )


def type_counts(df: DataFrame) -> dict[str, int]:
    out: dict[str, int] = {}
    for _, kind in df.dtypes:
        out[kind] = out.get(kind, 0) + 1
    return out


def frame_profile(df: DataFrame, label: str | None = None) -> DataFrame:
    """(item, measure, value): shape, columns per type, class counts, describe with quartiles."""
    numbers = numeric_columns(df)
    stats = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }
    cells = [("table", "rows", F.count(F.lit(1))), ("table", "columns", F.lit(len(df.columns)))]
    cells.append(("table", "size", F.count(F.lit(1)) * len(df.columns)))
    cells += [("type", kind, F.lit(n)) for kind, n in type_counts(df).items()]
    cells += [(c, name, fn(c)) for c in numbers for name, fn in stats.items()]
    shares = [0.25, 0.5, 0.75]
    quartiles = exact_quantiles(df, numbers, shares) if numbers else {}
    cells += [(c, f"{share:.0%}", F.lit(q)) for c in numbers for share, q in zip(shares, quartiles[c])]
    one = df.agg(*[cell.cast("double").alias(f"c{i}") for i, (_, _, cell) in enumerate(cells)])
    out = one.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(item).alias("item"), F.lit(m).alias("measure"), F.col(f"c{i}").alias("value"))
                    for i, (item, m, _) in enumerate(cells)
                ]
            )
        ).alias("s")
    ).select("s.*")
    if label is None:
        return out
    classes = df.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return out.unionByName(
        classes.select(F.lit("class").alias("item"), F.col(label).cast("string").alias("measure"), "value")
    )


def density(df: DataFrame, cols: Sequence[str], bandwidth: float, lo: float, hi: float, points: int) -> DataFrame:
    """Gaussian kernel density of each column on an even grid (absolute bandwidth).

    Every row adds to each grid point; the partial aggregation keeps the shuffle
    at (columns x grid points) rows per task.
    """
    step = (hi - lo) / (points - 1)
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo + i * step).alias("x")) for i in range(points)])
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "attribute", "v")
    z = (F.col("p.x") - F.col("v")) / F.lit(float(bandwidth))
    kernel = F.exp(-0.5 * z * z) / F.lit(bandwidth * (2.0 * 3.141592653589793) ** 0.5)
    return (
        long.where(F.col("v").isNotNull())
        .withColumn("p", F.explode(grid))
        .groupBy("attribute", F.col("p.i").alias("point"), F.col("p.x").alias("x"))
        .agg(F.avg(kernel).alias("density"))
    )


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
