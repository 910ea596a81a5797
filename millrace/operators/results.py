"""Tables behind the plots: series, box summaries, best points, column pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ordering import grouped_quantiles, join_unique
from millrace.operators.clean import numeric_columns


def series(results: DataFrame, x: str | None, ys: Sequence[str], run: str = "run") -> DataFrame:
    """Each run's rows by ascending x with the chosen measures.

    Without x the rows of a run are numbered from 0 in the order they stand in,
    as column ``index``; a run holds few rows.
    """
    if x is None:
        numbered = results.withColumn("at_", F.monotonically_increasing_id())
        index = F.row_number().over(Window.partitionBy(run).orderBy("at_")) - 1
        results, x = numbered.withColumn("index", index.cast("bigint")), "index"
    return results.select(run, x, *ys).orderBy(run, x)


def parse_list(column: str) -> F.Column:
    """List text as doubles; a missing entry stays missing."""
    return F.from_json(F.col(column).cast("string"), "array<double>")


def box_values(results: DataFrame, x: str, y: str, run: str = "run") -> DataFrame:
    """(run, x, value) of a column holding lists as text."""
    return results.select(run, x, F.explode(parse_list(y)).alias("value")).where(F.col("value").isNotNull())


def box_summary(values: DataFrame, keys: Sequence[str], value: str = "value", hot_rows: int = 1_000_000) -> DataFrame:
    """Quartiles and whiskers (the extremes within 1.5 interquartile ranges) per key."""
    keys = list(keys)
    q = grouped_quantiles(values, keys, value, [0.25, 0.5, 0.75], hot_rows)
    q = q.select(*keys, "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - fence, F.col("q3") + fence)
    return (
        join_unique(values, q, keys, "n", hot_rows)
        .groupBy(*keys)
        .agg(
            F.min(F.when(inside, F.col(value))).alias("low"),
            *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
            F.max(F.when(inside, F.col(value))).alias("high"),
        )
    )


def best_points(results: DataFrame, y0: str, y1: str, run: str = "run") -> DataFrame:
    """Distance of (y0, y1) from the origin; the three farthest of a run are best, two more second.

    The fifth distance of each run is enough to flag every row, so only those
    few values are ordered, not the run.
    """
    distance = F.sqrt(F.col(y0) * F.col(y0) + F.col(y1) * F.col(y1))
    with_distance = results.withColumn("distance", distance)
    first = Window.partitionBy(run).orderBy(F.col("distance").desc())
    top = (
        with_distance.select(run, "distance")
        .withColumn("n_", F.row_number().over(first))
        .where(F.col("n_") <= 5)
        .groupBy(run)
        .agg(
            F.min(F.when(F.col("n_") <= 3, F.col("distance"))).alias("third_"),
            F.min("distance").alias("fifth_"),
        )
    )
    place = F.when(F.col("distance") >= F.col("third_"), F.lit("best")).when(
        F.col("distance") >= F.col("fifth_"), F.lit("second")
    )
    return with_distance.join(top, run).withColumn("place", F.coalesce(place, F.lit(""))).drop("third_", "fifth_")


def point_table(results: DataFrame, y0: str, y1: str, label: str, run: str = "run") -> DataFrame:
    """(run, x, y, label), a series per row when labels are given per row."""
    return results.select(run, F.col(y0).alias("x"), F.col(y1).alias("y"), F.col(label).cast("string").alias("label"))


def column_pairs(df: DataFrame, row_id: str, cols: Sequence[str] | None = None) -> DataFrame:
    """(row_id, col_i, col_j, x, y) for all numeric column pairs i < j, made within the row."""
    cols = list(cols or [c for c in numeric_columns(df) if c != row_id])
    cells = [
        F.struct(
            F.lit(a).alias("col_i"),
            F.lit(b).alias("col_j"),
            F.col(a).cast("double").alias("x"),
            F.col(b).cast("double").alias("y"),
        )
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    ]
    return df.select(row_id, F.explode(F.array(*cells)).alias("p")).select(row_id, "p.*")
