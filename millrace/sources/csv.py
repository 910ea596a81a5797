"""Delimited text in the layouts the data sets and result tables come in."""

from __future__ import annotations

import csv as _csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_two_header_csv(spark: SparkSession, path: str, header_file: str | None = None) -> DataFrame:
    """A table whose first line holds group titles and whose second one the names.

    Columns come as text.  Both header lines are recognised by their content, so
    they may repeat at the top of every file of a directory.
    """
    lines = spark.read.text(header_file or path).limit(2).collect()
    titles, names = (next(_csv.reader([r["value"]])) for r in lines)
    # every cell is tested lazily: a header line equals it in all filled cells
    table = spark.read.schema(_text_schema(names)).csv(path, header=False, sep=",")

    def is_line(cells: Sequence[str]) -> Column:
        out = F.lit(True)
        for n, cell in zip(names, list(cells) + [""] * len(names)):
            out = out & F.col(f"`{n}`").eqNullSafe(F.lit(cell or None))
        return out

    return table.where(~is_line(titles) & ~is_line(names))


def read_headerless_csv(spark: SparkSession, path: str, columns: int, schema: T.StructType | None = None) -> DataFrame:
    """A table without header; columns are named by position."""
    names = [str(i) for i in range(columns)]
    return spark.read.schema(schema or _text_schema(names)).csv(path, header=False, sep=",").toDF(*names)


def _results(spark: SparkSession, path: str, schema: T.StructType | str | None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A result table with header; the first column is the row index."""
    table = _results(spark, path, schema)
    return table.withColumnRenamed(table.columns[0], "index")


def read_results_per_run(
    spark: SparkSession, directory: str, log_file: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """The result table of every sub-directory, with the directory name as ``run``."""
    table = _results(spark, f"{directory}/*/{log_file}", schema)
    # a table written by Spark is a directory of part files, one level deeper
    parts = F.split(F.col("_metadata.file_path"), "/")
    above = F.element_at(parts, -2)
    run = F.url_decode(F.when(above == F.lit(log_file), F.element_at(parts, -3)).otherwise(above))
    return table.select(run.alias("run"), *table.columns).withColumnRenamed(table.columns[0], "index")


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
