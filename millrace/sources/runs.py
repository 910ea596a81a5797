"""Run records: one configuration and one set of metrics per run, as JSON."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_TABULATED = "dropedCols"


def write_records(spark: SparkSession, records: Mapping[str, Mapping], path: str) -> None:
    """Appends one JSON object per run, in a folder per run."""
    rows = [(run, json.dumps(record)) for run, record in records.items()]
    spark.createDataFrame(rows, "run string, value string").write.mode("append").partitionBy("run").text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Appends metric rows as JSON, in a folder per ``run``."""
    df.write.mode("append").partitionBy("run").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Keys missing in some runs come as NULL."""
    return spark.read.json(path).withColumn("run", F.col("run").cast("string"))


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns are replaced by their fields; the parent name is lost."""
    names: list[str] = []
    cells = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            names += f.dataType.names
            cells += [F.col(f"`{f.name}`.`{n}`").alias(n) for n in f.dataType.names]
        else:
            names.append(f.name)
            cells.append(F.col(f"`{f.name}`"))
    clashes = [n for n, c in Counter(names).items() if c > 1]
    if clashes:
        raise ValueError(f"flattening would give several columns named {clashes}")
    return df.select(*cells)


def unify(configs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per run: flattened configuration and metrics, metrics winning on equal names.

    A run that has only one of the two keeps its row, the other's columns NULL.
    """
    metrics = metrics.drop(NOT_TABULATED)
    own = [c for c in flatten(configs).columns if c == "run" or (c not in metrics.columns and c != NOT_TABULATED)]
    return flatten(configs).select(*own).join(metrics, "run", "full")


def as_text_cells(df: DataFrame) -> DataFrame:
    """List cells as JSON text, so that the table fits a CSV file."""
    return df.select(
        *[
            F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def unify_to_csv(spark: SparkSession, config_path: str, metric_path: str, out: str) -> DataFrame:
    table = unify(read_records(spark, config_path), read_records(spark, metric_path))
    as_text_cells(table).write.mode("overwrite").option("header", True).csv(out)
    return table
