"""Helpers that the corpus operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import new_path, shared_dir

#: Rows of a lookup table that may go to every task.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Written once to the shared folder and read back: read often, and safe from lost executors.

    Columns named last get a folder per value.
    """
    path = new_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a :func:`stored` table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        shared = jvm.org.apache.hadoop.fs.Path(shared_dir(df.sparkSession))
        files = folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
        # never anything but a folder of new_path
        if files.makeQualified(folder.getParent()).equals(files.makeQualified(shared)):
            files.delete(folder, True)


def whole(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def as_bytes(text: str | Column) -> Column:
    return whole(text).cast("binary")


def row_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """128 bits that name a row by its id and text; rows equal in both share them, null ids included."""
    parts = (F.col(doc_id).cast("string"), whole(text))
    tell = F.when(parts[0].isNull(), "-").otherwise("+")
    return (
        F.xxhash64(tell, F.coalesce(parts[0], F.lit("")), parts[1]),
        F.xxhash64(F.lit("second"), parts[1], tell, F.coalesce(parts[0], F.lit(""))),
    )


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, the measure by which work is cut into parts."""
    return docs.agg(F.sum(F.octet_length(whole(text)))).first()[0] or 0


def parts_for(docs: DataFrame, total: int, each: int) -> int:
    """So many parts that none has to hold more than ``each`` bytes, the shuffle's setting at least."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / each), 1)


def small_side(df: DataFrame) -> DataFrame:
    """Marked for broadcast if a count proves it small, else left to a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def crc_fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)
