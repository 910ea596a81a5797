"""Feature tables derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.spec import TableSpec


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Orders: the price of orders of unspecified priority counts as unknown.
ORDERS = TableSpec("row_id", ("price", "month", "day", "priority"), "label")
ORDERS_SQL = """orders_f AS (
  SELECT o_orderkey AS row_id, o_orderstatus AS label,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END AS price,
         CAST(month(o_orderdate) AS DOUBLE) AS month, CAST(day(o_orderdate) AS DOUBLE) AS day,
         CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority
  FROM orders)"""


def orders_features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderstatus").alias("label"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_totalprice")).alias("price"),
        F.month("o_orderdate").cast("double").alias("month"),
        F.dayofmonth("o_orderdate").cast("double").alias("day"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
    )


# Orders with the median put in for unknown prices.
FILLED_SQL = (
    ORDERS_SQL
    + """, filled AS (
  SELECT row_id, label, coalesce(price, (SELECT median(price) FROM orders_f)) AS price, month, day, priority
  FROM orders_f)"""
)

# Labelled documents with counts of their whole text.
DOCS = TableSpec("row_id", ("n_chars", "n_spaces", "n_digits", "n_lines"), "quality")
DOCS_SQL = """docs_f AS (
  SELECT l.doc_id AS row_id, l.quality, l.toxic, CAST(d.n_chars AS DOUBLE) AS n_chars,
         CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) AS n_spaces,
         CAST(length(d.text) - length(regexp_replace(d.text, '[0-9]', '', 'g')) AS DOUBLE) AS n_digits,
         CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS DOUBLE) AS n_lines
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def doc_features(spark: SparkSession, sf: str) -> DataFrame:
    length = F.char_length("text")
    # counted before the join: texts are neither shuffled nor sorted, only four numbers of each
    counts = table(spark, sf, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        (length - F.char_length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("n_spaces"),
        (length - F.char_length(F.regexp_replace("text", "[0-9]", ""))).cast("double").alias("n_digits"),
        (length - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("double").alias("n_lines"),
    )
    labels = table(spark, sf, "labels").join(counts, "doc_id")
    return labels.select(F.col("doc_id").alias("row_id"), "quality", "toxic", *DOCS.features)


EMBEDDING_DIMS = 64
EMB_SQL = "emb AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


EMB_FEATURES = tuple(f"x{i}" for i in range(EMBEDDING_DIMS))
EMB = TableSpec("row_id", EMB_FEATURES, "label")
EMB_WIDE_SQL = (
    "emb_wide AS (SELECT vec_id AS row_id, label, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(EMBEDDING_DIMS))
    + " FROM embeddings)"
)


def embeddings_wide(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        "label",
        *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(EMB_FEATURES)],
    )


# Event types a user produced on a day: the items of one transaction.
BASKETS_SQL = """baskets AS (
  SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, event_type AS item FROM events)"""


def baskets(spark: SparkSession, sf: str) -> DataFrame:
    # a set of event types stays as small as the number of types, however many events meet in it
    return (
        table(spark, sf, "events")
        .groupBy("user_id", F.col("ts").cast("date").alias("d"))
        .agg(F.collect_set("event_type").alias("items"))
    )


# Parts with a 0/1 attribute beside two numeric ones.
PARTS = TableSpec("row_id", ("size", "price", "standard"), "brand")
PARTS_SQL = """parts_f AS (
  SELECT p_partkey AS row_id, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price,
         CASE WHEN p_type = 'STANDARD' THEN 1.0 ELSE 0.0 END AS standard, p_brand AS brand
  FROM part)"""


def part_features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"),
        F.when(F.col("p_type") == "STANDARD", 1.0).otherwise(0.0).alias("standard"),
        F.col("p_brand").alias("brand"),
    )


LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_returnflag", *LINE_FEATURES)
