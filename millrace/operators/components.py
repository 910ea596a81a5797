"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.ordering import join_unique
from millrace.session import cut_lineage

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable from each node of (u, v).

    Alternates two local steps (attach larger neighbours to the smallest one,
    then smaller neighbours) until the edges no longer change; each round is an
    aggregation and a join, hubs included, and is checkpointed.
    """
    current = cut_lineage(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = _mark(current)
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            join_unique(both, _lowest(both), ["u"], "n", at_most=2 * mark[0])
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        large = cut_lineage(large)
        low = _lowest(large)
        small = (
            join_unique(large, low, ["u"], "n", at_most=2 * mark[0])
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        current = cut_lineage(small)
        now = _mark(current)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
