"""Exact ranks, quantiles and quotas without sorting a whole group in one task.

``percentile``/``median`` keep every distinct value of a group in one buffer and
``row_number`` sorts a whole group in one task.  Both fail on a group that holds
a third of a very large table, so the helpers here work from counts instead:

* ``order_statistics`` narrows a value range around each wanted rank by counting
  rows per equal-width bucket (partial aggregation, no row is shuffled) until the
  range is small, then finishes on that range only;
* ``running_counts`` range-partitions distinct values and adds per-partition
  offsets, a distributed prefix sum.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.hashing import HASH_KEYS
from millrace.functions.vectors import present
from millrace.session import cut_lineage

LEAF_ROWS = 200_000
HISTOGRAM_ROWS = 200_000
MOST_DOUBLE, LEAST_DOUBLE = sys.float_info.max, 5e-324


@dataclass(frozen=True)
class Bounds:
    n: int
    lo: object
    hi: object


@dataclass(frozen=True)
class Found:
    value: object
    rows_up_to: int  # rows whose value is <= value


def group_bounds(df: DataFrame, group: str, value: str) -> dict[object, Bounds]:
    rows = (
        df.where(F.col(value).isNotNull())
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        .collect()
    )
    return {r[group]: Bounds(r["n"], r["lo"], r["hi"]) for r in rows}


def hash_bounds(df: DataFrame, group: str) -> dict[object, Bounds]:
    """Bounds of a row hash per group: only the rows are counted."""
    rows = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r[group]: Bounds(r["n"], 0, HASH_KEYS - 1) for r in rows}


def _offset(value: Column, lo: Column, integral: bool) -> Column:
    # Decimal differences of BIGINT keys neither overflow nor lose low bits; halves of doubles do not overflow.
    if integral:
        return (value.cast("decimal(20,0)") - lo.cast("decimal(20,0)")).cast("double")
    return value.cast("double") / 2 - lo.cast("double") / 2


def _bucket(buckets: int, integral: bool) -> Column:
    """Equal-width bucket of ``v_`` in [lo_, hi_]; infinite values are buckets of their own below and above."""
    lo, hi, value = F.col("lo_"), F.col("hi_"), F.col("v_")
    if not integral:
        lo, hi = F.greatest(lo, F.lit(-MOST_DOUBLE)), F.least(hi, F.lit(MOST_DOUBLE))
    width = F.greatest(_offset(hi, lo, integral) / F.lit(float(buckets)), F.lit(LEAST_DOUBLE))
    inner = F.least(F.lit(float(buckets - 1)), F.floor(_offset(value, lo, integral) / width)).cast("int")
    if integral:
        return inner
    return F.when(value > MOST_DOUBLE, buckets).when(value < -MOST_DOUBLE, -1).otherwise(inner)


def order_statistics(
    df: DataFrame,
    group: str,
    value: str,
    bounds: Mapping[object, Bounds],
    ranks: Mapping[object, Sequence[int]],
    leaf_rows: int = LEAF_ROWS,
) -> dict[tuple[object, int], Found]:
    """The values at the given 0-based ranks of each group, exactly."""
    spark = df.sparkSession
    group_type = df.schema[group].dataType
    value_type = df.schema[value].dataType
    integral = isinstance(value_type, T.IntegralType)
    # a bracket spans [lo, hi] and holds n rows after ``below`` smaller ones
    pending = {
        (g, r): (bounds[g].lo, bounds[g].hi, 0, bounds[g].n) for g, rs in ranks.items() for r in set(rs)
    }
    found: dict[tuple[object, int], Found] = {}
    schema = T.StructType(
        [
            T.StructField("g_", group_type),
            T.StructField("lo_", value_type),
            T.StructField("hi_", value_type),
            T.StructField("span_", T.IntegerType()),
        ]
    )

    def rows_in(spans):
        table = spark.createDataFrame([(g, lo, hi, i) for (g, lo, hi), i in spans.items()], schema)
        # one row per wanted rank, so the broadcast side is bounded by the request
        return (
            df.select(F.col(group).alias("g_"), F.col(value).alias("v_"))
            .join(F.broadcast(table), "g_")
            .where(F.col("v_").between(F.col("lo_"), F.col("hi_")))
        )

    while True:
        for key, (lo, hi, below, n) in list(pending.items()):
            if lo == hi:
                found[key] = Found(lo, below + n)
                del pending[key]
        wide = {}
        for (g, _), (lo, hi, _, n) in pending.items():
            if n > leaf_rows:
                wide.setdefault((g, lo, hi), len(wide))
        if not wide:
            break
        buckets = max(4, min(16_384, HISTOGRAM_ROWS // len(wide)))
        histogram = defaultdict(list)
        for r in (
            rows_in(wide)
            .groupBy("span_", _bucket(buckets, integral).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v_").alias("lo"), F.max("v_").alias("hi"))
            .collect()
        ):
            histogram[r["span_"]].append((r["bucket"], r["n"], r["lo"], r["hi"]))
        for key, (lo, hi, below, n) in list(pending.items()):
            if n <= leaf_rows:
                continue
            for _, count, b_lo, b_hi in sorted(histogram[wide[(key[0], lo, hi)]]):
                if below + count > key[1]:
                    if (b_lo, b_hi) == (lo, hi):
                        raise RuntimeError(f"the range [{lo}, {hi}] does not get narrower")
                    pending[key] = (b_lo, b_hi, below, count)
                    break
                below += count

    if pending:
        spans: dict[tuple, int] = {}
        for (g, _), (lo, hi, _, _) in pending.items():
            spans.setdefault((g, lo, hi), len(spans))
        wanted = [(spans[(g, lo, hi)], r, r - below, below) for (g, r), (lo, hi, below, _) in pending.items()]
        targets = spark.createDataFrame(wanted, "span_ int, rank_ bigint, local_ bigint, below_ bigint")
        w = Window.partitionBy("span_").orderBy("v_")
        leaves = (
            rows_in(spans)
            .groupBy("g_", "span_", "v_")
            .agg(F.count(F.lit(1)).alias("n_"))
            .withColumn("upto_", F.sum("n_").over(w))
        )
        for r in (
            leaves.join(F.broadcast(targets), "span_")
            .where((F.col("upto_") > F.col("local_")) & (F.col("upto_") - F.col("n_") <= F.col("local_")))
            .select("g_", "rank_", "v_", (F.col("upto_") + F.col("below_")).alias("le_"))
            .collect()
        ):
            found[(r["g_"], r["rank_"])] = Found(r["v_"], r["le_"])
    return found


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., attribute, x) with missing values left out."""
    prepared = df.select(*keep, *[present(c).alias(c) for c in cols])
    return prepared.unpivot(list(keep), list(cols), "attribute", "x").where(F.col("x").isNotNull())


def _between(low: float, high: float, share: float) -> float:
    # equal infinities have no difference
    return low if share == 0 or low == high else low + (high - low) * share


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], leaf_rows: int = LEAF_ROWS
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column, NULLs and NaNs skipped."""
    long = long_form(df, cols)
    bounds = group_bounds(long, "attribute", "x")
    ranks = {
        c: sorted({f(p * (b.n - 1)) for p in probs for f in (math.floor, math.ceil)}) for c, b in bounds.items()
    }
    found = order_statistics(long, "attribute", "x", bounds, ranks, leaf_rows)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        if c not in bounds:
            out[c] = [None] * len(probs)
            continue
        values = []
        for p in probs:
            h = p * (bounds[c].n - 1)
            low, high = found[(c, math.floor(h))].value, found[(c, math.ceil(h))].value
            values.append(_between(low, high, h - math.floor(h)))
        out[c] = values
    return out


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], hot_rows: int = 1_000_000
) -> DataFrame:
    """(keys..., n, q): interpolated quantiles of each key's values, as an array.

    A key with at most ``hot_rows`` rows is one small buffer; the few larger ones
    are counted out by rank.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") > hot_rows).collect()

    def of_small(part: DataFrame) -> DataFrame:
        q = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))
        return part.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), q.alias("q"))

    if not hot:
        return of_small(rows)
    key_fields = [df.schema[k] for k in keys]
    # at most (all rows / hot_rows) keys
    numbered = F.broadcast(
        df.sparkSession.createDataFrame(
            [(*[r[k] for k in keys], i) for i, r in enumerate(hot)],
            T.StructType(key_fields + [T.StructField("key_", T.IntegerType())]),
        )
    )
    large = rows.join(numbered, keys).select("key_", F.col(value).cast("double").alias("x"))
    bounds = group_bounds(large, "key_", "x")
    ranks = {g: {f(p * (b.n - 1)) for p in probs for f in (math.floor, math.ceil)} for g, b in bounds.items()}
    found = order_statistics(large, "key_", "x", bounds, {g: sorted(r) for g, r in ranks.items()})
    out = []
    for i, r in enumerate(hot):
        q = []
        for p in probs:
            h = p * (bounds[i].n - 1)
            low, high = found[(i, math.floor(h))].value, found[(i, math.ceil(h))].value
            q.append(_between(low, high, h - math.floor(h)))
        out.append((*[r[k] for k in keys], bounds[i].n, q))
    schema = T.StructType(key_fields + [T.StructField("n", T.LongType()), T.StructField("q", T.ArrayType(T.DoubleType()))])
    small = of_small(rows.join(numbered.select(*keys), keys, "left_anti"))
    return small.unionByName(df.sparkSession.createDataFrame(out, schema))


def smallest_per_group(
    df: DataFrame,
    group: str,
    key: str,
    row_id: str,
    quota: Mapping[object, int],
    leaf_rows: int = LEAF_ROWS,
    hashed: bool = False,
) -> DataFrame:
    """The ``quota[g]`` rows of each group with the smallest (key, row_id).

    Groups missing from ``quota`` and rows without a group are kept whole.  ``hashed`` tells that the key
    is a row hash, whose range is known without reading it.
    """
    bounds = hash_bounds(df, group) if hashed else group_bounds(df, group, key)
    ranks = {g: [q - 1] for g, q in quota.items() if g in bounds and 0 < q < bounds[g].n}
    found = order_statistics(df, group, key, bounds, ranks, leaf_rows)
    schema = T.StructType(
        [
            T.StructField(group, df.schema[group].dataType),
            T.StructField("cut_", df.schema[key].dataType),
            T.StructField("tied_", T.BooleanType()),
            T.StructField("all_", T.BooleanType()),
        ]
    )
    spare: dict[object, int] = {}
    table = []
    for g, b in bounds.items():
        if (g, quota.get(g, b.n) - 1) in found:
            hit = found[(g, quota[g] - 1)]
            tied = hit.rows_up_to != quota[g]
            table.append((g, hit.value, tied, False))
            if tied:
                spare[g] = quota[g]
        else:
            table.append((g, None, False, quota.get(g, b.n) > 0))
    # one row per group value; rows without a group match none and are kept
    marked = df.join(F.broadcast(df.sparkSession.createDataFrame(table, schema)), group, "left")
    marked = marked.withColumns({"all_": F.coalesce("all_", F.lit(True)), "tied_": F.coalesce("tied_", F.lit(False))})
    kept = marked.where(
        F.col("all_") | (F.col(key) < F.col("cut_")) | (~F.col("tied_") & (F.col(key) == F.col("cut_")))
    )
    if spare:
        # equal hash keys at the boundary: only those few rows are ranked
        strictly = {
            r[group]: r["n"]
            for r in marked.where(F.col("tied_") & (F.col(key) < F.col("cut_"))).groupBy(group).agg(
                F.count(F.lit(1)).alias("n")
            ).collect()
        }
        need = [(g, q - strictly.get(g, 0)) for g, q in spare.items()]
        need_df = df.sparkSession.createDataFrame(
            need, T.StructType([schema[group], T.StructField("need_", T.LongType())])
        )
        ties = marked.where(F.col("tied_") & (F.col(key) == F.col("cut_"))).join(F.broadcast(need_df), group)
        ties = ties.withColumn("rn_", F.row_number().over(Window.partitionBy(group).orderBy(row_id)))
        kept = kept.select(*df.columns).unionByName(ties.where(F.col("rn_") <= F.col("need_")).select(*df.columns))
    return kept.select(*df.columns)


def running_counts(counts: DataFrame, group: str, value: str, n: Sequence[str], descending: bool = False) -> DataFrame:
    """Adds ``<n>_before``: the sum of ``n`` over smaller (or larger) values of the group.

    ``counts`` holds each (group, value) once.
    """
    order = F.col(value).desc() if descending else F.col(value).asc()
    placed = cut_lineage(
        counts.repartitionByRange(F.col(group), order).withColumn("part_", F.spark_partition_id())
    )
    # one row per group and partition
    totals = placed.groupBy(group, "part_").agg(*[F.sum(c).alias(f"{c}_part") for c in n])
    before_part = Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        group, "part_", *[F.coalesce(F.sum(f"{c}_part").over(before_part), F.lit(0)).alias(f"{c}_off") for c in n]
    )
    within = Window.partitionBy(group, "part_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(offsets, [group, "part_"])
        .withColumns(
            {f"{c}_before": F.col(f"{c}_off") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in n}
        )
        .drop("part_", *[f"{c}_off" for c in n])
    )


def join_unique(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    copies: str,
    hot_rows: int = 1_000_000,
    at_most: int | None = None,
) -> DataFrame:
    """Joins rows to a lookup that holds each key once together with its row count.

    Keys with more rows than the limit number at most 10,000 (all rows / limit);
    that part of the lookup goes to every task instead of pulling the hot rows
    into one.  ``at_most`` is a known bound of the number of rows.
    """
    keys = list(keys)
    if at_most is not None and at_most <= hot_rows:
        return rows.join(lookup, keys)
    top, total = lookup.agg(F.max(copies), F.sum(copies)).first()
    limit = max(hot_rows, (total or 0) // 10_000)
    if (top or 0) <= limit:
        return rows.join(lookup, keys)
    hot = F.broadcast(lookup.where(F.col(copies) > limit))
    cold = lookup.where(F.col(copies) <= limit)
    return rows.join(hot, keys).unionByName(
        rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys).select(*rows.join(hot, keys).columns)
    )
