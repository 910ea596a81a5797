"""Binning and one-hot encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ordering import exact_quantiles
from millrace.functions.vectors import present


def binary_columns(df: DataFrame, cols: Sequence[str], allow_na: bool = False) -> list[str]:
    """Columns whose distinct values are exactly 0 and 1."""
    row = df.agg(
        *[
            F.struct(
                F.min(present(c)).alias("lo"),
                F.max(present(c)).alias("hi"),
                F.count_if(~present(c).isin(0.0, 1.0)).alias("other"),
                F.count_if(present(c).isNull()).alias("missing"),
            ).alias(c)
            for c in cols
        ]
    ).first()
    return [
        c
        for c in cols
        if row[c]["lo"] == 0 and row[c]["hi"] == 1 and not row[c]["other"] and (allow_na or not row[c]["missing"])
    ]


def equal_width_edges(df: DataFrame, cols: Sequence[str], n: int = 3) -> dict[str, list[float]]:
    """The inner edges of n bins of equal width."""
    row = df.agg(*[F.struct(F.min(present(c)).alias("lo"), F.max(present(c)).alias("hi")).alias(c) for c in cols]).first()
    edges = {}
    for c in cols:
        lo, hi = row[c]["lo"], row[c]["hi"]
        if lo is None:
            edges[c] = []
            continue
        if lo == hi:
            # a constant column gets a small range around its value
            pad = 0.001 * abs(lo) if lo else 0.001
            lo, hi = lo - pad, hi + pad
        step = (hi - lo) / n
        edges[c] = [lo + i * step for i in range(1, n)]
    return edges


def quantile_edges(df: DataFrame, cols: Sequence[str], n: int = 3) -> dict[str, list[float]]:
    """The inner edges of n bins of equal frequency; equal edges merge into one bin."""
    q = exact_quantiles(df, cols, [i / n for i in range(n + 1)])
    edges = {}
    for c in cols:
        if q[c][0] is None:
            edges[c] = []
            continue
        distinct = sorted(set(q[c]))
        edges[c] = distinct[1:-1]
    return edges


EDGES = {"cut": equal_width_edges, "qcut": quantile_edges}


def bin_of(column: str, edges: Sequence[float]) -> Column:
    """0-based right-closed bin: the number of inner edges below the value."""
    x = present(column)
    bin_ = F.lit(0)
    for e in edges:
        bin_ = bin_ + (x > F.lit(float(e))).cast("int")
    return F.when(x.isNotNull(), bin_)


def discretize(df: DataFrame, cols: Sequence[str], n: int = 3, type: str = "cut") -> tuple[DataFrame, dict[str, list[float]]]:
    """Bins every column that is not 0/1; returns the table and the inner edges used."""
    binary = set(binary_columns(df, cols))
    edges = EDGES[type](df, [c for c in cols if c not in binary], n) if len(binary) < len(cols) else {}
    return df.withColumns({c: bin_of(c, e) for c, e in edges.items()}) if edges else df, edges


def items_of(binned: Sequence[str], binary: Sequence[str] = ()) -> Column:
    """The row as a set of items ``attribute_bin``; a 0/1 attribute is an item when it is 1."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}_"), F.col(c).cast("string"))) for c in binned]
    parts += [F.when(F.col(c) == 1, F.lit(c)) for c in binary]
    return F.array_compact(F.array(*parts))


def one_hot(df: DataFrame, levels: Mapping[str, Sequence], binary: Sequence[str] = ()) -> DataFrame:
    """One 0/1 column per attribute and level; 0/1 attributes pass through."""
    kept = [c for c in df.columns if c not in levels and c not in binary]
    wide = [
        F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c, values in levels.items()
        for v in values
    ]
    return df.select(*kept, *wide, *[F.col(b).cast("int").alias(b) for b in binary])
