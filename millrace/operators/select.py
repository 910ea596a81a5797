"""Scoring and choosing features.

Scores come from one grouped aggregation (classes x features numbers); no row
reaches the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ordering import join_unique, long_form, running_counts
from millrace.functions.tails import chi2_tail, f_tail
from millrace.functions.vectors import present


@dataclass(frozen=True)
class Score:
    feature: str
    position: int
    score: float | None
    p_value: float | None


def anova_scores(df: DataFrame, cols: Sequence[str], label: str) -> list[Score]:
    """One-way ANOVA F of each feature over the classes."""
    rows = (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(
            *[
                F.struct(
                    F.count(present(c)).alias("n"), F.avg(present(c)).alias("mean"), F.var_pop(present(c)).alias("var")
                ).alias(c)
                for c in cols
            ]
        )
        .collect()
    )
    out = []
    for i, c in enumerate(cols):
        groups = [r[c] for r in rows if r[c]["n"]]
        n, k = sum(g["n"] for g in groups), len(groups)
        score = p = None
        if k > 1 and n > k:
            mean = sum(g["n"] * g["mean"] for g in groups) / n
            between = sum(g["n"] * (g["mean"] - mean) ** 2 for g in groups)
            within = sum(g["n"] * g["var"] for g in groups)
            if within > 0:
                score = (between / (k - 1)) / (within / (n - k))
                p = f_tail(score, k - 1, n - k)
        out.append(Score(c, i, score, p))
    return out


def chi2_scores(df: DataFrame, cols: Sequence[str], label: str) -> list[Score]:
    """Chi-square of class sums of non-negative features against the class shares."""
    rows = (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n_"), *[F.sum(present(c)).alias(c) for c in cols])
        .collect()
    )
    n = sum(r["n_"] for r in rows)
    out = []
    for i, c in enumerate(cols):
        total = sum(r[c] or 0.0 for r in rows)
        score = p = None
        if total > 0:
            score = sum(((r[c] or 0.0) - total * r["n_"] / n) ** 2 / (total * r["n_"] / n) for r in rows)
            p = chi2_tail(score, len(rows) - 1) if len(rows) > 1 else None
        out.append(Score(c, i, score, p))
    return out


def regression_scores(df: DataFrame, cols: Sequence[str], label: str) -> list[Score]:
    """F of the simple linear regression of the label on each feature."""
    y = present(F.col(label))
    row = df.agg(
        *[
            F.struct(
                F.corr(present(c), y).alias("r"), F.count_if(present(c).isNotNull() & y.isNotNull()).alias("n")
            ).alias(c)
            for c in cols
        ]
    ).first()
    out = []
    for i, c in enumerate(cols):
        r, n = row[c]["r"], row[c]["n"]
        score = p = None
        if r is not None and not math.isnan(r) and n > 2:
            score = math.inf if abs(r) >= 1.0 else r * r / (1 - r * r) * (n - 2)
            p = 0.0 if math.isinf(score) else f_tail(score, 1, n - 2)
        out.append(Score(c, i, score, p))
    return out


SCORERS = {"f_classif": anova_scores, "chi2": chi2_scores, "f_regression": regression_scores}


def best(scores: Sequence[Score], k: int) -> list[str]:
    """The k highest scores in table order; of equal scores the later column."""
    ranked = sorted(scores, key=lambda s: (-math.inf if s.score is None else s.score, s.position), reverse=True)
    return [s.feature for s in sorted(ranked[:k], key=lambda s: s.position)]


def best_fraction(df: DataFrame, cols: Sequence[str], label: str, algorithm: str, fraction: float) -> tuple[list[str], list[str]]:
    """(kept, dropped) with ``int(fraction * columns)`` kept."""
    kept = best(SCORERS[algorithm](df, cols, label), int(fraction * len(cols)))
    return kept, [c for c in cols if c not in kept]


def mixed_scores(df: DataFrame, numeric: Sequence[str], binary: Sequence[str], label: str) -> list[Score]:
    """chi-square for 0/1 features and ANOVA F for the others, comparable by p-value."""
    scores = (chi2_scores(df, binary, label) if binary else []) + (
        anova_scores(df, numeric, label) if numeric else []
    )
    order = {s.feature: i for i, s in enumerate(scores)}
    return sorted(scores, key=lambda s: (2.0 if s.p_value is None else s.p_value, order[s.feature]))


def scores_frame(spark, scores: Sequence[Score]) -> DataFrame:
    return spark.createDataFrame(
        [(s.feature, s.position, s.score, s.p_value) for s in scores],
        "feature string, position int, score double, p_value double",
    )


def _gram(df: DataFrame, cols: Sequence[str], about: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per column pair over rows that have both: count, sum, sum of squares and products about ``about``.

    A task adds up its rows and sends one row for each column.
    """
    d = len(cols)

    def sums(batches):
        total = np.zeros((d, 4 * d))
        for pdf in batches:
            x = pdf.to_numpy(dtype=np.float64) - about
            here = ~np.isnan(x)
            p, x = here.astype(np.float64), np.where(here, x, 0.0)
            total += np.hstack([p.T @ p, x.T @ p, (x * x).T @ p, x.T @ x])
        yield pd.DataFrame({"i": np.arange(d, dtype=np.int32), "total": list(total)})

    values = df.select(*[present(c).alias(f"c{i}") for i, c in enumerate(cols)])
    parts = values.mapInPandas(sums, "i int, total array<double>").select("i", F.posexplode("total"))
    out = np.zeros((d, 4 * d))
    for r in parts.groupBy("i", "pos").agg(F.sum("col").alias("s")).collect():
        out[r["i"], r["pos"]] = r["s"]
    return tuple(out[:, k * d : (k + 1) * d] for k in range(4))


def _pearson(x: Column, y: Column) -> Column:
    """r over rows that have both, NULL if one of them is constant there."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation_pairs(df: DataFrame, cols: Sequence[str], narrow: int = 40) -> DataFrame:
    """|Pearson r| of every column pair i < j over the rows that have both; undefined ones left out.

    Up to ``narrow`` columns it is an expression per pair, beyond that (where so
    many expressions would not compile) one pass that adds up Gram matrices.  The
    answers are the same.
    """
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if len(cols) <= narrow:
        one = df.agg(*[_pearson(present(cols[i]), present(cols[j])).alias(f"r{i}_{j}") for i, j in pairs])
        cells = [
            F.struct(F.lit(cols[i]).alias("col_i"), F.lit(cols[j]).alias("col_j"), F.abs(F.col(f"r{i}_{j}")).alias("abs_corr"))
            for i, j in pairs
        ]
        out = one.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
    else:
        about = np.array([float(v or 0.0) for v in df.agg(*[F.avg(present(c)) for c in cols]).first()])
        n, total, squares, products = _gram(df, cols, about)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = squares - total * total / n
            # what is left of a constant column is rounding
            spread[spread <= 1e-14 * squares] = np.nan
            r = np.abs(products - total * total.T / n) / np.sqrt(spread * spread.T)
        rows = [(cols[i], cols[j], float(r[i, j])) for i, j in pairs if np.isfinite(r[i, j])]
        out = df.sparkSession.createDataFrame(rows, "col_i string, col_j string, abs_corr double")
    return out.where(F.col("abs_corr").isNotNull() & ~F.isnan("abs_corr"))


def top_correlations(df: DataFrame, cols: Sequence[str], n: int | None = None) -> DataFrame:
    out = correlation_pairs(df, cols).orderBy(F.col("abs_corr").desc(), "col_i", "col_j")
    return out.limit(n) if n else out


def drop_correlated(df: DataFrame, cols: Sequence[str], max_corr: float, n: int | None = None) -> list[str]:
    """Columns to drop so that every remaining pair is at or below the threshold.

    Of each pair above it the column in more such pairs goes, the later one when equal.
    """
    over = top_correlations(df, cols, n).where(F.col("abs_corr") > max_corr).select("col_i", "col_j").collect()
    seen = Counter(c for r in over for c in r)
    dropped = {r[0] if seen[r[0]] > seen[r[1]] else r[1] for r in over}
    return [c for c in cols if c in dropped]


def average_ranks(df: DataFrame, row_id: str, cols: Sequence[str]) -> DataFrame:
    """(row_id, attribute, rank) with equal values sharing their mean rank."""
    long = long_form(df, cols, [row_id])
    counts = long.groupBy("attribute", "x").agg(F.count(F.lit(1)).alias("n"))
    ranks = running_counts(counts, "attribute", "x", ["n"]).select(
        "attribute", "x", "n", (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank")
    )
    return join_unique(long, ranks, ["attribute", "x"], "n").select(row_id, "attribute", "rank")


def _rank_blocks(df: DataFrame, row_id: str, cols: Sequence[str], width: int) -> DataFrame:
    """(row_id, block, at, rank): a row's ranks about the middle rank and their columns, ``width`` columns at a time, missing ones left out."""
    position = F.create_map(*[F.lit(v) for i, c in enumerate(cols) for v in (c, i)])
    ranks = average_ranks(df, row_id, cols).withColumn("at", position[F.col("attribute")])
    present_ = long_form(df, cols).groupBy("attribute").agg(((F.count(F.lit(1)) + 1) / F.lit(2.0)).alias("middle"))
    cell = F.struct((F.col("at") % width).cast("int").alias("at"), (F.col("rank") - F.col("middle")).alias("rank"))
    centred = ranks.join(F.broadcast(present_), "attribute")
    # at most ``width`` cells meet
    blocks = centred.groupBy(row_id, F.floor(F.col("at") / width).cast("int").alias("block")).agg(F.collect_list(cell).alias("cells"))
    # plain arrays: a task reads structs as a dictionary per cell
    return blocks.select(row_id, "block", F.col("cells.at").alias("at"), F.col("cells.rank").alias("rank"))


#: Rows a task multiplies at once: a dozen tables of 2 MB.
PRODUCT_ROWS = 1_024

PRODUCTS = "i int, j int, n double, x double, y double, xx double, yy double, xy double"


def _products(width: int):
    """Sums over the rows of two column blocks, for every pair of their columns; the rows come block pair by block pair."""

    def dense(at: pd.Series, rank: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        x, there = np.zeros((len(at), width)), np.zeros((len(at), width))
        row = np.repeat(np.arange(len(at)), [len(a) for a in at])
        col = np.concatenate(at.to_list()).astype(np.int64)
        x[row, col], there[row, col] = np.concatenate(rank.to_list()), 1.0
        return x, there

    def rows(pair: tuple[int, int], total: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(total[0] > 0)
        out = pd.DataFrame({"i": (i + pair[0] * width).astype(np.int32), "j": (j + pair[1] * width).astype(np.int32)})
        for name, values in zip(("n", "x", "y", "xx", "yy", "xy"), total):
            out[name] = values[i, j]
        return out[out["i"] < out["j"]]

    def run(batches):
        held, total = None, np.zeros((6, width, width))
        for pdf in batches:
            for pair, part in pdf.groupby(["a", "b"], sort=False):
                if held is not None and pair != held:
                    yield rows(held, total)
                    total = np.zeros((6, width, width))
                held = pair
                for start in range(0, len(part), PRODUCT_ROWS):
                    some = part.iloc[start : start + PRODUCT_ROWS]
                    x, mx = dense(some["at"], some["rank"])
                    y, my = dense(some["right_at"], some["right_rank"]) if "right_at" in some else (x, mx)
                    total += np.stack([mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y])
        if held is not None:
            yield rows(held, total)

    return run


def spearman_pairs(df: DataFrame, row_id: str, cols: Sequence[str], width: int = 256) -> DataFrame:
    """(col_i, col_j, rho) of every column pair: Pearson r of the average ranks over the rows that have both.

    The ranks are cut into blocks of ``width`` columns; a task multiplies two blocks and hands
    back one row of sums per pair.  A pair without spread has no rho.
    """
    cols = list(cols)
    blocks = _rank_blocks(df, row_id, cols, min(width, len(cols)))
    n_blocks = math.ceil(len(cols) / width)
    if n_blocks == 1:
        both = blocks.withColumns({"a": F.lit(0), "b": F.lit(0)})
    else:
        right = blocks.select(row_id, F.col("block").alias("b"), F.col("at").alias("right_at"), F.col("rank").alias("right_rank"))
        both = blocks.withColumnRenamed("block", "a").join(right, row_id).where("a <= b")
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = both.repartition(max(parts, n_blocks * n_blocks), "a", "b", F.pmod(F.xxhash64(row_id), F.lit(parts))).sortWithinPartitions("a", "b")
    sums = both.select("a", "b", "at", "rank", *(["right_at", "right_rank"] if n_blocks > 1 else [])).mapInPandas(_products(min(width, len(cols))), PRODUCTS)
    names = ["n", "x", "y", "xx", "yy", "xy"]
    total = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    spread = (F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n"))
    rho = F.when(spread > 0, (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(spread))
    named = F.array(*[F.lit(c) for c in cols])
    return total.select(named[F.col("i")].alias("col_i"), named[F.col("j")].alias("col_j"), rho.alias("rho"))
