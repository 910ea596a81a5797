"""Approximate nearest neighbours by random-projection trees.

A tree halves the rows level by level at a median along one direction a level.
Directions are differences of rows made orthonormal, so the squared amounts by
which a query lies on the wrong side of the cuts above a leaf add up to a lower
bound of its squared distance to any row of the leaf: a query visits the leaves of
least bound first.  How many it visits is read off a sample of queries whose exact
neighbours are known, as the least number that reaches the wanted recall.  Leaves
side by side meet their visitors in blocks of bounded size, as in the exact join; pairs of
a query and a row of a leaf it does not visit are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.neighbors import block_join, first_copies, knn, matrix, nearest_of_block, row_chunks, whole_vector
from millrace.session import cut_lineage

#: Rows that a leaf aims at.
LEAF_ROWS = 1_000
#: Rows of the leaves that stand side by side in a task; a query comes once for all of them it visits.
BUNDLE_ROWS = 8_192
#: Rows the cuts are fitted on, and how many of them a leaf needs; all rows are placed.
FIT_ROWS = 32_768
FIT_LEAF_ROWS = 4
#: Queries whose exact neighbours are looked up to settle the number of leaves.
TUNE_ROWS = 256


@dataclass(frozen=True)
class Forest:
    """Per tree the directions (dims x depth, orthonormal) and the cuts of its nodes, level by level."""

    directions: list[np.ndarray]
    cuts: list[np.ndarray]

    @property
    def depth(self) -> int:
        return self.directions[0].shape[1]

    @property
    def n_leaves(self) -> int:
        return 2**self.depth

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.cuts)), np.int64)
        for t, (along, cuts) in enumerate(zip(self.directions, self.cuts)):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + 1 + (x @ along[:, level] > cuts[node])
            out[:, t] = node - (self.n_leaves - 1)
        return out

    def bounds(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Lower bounds of the squared distances of each row to the leaves of a tree."""
        bound = np.zeros((len(x), 1))
        for level in range(self.depth):
            over = (x @ self.directions[tree][:, level])[:, None] - self.cuts[tree][2**level - 1 : 2 ** (level + 1) - 1]
            sides = [bound + np.maximum(over, 0.0) ** 2, bound + np.maximum(-over, 0.0) ** 2]
            bound = np.stack(sides, axis=2).reshape(len(x), -1)
        return bound


def fit(points: DataFrame, trees: int = 2, leaf_rows: int = LEAF_ROWS, fit_rows: int = FIT_ROWS, seed: int = 0) -> Forest:
    """The cuts, from at most ``fit_rows`` rows picked by hash.

    The depth follows the number of rows, up to the number of dimensions and to
    ``fit_rows`` / FIT_LEAF_ROWS leaves; beyond that leaves grow with the rows.
    """
    n = points.count()
    picked = points.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(fit_rows)
    x = matrix(pd.Series([r[0] for r in picked.select(F.col("vec").cast("array<double>")).collect()], dtype=object))
    most = math.floor(math.log2(max(1, len(x) / FIT_LEAF_ROWS)))
    depth = max(0, min(math.ceil(math.log2(max(1, n / leaf_rows))), most, x.shape[1]))
    rng = np.random.default_rng(seed)
    directions, cuts = [], []
    for _ in range(trees):
        a, b = (x[rng.integers(0, max(1, len(x)), depth)] for _ in range(2)) if depth else (x[:0], x[:0])
        scale = float(np.abs(x).max(initial=0.0)) or 1.0
        along = np.linalg.qr((a - b).T + 1e-9 * scale * rng.standard_normal((x.shape[1], depth)))[0]
        cut = np.zeros(2**depth - 1)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            at = x @ along[:, level]
            order = np.lexsort((at, node))
            first = 2**level - 1
            edges = np.searchsorted(node[order], np.arange(first, first + 2**level + 1))
            for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
                cut[first + k] = at[order[(lo + hi - 1) // 2]] if hi > lo else 0.0
            node = 2 * node + 1 + (at > cut[node])
        directions.append(along)
        cuts.append(cut)
    return Forest(directions, cuts)


def _placed(rows: DataFrame, forest: Forest, bundle: int = 1) -> DataFrame:
    """(row_id, vec, bundle, leaf): each row in its leaf of every tree; ``bundle`` leaves in a row share a group."""
    known = rows.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = known.value
        for pdf in batches:
            x = matrix(pdf["vec"])
            for part in row_chunks(len(x), max(forest.n_leaves, x.shape[1])):
                own = forest.leaves(x[part])
                for t in range(len(forest.cuts)):
                    yield pdf.iloc[part].assign(bundle=[f"{t}:{leaf // bundle}" for leaf in own[:, t]], leaf=own[:, t].astype(np.int32))

    return _vectors(rows).mapInPandas(place, "row_id bigint, vec array<double>, bundle string, leaf int")


def _visiting(rows: DataFrame, forest: Forest, probes: int, bundle: int) -> DataFrame:
    """(row_id, vec, bundle, visits): a row once per bundle that holds any of its ``probes`` leaves of least bound, with a bit per leaf."""
    known = rows.sparkSession.sparkContext.broadcast(forest)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = known.value
        for pdf in batches:
            x = matrix(pdf["vec"])
            for part in row_chunks(len(x), 4 * max(forest.n_leaves, x.shape[1])):
                for t in range(len(forest.cuts)):
                    hit = np.ones((len(x[part]), forest.n_leaves), bool)
                    if probes < forest.n_leaves:
                        hit[:] = False
                        near = np.argpartition(forest.bounds(x[part], t), probes - 1, axis=1)[:, :probes]
                        np.put_along_axis(hit, near, True, axis=1)
                    for first in range(0, forest.n_leaves, bundle):
                        some = hit[:, first : first + bundle]
                        going = np.flatnonzero(some.any(axis=1))
                        if len(going):
                            bits = np.packbits(some[going], axis=1)
                            yield pdf.iloc[part].iloc[going].assign(bundle=f"{t}:{first // bundle}", visits=[b.tobytes() for b in bits])

    return _vectors(rows).mapInPandas(visit, "row_id bigint, vec array<double>, bundle string, visits binary")


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("vec").cast("array<double>").alias("vec"))


def _whole(df: DataFrame, missing: str, side: str) -> DataFrame:
    if missing not in ("raise", "drop"):
        raise ValueError(f"missing must be 'raise' or 'drop', not {missing!r}")
    if missing == "raise" and df.where(~whole_vector()).limit(1).count():
        raise ValueError(f"{side} rows have missing or infinite values; impute them or pass missing='drop'")
    return df.where(whole_vector())


def _tuning(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool, rows: int) -> tuple[DataFrame, DataFrame]:
    """Some queries, picked by hash, and their exact neighbours."""
    some = cut_lineage(queries.select("row_id", "vec").orderBy(F.xxhash64("row_id", F.lit("tune")), "row_id").limit(rows))
    return some, knn(some, points, k, exclude_self=exclude_self).select("row_id", "neighbor_id")


def probes_for(
    forest: Forest, queries: DataFrame, points: DataFrame, k: int, recall: float = 0.9, exclude_self: bool = False, rows: int = TUNE_ROWS
) -> int:
    """The least number of leaves a tree by which a sample of ``rows`` queries finds a fifth of the
    allowed misses less than ``recall`` permits."""
    some, exact = _tuning(queries, points, k, exclude_self, rows)
    vectors = {r["row_id"]: np.array(r["vec"], dtype=np.float64) for r in some.collect()}
    sought = F.broadcast(exact.select("neighbor_id").distinct())
    homes = _placed(points.join(sought, F.col("row_id") == F.col("neighbor_id")), forest).select("row_id", F.concat(F.split_part("bundle", F.lit(":"), F.lit(1)), F.lit(":"), F.col("leaf")).alias("leaf"))
    home: dict[int, dict[int, int]] = {}
    for r in homes.collect():
        tree, leaf = map(int, r["leaf"].split(":"))
        home.setdefault(r["row_id"], {})[tree] = leaf
    of: dict[int, list[int]] = {}
    for r in exact.collect():
        of.setdefault(r["row_id"], []).append(r["neighbor_id"])
    visits = []
    for q, near in of.items():
        best = np.full(len(near), forest.n_leaves)
        for t in range(len(forest.cuts)):
            bound = forest.bounds(vectors[q][None, :], t)[0]
            rank = np.empty(len(bound), np.int64)
            rank[np.argsort(bound, kind="stable")] = np.arange(len(bound))
            best = np.minimum(best, rank[[home[i][t] for i in near]])
        visits.append(best)
    if not visits:
        return 1
    ranks = np.sort(np.concatenate(visits))
    wanted = min(1.0, recall + (1 - recall) / 5)
    return int(ranks[max(0, math.ceil(wanted * len(ranks)) - 1)]) + 1


def knn_by_trees(
    queries: DataFrame, points: DataFrame, k: int, recall: float = 0.9, probes: int | None = None, trees: int = 2,
    leaf_rows: int = LEAF_ROWS, fit_rows: int = FIT_ROWS, exclude_self: bool = False, missing: str = "raise", seed: int = 0,
) -> DataFrame:
    """(row_id, neighbor_id, distance, rank): the k nearest reference rows among the visited leaves.

    Distances are exact; equal ones go to the smaller id.  ``probes`` (leaves a
    tree) is settled on a sample for the wanted ``recall`` if it is not given; with
    as many as there are leaves the answer is exact.  Missing values as in
    :func:`millrace.operators.neighbors.knn`.
    """
    queries = _whole(queries, missing, "query")
    points = cut_lineage(first_copies(_whole(points, missing, "reference"), k + 1 if exclude_self else k))
    forest = fit(points, trees, leaf_rows, fit_rows, seed)
    if probes is None:
        probes = probes_for(forest, queries, points, k, recall, exclude_self)

    bundle = max(1, BUNDLE_ROWS * forest.n_leaves // max(1, points.count()))

    def nearest(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame()
        bits = np.unpackbits(np.array([np.frombuffer(v, np.uint8) for v in q["visits"]]), axis=1).astype(bool)
        leaf = p["leaf"].to_numpy() % bundle
        return nearest_of_block(q, p, k, exclude_self, lambda part: bits[part][:, leaf])

    visiting, homes = _visiting(queries, forest, min(probes, forest.n_leaves), bundle), _placed(points, forest, bundle)
    fields = "row_id bigint, neighbor_id bigint, distance double, rank int"
    found, _ = block_join(visiting, homes, nearest, fields, group="bundle", query_extra=["visits"], point_extra=["leaf"])
    # a row may be met in several trees; at most k rows per bundle and block come here, in one shuffle for both steps
    found = found.select("row_id", "neighbor_id", "distance").repartition("row_id")
    merge = Window.partitionBy("row_id").orderBy("distance", "neighbor_id")
    once = found.groupBy("row_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    return once.withColumn("rank", F.row_number().over(merge)).where(F.col("rank") <= k)


def measured_recall(found: DataFrame, queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, rows: int | None = None) -> DataFrame:
    """(n_queries, n_sought, n_found, recall) against the exact join, for all queries or ``rows`` picked by hash.

    A row as near as the k-th exact neighbour counts as found, whichever of equal ones was named.
    """
    asked = queries if rows is None else queries.orderBy(F.xxhash64("row_id", F.lit("measure")), "row_id").limit(rows)
    exact = knn(asked, points, k, exclude_self=exclude_self).groupBy("row_id").agg(F.max("distance").alias("reach"), F.count("*").alias("sought"))
    within = F.count_if(F.col("distance") <= F.col("reach"))
    each = exact.join(found, "row_id", "left").groupBy("row_id", "sought").agg(F.least(within, F.col("sought")).alias("met"))
    total = each.agg(F.count("*").alias("n_queries"), F.coalesce(F.sum("sought"), F.lit(0)).alias("n_sought"), F.coalesce(F.sum("met"), F.lit(0)).alias("n_found"))
    return total.withColumn("recall", F.when(F.col("n_sought") > 0, F.col("n_found") / F.col("n_sought")))
