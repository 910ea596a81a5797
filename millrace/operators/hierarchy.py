"""Ward's hierarchical clustering and clustering-feature trees on tables.

Ward's criterion is reducible: a merge never brings the result nearer to a third
cluster than both of its parts were.  So two clusters that are nearer to each
other than to any third one may merge at once, wherever they are, and the merges
are those of always taking the cheapest pair.  A round deals the clusters into
cells of near ones, bounds for each the cost of merging with any cluster outside
its cell (an exact block join), and merges inside the cells below these bounds;
mutually nearest clusters of two cells merge in the table.  The history of merges
is a table; cutting it needs its few highest rows only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.neighbors import QUERY_BLOCK, approx_sq, block_join, matrix, place_near_pivots, row_chunks
from millrace.session import cut_lineage, scope

#: Clusters of a cell, whose cost matrix one task holds.
CELL_CLUSTERS = 2_048
#: Cells' worth of clusters that one task merges without such a matrix.
CELLS_AT_ONCE = 4
#: Outdated clusters whose nearest ones are looked up in one product.
LOOKS = 32
#: Rows and columns of tiles into which the comparison of all clusters is cut at least, and the least clusters of one.
LEAST_TILES, LEAST_BLOCK = 6, 512
#: Costs that a task works on at once, in two tables of 4 MB.
TILE_CELLS = 1 << 19

CLUSTERS = "row_id bigint, vec array<double>, n double, height double"
MERGES = "kept bigint, gone bigint, height double, n double"


def ward_costs(centres: np.ndarray, weights: np.ndarray, others: np.ndarray, other_weights: np.ndarray) -> np.ndarray:
    """Growth of the sum of squares if a cluster of the first kind merges with one of the second."""
    # differences, not products: near pairs decide
    d2 = np.zeros((len(centres), len(others)))
    for c in range(centres.shape[1]):
        gap = centres[:, c, None] - others[None, :, c]
        d2 += gap * gap
    return d2 * (weights[:, None] * other_weights[None, :] / (weights[:, None] + other_weights[None, :]))


def merge_inside(
    ids: np.ndarray, centres: np.ndarray, weights: np.ndarray, heights: np.ndarray, bounds: np.ndarray, partner: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Clusters left and the merges done, cheapest first.

    A pair merges while its cost is below the ``bounds`` of both, or if both are
    nearest to each other among all clusters, as ``partner`` tells.  Ties go to the smaller ids.
    """
    order = np.argsort(ids, kind="stable")
    ids, bounds, partner = ids[order], bounds[order].copy(), partner[order].copy()
    centres, weights, heights = centres[order].copy(), weights[order].copy(), heights[order].copy()
    m = len(ids)
    cost = ward_costs(centres, weights, centres, weights)
    np.fill_diagonal(cost, np.inf)
    mates = np.flatnonzero(partner[np.minimum(np.searchsorted(ids, partner), m - 1)] == ids)
    mates = mates[ids[np.minimum(np.searchsorted(ids, partner[mates]), m - 1)] == partner[mates]]
    near, at = cost.min(axis=1), cost.argmin(axis=1)
    alive, shut = np.ones(m, bool), np.zeros(m, bool)
    merges: list[tuple] = []

    def merge(i: int, j: int) -> None:
        i, j = min(i, j), max(i, j)
        total = weights[i] + weights[j]
        height = max(cost[i, j], heights[i], heights[j])
        merges.append((int(ids[i]), int(ids[j]), float(height), float(total)))
        centres[i] = (weights[i] * centres[i] + weights[j] * centres[j]) / total
        weights[i], heights[i], alive[j] = total, height, False
        bounds[i] = min(bounds[i], bounds[j])
        cost[j, :] = cost[:, j] = np.inf
        new = ward_costs(centres[i : i + 1], weights[i : i + 1], centres, weights)[0]
        new[~alive] = np.inf
        new[i] = np.inf
        cost[i, :] = cost[:, i] = new
        near[j] = np.inf
        # whoever was nearest to one of the two looks again; by reducibility nobody else has come nearer
        for r in np.append(np.flatnonzero(alive & ((at == i) | (at == j))), i):
            at[r] = cost[r].argmin()
            near[r], shut[r] = cost[r, at[r]], False

    for i in mates:
        j = int(np.searchsorted(ids, partner[i]))
        if i < j and alive[i] and alive[j]:
            merge(int(i), j)
    while True:
        allowed = alive & ~shut & (near < np.minimum(bounds, bounds[at]))
        if not allowed.any():
            break
        i = int(np.where(allowed, near, np.inf).argmin())
        # the cheapest allowed pair is mutually nearest, or its other end has a cheaper one that is not allowed
        j = int(at[i])
        if near[j] < near[i]:
            shut[i] = True
            continue
        merge(i, j)
    return ids[alive], centres[alive], weights[alive], heights[alive], merges


def nearest_by_ward(
    centres: np.ndarray, weights: np.ndarray, others: np.ndarray, other_weights: np.ndarray, barred: np.ndarray,
    ids: np.ndarray, other_ids: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per cluster the least cost among the others that are not ``barred``, and the smaller and larger id of that pair.

    Of equally near clusters the pair with the smaller ids counts, so all ends of a tie agree.  One matrix product
    leaves few pairs, whose costs are those of :func:`ward_costs`.
    """
    cost, high = np.full(len(centres), np.inf), np.full(len(centres), np.iinfo(np.int64).max)
    low = high.copy()
    d2, slack = approx_sq(centres, others)
    share = weights[:, None] * other_weights[None, :] / (weights[:, None] + other_weights[None, :])
    # a cost is known up to the slack times its share, and a rounding of the product
    d2 *= share
    share *= slack
    share += 1e-14 * d2
    d2[barred] = np.inf
    reach = (d2 + share).min(axis=1)
    rows, cols = np.nonzero((d2 - share <= reach[:, None]) & np.isfinite(d2))
    exact = np.zeros(len(rows))
    for c in range(centres.shape[1]):
        gap = centres[rows, c] - others[cols, c]
        exact += gap * gap
    exact *= weights[rows] * other_weights[cols] / (weights[rows] + other_weights[cols])
    small, large = np.minimum(ids[rows], other_ids[cols]), np.maximum(ids[rows], other_ids[cols])
    order = np.lexsort((large, small, exact, rows))
    hit, first = np.unique(rows[order], return_index=True)
    first = order[first]
    cost[hit], low[hit], high[hit] = exact[first], small[first], large[first]
    return cost, low, high


def compare_blocks(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
    """(row_id, cost, low, high, away, bound) for each cluster of ``q`` among those of ``p``: its nearest one as of
    :func:`nearest_by_ward` and whether that stands in another cell, and what the nearest one of another cell costs at least.

    Clusters stand in the order of their cells, so both minima are read off parts of the same rows of one matrix product.
    """
    q, p = q.sort_values("home", kind="stable"), p.sort_values("home", kind="stable")
    a, b = matrix(q["vec"]), matrix(p["vec"])
    q_id, p_id, q_n, p_n, q_cell, p_cell = (x.to_numpy() for c in ("row_id", "n", "home") for x in (q[c], p[c]))
    shift = b.mean(axis=0)
    x, y = a - shift, b - shift
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    # a squared distance is known up to the slack, a cost up to that times its share, which is below the query's weight
    slack = 1e-12 * a.shape[1] * float(xx.max(initial=0.0) + yy.max(initial=0.0)) + 1e-300
    error = slack * q_n
    left, right = np.hstack([-2.0 * x, np.ones((len(x), 1))]), np.ascontiguousarray(np.hstack([y, yy[:, None]]).T)
    by_id = np.argsort(p_id, kind="stable")
    own = by_id[np.minimum(np.searchsorted(p_id, q_id, sorter=by_id), len(p_id) - 1)]
    own = np.where(p_id[own] == q_id, own, -1)
    lo, hi = np.searchsorted(p_cell, q_cell, side="left"), np.searchsorted(p_cell, q_cell, side="right")
    q_inverse, p_inverse = 1.0 / q_n, 1.0 / p_n
    cost, bound, away = np.full(len(a), np.inf), np.full(len(a), np.inf), np.zeros(len(a), bool)
    low = np.full(len(a), np.iinfo(np.int64).max)
    high = low.copy()
    edges = np.append(np.flatnonzero(np.append(True, q_cell[1:] != q_cell[:-1])), len(a))
    step = max(1, TILE_CELLS // len(b))
    tile, scale = (np.empty((min(step, len(a)), len(b))) for _ in range(2))
    for first, last in zip(edges[:-1], edges[1:]):
        inner = slice(lo[first], hi[first])
        for start in range(first, last, step):
            part = slice(start, min(last, start + step))
            costs = np.dot(left[part], right, out=tile[: part.stop - start])
            costs += xx[part, None]
            costs /= np.add(q_inverse[part, None], p_inverse[None, :], out=scale[: part.stop - start])
            met = np.flatnonzero(own[part] >= 0)
            costs[met, own[part][met]] = np.inf
            others = np.minimum(costs[:, : inner.start].min(axis=1, initial=np.inf), costs[:, inner.stop :].min(axis=1, initial=np.inf))
            bound[part] = np.maximum(others * (1.0 - 1e-13) - error[part], 0.0)
            reach = np.minimum(others, costs[:, inner].min(axis=1, initial=np.inf))
            limit = np.where(np.isfinite(reach), reach + 1e-13 * np.abs(reach) + 2.0 * error[part], -np.inf)
            at, cols = np.divmod(np.flatnonzero(costs <= limit[:, None]), len(b))
            at += start
            exact = np.zeros(len(at))
            for c in range(a.shape[1]):
                gap = a[at, c] - b[cols, c]
                exact += gap * gap
            exact *= q_n[at] * p_n[cols] / (q_n[at] + p_n[cols])
            small, large = np.minimum(q_id[at], p_id[cols]), np.maximum(q_id[at], p_id[cols])
            order = np.lexsort((large, small, exact, at))
            hit, of = np.unique(at[order], return_index=True)
            of = order[of]
            cost[hit], low[hit], high[hit] = exact[of], small[of], large[of]
            away[hit] = p_cell[cols[of]] != q_cell[hit]
    return pd.DataFrame({"row_id": q_id, "cost": cost, "low": low, "high": high, "away": away, "bound": bound})


def merge_below(
    ids: np.ndarray, centres: np.ndarray, weights: np.ndarray, heights: np.ndarray, limit: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Clusters left and the merges done: always the cheapest pair, while it costs less than ``limit``.

    A cluster keeps its nearest one.  If that is merged, the cost stays as a bound, which no merge
    undercuts, and the cluster looks again when it is the cheapest: memory grows with the clusters, not with their pairs.
    """
    order = np.argsort(ids, kind="stable")
    ids, centres, weights, heights = (x[order].copy() for x in (ids, centres, weights, heights))
    known = compare_blocks(*[pd.DataFrame({"row_id": ids, "vec": list(centres), "n": weights, "home": 0})] * 2)
    near, low, high = (known[c].to_numpy().copy() for c in ("cost", "low", "high"))
    at = np.minimum(np.searchsorted(ids, np.where(low == ids, high, low)), len(ids) - 1)
    stale, alive = np.zeros(len(ids), bool), np.ones(len(ids), bool)
    shift = centres.mean(axis=0)
    moved = centres - shift
    squares, inverse = (moved * moved).sum(axis=1), 1.0 / weights
    merges: list[tuple] = []

    def look(some: np.ndarray) -> None:
        """The nearest cluster of each of ``some``: a product leaves few, whose costs are exact."""
        cost = (-2.0 * moved[some]) @ moved.T
        cost += squares
        cost += squares[some, None]
        cost /= inverse[some, None] + inverse
        cost[np.arange(len(some)), some] = math.inf
        least = cost.min(axis=1)
        error = weights[some] * 1e-12 * centres.shape[1] * 2.0 * float(squares[alive].max()) + 1e-300
        limits = np.where(least < math.inf, least + 1e-13 * np.abs(least) + 2.0 * error, -math.inf)
        rows, cols = np.divmod(np.flatnonzero(cost <= limits[:, None]), len(ids))
        gaps = centres[some[rows]] - centres[cols]
        exact = (gaps * gaps).sum(axis=1) * weights[some[rows]] * weights[cols] / (weights[some[rows]] + weights[cols])
        order = np.lexsort((cols, exact, rows))
        hit, first = np.unique(rows[order], return_index=True)
        stale[some], near[some] = False, math.inf
        near[some[hit]], at[some[hit]] = exact[order[first]], cols[order[first]]

    def next_looks(i: int) -> np.ndarray:
        """``i`` and the outdated clusters of least bounds: their costs come from one product."""
        waiting = np.flatnonzero(stale)
        if len(waiting) > LOOKS:
            waiting = waiting[np.argpartition(near[waiting], LOOKS - 1)[:LOOKS]]
        return np.union1d(waiting, [i])

    while len(ids) > 1:
        i = int(near.argmin())
        if not near[i] < limit:
            break
        if stale[i]:
            look(next_looks(i))
            continue
        cost, i, j = near[i], min(i, int(at[i])), max(i, int(at[i]))
        total = weights[i] + weights[j]
        height = max(cost, heights[i], heights[j])
        merges.append((int(ids[i]), int(ids[j]), float(height), float(total)))
        centres[i] = (weights[i] * centres[i] + weights[j] * centres[j]) / total
        moved[i] = centres[i] - shift
        squares[i], squares[j] = moved[i] @ moved[i], math.inf
        weights[i], inverse[i], heights[i] = total, 1.0 / total, height
        alive[j], near[j], stale[j] = False, math.inf, False
        stale |= alive & ((at == i) | (at == j))
        stale[i] = True
        # no merge costs less than the last one did
        near[i] = cost
        if 2 * alive.sum() < len(ids):
            stale |= ~alive[at]
            at = (np.cumsum(alive) - 1)[at]
            ids, centres, weights, inverse, heights, near, at, stale, moved, squares = (
                x[alive] for x in (ids, centres, weights, inverse, heights, near, at, stale, moved, squares)
            )
            alive = alive[alive]
    return ids[alive], centres[alive], weights[alive], heights[alive], merges


def _outside(placed: DataFrame, n: int, whole: bool) -> DataFrame:
    """(row_id, low, high, cost, away, bound): the nearest cluster of all, and a bound for those of other cells.

    ``whole`` tells that all clusters are known to have distances.
    """

    def costs(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return compare_blocks(q, p) if len(q) and len(p) else pd.DataFrame()

    schema = "row_id bigint, cost double, low bigint, high bigint, away boolean, bound double"
    # few clusters make at least LEAST_TILES tiles, many make tiles of the usual size
    block = min(QUERY_BLOCK, max(LEAST_BLOCK, math.ceil(n / LEAST_TILES)))
    found, _ = block_join(placed, placed, costs, schema, query_extra=["n", "home"], point_extra=["n", "home"], query_block=block, point_block=block, rows=n if whole else None)
    best = found.groupBy("row_id").agg(F.min(F.struct("cost", "low", "high", "away")).alias("best"), F.min("bound").alias("bound"))
    return best.select("row_id", "best.*", "bound")


def _in_cells(alive: DataFrame, n: int, cell_clusters: int) -> DataFrame:
    """The clusters with their cell ``home``, none of which has many more than ``cell_clusters``."""
    cells = math.ceil(n / cell_clusters)
    if cells == 1:
        return alive.withColumn("home", F.lit(0).cast("bigint"))
    placed = place_near_pivots(alive, 2 * cells)
    # at most 16,384 cells
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("of_cell"))
    parts = F.ceil(F.col("of_cell") / cell_clusters)
    home = F.col("cell").cast("bigint") * F.lit(1 << 32) + F.pmod(F.xxhash64("row_id"), parts)
    return cut_lineage(placed.join(F.broadcast(counts), "cell").withColumn("home", home).drop("cell", "of_cell"))


ROUND = f"{CLUSTERS}, kept bigint, gone bigint, low bigint, high bigint, cost double"


def _merge_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Clusters left of a cell, then its merges.  A cluster that has not changed brings its pair with a nearest one of another cell."""
    low, high, own, still = (pdf[c].to_numpy() for c in ("low", "high", "row_id", "still"))
    clusters = own, matrix(pdf["vec"]), pdf["n"].to_numpy(), pdf["height"].to_numpy()
    if pdf["home"].iloc[0] < 0:
        ids, centres, weights, heights, merges = merge_below(*clusters, float(pdf["bound"].iloc[0]))
    else:
        bounds, partner = np.where(still, 0.0, pdf["bound"].to_numpy()), np.where(still | (low == own), high, low)
        ids, centres, weights, heights, merges = merge_inside(*clusters, bounds, np.where(still, own, partner))
    done = pd.DataFrame(merges, columns=["kept", "gone", "height", "n"]).assign(row_id=None, vec=None, low=None, high=None, cost=None)
    changed = pdf["row_id"].isin(done["kept"]) | pdf["row_id"].isin(done["gone"])
    open_ = pdf.loc[pdf["away"] & ~changed, ["row_id", "low", "high", "cost"]].astype(object)
    left = pd.DataFrame({"row_id": ids, "vec": list(centres), "n": weights, "height": heights, "kept": None, "gone": None}).astype(object)
    left = left[~np.isin(ids, own[still])].merge(open_, on="row_id", how="left")
    columns = ["row_id", "vec", "n", "height", "kept", "gone", "low", "high", "cost"]
    both = pd.concat([left[columns].astype(object), done[columns].astype(object)])
    return both.where(both.notna(), None)


def _at_once(told: DataFrame, clusters: int) -> DataFrame:
    """Adds the cell -1 of at most ``clusters`` clusters: those whose nearest one costs less than a limit, their ``bound`` there.

    A pair below the limit has both ends there, and so has every merge of them.  In their own cells
    they stand ``still``: others must not merge past them.
    """
    limit = told.select("cost").orderBy("cost").limit(clusters + 1).agg(F.count(F.lit(1)), F.max("cost")).first()
    limit = limit[1] if limit[0] > clusters else math.inf
    there = told.where(F.col("cost") < limit)
    cell = {"home": F.lit(-1).cast("bigint"), "bound": F.lit(limit), "away": F.lit(False), "still": F.lit(False)}
    return told.withColumn("still", F.col("cost") < limit).unionByName(there.withColumns(cell))


def ward_merges(points: DataFrame, cell_clusters: int = CELL_CLUSTERS) -> DataFrame:
    """(kept, gone, height, n): all merges of the points (row_id, vec, n) down to one cluster, cheapest first in effect.

    A cluster is named by its smallest row; ``height`` is the growth of the sum of
    squares (never below that of the parts), ``n`` the weight of the result.
    Points of equal vectors belong into one row beforehand.
    """
    alive = cut_lineage(points.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("vec").cast("array<double>").alias("vec"), F.col("n").cast("double").alias("n"), F.lit(0.0).alias("height")))
    history = points.sparkSession.createDataFrame([], MERGES)
    left, whole = alive.count(), False
    while left > 1:
        with scope():
            if left > (CELLS_AT_ONCE if whole else 1) * cell_clusters:
                homes = _in_cells(alive, left, cell_clusters)
                told = _at_once(cut_lineage(homes.join(_outside(homes, left, whole), "row_id")), CELLS_AT_ONCE * cell_clusters)
            else:
                told = alive.select("*", F.lit(-1).cast("bigint").alias("home"), F.col("row_id").alias("low"), F.col("row_id").alias("high"), F.lit(0.0).alias("cost"), F.lit(False).alias("away"), F.lit(math.inf).alias("bound"), F.lit(False).alias("still"))
            after = cut_lineage(_merged_pairs(told.groupBy("home").applyInPandas(_merge_cell, ROUND)))
        history = history.unionByName(after.where(F.col("gone").isNotNull()).select("kept", "gone", "height", "n"))
        alive = after.where(F.col("row_id").isNotNull()).select("row_id", "vec", "n", "height")
        before, left, whole = left, alive.count(), True
        if left >= before:
            raise RuntimeError(f"no two of {left} clusters are nearest to each other")
    return history


def _merged_pairs(inside: DataFrame) -> DataFrame:
    """Clusters and merges, with clusters of two cells that are nearest to each other merged: both bring the same pair."""
    merge = F.col("row_id").isNull()
    pair = [F.when(merge, F.col(own)).otherwise(F.coalesce(end, "row_id")) for own, end in (("kept", "low"), ("gone", "high"))]
    members = F.array_sort(F.collect_list(F.struct("row_id", "n", "height", "vec", "cost", "kept", "gone")))
    grouped = inside.groupBy(merge.alias("merge"), pair[0].alias("k"), pair[1].alias("g")).agg(members.alias("of"))
    a, b = F.col("of")[0], F.get("of", F.lit(1))
    met = F.size("of") == 2
    total = a["n"] + b["n"]
    centre = F.zip_with(a["vec"], b["vec"], lambda x, y: (a["n"] * x + b["n"] * y) / total)
    return grouped.select(
        a["row_id"].alias("row_id"),
        F.when(met, centre).otherwise(a["vec"]).alias("vec"),
        F.when(met, total).otherwise(a["n"]).alias("n"),
        F.when(met, F.greatest(a["cost"], a["height"], b["height"])).otherwise(a["height"]).alias("height"),
        F.when(met, a["row_id"]).otherwise(a["kept"]).alias("kept"),
        F.when(met, b["row_id"]).otherwise(a["gone"]).alias("gone"),
    )


def cut(points: DataFrame, merges: DataFrame, n_clusters: int) -> DataFrame:
    """(row_id, cluster): the cluster of each point, named by its smallest row, when ``n_clusters`` are left."""
    # a merge that contains another one is never lower and always heavier
    last = merges.orderBy(F.col("height").desc(), F.col("n").desc(), F.col("kept").desc(), F.col("gone").desc()).limit(max(n_clusters - 1, 0))
    kept = merges.join(F.broadcast(last.select("gone")), "gone", "left_anti")
    # every cluster but the smallest of its kind is merged away once: follow the names, doubling the steps
    names = cut_lineage(kept.select(F.col("gone").alias("row_id"), F.col("kept").alias("cluster")))
    while True:
        further = names.select(F.col("row_id").alias("cluster"), F.col("cluster").alias("beyond"))
        # a name that very many follow is split by the adaptive join
        ahead = names.join(further, "cluster", "left")
        names = cut_lineage(ahead.select("row_id", F.coalesce("beyond", "cluster").alias("cluster"), F.col("beyond").isNotNull().alias("moved")))
        if names.where("moved").isEmpty():
            break
        names = names.drop("moved")
    return points.select("row_id").join(names, "row_id", "left").select("row_id", F.coalesce("cluster", "row_id").alias("cluster"))


# ---- clustering-feature trees


@dataclass
class Node:
    """Entries (count, sum, sum of squares) of a node; an inner one has a child per entry."""

    dims: int
    leaf: bool
    n: list[float] = field(default_factory=list)
    total: list[np.ndarray] = field(default_factory=list)
    squares: list[float] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    def nearest(self, centre: np.ndarray) -> int:
        centres = np.array(self.total) / np.array(self.n)[:, None]
        return int(((centres - centre) ** 2).sum(axis=1).argmin())

    def put(self, n: float, total: np.ndarray, squares: float, child: Node | None = None) -> None:
        self.n.append(n)
        self.total.append(total)
        self.squares.append(squares)
        if child is not None:
            self.children.append(child)

    def add(self, i: int, n: float, total: np.ndarray, squares: float) -> None:
        self.n[i] += n
        self.total[i] = self.total[i] + total
        self.squares[i] += squares

    def summary(self) -> tuple[float, np.ndarray, float]:
        return sum(self.n), np.sum(self.total, axis=0), sum(self.squares)

    def halves(self) -> tuple[Node, Node]:
        """Two nodes around the two entries that are farthest apart."""
        centres = np.array(self.total) / np.array(self.n)[:, None]
        apart = ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        i, j = np.unravel_index(apart.argmax(), apart.shape)
        both = Node(self.dims, self.leaf), Node(self.dims, self.leaf)
        near = apart[j] < apart[i]
        near[i], near[j] = False, True
        for e in range(len(self.n)):
            both[int(near[e])].put(self.n[e], self.total[e], self.squares[e], None if self.leaf else self.children[e])
        return both


def radius(n: float, total: np.ndarray, squares: float) -> float:
    centre = total / n
    return math.sqrt(max(squares / n - float(centre @ centre), 0.0))


class FeatureTree:
    """Entries go down to the nearest leaf entry, and join it if its radius stays within the threshold."""

    def __init__(self, dims: int, threshold: float, branching: int) -> None:
        self.threshold, self.branching = threshold, branching
        self.root = Node(dims, True)

    def insert(self, n: float, total: np.ndarray, squares: float) -> None:
        path: list[tuple[Node, int]] = []
        node, centre = self.root, total / n
        while not node.leaf:
            i = node.nearest(centre)
            path.append((node, i))
            node = node.children[i]
        if node.n:
            i = node.nearest(centre)
            if radius(node.n[i] + n, node.total[i] + total, node.squares[i] + squares) <= self.threshold:
                node.add(i, n, total, squares)
                for above, j in path:
                    above.add(j, n, total, squares)
                return
        node.put(n, total, squares)
        for above, j in path:
            above.add(j, n, total, squares)
        self._split(node, path)

    def _split(self, node: Node, path: list[tuple[Node, int]]) -> None:
        while len(node.n) > self.branching:
            halves = node.halves()
            if path:
                above, i = path.pop()
                for values in (above.n, above.total, above.squares, above.children):
                    del values[i]
            else:
                above = self.root = Node(node.dims, False)
            for half in halves:
                above.put(*half.summary(), half)
            node = above

    def nodes(self) -> list[Node]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            out.append(node)
            todo += node.children
        return out

    def entries(self) -> list[tuple[float, np.ndarray, float]]:
        return [e for node in self.nodes() if node.leaf for e in zip(node.n, node.total, node.squares)]


ENTRIES = "row_id bigint, vec array<double>, n double, squares double"


def feature_entries(points: DataFrame, threshold: float, branching: int, cell_rows: int) -> DataFrame:
    """(row_id, vec, n, squares): leaf entries of a tree per cell of near points; ``row_id`` is the first row of an entry.

    ``points`` are rows or entries of other trees: (row_id, vec, n, squares) with the centre as ``vec``.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        centres, n = matrix(pdf["vec"]), pdf["n"].to_numpy()
        tree = FeatureTree(centres.shape[1], threshold, branching)
        for c, k, s in zip(centres, n, pdf["squares"].to_numpy()):
            tree.insert(float(k), c * k, float(s))
        found = tree.entries()
        middles = np.array([t / k for k, t, _ in found])
        # an entry is named by a point of its own: the first one that lies nearest to no other entry of the cell
        owner = np.concatenate([((centres[part, None, :] - middles[None, :, :]) ** 2).sum(axis=2).argmin(axis=1) for part in row_chunks(len(centres), middles.size)])
        names = np.full(len(found), -1, np.int64)
        ids = pdf["row_id"].to_numpy()
        for i in range(len(ids) - 1, -1, -1):
            names[owner[i]] = ids[i]
        spare = iter(sorted(set(ids.tolist()) - set(names.tolist())))
        names = [int(x) if x >= 0 else next(spare) for x in names]
        return pd.DataFrame({"row_id": names, "vec": list(middles), "n": [k for k, _, _ in found], "squares": [s for _, _, s in found]})

    n = points.count()
    homes = _in_cells(points, n, cell_rows)
    return cut_lineage(homes.groupBy("home").applyInPandas(build, ENTRIES))
