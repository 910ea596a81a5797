"""Density-based clustering: DBSCAN and mean shift."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ordering import join_unique, running_counts
from millrace.operators.components import components
from millrace.operators.neighbors import block_join, knn, matrix, placement, row_chunks, within_mask
from millrace.session import cut_lineage, keep, scope


def _block_forest(near: np.ndarray, a_id: np.ndarray, b_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links each row of two blocks to the smallest id it is connected with in them.

    A breadth-first walk over the two blocks: every row is expanded once, and
    only as many links as rows leave the task.
    """
    a_open, b_open = near.any(axis=1), near.any(axis=0)
    across = near.T.copy()
    ids_out, roots = [], []
    for start in np.nonzero(a_open)[0]:
        if not a_open[start]:
            continue
        a_open[start] = False
        frontier, on_a, seen = np.array([start]), True, [a_id[[start]]]
        while len(frontier):
            reached = (near if on_a else across)[frontier].any(axis=0)
            on_a = not on_a
            free, ids = (a_open, a_id) if on_a else (b_open, b_id)
            frontier = np.nonzero(reached & free)[0]
            free[frontier] = False
            seen.append(ids[frontier])
        ids = np.concatenate(seen)
        ids_out.append(ids)
        roots.append(np.full(len(ids), ids.min()))
    if not ids_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids_out), np.concatenate(roots)


#: Core rows beyond which cells are first linked by one row each.
LINK_ROWS = 16_384

#: Grid cells from the origin within which rounding cannot put rows of one cell too far apart.
GRID_REACH = float(1 << 20)


def _grid_cell(eps: float) -> Column:
    """The cell of a grid whose diagonal is just under ``eps``: rows that share one are within ``eps``.

    A row too far out for the grid is a cell of its own.
    """
    alone = F.concat(F.transform("vec", lambda x: F.lit(0).cast("bigint")), F.array("row_id"))
    if not eps > 0:
        return alone
    side = F.lit(eps * (1 - 1e-8)) / F.sqrt(F.size("vec").cast("double"))
    inside = F.forall("vec", lambda x: F.abs(x) < F.lit(GRID_REACH) * side)
    return F.when(inside, F.transform("vec", lambda x: F.floor(x / side))).otherwise(alone)


def _any_of(near: np.ndarray, unit: np.ndarray, axis: int) -> np.ndarray:
    """The mask with rows (or columns) of equal ``unit`` merged, in the order of the distinct units."""
    order = np.argsort(unit, kind="stable")
    starts = np.unique(unit[order], return_index=True)[1]
    return np.logical_or.reduceat(near.take(order, axis=axis), starts, axis=axis)


def dbscan(df: DataFrame, eps: float, min_samples: int = 5) -> DataFrame:
    """(row_id, cluster, is_core) for a table with ``row_id`` and ``vec``.

    -1 is noise.  Clusters are numbered by their first core row; a border row
    joins the lowest-numbered cluster it touches.  Equal vectors are one point
    with a weight, so any number of copies costs the same.

    Rows of one grid cell are within ``eps`` of each other: cells of
    ``min_samples`` rows are core without a distance, only the rows of other
    cells are counted around, and links are found between cells.  The rows are
    placed among pivots once for all three joins.
    """
    points = keep(
        df.groupBy(F.col("vec").cast("array<double>").alias("vec"))
        .agg(F.count(F.lit(1)).alias("n_"), F.min(F.col("row_id").cast("bigint")).alias("row_id"))
        .withColumn("at", _grid_cell(eps))
    )
    held = points.groupBy("at").agg(
        F.count(F.lit(1)).alias("rows"), (F.sum("n_") >= min_samples).alias("dense"), F.min("row_id").alias("in_cell")
    )
    points = join_unique(points, held, ["at"], "rows").select("row_id", "vec", "n_", "in_cell", "dense")
    placed = placement(points, ["n_", "in_cell", "dense"])

    def neighbours(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame()
        a, b, weight = matrix(q["vec"]), matrix(p["vec"]), p["n_"].to_numpy().astype(np.float64)
        near = [within_mask(a[part], b, eps) @ weight for part in row_chunks(len(a), len(b))]
        return pd.DataFrame({"row_id": q["row_id"].to_numpy(), "near": np.concatenate(near).astype(np.int64)})

    counted, _ = block_join(placed.rows.where("NOT dense"), placed, neighbours, "row_id bigint, near bigint", eps)
    cores = counted.groupBy("row_id").agg((F.sum("near") >= min_samples).alias("found"))
    is_core = F.col("dense") | F.coalesce("found", F.lit(False))
    points = cut_lineage(placed.rows.join(cores, "row_id", "left").withColumn("is_core", is_core).drop("found", "dense"))
    core, rest = points.where("is_core"), points.where("NOT is_core")
    # cells are linked under the id of their first core row
    units = core.groupBy("in_cell").agg(F.min("row_id").alias("unit"), F.count(F.lit(1)).alias("rows"))
    units = keep(units)
    core = keep(join_unique(core, units, ["in_cell"], "rows").drop("rows"))

    def link(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame()
        a, b, a_unit, b_unit = matrix(q["vec"]), matrix(p["vec"]), q["unit"].to_numpy(), p["unit"].to_numpy()
        near = np.vstack([_any_of(within_mask(a[part], b, eps), b_unit, 1) for part in row_chunks(len(a), len(b))])
        u, v = _block_forest(_any_of(near, a_unit, 0), np.unique(a_unit), np.unique(b_unit))
        return pd.DataFrame({"u": u, "v": v})

    def linked(rows: DataFrame) -> DataFrame:
        return block_join(rows, placed.of(core), link, "u bigint, v bigint", eps, query_extra=["unit"])[0]

    if core.count() > LINK_ROWS:
        # most cells are linked by their first rows already; a link that lacks has an end outside the largest component
        first = core.where("row_id = unit")
        edges, _ = block_join(first, placed.of(first), link, "u bigint, v bigint", eps, query_extra=["unit"])
        edges = cut_lineage(edges)
        held = components(edges).withColumnRenamed("node", "unit")
        held = cut_lineage(units.join(held, "unit", "left").withColumn("component", F.coalesce("component", "unit")))
        largest = held.groupBy("component").agg(F.sum("rows").alias("n")).orderBy(F.col("n").desc(), "component").first()["component"]
        apart = held.where(F.col("component") != largest).select("in_cell", "rows")
        edges = edges.unionByName(linked(join_unique(core, apart, ["in_cell"], "rows").drop("rows")))
    else:
        edges = linked(core)
    joined = components(edges).withColumnRenamed("node", "unit")
    named = units.join(joined, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    grouped = cut_lineage(join_unique(core.drop("unit"), named.drop("unit"), ["in_cell"], "rows").drop("rows"))

    def touch(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame()
        a, b = matrix(q["vec"]), matrix(p["vec"])
        order = np.argsort(p["component"].to_numpy(), kind="stable")
        ranked, b = p["component"].to_numpy()[order], b[order]
        ids, first = [], []
        for part in row_chunks(len(a), len(b)):
            mask = within_mask(a[part], b, eps)
            hit = mask.any(axis=1)
            ids.append(q["row_id"].to_numpy()[part][hit])
            first.append(ranked[mask.argmax(axis=1)[hit]])
        return pd.DataFrame({"row_id": np.concatenate(ids), "component": np.concatenate(first)})

    touched, _ = block_join(rest, placed.of(grouped), touch, "row_id bigint, component bigint", eps)
    border = touched.groupBy("row_id").agg(F.min("component").alias("component"))
    # first row of each component, counted through in order: the cluster numbers
    firsts = grouped.select(F.lit(0).alias("g"), "component").distinct().withColumn("one", F.lit(1))
    numbers = running_counts(firsts, "g", "component", ["one"]).select(
        "component", F.col("one_before").cast("bigint").alias("cluster")
    )
    members = grouped.select("row_id", "component").unionByName(border)
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    numbered = join_unique(members, numbers.join(sizes, "component"), ["component"], "size").select("row_id", "cluster")
    labelled = points.join(numbered, "row_id", "left").select(
        "vec", "n_", F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"), "is_core"
    )
    rows = df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("vec").cast("array<double>").alias("vec"))
    return join_unique(rows, labelled, ["vec"], "n_").select("row_id", "cluster", "is_core")


def _shift(seeds: DataFrame, points: DataFrame, bandwidth: float, dims: int) -> DataFrame:
    """(row_id, near, to): rows within the bandwidth of each seed and their mean."""

    def sums(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame()
        a, b, weight = matrix(q["vec"]), matrix(p["vec"]), p["n_"].to_numpy().astype(np.float64)
        rows = []
        for part in row_chunks(len(a), len(b)):
            w = within_mask(a[part], b, bandwidth) * weight
            total = np.hstack([w.sum(axis=1, keepdims=True), w @ b])
            for row_id, t in zip(q["row_id"].to_numpy()[part], total):
                if t[0] > 0:
                    rows.append((row_id, float(t[0]), t[1:].tolist()))
        return pd.DataFrame(rows, columns=["row_id", "near", "total"])

    found, split = block_join(
        seeds, points, sums, "row_id bigint, near double, total array<double>", bandwidth, point_extra=["n_"]
    )
    if split:
        found = found.groupBy("row_id").agg(
            F.sum("near").alias("near"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total")
        )
    return found.select(
        "row_id", "near", F.transform("total", lambda x: x / F.col("near")).alias("to")
    )


def _separate(modes: DataFrame, bandwidth: float) -> DataFrame:
    """The modes left when each one removes the weaker ones within the bandwidth.

    A mode without a stronger open neighbour stays and removes its neighbours;
    repeated until no mode is open.  ``row_id`` orders the modes, strongest first.
    """

    def strongest(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame()
        p = p.sort_values("row_id")
        a, b, ids = matrix(q["vec"]), matrix(p["vec"]), p["row_id"].to_numpy()
        parts = []
        for part in row_chunks(len(a), len(b)):
            mask = within_mask(a[part], b, bandwidth)
            hit = mask.any(axis=1)
            parts.append(pd.DataFrame({"row_id": q["row_id"].to_numpy()[part][hit], "top": ids[mask.argmax(axis=1)[hit]]}))
        return pd.concat(parts)

    def lowest(queries: DataFrame, points: DataFrame) -> DataFrame:
        found, _ = block_join(queries, points, strongest, "row_id bigint, top bigint", bandwidth)
        return found.groupBy("row_id").agg(F.min("top").alias("top"))

    kept, open_ = None, modes
    while True:
        with scope():
            stays = cut_lineage(lowest(open_, open_).where("row_id = top").select("row_id").join(open_, "row_id"))
            kept = stays if kept is None else kept.unionByName(stays)
            rest = open_.join(stays, "row_id", "left_anti")
            open_ = cut_lineage(rest.join(lowest(rest, stays), "row_id", "left_anti"))
        if open_.isEmpty():
            return kept


def mean_shift(
    df: DataFrame, bandwidth: float, max_iter: int = 300, bin_seeding: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(row_id, cluster), and the modes (cluster, vec), densest first, for a table with ``row_id`` and ``vec``.

    Seeds are all distinct rows, or with ``bin_seeding`` one per occupied grid
    cell of the bandwidth.  Settled seeds leave the loop.
    """
    points = cut_lineage(
        df.groupBy(F.col("vec").cast("array<double>").alias("vec")).agg(
            F.count(F.lit(1)).alias("n_"), F.min(F.col("row_id").cast("bigint")).alias("row_id")
        )
    )
    dims = len(points.select("vec").first()["vec"])
    if bin_seeding:
        cell = F.transform("vec", lambda x: F.round(x / F.lit(bandwidth)) * F.lit(bandwidth))
        seeds = points.groupBy(cell.alias("vec")).agg(F.min("row_id").alias("row_id"))
    else:
        seeds = points.select("row_id", "vec")
    modes = None
    for _ in range(max_iter):
        # what a round caches is released with it
        with scope():
            moved = _shift(seeds, points, bandwidth, dims)
            gap = F.sqrt(
                F.aggregate(F.zip_with("vec", "to", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
            )
            after = cut_lineage(seeds.join(moved, "row_id").withColumn("done", gap < F.lit(1e-3 * bandwidth)))
        settled = after.where("done").select("near", F.col("to").alias("vec"))
        modes = settled if modes is None else modes.unionByName(settled)
        seeds = after.where("NOT done").select("row_id", F.col("to").alias("vec"))
        if seeds.isEmpty():
            break
    else:
        raise RuntimeError(f"seeds did not settle in {max_iter} rounds")
    # seeds that ended at the same place, then numbered from the densest
    snap = F.transform("vec", lambda x: F.round(x / F.lit(1e-3 * bandwidth)))
    distinct = modes.groupBy(snap.alias("at")).agg(F.max(F.struct("near", "vec")).alias("m"))
    ordered = running_counts(
        distinct.select(F.lit(0).alias("g"), "m", F.lit(1).alias("one")), "g", "m", ["one"], descending=True
    )
    ordered = cut_lineage(ordered.select(F.col("one_before").cast("bigint").alias("row_id"), F.col("m.vec").alias("vec")))
    kept = _separate(ordered, bandwidth)
    numbered = cut_lineage(
        running_counts(kept.select(F.lit(0).alias("g"), "row_id", "vec", F.lit(1).alias("one")), "g", "row_id", ["one"]).select(
            F.col("one_before").cast("bigint").alias("row_id"), "vec"
        )
    )
    nearest = knn(df.select("row_id", "vec"), numbered, 1)
    return (
        nearest.select("row_id", F.col("neighbor_id").alias("cluster")),
        numbered.select(F.col("row_id").alias("cluster"), "vec"),
    )


def assign_nearest(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """(row_id, cluster): the index of the nearest centre."""

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                vectors = matrix(pdf["vec"])
                parts = [
                    ((vectors[part, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
                    for part in row_chunks(len(vectors), centres.size)
                ]
                yield pd.DataFrame({"row_id": pdf["row_id"], "cluster": np.concatenate(parts).astype(np.int64)})

    rows = df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInPandas(assign, "row_id bigint, cluster bigint")
