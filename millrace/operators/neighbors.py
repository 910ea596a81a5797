"""Exact neighbour joins by pivot cells.

Reference rows are placed into the cell of a near pivot and stay there.  A query
row with a search radius ``theta`` visits only the cells that can hold a row
within it: by the triangle inequality those whose pivot is at most ``theta`` plus
the cell radius away.  For nearest neighbours ``theta`` is first bounded by the
k-th distance inside one block of the query's own cell.  Cells are cut into
blocks of bounded size, one task works on one query block and one reference
block, and it hands back only its reduced result (top k, counts, sums), never
the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.hashing import hash_key
from millrace.session import cut_lineage, keep

CELL_ROWS = 2_000
MAX_PIVOTS = 16_384
# square tiles: n rows are copied 2 n / 16,384 times in all when nothing can be left out
QUERY_BLOCK = 16_384
POINT_BLOCK = 16_384
# pairs a task compares at once: a few tables of 8 MB
CHUNK_CELLS = 1_000_000
SLICE_CELLS = 4
OUTPUT_ROWS = 20_000
TASKS_PER_PARTITION = 16
# pairs a partition of tasks compares: about a second, whatever bytes it reads
PARTITION_PAIRS = 1 << 25
MAX_PARTITIONS = 100_000


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def approx_sq(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one matrix product, and a bound on their rounding error."""
    shift = b.mean(axis=0)
    a, b = a - shift, b - shift
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d2 = aa[:, None] + bb[None, :] - 2.0 * (a @ b.T)
    slack = 1e-12 * a.shape[1] * float(aa.max(initial=0.0) + bb.max(initial=0.0)) + 1e-300
    return np.maximum(d2, 0.0), slack


def exact_sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of aligned rows, without cancellation."""
    diff = a - b
    return (diff * diff).sum(axis=1)


def within_mask(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Which pairs are at most ``radius`` apart; near-ties decided on exact distances."""
    d2, slack = approx_sq(a, b)
    mask = d2 <= radius * radius - slack
    rows, cols = np.nonzero(np.abs(d2 - radius * radius) <= slack)
    if len(rows):
        mask[rows, cols] = np.sqrt(exact_sq(a[rows], b[cols])) <= radius
    return mask


def row_chunks(n_rows: int, n_cols: int) -> Iterator[slice]:
    step = max(1, CHUNK_CELLS // max(1, n_cols))
    for start in range(0, n_rows, step):
        yield slice(start, min(n_rows, start + step))


@dataclass(frozen=True)
class Cells:
    """Pivots, and per group the rows and the radius of each reference cell."""

    pivots: np.ndarray
    counts: dict[str, np.ndarray]
    radius: dict[str, np.ndarray]

    @property
    def whole(self) -> bool:
        return self.pivots.shape[1] == 0

    def gaps(self, vectors: np.ndarray) -> tuple[np.ndarray, float]:
        """Squared distances to the pivots and their error."""
        return approx_sq(vectors, self.pivots)

    @property
    def place_slack(self) -> float:
        """By how much a row's squared distance to its pivot may exceed that to another one: rounding while placing."""
        spread = math.sqrt(((self.pivots - self.pivots.mean(axis=0)) ** 2).sum(axis=1).max(initial=0.0))
        far = 2 * spread + max((float(r.max(initial=0.0)) for r in self.radius.values()), default=0.0)
        return 4e-12 * self.pivots.shape[1] * far * far + 1e-300

    def visits(self, grp: str, vectors: np.ndarray, theta: np.ndarray, k: int) -> np.ndarray:
        """Which cells can hold a row within ``theta`` (for an unknown one: one of the k nearest)."""
        counts, radius = self.counts[grp], self.radius[grp]
        if self.whole:
            return np.ones((len(vectors), 1), dtype=bool)
        d2, slack = self.gaps(vectors)
        unknown = np.nonzero(np.isinf(theta))[0]
        if len(unknown) and k:
            theta = theta.copy()
            far = np.where(counts > 0, np.sqrt(d2[unknown] + slack) + radius, np.inf)
            order = np.argsort(far, axis=1)
            enough = np.cumsum(counts[order], axis=1) >= k
            first = np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1)
            theta[unknown] = np.where(enough.any(axis=1), np.take_along_axis(far, first, axis=1)[:, 0], np.inf)
        # rounding of the distances must not lose a row on the rim
        limit = (theta[:, None] + radius) * (1.0 + 1e-9) + 1e-12
        near = (np.sqrt(np.maximum(d2 - slack, 0.0)) <= limit) & (counts > 0)
        # rows of a cell lie on its side of the plane halfway to the query's own pivot
        own = d2.argmin(axis=1)
        between, slack_between = approx_sq(self.pivots[own], self.pivots)
        beyond = d2 - np.take_along_axis(d2, own[:, None], axis=1) - 2 * (slack + self.place_slack)
        reach = 2 * np.sqrt(between + slack_between) * (theta[:, None] * (1.0 + 1e-9) + 1e-12)
        return near & (beyond <= reach)

    def home(self, grp: str, vectors: np.ndarray) -> np.ndarray:
        """The nearest cell that is not empty."""
        return np.where(self.counts[grp] > 0, self.gaps(vectors)[0], np.inf).argmin(axis=1)


@dataclass(frozen=True)
class Layout:
    """How the cells of each group are cut into blocks.

    The tasks of a cell are numbered from ``first`` on, one per query block and
    reference block.
    """

    query_blocks: dict[str, np.ndarray]
    point_blocks: dict[str, np.ndarray]
    first: dict[str, np.ndarray]


def _layout(visitors: dict[str, np.ndarray], cells: Cells, query_block: int, point_block: int) -> Layout:
    q_blocks, p_blocks, first, task = {}, {}, {}, 0
    for grp, visiting in sorted(visitors.items()):
        q_blocks[grp] = -(-visiting // query_block)
        p_blocks[grp] = np.maximum(1, -(-cells.counts[grp] // point_block))
        ends = task + np.cumsum(q_blocks[grp] * p_blocks[grp])
        first[grp] = ends - q_blocks[grp] * p_blocks[grp]
        task = int(ends[-1])
    return Layout(q_blocks, p_blocks, first)


def _by_group(pdf: pd.DataFrame, known: dict) -> Iterator[tuple[str, np.ndarray]]:
    """(group, positions) of the rows whose group is known."""
    grp = pdf["grp"].to_numpy()
    for g in pd.unique(grp):
        if g in known:
            yield g, np.nonzero(grp == g)[0]


def _slices(pdf: pd.DataFrame, cells: Cells) -> Iterator[pd.DataFrame]:
    for part in row_chunks(len(pdf), SLICE_CELLS * len(cells.pivots)):
        yield pdf.iloc[part]


@dataclass(frozen=True)
class Placement:
    """Reference rows that stand in cells, to be joined with several query tables."""

    rows: DataFrame
    pivots: np.ndarray

    def of(self, rows: DataFrame) -> Placement:
        """The same cells with some of the rows, or more columns."""
        return Placement(rows, self.pivots)


def placement(points: DataFrame, extra: list[str] | None = None) -> Placement:
    """Places rows with ``row_id`` and ``vec`` once."""
    points = keep(_standard(points, None, extra or []))
    pivots = _choose_pivots(points, min(MAX_PIVOTS, math.ceil(sum(_sizes(points, "raise", "reference").values()) / CELL_ROWS)))
    return Placement(keep(_place(points, pivots)), pivots)


def place_near_pivots(points: DataFrame, cells: int) -> DataFrame:
    """(row_id, vec, cell): rows that are near each other share one of at most ``cells`` cells."""
    points = keep(points)
    return keep(_place(points, _choose_pivots(points, min(cells, MAX_PIVOTS))).drop("gap"))


def _choose_pivots(points: DataFrame, count: int) -> np.ndarray:
    """Rows with the smallest hashes; none when one cell is enough."""
    if count <= 1:
        return np.zeros((1, 0))
    rows = points.orderBy(hash_key("pivot", "row_id"), "row_id").limit(count).select("vec").collect()
    return np.unique(np.array([r["vec"] for r in rows], dtype=np.float64), axis=0)


def _place(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds a near pivot and the distance to it."""
    if pivots.shape[1] == 0:
        return df.withColumns({"cell": F.lit(0), "gap": F.lit(0.0)})
    schema = T.StructType(df.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])

    def place(batches):
        for pdf in batches:
            if len(pdf):
                vectors = matrix(pdf["vec"])
                near = [approx_sq(vectors[part], pivots)[0].argmin(axis=1) for part in row_chunks(len(vectors), len(pivots))]
                cell = np.concatenate(near)
                yield pdf.assign(cell=cell.astype(np.int32), gap=np.sqrt(exact_sq(vectors, pivots[cell])))

    return df.mapInPandas(place, schema)


def _cells(placed: DataFrame, pivots: np.ndarray) -> Cells:
    counts: dict[str, np.ndarray] = {}
    radius: dict[str, np.ndarray] = {}
    for r in placed.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect():
        g = r["grp"]
        counts.setdefault(g, np.zeros(len(pivots), dtype=np.int64))[r["cell"]] = r["n"]
        radius.setdefault(g, np.zeros(len(pivots)))[r["cell"]] = r["radius"]
    return Cells(pivots, counts, radius)


def _count_visitors(queries: DataFrame, cells: Cells, k: int) -> dict[str, np.ndarray]:
    """Queries per cell; a task sends one row per cell it meets."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for pdf in _slices(whole, cells):
                for g, rows in _by_group(pdf, cells.counts):
                    seen = cells.visits(g, matrix(pdf["vec"].iloc[rows]), pdf["theta"].to_numpy()[rows], k).sum(axis=0)
                    total[g] = total.get(g, 0) + seen
        for g, seen in total.items():
            hit = np.nonzero(seen)[0]
            yield pd.DataFrame({"grp": g, "cell": hit.astype(np.int32), "n": seen[hit].astype(np.int64)})

    found = queries.select("grp", "vec", "theta").mapInPandas(count, "grp string, cell int, n bigint")
    out: dict[str, np.ndarray] = {}
    for r in found.groupBy("grp", "cell").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["grp"], np.zeros(len(cells.pivots), dtype=np.int64))[r["cell"]] = r["n"]
    return out


def _copies(pdf: pd.DataFrame, at: np.ndarray, tasks: np.ndarray) -> Iterator[pd.DataFrame]:
    # short outputs keep the replicated vectors of one Arrow batch small
    for start in range(0, len(at), OUTPUT_ROWS):
        part = slice(start, start + OUTPUT_ROWS)
        yield pdf.iloc[at[part]].assign(task=tasks[part])


def _with_task(df: DataFrame) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in ("cell", "gap")] + [T.StructField("task", T.LongType())])


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions repeated by their counts, and the running number within each."""
    at = np.repeat(np.arange(len(counts)), counts)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)


def _spread_queries(queries: DataFrame, cells: Cells, layout: Layout, k: int, home_only: bool = False) -> DataFrame:
    """A copy of a query row per reference block of every cell it visits.

    ``home_only`` sends it to a single block of its own cell.
    """

    def spread(batches):
        for whole in batches:
            for pdf in _slices(whole, cells):
                salt = pdf["salt"].to_numpy()
                for g, rows in _by_group(pdf, layout.first):
                    vectors = matrix(pdf["vec"].iloc[rows])
                    if home_only:
                        hit, cell = np.arange(len(rows)), cells.home(g, vectors)
                    else:
                        hit, cell = np.nonzero(cells.visits(g, vectors, pdf["theta"].to_numpy()[rows], k))
                    # a cell without blocks was out of reach when the visitors were counted
                    open_ = layout.query_blocks[g][cell] > 0
                    hit, cell = hit[open_], cell[open_]
                    parts = layout.point_blocks[g][cell]
                    a = salt[rows[hit]] % layout.query_blocks[g][cell]
                    if home_only:
                        at, b = np.arange(len(hit)), (salt[rows[hit]] >> 20) % parts
                    else:
                        at, b = _each(parts)
                    yield from _copies(pdf, rows[hit[at]], layout.first[g][cell[at]] + a[at] * parts[at] + b)

    return queries.mapInPandas(spread, _with_task(queries))


def _spread_points(placed: DataFrame, layout: Layout) -> DataFrame:
    """A copy of a reference row per query block of its cell."""
    names = [f.name for f in placed.schema.fields if f.name not in ("cell", "gap")]

    def spread(batches):
        for pdf in batches:
            for g, rows in _by_group(pdf, layout.first):
                cell = pdf["cell"].to_numpy()[rows]
                parts = layout.point_blocks[g][cell]
                b = pdf["salt"].to_numpy()[rows] % parts
                at, a = _each(layout.query_blocks[g][cell])
                yield from _copies(pdf[names], rows[at], layout.first[g][cell[at]] + a * parts[at] + b[at])

    return placed.mapInPandas(spread, _with_task(placed))


def whole_vector(vec: str = "vec") -> Column:
    """Whether every value of the vector is there and finite; only such vectors have distances."""
    finite = F.forall(F.col(vec).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    return F.coalesce(finite, F.lit(False))


def _sizes(df: DataFrame, missing: str, side: str) -> dict[str, int]:
    """Rows per group; rows that have no distances are an error unless they are left out."""
    counts = df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(~whole_vector()).alias("bad")).collect()
    bad = sum(r["bad"] for r in counts)
    if bad:
        width = df.agg(F.max(F.size("vec"))).first()[0] or 0
        finite = [F.coalesce(F.abs(F.get("vec", F.lit(i))) < math.inf, F.lit(False)) for i in range(max(width, 0))]
        columns = list(df.agg(*[F.count_if(~f) for f in finite]).first()) if finite else []
        raise ValueError(
            f"{bad} {side} rows have missing or infinite values (by position: {columns}); impute them or pass missing='drop'"
        )
    return {r["grp"]: r["n"] for r in counts}


def _standard(df: DataFrame, group: str | None, extra: list[str]) -> DataFrame:
    # a missing group is a group of its own, apart from the empty text
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")) if group else F.lit("")
    return df.select(
        F.col("row_id").cast("bigint").alias("row_id"),
        F.col("vec").cast("array<double>").alias("vec"),
        grp.alias("grp"),
        F.xxhash64("row_id").alias("salt"),
        *extra,
    )


def _work(visitors: dict[str, np.ndarray], cells: Cells) -> int:
    return sum(int((v * cells.counts[g]).sum()) for g, v in visitors.items())


def block_join(
    queries: DataFrame,
    points: DataFrame | Placement,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    reach: float = math.inf,
    k: int = 0,
    group: str | None = None,
    query_extra: list[str] | None = None,
    point_extra: list[str] | None = None,
    query_block: int = QUERY_BLOCK,
    point_block: int = POINT_BLOCK,
    missing: str = "raise",
    rows: int | None = None,
) -> tuple[DataFrame, bool]:
    """Runs the kernel on every pair of blocks that can matter.

    ``queries`` and ``points`` carry ``row_id`` and ``vec``.  Reference rows
    farther than ``reach``, or beyond the ``k`` nearest ones, are of no use to a
    query.  Points that are a :class:`Placement` keep their cells, and have no
    groups.  Also tells whether a query row can occur in more than one task, in
    which case the caller merges.  Rows with a missing or infinite value have no
    distances: they raise, or with ``missing="drop"`` they neither ask nor answer.
    ``rows`` is for tables without groups of which the caller knows that both have so
    many rows, all with distances: they are not read to count and check them.
    """
    # read several times (counts, bounds, spreading); recomputed if lost
    if missing not in ("raise", "drop"):
        raise ValueError(f"missing must be 'raise' or 'drop', not {missing!r}")
    ready = points if isinstance(points, Placement) else None
    points = ready.rows.drop("cell", "gap") if ready else _standard(points, group, point_extra or [])
    queries = _standard(queries, group, query_extra or [])
    if missing == "drop":
        points, queries = points.where(whole_vector()), queries.where(whole_vector())
    if rows is None:
        points, queries = keep(points), keep(queries)
        given, asked = _sizes(points, missing, "reference"), _sizes(queries, missing, "query")
    else:
        given = asked = {"": rows}
    queries = queries.withColumn("theta", F.lit(float(reach)))
    none = np.zeros((1, 0))
    placed = _place(points, none)
    cells = Cells(none, {g: np.array([n]) for g, n in given.items()}, {g: np.zeros(1) for g in given})
    asked = {g: np.array([n]) for g, n in asked.items()}
    visitors = {g: n for g, n in asked.items() if g in cells.counts}
    n_points = sum(int(n.sum()) for n in cells.counts.values())
    useful = k > 0 or not math.isinf(reach)
    if ready:
        pivots = ready.pivots
    else:
        pivots = _choose_pivots(points, min(MAX_PIVOTS, math.ceil(n_points / CELL_ROWS))) if useful else none
    if pivots.shape[1]:
        in_cells = ready.rows if ready else keep(_place(points, pivots))
        fine = _cells(in_cells, pivots)
        bounded = queries
        if k:
            bounded = keep(_bounded(queries, in_cells, fine, visitors, k, query_block, point_block))
        fine_visitors = _count_visitors(bounded, fine, k)
        # in many dimensions the cells overlap too much to be of use
        if 2 * _work(fine_visitors, fine) < _work(visitors, cells):
            queries, placed, cells, visitors = bounded, in_cells, fine, fine_visitors
    layout = _layout(visitors, cells, query_block, point_block)
    split = not cells.whole or any((b > 1).any() for b in layout.point_blocks.values())
    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return kernel(q, p)

    work = _work(visitors, cells)
    return _meet(_spread_queries(queries, cells, layout, k), _spread_points(placed, layout), layout, work, run, schema), split


def _meet(left: DataFrame, right: DataFrame, layout: Layout, work: int, run: Callable, schema) -> DataFrame:
    """Brings the two sides of every task together, a few tasks per partition.

    Partitions are counted by the pairs they compare: the rows are few bytes, and
    Spark would put all of them into a handful of partitions.
    """
    tasks = sum(int((q * layout.point_blocks[g]).sum()) for g, q in layout.query_blocks.items())
    partitions = max(tasks // TASKS_PER_PARTITION, min(tasks, -(-work // PARTITION_PAIRS)))
    partitions = max(1, min(MAX_PARTITIONS, partitions))
    left, right = left.repartition(partitions, "task"), right.repartition(partitions, "task")
    return left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(run, schema)


def _bounded(
    queries: DataFrame, placed: DataFrame, cells: Cells, asked: dict[str, np.ndarray], k: int, query_block: int, point_block: int
) -> DataFrame:
    """The queries with ``theta`` set to the k-th distance in one block of their own cell.

    Any block gives a valid bound, so each query goes to just one.  Query blocks
    are sized for the case that all queries of a group share a cell in
    proportion to its reference rows.
    """
    share = {g: np.ceil(n.sum() * cells.counts[g] / cells.counts[g].sum()).astype(np.int64) for g, n in asked.items()}
    layout = _layout(share, cells, query_block, point_block)
    schema = T.StructType(queries.schema.fields)
    names = schema.fieldNames()

    def bound(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return pd.DataFrame(columns=names)
        theta = np.full(len(q), math.inf)
        if len(p) >= k:
            a, b = matrix(q["vec"]), matrix(p["vec"])
            for part in row_chunks(len(a), len(b)):
                d2, slack = approx_sq(a[part], b)
                theta[part] = np.sqrt(np.partition(d2, k - 1, axis=1)[:, k - 1] + slack)
        return q[names].assign(theta=theta)

    left = _spread_queries(queries, cells, layout, k, home_only=True)
    # a query meets one block of its cell
    work = sum(int((n * -(-cells.counts[g] // layout.point_blocks[g])).sum()) for g, n in share.items())
    return _meet(left, _spread_points(placed, layout), layout, work, bound, schema)


def nearest_of_block(
    q: pd.DataFrame, p: pd.DataFrame, k: int, exclude_self: bool, seen: Callable[[slice], np.ndarray] | None = None
) -> pd.DataFrame:
    """The k nearest rows of a reference block for each row of a query block; a column ``carry_`` is brought along.

    ``seen`` tells for some of the queries which reference rows count; all do if it is not given.
    """
    if not len(q) or not len(p):
        return pd.DataFrame()
    a, b = matrix(q["vec"]), matrix(p["vec"])
    q_id, p_id = q["row_id"].to_numpy(), p["row_id"].to_numpy()
    theta = q["theta"].to_numpy() if "theta" in q else None
    take = min(k + 1 if exclude_self else k, len(b))
    parts = []
    for part in row_chunks(len(a), len(b)):
        d2, slack = approx_sq(a[part], b)
        if seen is not None:
            d2[~seen(part)] = np.inf
        kth = np.partition(d2, take - 1, axis=1)[:, take - 1]
        near = d2 <= kth[:, None] + 2 * slack
        if seen is not None:
            near &= d2 < np.inf
        rows, cols = np.nonzero(near)
        d = np.sqrt(exact_sq(a[part][rows], b[cols]))
        if theta is not None:
            # the k nearest rows of all blocks are no farther
            of_use = d <= theta[part][rows] * (1.0 + 1e-9) + 1e-12
            rows, cols, d = rows[of_use], cols[of_use], d[of_use]
        order = np.lexsort((p_id[cols], d, rows))
        rows, cols, d = rows[order], cols[order], d[order]
        if exclude_self:
            other = q_id[part][rows] != p_id[cols]
            rows, cols, d = rows[other], cols[other], d[other]
        first = np.searchsorted(rows, rows, side="left")
        rank = np.arange(len(rows)) - first
        keep = rank < k
        out = pd.DataFrame({"row_id": q_id[part][rows[keep]], "neighbor_id": p_id[cols[keep]], "distance": d[keep]})
        if "carry_" in p:
            out["carry_"] = p["carry_"].to_numpy()[cols[keep]]
        out["rank"] = (rank[keep] + 1).astype(np.int32)
        parts.append(out)
    return pd.concat(parts, ignore_index=True)


def first_copies(points: DataFrame, wanted: int, group: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Of any number of exact copies the first few ids, cut before the shuffle of whole vectors."""
    copies = Window.partitionBy(*([group] if group else []), F.xxhash64("vec"), "vec").orderBy("row_id")
    return (
        points.select("row_id", F.col("vec").cast("array<double>").alias("vec"), *([group] if group else []), *[c for c in extra if c not in (group, "vec")])
        .withColumn("copy_", F.row_number().over(copies))
        .where(F.col("copy_") <= wanted)
        .drop("copy_")
    )


def knn(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    group: str | None = None,
    exclude_self: bool = False,
    carry: str | None = None,
    query_block: int = QUERY_BLOCK,
    point_block: int = POINT_BLOCK,
    missing: str = "raise",
) -> DataFrame:
    """(row_id, neighbor_id, distance, rank[, carry]): the k nearest reference rows.

    Equal distances go to the smaller neighbour id.  With ``group`` only rows of
    the same group are neighbours; ``carry`` brings a column of the neighbour.
    """
    wanted = k + 1 if exclude_self else k
    extra = [carry] if carry else []
    # Of any number of exact copies only the first few ids can be an answer; the
    # limit is applied before the shuffle, so a hot vector stays small.
    distinct = first_copies(points, wanted, group, extra)
    # the vector comes along in any case
    own_vector = carry == "vec"
    if carry and not own_vector:
        distinct = distinct.withColumn("carry_", F.col(carry))

    def nearest(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if own_vector and len(p):
            p = p.rename(columns={"vec": "carry_"}).assign(vec=p["vec"])
        return nearest_of_block(q, p, k, exclude_self)

    fields = "row_id bigint, neighbor_id bigint, distance double"
    if carry:
        fields += f", carry_ {points.schema[carry].dataType.simpleString()}"
    found, split = block_join(
        queries,
        distinct,
        nearest,
        fields + ", rank int",
        k=wanted,
        group=group,
        point_extra=["carry_"] if carry and not own_vector else None,
        query_block=query_block,
        point_block=point_block,
        missing=missing,
    )
    if split:
        # at most k rows per reference block meet here
        merge = Window.partitionBy("row_id").orderBy("distance", "neighbor_id")
        found = found.withColumn("rank", F.row_number().over(merge)).where(F.col("rank") <= k)
    return found.withColumnRenamed("carry_", carry) if carry else found


def knn_until(queries: DataFrame, points: DataFrame, depth: int, short: Callable[[DataFrame], DataFrame], carry: str | None = None) -> DataFrame:
    """Neighbour lists as of :func:`knn`, each as deep as its query needs.

    ``short(lists)`` gives the ``row_id`` of the queries whose list does not do.
    These are looked up again, four times as deep, until none is left or its list
    holds all reference rows.
    """
    done = None
    while True:
        found = cut_lineage(knn(queries, points, depth, carry=carry))
        may_go_on = found.where(F.col("rank") == depth).select("row_id")
        lacking = cut_lineage(short(found).select("row_id").join(may_go_on, "row_id", "left_semi"))
        good = found.join(lacking, "row_id", "left_anti")
        done = good if done is None else done.unionByName(good)
        if lacking.isEmpty():
            return done
        queries, depth = queries.join(lacking, "row_id", "left_semi"), 4 * depth


def nearest_distance_curve(points: DataFrame) -> DataFrame:
    """Distance of every row to its closest other row, ascending."""
    return (
        knn(points, points, 1, exclude_self=True)
        .select("row_id", "distance")
        .orderBy("distance", "row_id")
    )
