"""Nearest neighbours by inner product: a vantage-point tree per shard.

Rows are dealt into shards by their id.  In a shard every vector gets one more
component that brings all to one length; Euclidean distance then orders them as
the inner product does (falling).  Its tree splits the vectors at a node into the
nearer and the farther half from a vantage point and keeps the range of distances
of both.  A search skips a half if the triangle inequality puts it beyond the
k-th best so far by ``stretch`` times less: 1 is exact, more prunes more.  The
trees are a table of one row per shard; queries meet it in blocks of bounded size;
a task takes its shards one after the other and hands back k rows per query.

Rows whose id or vector is null, whose vector is empty or zero or holds a null or
non-finite component take no part.  Vectors of different length never meet.  Rows
equal in id and vector count once, several vectors of an id by the best of them; a row
with the query's id is its own and never found.
Equal scores go to the smaller id.  An empty table or no query gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

NEIGHBOURS = 20
#: One row in so many is a query.
QUERY_EVERY = 20
#: Vectors below a node that is not split again.
LEAF = 64
#: Bytes of the vectors of a shard, of a block of queries, and of all blocks that go to every task at once.
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 1 << 26

TREES = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("vectors", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("nodes", pa.binary())])
TREES_DDL = "shard bigint, dim int, vectors binary, ids binary, counts binary, nodes binary"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND_DDL = "query_id bigint, vec_id bigint, score double"
#: A node's vectors are those from ``low`` to ``high``; the half nearer to the one at ``vantage`` ends at ``middle`` (-1 at a leaf).
NODE = np.dtype([("low", "<i8"), ("high", "<i8"), ("middle", "<i8"), ("vantage", "<i8"), ("ranges", "<f8", (2, 2)), ("children", "<i8", 2)])


def usable(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(vec_id, vec, dim) of the rows that take part."""
    v = F.col(vec).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    good = F.col(vec_id).isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = df.where(F.coalesce(good, F.lit(False)))
    return rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("vec"), F.size(v).alias("dim"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def lengthened(x: np.ndarray) -> np.ndarray:
    """The vectors with the component that brings all to the greatest length among them."""
    squares = (x * x).sum(axis=1)
    return np.column_stack((x, np.sqrt(np.maximum(squares.max() - squares, 0.0))))


def grow(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The order of the points in the tree, and its nodes, the root first."""
    order = np.arange(len(points))
    nodes: list[tuple] = [()]
    todo = [(0, 0, len(points))]
    while todo:
        node, low, high = todo.pop()
        if high - low <= leaf:
            nodes[node] = (low, high, -1, 0, ((0, 0), (0, 0)), (-1, -1))
            continue
        own = order[low:high]
        # the point farthest from the first one: its distances differ most
        vantage = own[((points[own] - points[own[0]]) ** 2).sum(axis=1).argmax()]
        away = np.sqrt(((points[own] - points[vantage]) ** 2).sum(axis=1))
        turn = np.argsort(away, kind="stable")
        order[low:high], away = own[turn], away[turn]
        half = (high - low) // 2
        middle = low + half
        children = (len(nodes), len(nodes) + 1)
        nodes += [(), ()]
        nodes[node] = (low, high, middle, vantage, ((away[0], away[half - 1]), (away[half], away[-1])), children)
        todo += [(children[0], low, middle), (children[1], middle, high)]
    tree = np.array(nodes, NODE)
    tree["vantage"] = np.argsort(order)[tree["vantage"]]
    return order, tree


def _planted(table: pa.Table) -> pa.Table:
    """The tree of one shard over its distinct vectors, each with its ids in order."""
    shard, dim = table["shard"][0].as_py(), table["dim"][0].as_py()
    x, ids = _matrix(table["vec"], dim), table["vec_id"].to_numpy()
    # zeros of either sign are one value
    vectors, which = np.unique(x + 0.0, axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack((which.reshape(-1), ids)), axis=0)
    counts = np.bincount(pairs[:, 0], minlength=len(vectors))
    points = lengthened(vectors)
    order, nodes = grow(points)
    starts = np.concatenate(([0], np.cumsum(counts)))
    sorted_ids = np.concatenate([pairs[starts[i] : starts[i + 1], 1] for i in order])
    row = [shard, dim, vectors[order].tobytes(), sorted_ids.astype("<i8").tobytes(), counts[order].astype("<i8").tobytes(), nodes.tobytes()]
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, TREES)], schema=TREES)


class Tree:
    """A shard's tree, read back."""

    def __init__(self, dim: int, vectors: bytes, ids: bytes, counts: bytes, nodes: bytes) -> None:
        self.vectors = np.frombuffer(vectors, "<f8").reshape(-1, dim)
        self.ids = np.frombuffer(ids, "<i8")
        self.starts = np.concatenate(([0], np.cumsum(np.frombuffer(counts, "<i8"))))
        self.nodes = np.frombuffer(nodes, NODE)
        self.points = lengthened(self.vectors)
        self.length = float((self.points[0] ** 2).sum())


class Search:
    """The best of some queries over the trees shown so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, stretch: float) -> None:
        self.ids, self.queries, self.k, self.stretch = ids, queries, k, stretch
        self.squares = (queries * queries).sum(axis=1)
        # one more than k, for the query's own row
        self.best = np.full((len(ids), k + 1), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.compared = 0

    def visit(self, tree: Tree) -> None:
        q = np.column_stack((self.queries, np.zeros(len(self.queries))))
        # products are rounded: whatever is as near as this may be better
        self.slack = 1e-9 * np.sqrt(self.squares * tree.length)
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(0, np.arange(len(q)), np.zeros(len(q)))]
        while todo:
            at, who, bound = todo.pop()
            node = tree.nodes[at]
            # distance of the k-th best so far
            reach = np.maximum(self.squares[who] + tree.length - 2.0 * (self.best[who, -1] - self.slack[who]), 0.0)
            who = who[bound * self.stretch <= np.sqrt(reach)]
            if not len(who):
                continue
            if node["middle"] < 0:
                met.append(self._compare(tree, who, int(node["low"]), int(node["high"])))
                continue
            away = np.sqrt(np.maximum(self.squares[who] + tree.length - 2.0 * (q[who] @ tree.points[node["vantage"]]), 0.0))
            bounds = [np.maximum(np.maximum(lo - away, away - hi), 0.0) - 1e-7 * (1.0 + away) for lo, hi in node["ranges"]]
            both = [(int(c), who, b) for c, b in zip(node["children"], bounds)]
            # most queries' nearer half first: the stack hands out the last one
            todo += both if (bounds[0] > bounds[1]).mean() > 0.5 else both[::-1]
        self._settle(tree, met)

    def _compare(self, tree: Tree, who: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = self.queries[who] @ tree.vectors[low:high].T
        self.compared += score.size
        good = score >= (self.best[who, -1] - self.slack[who])[:, None]
        some = np.flatnonzero(good.any(axis=1))
        if len(some):
            both = np.concatenate((self.best[who[some]], score[some]), axis=1)
            kept = self.best.shape[1]
            top = np.partition(both, both.shape[1] - kept, axis=1)[:, -kept:]
            top.sort(axis=1)
            self.best[who[some]] = top[:, ::-1]
        i, j = np.nonzero(good)
        return who[i], j + low, score[i, j]

    def _settle(self, tree: Tree, met: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Exact scores of what may be among the best of a tree, merged with what was held."""
        if not met:
            return
        who, place, score = (np.concatenate(x) for x in zip(*met))
        good = score >= self.best[who, -1] - self.slack[who]
        who, place = who[good], place[good]
        # term by term, so that equal vectors score alike wherever they stand
        exact = np.zeros(len(who))
        for c in range(self.queries.shape[1]):
            exact += self.queries[who, c] * tree.vectors[place, c]
        # of many ids of one vector only the smallest can be among the best
        n = np.minimum(tree.starts[place + 1] - tree.starts[place], self.k + 1)
        at = np.repeat(tree.starts[place] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        ids, who, exact = tree.ids[at], np.repeat(who, n), np.repeat(exact, n)
        other = ids != self.ids[who]
        self.held.append((who[other], ids[other], exact[other]))
        self.held = [self._top()]

    def _top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, ids, score = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -score, who))
        who, ids, score = who[order], ids[order], score[order]
        # one id with two vectors counts with its better one
        first = np.unique(np.column_stack((who, ids)), axis=0, return_index=True)[1]
        first.sort()
        who, ids, score = who[first], ids[first], score[first]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        return who[rank < self.k], ids[rank < self.k], score[rank < self.k]

    def rows(self) -> pa.RecordBatch:
        who, ids, score = self.held[0] if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[who]), pa.array(ids), pa.array(score)], schema=FOUND)


def _searched(k: int, stretch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[tuple[int, int], Search] = {}
        known: tuple[tuple[int, int], Tree] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                shard, block = (row["shard"], row["dim"]), (row["block"], row["dim"])
                if known is None or known[0] != shard:
                    known = shard, Tree(row["dim"], row["vectors"], row["ids"], row["counts"], row["nodes"])
                search = searches.get(block)
                if search is None:
                    queries = np.frombuffer(row["queries"], "<f8").reshape(-1, row["dim"])
                    search = searches[block] = Search(np.frombuffer(row["query_ids"], "<i8"), queries, k, stretch)
                search.visit(known[1])
        for search in searches.values():
            yield search.rows()

    return run


def planted(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index: one row per shard with its tree."""
    rows = usable(df, vec_id, vec)
    total = rows.agg(F.sum(F.col("dim").cast("bigint")).alias("c")).first()["c"] or 0
    shards = max(1, math.ceil(8 * total / shard_bytes))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("dim", "vec_id"), F.lit(shards)))
    # an explicit number: small partitions are not merged again, so that the trees grow side by side
    parts = min(shards, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(shards / 16)))
    return dealt.repartition(parts, "shard", "dim").groupBy("shard", "dim").applyInArrow(_planted, TREES_DDL)


def _packed(table: pa.Table) -> pa.Table:
    dim = table["dim"][0].as_py()
    ids, x = table["vec_id"].to_numpy(), _matrix(table["vec"], dim)
    row = [table["block"][0].as_py(), dim, ids.astype("<i8").tobytes(), x.tobytes()]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["block", "dim", "query_ids", "queries"])


def nearest(
    index: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, stretch: float = 1.0, vec_id: str = "vec_id", vec: str = "embedding",
    block_bytes: int = BLOCK_BYTES, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest inner product in a stored index."""
    rows = usable(queries, vec_id, vec)
    total = 8 * (rows.agg(F.sum(F.col("dim").cast("bigint")).alias("c")).first()["c"] or 0)
    blocks = max(1, math.ceil(total / block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "dim"), F.lit(blocks)))
    packed = stored(
        dealt.groupBy("block", "dim").applyInArrow(_packed, "block bigint, dim int, query_ids binary, queries binary"), "queries"
    )
    batches = max(1, math.ceil(total / batch_bytes))
    found = []
    for batch in range(batches):
        # at most about batch_bytes go to every task
        some = F.broadcast(packed.where(F.pmod("block", F.lit(batches)) == batch))
        met = index.join(some, "dim").mapInArrow(_searched(k, stretch), FOUND_DDL)
        # an id may have several vectors
        met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
        best = met.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
        found.append(stored(best, "nearest") if batches > 1 else best)
    return reduce(DataFrame.unionByName, found)


def is_query(vec_id: str | Column = "vec_id", every: int = QUERY_EVERY) -> Column:
    return (F.col(vec_id) if isinstance(vec_id, str) else vec_id) % F.lit(every) == 0


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    both = exact.join(found, ["query_id", "vec_id"]).count()
    return both / max(exact.count(), 1)


def searched(vectors: DataFrame, k: int = NEIGHBOURS, stretch: float = 1.0) -> DataFrame:
    """The nearest rows of every query row of the table."""
    index = stored(planted(vectors), "trees")
    return nearest(index, vectors.where(is_query()), k, stretch)


SQL = f"""WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(q.x, c.x)) AS score
      FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {NEIGHBOURS}"""
