"""Decision trees and forests with exact splits: every midpoint between two neighbouring values is tried.

A tree grows level by level.  For its open nodes the class counts of every
(node, attribute, value) are added up once and summed along the values; the best
cut of a node is read off these prefix counts, and a table of the splits sends the
rows to the children.  A node of at most ``task_rows`` rows is finished inside one
task by the same rule, so the tree does not depend on where that happens.

Among equally good cuts the first attribute and then the lowest value wins.  A
node splits while it holds more than one class, is above ``max_depth`` and some
attribute has two values.  Rows with a missing feature or label teach nothing, and
a row with a missing feature gets no class.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import digest
from millrace.functions.ordering import join_unique
from millrace.functions.vectors import as_array, present
from millrace.session import cut_lineage

#: Rows of a node that one task finishes.
TASK_ROWS = 20_000
#: Ranges of an attribute's values, summed each by itself.
VALUE_RANGES = 256
#: Nodes that go to every task when rows are classified; larger forests are joined level by level.
BROADCAST_NODES = 200_000
#: Node 1 is the root, 2 i and 2 i + 1 are the children of i: a BIGINT holds so many levels.
MOST_LEVELS = 61

NODES = "tree int, node bigint, attribute int, threshold double, counts array<double>"
_NODE = [("tree", pa.int32()), ("node", pa.int64())]
COUNTED = pa.schema([*_NODE, ("counts", pa.list_(pa.float64()))])
CUTS = pa.schema([*_NODE, ("attribute", pa.int32()), ("threshold", pa.float64())])
CUT_NODES = pa.schema([*CUTS, ("counts", pa.list_(pa.float64()))])


def purity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """What the two sides of a cut add to its score, per row of class counts; more is purer."""
    total = counts.sum(axis=-1)
    if criterion == "gini":
        return (counts * counts).sum(axis=-1) / total
    parts = np.where(counts > 0, counts * np.log(np.where(counts > 0, counts, 1.0)), 0.0)
    return parts.sum(axis=-1) - total * np.log(total)


def _purity(counts: Sequence[Column], criterion: str) -> Column:
    total = sum(counts[1:], counts[0])
    if criterion == "gini":
        squares = [c * c for c in counts]
        return sum(squares[1:], squares[0]) / total
    parts = [F.when(c > 0, c * F.ln(c)).otherwise(0.0) for c in counts]
    return sum(parts[1:], parts[0]) - total * F.ln(total)


def midpoint(low: float, high: float) -> float:
    """Halfway; the lower value where rounding would reach the upper one."""
    middle = low + (high - low) / 2
    return low if middle >= high or not math.isfinite(middle) else middle


def _rank_key(seed: int, tree: int, node: int, attribute: int) -> str:
    """Orders the attributes of a node at random; the spelling of ``functions.hashing.digest``."""
    return hashlib.md5(f"{seed}:{tree}:{node}:{attribute}".encode()).hexdigest()


@dataclass(frozen=True)
class Growth:
    """How trees grow; ``subset`` attributes are tried at a node, all of them if None."""

    classes: int
    criterion: str
    max_depth: int
    subset: int | None
    seed: int

    def best_cut(self, tree: int, node: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[int, float] | None:
        """Attribute and threshold of a node's best cut, None if all rows are alike."""
        attributes = [a for a in range(x.shape[1]) if x[:, a].min() < x[:, a].max()]
        if self.subset is not None and len(attributes) > self.subset:
            attributes = sorted(sorted(attributes, key=lambda a: _rank_key(self.seed, tree, node, a))[: self.subset])
        best, found = -math.inf, None
        one_hot = np.zeros((len(y), self.classes))
        one_hot[np.arange(len(y)), y] = w
        total = one_hot.sum(axis=0)
        for a in attributes:
            order = np.argsort(x[:, a], kind="stable")
            values = x[order, a]
            ends = np.flatnonzero(values[1:] > values[:-1])
            left = np.cumsum(one_hot[order], axis=0)[ends]
            score = purity(left, self.criterion) + purity(total - left, self.criterion)
            i = int(score.argmax())
            if score[i] > best:
                best, found = score[i], (a, midpoint(values[ends[i]], values[ends[i] + 1]))
        return found

    def grow(self, tree: int, root: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Iterator[tuple]:
        """The nodes of a subtree."""
        todo = [(root, np.arange(len(y)))]
        while todo:
            node, rows = todo.pop()
            counts = np.bincount(y[rows], w[rows], self.classes)
            cut = None
            if (counts > 0).sum() > 1 and node.bit_length() <= self.max_depth:
                cut = self.best_cut(tree, node, x[rows], y[rows], w[rows])
            if cut is None:
                yield tree, node, -1, None, counts.tolist()
                continue
            yield tree, node, cut[0], cut[1], counts.tolist()
            left = x[rows, cut[0]] <= cut[1]
            todo += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]


def _totals(rows: DataFrame, k: int) -> DataFrame:
    counts = F.array(*[F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0.0)) for c in range(k)])
    return rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), counts.alias("counts"))


def _ranged(rows: DataFrame) -> DataFrame:
    """Adds ``ranges``: for each value of ``vec`` the number of one of at most ``VALUE_RANGES`` ranges of its attribute.

    The limits are near quantiles of the first tree's rows.  They tell where sums are made, not what they are.
    """
    features = len(rows.select("vec").first()[0])
    probs = [i / VALUE_RANGES for i in range(1, VALUE_RANGES)]
    quantiles = [F.percentile_approx(F.col("vec")[a], probs, 10 * VALUE_RANGES).alias(f"q{a}") for a in range(features)]
    limits = [np.unique(np.array(q or [], dtype=np.float64)) for q in rows.where("tree = 0").agg(*quantiles).first()]

    @F.pandas_udf("array<int>")
    def ranges(vec: pd.Series) -> pd.Series:
        x = np.vstack(vec.to_numpy()) if len(vec) else np.zeros((0, features))
        at = np.stack([np.searchsorted(of, x[:, a]) for a, of in enumerate(limits)], axis=1)
        return pd.Series(list(at.astype(np.int32)), dtype=object)

    return rows.withColumn("ranges", ranges("vec"))


def _splits(rows: DataFrame, totals: DataFrame, growth: Growth) -> DataFrame:
    """(tree, node, attribute, threshold): the best cuts of the nodes, found on summed class counts.

    Counts are summed along the values of a range, and along the ranges of a node's attribute.
    """
    k = growth.classes
    names = [f"c{c}" for c in range(k)]
    at, of_range = ["tree", "node", "attribute"], ["tree", "node", "attribute", "range"]
    long = rows.select("tree", "node", "y", "w", F.posexplode(F.arrays_zip("vec", "ranges")).alias("attribute", "value"))
    counts = cut_lineage(
        long.groupBy("tree", "node", "attribute", F.col("value.ranges").alias("range"), F.col("value.vec").alias("x"))
        .agg(*[F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0.0)).alias(n) for c, n in enumerate(names)])
    )
    ranges = counts.groupBy(*of_range).agg(F.min("x").alias("low"), F.max("x").alias("high"), *[F.sum(n).alias(n) for n in names])
    # a node's attribute has at most VALUE_RANGES rows here
    earlier = Window.partitionBy(*at).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*at)
    offsets = ranges.select(
        *of_range, F.max("high").over(earlier).alias("last"), F.min("low").over(whole).alias("low"), F.max("high").over(whole).alias("high"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0.0)).alias(f"{n}_off") for n in names],
    ).where("low < high").drop("low", "high")
    if growth.subset is not None:
        key = digest(growth.seed, F.col("tree"), F.col("node"), F.col("attribute"))
        # of the attributes that differ in a node
        rank = F.dense_rank().over(Window.partitionBy("tree", "node").orderBy(key, "attribute"))
        offsets = offsets.withColumn("rank", rank).where(F.col("rank") <= growth.subset).drop("rank")
    before = Window.partitionBy(*of_range).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.select(*of_range, "x", F.max("x").over(before).alias("previous"), *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(n) for n in names])
    summed = within.join(offsets, of_range).withColumn("below", F.coalesce("previous", "last")).where(F.col("below").isNotNull())
    sides = summed.join(F.broadcast(totals.select("tree", "node", F.col("counts").alias("all"))), ["tree", "node"])
    left = [F.col(n) + F.col(f"{n}_off") for n in names]
    right = [F.col("all")[c] - n for c, n in enumerate(left)]
    score = _purity(left, growth.criterion) + _purity(right, growth.criterion)
    best = sides.groupBy("tree", "node").agg(F.min(F.struct((-score).alias("s"), "attribute", "x", "below")).alias("b"))
    low, high = F.col("b.below"), F.col("b.x")
    middle = low + (high - low) / 2
    inside = (middle < high) & (F.abs(middle) < math.inf)
    return best.select("tree", "node", "b.attribute", F.when(inside, middle).otherwise(low).alias("threshold"))


def _small(spark: SparkSession, rows: Sequence[Mapping], schema: pa.Schema) -> DataFrame:
    """A table of a few rows that the driver holds: no job makes it."""
    return spark.createDataFrame(pa.Table.from_pylist([dict(r) for r in rows], schema))


def grow_trees(rows: DataFrame, growth: Growth, task_rows: int = TASK_ROWS) -> DataFrame:
    """The nodes of all trees over rows (tree, y, w, vec); attribute -1 marks a leaf."""
    spark = rows.sparkSession
    fields = ["tree", "node", "y", "w", "vec"]
    rows = cut_lineage(rows.select("tree", F.lit(1).cast("bigint").alias("node"), "y", "w", "vec"))
    # nodes of more than task_rows rows: a level has at most all rows / task_rows of them
    found: list[dict] = []
    levels: list[DataFrame] = []

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(pdf["vec"].to_numpy()).astype(np.float64)
        nodes = growth.grow(int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0]), x, pdf["y"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame(list(nodes), columns=["tree", "node", "attribute", "threshold", "counts"])

    while True:
        large = [r.asDict() for r in _totals(rows, growth.classes).where(F.col("n") > task_rows).collect()]
        if large and not levels:
            rows = cut_lineage(_ranged(rows))
        levels.append(rows.select(*fields))
        # a node of level l has l binary digits
        open_ = [r for r in large if sum(c > 0 for c in r["counts"]) > 1 and r["node"].bit_length() <= growth.max_depth]
        cuts: list[dict] = []
        if open_:
            at = F.broadcast(_small(spark, open_, COUNTED))
            cuts = [r.asDict() for r in _splits(rows.join(at.select("tree", "node"), ["tree", "node"], "left_semi"), at, growth).collect()]
        known = {(c["tree"], c["node"]): c for c in cuts}
        leaf = {"attribute": -1, "threshold": None}
        found += [{**leaf, **r, **known.get((r["tree"], r["node"]), {})} for r in large]
        if not cuts:
            break
        side = F.when(F.col("vec")[F.col("attribute")] <= F.col("threshold"), 0).otherwise(1)
        sent = rows.join(F.broadcast(_small(spark, cuts, CUTS)), ["tree", "node"])
        rows = cut_lineage(sent.select("tree", (2 * F.col("node") + side).alias("node"), "y", "w", "vec", "ranges"))
    ready = reduce(DataFrame.unionByName, levels)
    if not found:
        return ready.groupBy("tree", "node").applyInPandas(finish, NODES)
    nodes = _small(spark, found, CUT_NODES)
    # one join for the rows of all levels: an anti join would be made in each of them
    above = F.broadcast(nodes.select("tree", "node", F.lit(True).alias("above")))
    ready = ready.join(above, ["tree", "node"], "left").where(F.col("above").isNull()).select(*fields)
    return nodes.select("tree", "node", "attribute", "threshold", "counts").unionByName(ready.groupBy("tree", "node").applyInPandas(finish, NODES))


@dataclass(frozen=True)
class Forest:
    """Grown trees; a row's class probabilities are the means of its leaves' class shares."""

    nodes: DataFrame
    features: tuple[str, ...]
    classes: tuple
    n_trees: int

    def _vec(self) -> Column:
        return F.array(*[present(f) for f in self.features])

    def predict_probability(self, df: DataFrame) -> DataFrame:
        if self.nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
            return self._walked(df)
        return self._joined(df)

    def _walked(self, df: DataFrame) -> DataFrame:
        known = self.nodes.orderBy("tree", "node").toPandas()
        trees = [_Arrays(part) for _, part in known.groupby("tree")]
        k = len(self.classes)

        @F.pandas_udf("array<double>")
        def probability(vec: pd.Series) -> pd.Series:
            # missing features arrive as NaN
            x = np.vstack(vec.to_numpy()).astype(np.float64) if len(vec) else np.zeros((0, 1))
            whole = ~np.isnan(x).any(axis=1)
            total = np.zeros((len(x), k))
            for tree in trees:
                total[whole] += tree.shares(x[whole])
            total /= max(len(trees), 1)
            return pd.Series([t.tolist() if w else None for t, w in zip(total, whole)], dtype=object)

        # a list of NULLs would be no list of numbers
        vec = F.transform(self._vec(), lambda v: F.coalesce(v, F.lit(float("nan"))))
        return df.withColumn("probability", probability(vec))

    def _joined(self, df: DataFrame) -> DataFrame:
        """The rows of every tree join its nodes, a level at a time."""
        k = len(self.classes)
        numbered = cut_lineage(df.withColumn("row_", F.monotonically_increasing_id()))
        vec = self._vec()
        whole = F.forall(vec, lambda v: v.isNotNull())
        at = numbered.where(whole).select("row_", vec.alias("vec_"), F.lit(1).cast("bigint").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(self.n_trees - 1))).alias("tree"))
        leaves = None
        while True:
            visits = at.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"))
            met = cut_lineage(join_unique(at, self.nodes.join(visits, ["tree", "node"]), ["tree", "node"], "n"))
            ended = met.where("attribute < 0").select("row_", "counts")
            leaves = ended if leaves is None else leaves.unionByName(ended)
            side = F.when(F.col("vec_")[F.col("attribute")] <= F.col("threshold"), 0).otherwise(1)
            at = met.where("attribute >= 0").select("row_", "vec_", (2 * F.col("node") + side).alias("node"), "tree")
            if at.isEmpty():
                break
        total = F.aggregate("counts", F.lit(0.0), lambda s, c: s + c)
        shares = leaves.groupBy("row_").agg(*[F.sum(F.col("counts")[c] / total).alias(f"p{c}") for c in range(k)])
        shares = shares.select("row_", F.array(*[F.col(f"p{c}") / F.lit(float(self.n_trees)) for c in range(k)]).alias("probability"))
        return numbered.join(shares, "row_", "left").select(*df.columns, "probability")

    def predict(self, df: DataFrame) -> DataFrame:
        scores = F.transform("probability", lambda p: F.round(p, 9))
        best = F.array_position(scores, F.array_max(scores)) - 1
        label = F.get(F.array(*[F.lit(c) for c in self.classes]), best.cast("int"))
        return self.predict_probability(df).withColumn("prediction", label).select(*df.columns, "prediction")


class _Arrays:
    """A tree as arrays, its nodes in order."""

    def __init__(self, nodes: pd.DataFrame) -> None:
        self.ids = nodes["node"].to_numpy()
        self.attribute = nodes["attribute"].to_numpy()
        self.threshold = nodes["threshold"].to_numpy(dtype=np.float64)
        counts = np.vstack(nodes["counts"].to_numpy()).astype(np.float64)
        self.share = counts / counts.sum(axis=1, keepdims=True)
        self.left = np.searchsorted(self.ids, 2 * self.ids)
        self.right = np.searchsorted(self.ids, 2 * self.ids + 1)

    def shares(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        going = np.flatnonzero(self.attribute[at] >= 0)
        while len(going):
            here = at[going]
            low = x[going, self.attribute[here]] <= self.threshold[here]
            at[going] = np.where(low, self.left[here], self.right[here])
            going = going[self.attribute[at[going]] >= 0]
        return self.share[at]


def fit_trees(
    df: DataFrame, features: Sequence[str], y: Column, classes: Sequence, criterion: str, max_depth: int,
    weight: Column | None = None, n_trees: int = 1, subset: int | None = None, seed: int = 0, task_rows: int = TASK_ROWS,
) -> Forest:
    """Trees over the rows; ``weight`` may use the column ``tree`` and leaves rows out where it is 0."""
    if criterion not in ("gini", "entropy"):
        raise ValueError(f"criterion must be 'gini' or 'entropy', not {criterion!r}")
    if not 0 <= max_depth < MOST_LEVELS:
        raise ValueError(f"a tree has at most {MOST_LEVELS - 1} levels of splits")
    values = F.array(*[present(f) for f in features])
    whole = F.forall(values, lambda v: v.isNotNull())
    rows = df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    weighed = rows.select("tree", y.cast("int").alias("y"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w"), as_array(features).alias("vec"), whole.alias("whole"))
    taught = weighed.where("whole AND y IS NOT NULL AND w > 0").drop("whole")
    growth = Growth(len(classes), criterion, max_depth, subset, seed)
    return Forest(cut_lineage(grow_trees(taught, growth, task_rows)), tuple(features), tuple(classes), n_trees)
