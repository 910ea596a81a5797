"""Class balancing, train/test split and stratified folds.

Every choice depends on the row key and a seed only, so a recomputed partition
picks the same rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.hashing import hash_key, uniform
from millrace.functions.ordering import group_bounds, hash_bounds, order_statistics, running_counts, smallest_per_group
from millrace.functions.vectors import as_array
from millrace.operators.neighbors import approx_sq, knn, matrix, place_near_pivots, row_chunks

#: Rows whose neighbours' vectors one task of SMOTE hands back.
VECTOR_QUERIES = 8_192


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def counts_by_class(df: DataFrame, label: str) -> dict[object, int]:
    return {r[label]: r["n"] for r in class_counts(df.where(F.col(label).isNotNull()), label).collect()}


def frequency_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """(label, n_before, n_after)."""
    return class_counts(before, label).withColumnRenamed("n", "n_before").join(
        class_counts(after, label).withColumnRenamed("n", "n_after"), label, "full"
    )


def not_balanced(df: DataFrame, **_) -> DataFrame:
    return df


def random_undersample(
    df: DataFrame, label: str, row_id: str, caps: Mapping[object, int] | None = None, seed: int = 0
) -> DataFrame:
    """Each class cut to ``min(cap, count)`` rows, or all to the smallest class; rows without a label stay."""
    if caps is None:
        counts = counts_by_class(df, label)
        quota = {c: min(counts.values()) for c in counts}
    else:
        quota = dict(caps)
    keyed = df.withColumn("key_", hash_key(seed, row_id))
    return smallest_per_group(keyed, label, "key_", row_id, quota, hashed=True).drop("key_")


def _numbered(copies: DataFrame, rows: DataFrame, row_id: str, most: int) -> tuple[DataFrame, int]:
    """``copies`` with ``number_``, and the key below which ``most`` keys per number are free."""
    low, high = rows.agg(F.min(row_id), F.max(row_id)).first()
    whole_type = rows.schema[row_id].dataType
    limit = {"tinyint": 7, "smallint": 15, "int": 31}.get(whole_type.simpleString(), 63)
    if low is None or (low >= 0 and (high + 1) * most < 1 << limit):
        return copies.withColumn("number_", F.col(row_id).cast("bigint")), 0
    if -min(low, 0) + (rows.count() + 1) * most >= 1 << limit:
        raise ValueError(f"{row_id} leaves no room for keys of synthetic rows below {low}")
    ids = rows.select(F.lit(0).alias("g_"), F.col(row_id).alias("numbered_")).distinct().withColumn("one_", F.lit(1))
    numbers = running_counts(ids, "g_", "numbered_", ["one_"]).select("numbered_", F.col("one__before").cast("bigint").alias("number_"))
    return copies.join(numbers, F.col(row_id) == F.col("numbered_"), "left").drop("numbered_"), min(low, 0)


def smote(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    targets: Mapping[object, int] | None = None,
    k: int = 5,
    seed: int = 0,
    chunk: int = 10_000,
) -> DataFrame:
    """Adds synthetic rows until every class reaches the largest one (or its target).

    Each new row lies between a row and one of its k nearest rows of the class.
    The copies are dealt out evenly: every row gets ``need // n`` of them and the
    rows with the smallest hash one more.  Synthetic rows carry ``synthetic =
    true`` and negative keys made from those of their rows; where keys are negative
    or too large for that, they are counted down from the smallest key instead.
    """
    features = list(features)
    counts = counts_by_class(df, label)
    goal = {
        c: max(targets.get(c, n), n) if targets is not None else max(counts.values()) for c, n in counts.items()
    }
    need = {c: goal[c] - n for c, n in counts.items() if goal[c] > n}
    base = df.select(row_id, label, *features)
    real = base.withColumn("synthetic", F.lit(False))
    if not need:
        return real
    label_field = T.StructField(label, df.schema[label].dataType)
    shares = df.sparkSession.createDataFrame(
        [(c, m // counts[c]) for c, m in need.items()],
        T.StructType([label_field, T.StructField("share_", T.LongType())]),
    )
    # one row per growing class
    members = base.join(F.broadcast(shares), label).withColumn("key_", hash_key(f"{seed}:extra", row_id))
    lucky = smallest_per_group(
        members, label, "key_", row_id, {c: m % counts[c] for c, m in need.items()}, hashed=True
    )
    most = max(m // counts[c] + 1 for c, m in need.items())
    copies = members.join(
        lucky.select(F.col(row_id).alias("lucky_")), F.col(row_id) == F.col("lucky_"), "left"
    ).withColumn("copies_", F.col("share_") + F.col("lucky_").isNotNull().cast("int"))
    copies, top = _numbered(copies, base, row_id, most)
    vectors = members.select(F.col(row_id).alias("row_id"), as_array(features).alias("vec"), F.col(label).alias("class_"))
    # the neighbour brings its vector along: joining it in later by its key would
    # send all copies made towards a popular neighbour to one task
    # a task hands back k vectors a query, so it gets fewer queries than it could compare
    near = knn(vectors, vectors, k, group="class_", exclude_self=True, carry="vec", query_block=VECTOR_QUERIES)
    # at most k neighbours per row
    lists = near.groupBy(F.col("row_id").alias("near_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec"))), lambda s: s["vec"]).alias("near_")
    )
    grown = copies.where(F.col("copies_") > 0).join(lists, F.col(row_id) == F.col("near_id"), "left")
    grown = grown.withColumn("from_", F.explode(F.sequence(F.lit(0), F.col("copies_") - 1, F.lit(chunk))))
    if most > chunk:
        # a row with very many copies is spread over tasks before they are written out
        grown = grown.repartition(row_id, "from_")
    grown = grown.withColumn(
        "copy_", F.explode(F.sequence(F.col("from_"), F.least(F.col("from_") + chunk, F.col("copies_")) - 1))
    )
    pick = F.floor(uniform(f"{seed}:near", row_id, "copy_") * F.size("near_")).cast("int")
    grown = grown.withColumns(
        {"to_": F.when(F.size("near_") > 0, F.get("near_", pick)), "step_": uniform(f"{seed}:step", row_id, "copy_")}
    )
    made = grown.select(
        (F.lit(top) - (F.col("number_") * F.lit(most) + F.col("copy_")) - 1).cast(df.schema[row_id].dataType).alias(row_id),
        label,
        *[
            (F.col(f) + F.col("step_") * (F.coalesce(F.col("to_")[i], F.col(f)) - F.col(f))).alias(f)
            for i, f in enumerate(features)
        ],
        F.lit(True).alias("synthetic"),
    )
    return real.withColumns({f: F.col(f).cast("double") for f in features}).unionByName(made)


def _lloyd(x: np.ndarray, k: int, max_iter: int) -> np.ndarray:
    """k centres of a bounded block, started from evenly spaced rows and moved until they stand still."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(max_iter):
        near = np.concatenate([approx_sq(x[part], centres)[0].argmin(axis=1) for part in row_chunks(len(x), k)])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        if np.allclose(moved, centres, rtol=1e-9, atol=1e-12):
            return moved
        centres = moved
    raise RuntimeError(f"centres did not settle in {max_iter} rounds")


def _quotas(sizes: Sequence[int], k: int) -> list[int]:
    """k shared out in proportion to the sizes, largest remainders first."""
    exact = [k * n / sum(sizes) for n in sizes]
    out = [math.floor(e) for e in exact]
    for i in sorted(range(len(sizes)), key=lambda i: (out[i] - exact[i], i))[: k - sum(out)]:
        out[i] += 1
    return out


def _centres_in_blocks(
    rows: DataFrame, features: Sequence[str], k: int, first_id: int, max_iter: int, block_rows: int
) -> DataFrame:
    """k centres of a table of any size.

    Near rows are placed into blocks of at most about ``block_rows`` rows, each
    block gets its share of the centres and finds them on its own.
    """
    points = rows.select(F.col("id_").alias("row_id"), as_array(features).alias("vec"))
    n = points.count()
    placed = place_near_pivots(points, math.ceil(n / block_rows))
    cells = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {c: math.ceil(m / block_rows) for c, m in cells.items()}
    # a crowded cell is cut by the hash of the key
    cut = F.create_map(*[F.lit(v) for c, m in parts.items() for v in (c, m)])
    blocks = placed.withColumn("part", F.pmod(F.xxhash64("row_id"), cut[F.col("cell")].cast("bigint")).cast("int"))
    sizes = sorted((r["cell"], r["part"], r["n"]) for r in blocks.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")).collect())
    quota = _quotas([s[2] for s in sizes], k)
    starts = [first_id + sum(quota[:i]) for i in range(len(quota))]
    shares = rows.sparkSession.createDataFrame(
        [(c, p, q, s) for (c, p, _), q, s in zip(sizes, quota, starts)], "cell int, part int, quota int, start bigint"
    )

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        found = _lloyd(matrix(pdf["vec"]), int(pdf["quota"].iloc[0]), max_iter)
        ids = -(pdf["start"].iloc[0] + np.arange(len(found))) - 1
        return pd.DataFrame({"id_": ids, **{f: found[:, i] for i, f in enumerate(features)}})

    schema = ", ".join(["id_ bigint", *[f"`{f}` double" for f in features]])
    # one row per block
    return (
        blocks.join(F.broadcast(shares.where("quota > 0")), ["cell", "part"])
        .groupBy("cell", "part")
        .applyInPandas(centres, schema)
    )


def cluster_centroids(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    k: int | None = None,
    seed: int = 0,
    max_iter: int = 1_000,
    block_rows: int = 20_000,
) -> DataFrame:
    """Every class but the smallest replaced by the centres of its k clusters.

    k defaults to the size of the smallest class.  The clusters are found in
    blocks of near rows (one block up to ``block_rows`` rows), each until its
    centres stand still.  Centres carry negative keys.
    """
    features = list(features)
    counts = counts_by_class(df, label)
    k = k or min(counts.values())
    shrunk = [c for c in sorted(counts, key=str) if counts[c] > k]
    doubles = [F.col(f).cast("double").alias(f) for f in features]
    out = df.where(F.col(label).isin([c for c in counts if c not in shrunk])).select(row_id, label, *doubles)
    schema = out.schema
    for i, c in enumerate(shrunk):
        part = df.where(F.col(label) == F.lit(c)).select(F.col(row_id).alias("id_"), *doubles)
        found = _centres_in_blocks(part, features, k, i * k, max_iter, block_rows)
        found = found.select(F.col("id_").cast(schema[row_id].dataType).alias(row_id), F.lit(c).cast(schema[label].dataType).alias(label), *features)
        out = out.unionByName(found)
    return out


def combined(
    df: DataFrame, features: Sequence[str], label: str, row_id: str, targets: Mapping[object, int], seed: int = 0
) -> DataFrame:
    """Grows classes below their target with synthetic rows and cuts those above it."""
    grown = smote(df, features, label, row_id, targets=targets, seed=seed)
    return random_undersample(grown, label, row_id, caps=targets, seed=seed)


def train_test_split(df: DataFrame, row_id: str, test_size: float = 0.3, seed: int = 420, limit: int | None = None) -> DataFrame:
    """Adds ``is_test``: exactly ``ceil(test_size * n)`` rows with the smallest hash.

    ``limit`` keeps only that many training rows.
    """
    keyed = df.withColumns({"g_": F.lit(0), "key_": hash_key(seed, row_id)})
    bounds = hash_bounds(keyed, "g_")
    if not bounds:
        return df.withColumn("is_test", F.lit(False))
    n = bounds[0].n
    n_test = math.ceil(test_size * n)
    wanted = [r for r in (n_test - 1, n_test + (limit or n) - 1) if 0 <= r < n]
    found = order_statistics(keyed, "g_", "key_", bounds, {0: wanted})
    for r in wanted:
        if found[(0, r)].rows_up_to != r + 1:
            # equal hashes at the cut: an independent second hash decides
            return train_test_split(df, row_id, test_size, seed + 1_000_003, limit)
    test = F.lit(False) if n_test == 0 else F.col("key_") <= F.lit(found[(0, n_test - 1)].value)
    out = keyed.withColumn("is_test", test)
    if limit is not None and n_test + limit < n:
        out = out.where(F.col("key_") <= F.lit(found[(0, n_test + limit - 1)].value))
    return out.drop("g_", "key_")


def fold_sizes(counts: Sequence[int], k: int) -> list[list[int]]:
    """Per class the rows of each fold, with the classes laid end to end.

    A fold takes as many rows of a class as the class has positions p with
    p mod k equal to the fold number.
    """
    sizes, start = [], 0
    for n in counts:
        sizes.append([(start + n - 1 - i) // k - (start - 1 - i) // k for i in range(k)])
        start += n
    return sizes


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int = 5) -> DataFrame:
    """Adds ``fold``: contiguous key ranges per class; a row without a label is in no fold (NULL).

    The range ends are found by counting, so no task sorts a class.
    """
    bounds = group_bounds(df.where(F.col(label).isNotNull()), label, row_id)
    order = sorted(bounds, key=lambda c: bounds[c].lo)
    sizes = fold_sizes([bounds[c].n for c in order], k)
    starts = {c: list(itertools.accumulate(s))[:-1] for c, s in zip(order, sizes)}
    ranks = {c: [r for r in rs if r < bounds[c].n] for c, rs in starts.items()}
    found = order_statistics(df, label, row_id, bounds, ranks)
    key_type = df.schema[row_id].dataType
    schema = T.StructType(
        [T.StructField(label, df.schema[label].dataType)]
        + [T.StructField(f"cut{i}_", key_type) for i in range(1, k)]
    )
    cuts = [
        (c, *[found[(c, r)].value if (c, r) in found else None for r in starts[c]]) for c in order
    ]
    fold = F.lit(0)
    for i in range(1, k):
        fold = fold + F.coalesce((F.col(row_id) >= F.col(f"cut{i}_")).cast("int"), F.lit(0))
    # one row per class
    return (
        df.join(F.broadcast(df.sparkSession.createDataFrame(cuts, schema)), label, "left")
        .withColumn("fold", F.when(F.col(label).isNotNull(), fold))
        .select(*df.columns, "fold")
    )
