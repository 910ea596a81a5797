"""SimHash near-duplicates, candidates pruned by chains of segments around a ring.

Cut 64 bits into m segments on a ring.  If two fingerprints differ in at most t
bits, some segment starts a chain in which the differences of the first l
segments stay within l * t / m for every l.  The first segments of such a chain
have a budget below one, so they are equal: they are the join key.  The longer
chains are checked before the full Hamming distance.

A key held by more fingerprints than ``crowd`` is not compared pair by pair: each
of its fingerprints emits its one-bit variants, of which two fingerprints share
one if and only if they differ in at most two bits, and at most 65 can share one.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import as_bytes, row_key, stored
from millrace.operators.components import components

BITS = 2
SEGMENTS = 7
CROWD = 128
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_of(text: bytes, words: int = 3) -> int:
    tokens = text.translate(LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens), lambda a, b: a + 1 + b))
    starts = [0] + [e + 1 for e in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(tokens) < words:
        return digest(joined, 42)
    n = len(tokens) - words + 1
    h = np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])], "<u8", n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        some = h[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """The fingerprint's 64 bits as a signed number."""
    return pa.array(np.array([fingerprint_of(t.as_py()) for t in texts], "<u8").view("<i8"))


def ring(m: int) -> list[tuple[int, int]]:
    """(first bit, width) of m segments of 64 bits, as equal as can be."""
    edges = [round(k * 64 / m) for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def mask(segments: list[tuple[int, int]], start: int, length: int) -> int:
    """Bits of ``length`` segments from ``start`` on, as a signed number."""
    bits = 0
    for k in range(length):
        first, width = segments[(start + k) % len(segments)]
        bits |= ((1 << width) - 1) << first
    return bits - (1 << 64) if bits >> 63 else bits


def chain_keys(m: int, bits: int) -> int:
    """How many segments at the start of a chain must be equal: those whose budget is below one difference."""
    return max(k for k in range(m + 1) if k * bits < m)


def links(prints: DataFrame, bits: int = BITS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(u, v), u > v: pairs of distinct fingerprints ``fp``, each within ``bits`` differing bits.

    Pairs that share only crowded keys are given through a common neighbour: each
    is linked to the smallest fingerprint around a shared one-bit variant, so the
    classes are those of all links.
    """
    if bits != 2:
        raise ValueError("one-bit variants decide distances of up to two bits")
    cut = ring(segments)
    equal = chain_keys(segments, bits)
    keyed = stored(
        prints.select(
            "fp",
            F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(mask(cut, k, equal))) for k in range(segments)])).alias(
                "seg", "key"
            ),
        ),
        "keys",
    )
    crowded = keyed.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    quiet = keyed.join(crowded.select("seg", "key"), ["seg", "key"], "left_anti")
    a, b = quiet.select("seg", "key", F.col("fp").alias("u")), quiet.select("seg", "key", F.col("fp").alias("v"))
    differ = F.col("u").bitwiseXOR(F.col("v"))

    def within(start: int) -> Column:
        ok = F.lit(True)
        for length in range(equal + 1, segments):
            budget = length * bits // segments
            # a longer chain with the same budget says more
            if length + 1 == segments or (length + 1) * bits // segments > budget:
                ok = ok & (F.bit_count(differ.bitwiseAND(F.lit(mask(cut, start, length)))) <= budget)
        return ok

    chain = F.lit(False)
    for k in range(segments):
        chain = chain | ((F.col("seg") == k) & within(k))
    near = (
        a.join(b, ["seg", "key"])
        .where((F.col("u") > F.col("v")) & chain & (F.bit_count(differ) <= bits))
        .select("u", "v")
    )
    flocks = keyed.join(crowded.select("seg", "key"), ["seg", "key"], "left_semi").select("fp").distinct()
    variants = flocks.select(
        "fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k)) for k in range(64)])).alias("variant")
    )
    least = variants.groupBy("variant").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    around = variants.join(least.select("variant", "v"), "variant").where(F.col("fp") > F.col("v")).select(F.col("fp").alias("u"), "v")
    return near.unionByName(around).distinct()


def classes(prints: DataFrame, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(fp, root) for every fingerprint that has a link; root is the smallest fingerprint reachable."""
    return components(links(prints, segments=segments, crowd=crowd)).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def _grouped(rows: DataFrame, order: Column, segments: int, crowd: int) -> DataFrame:
    """(fp, first): the smallest ``order`` among all rows of the fingerprint's class."""
    prints = stored(rows.groupBy("fp").agg(F.min(order).alias("least")), "prints")
    root = prints.join(classes(prints.select("fp"), segments, crowd), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    root = stored(root, "roots")
    best = root.groupBy("root").agg(F.min("least").alias("first"))
    return root.join(best, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint, component_id per row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other.  Repeated
    rows are rows like others; a null id is never a component's smallest id, so a
    class without ids has a null component_id.  An empty table gives no rows.
    Other columns are not read.
    """
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(as_bytes(text)).alias("fp")), "fingerprints")
    found = _grouped(rows, F.col("doc_id"), segments, crowd)
    return rows.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """One row of ``docs`` per class, all columns as they are: that with the smallest id, rows without id last.

    Among rows with equal id (or none) the text's hash decides; rows equal in both
    are one.
    """
    k1, k2 = row_key(doc_id, text)
    order = F.struct(F.col(doc_id).isNull().alias("a"), F.col(doc_id).alias("b"), k1.alias("k1"), k2.alias("k2"))
    rows = stored(docs.select(order.alias("order"), fingerprint(as_bytes(text)).alias("fp")), "fingerprints")
    kept = _grouped(rows, F.col("order"), segments, crowd).select("first.k1", "first.k2").distinct()
    named = docs.select(F.struct("*").alias("row_"), k1.alias("k1"), k2.alias("k2"))
    return named.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row_.*")
