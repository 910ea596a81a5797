"""Spelling variants: words one edit apart, found by walking all words through one trie, level by level.

The trie of the vocabulary is a table of edges (node, letter, child); its nodes
are the prefixes that two words or more share, and an edge below which one word is
left is a leaf and holds that word.  The frontier is a table of states (word,
position, node, edits); each level joins it with the edges of that depth.  A state
without edits, a word at its own prefix, spends its edit on any later letter below
the node (replacement) or skips its own letter (deletion); a state with one edit
follows its own letter.  At a leaf or a word's end with one edit and equal rests
the state ends in a neighbour.  As the relation is symmetric, a replacement is
walked from the smaller and a deletion from the longer word, so that every pair is found once.

Words of more than ``TRIE_POINTS`` code points would need as many levels.  Pairs
of such words are joined exactly on hashes of the word without one of its points.

Nodes of a depth are told by 64 bits.  Nulls in text read as no words, a null id
as an empty one.  Repeated rows count as often as they stand.  An empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, stored
from millrace.llm.substrings import inverse, mixed, powers
from millrace.session import cut_lineage

#: A word has so many code points and occurrences at least.
LEAST_POINTS = 7
LEAST_COUNT = 2
#: One in so many (document, run) pairs loses a code point.
DROPPED = 31
#: A form occurs so many times as often as the word.
FORM_FACTOR = 10
#: Words of up to so many code points walk the trie.
TRIE_POINTS = 64
#: Edges of a depth that may go to every task, of a few dozen bytes and a word of ``TRIE_POINTS`` at most, and levels of one job.
BROADCAST_EDGES = 50_000
LEVELS_AT_ONCE = 4
#: Counts that a task holds before it passes them on.
HELD_COUNTS = 200_000

LOWER = bytes((c | 32) if chr(c).isalpha() else c for c in range(128)) + bytes(range(128, 256))
RUNS = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_POINTS)
COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def words_of(doc_id: str, text: bytes) -> dict[str, int]:
    """Occurrences of the words of one document, dropped code points applied."""
    out: dict[str, int] = {}
    for run, n in Counter(RUNS.findall(text.translate(LOWER).decode("utf-8", "replace"))).items():
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % DROPPED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_POINTS:
                continue
        out[run] = out.get(run, 0) + n
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], schema=COUNTED)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for word, n in words_of(doc_id, text.as_py()).items():
                held[word] = held.get(word, 0) + n
            if len(held) >= HELD_COUNTS:
                yield rows()
                held = {}
    if held:
        yield rows()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough in all texts."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), as_bytes("text").alias("text"))
    counts = texts.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _node(word: str, depth: Column) -> Column:
    """The node of a word's prefix."""
    return F.xxhash64(F.col(word).substr(F.lit(1), depth))


def _letter(word: str, at: Column) -> Column:
    """The code point at a place counted from 0, empty behind the end."""
    return F.col(word).substr(at + F.lit(1), F.lit(1))


def trie(words: DataFrame) -> DataFrame:
    """(depth, node, c, child, words, only, only_n): the edges of all nodes; ``only`` is the one word below a leaf."""
    at = F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("depth")
    steps = words.select("word", "n", at).select(
        "depth",
        _node("word", F.col("depth")).alias("node"),
        _letter("word", F.col("depth")).alias("c"),
        _node("word", F.col("depth") + F.lit(1)).alias("child"),
        "word", "n",
    )
    edges = steps.groupBy("depth", "node", "c").agg(
        F.first("child").alias("child"), F.count(F.lit(1)).alias("words"), F.min(F.struct("word", "n")).alias("only")
    )
    single = F.col("words") == 1
    return edges.select(
        "depth", "node", "c", "child", "words", F.when(single, F.col("only.word")).alias("only"), F.when(single, F.col("only.n")).alias("only_n")
    )


def _followed(joined: DataFrame, depth: int, pos: Column) -> DataFrame:
    """States with one edit beside the edge they take, having used the word's code points before ``pos``.

    Over an inner edge they go on; at a leaf they end, in a neighbour if the rests are equal.
    """

    def rest(word: str, start: Column) -> Column:
        return F.col(word).substr(start, F.char_length(word))

    met = (F.col("words") == 1) & (rest("only", F.lit(depth + 2)) == rest("word", pos + F.lit(1)))
    ended = F.col("other").isNotNull()
    states = joined.select(
        "word", "n", pos.alias("pos"), F.when(F.col("words") > 1, F.col("child")).alias("node"),
        F.when(ended, F.col("other")).when(met, F.col("only")).alias("other"),
        F.when(ended, F.col("other_n")).when(met, F.col("only_n")).alias("other_n"),
    )
    return states.where(F.col("node").isNotNull() | F.col("other").isNotNull())


def _step(states: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """States with one edit along their own letter; those that have ended have no node and stay."""
    own = states.withColumn("own_", _letter("word", F.col("pos")))
    to = edges.select(F.col("node").alias("node_"), "c", "child", "words", "only", "only_n")
    joined = own.join(to, (F.col("node") == F.col("node_")) & (F.col("own_") == F.col("c")), "left")
    return _followed(joined, depth, F.col("pos") + F.lit(1))


def _spent(words: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """States that spend their edit at this depth: the states without edits are the words at their own prefixes."""
    none = (F.lit(None).cast("string").alias("other"), F.lit(None).cast("bigint").alias("other_n"))
    own = _letter("word", F.lit(depth))
    before = _letter("word", F.lit(depth - 1)) if depth else F.lit("")
    here = words.where(F.char_length("word") > depth).select("word", "n", _node("word", F.lit(depth)).alias("node"), *none)
    to = edges.select(F.col("node").alias("node_"), "c", "child", "words", "only", "only_n")
    behind = _letter("word", F.lit(depth + 1))
    # another edge than the own one: a later letter replaces it, or the letter behind follows if it is skipped;
    # of equal letters in a row the first is skipped
    replaced = F.col("c") > own
    skipped = (F.col("c") == behind) & (own != before)
    ways = F.filter(F.array(F.when(replaced, F.lit(depth + 1)), F.when(skipped, F.lit(depth + 2))), lambda x: x.isNotNull())
    joined = here.join(to, (F.col("node") == F.col("node_")) & (replaced | skipped)).withColumn("used_", F.explode(ways))
    return _followed(joined, depth, F.col("used_"))


def _groups(sizes: dict[int, int]) -> list[list[int]]:
    """Levels in order; up to ``LEVELS_AT_ONCE`` neighbouring ones with few edges go in one job."""
    out: list[list[int]] = []
    for depth in range(max(sizes, default=-1) + 1):
        small = sizes.get(depth, 0) <= BROADCAST_EDGES
        if small and out and len(out[-1]) < LEVELS_AT_ONCE and sizes.get(out[-1][-1], 0) <= BROADCAST_EDGES:
            out[-1].append(depth)
        else:
            out.append([depth])
    return out


def trie_neighbours(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each unordered pair of words one edit apart once."""
    edges = trie(words)
    inner = F.sum("words").over(Window.partitionBy("depth", "node")) > 1
    # below a leaf there is nothing to walk
    edges = stored(edges.withColumn("inner_", inner).where("inner_").drop("inner_"), "trie", "depth")
    # one row per depth, TRIE_POINTS + 1 at most
    sizes = {r["depth"]: r["n"] for r in edges.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = words.sparkSession.createDataFrame([], "word string, n bigint, other string, other_n bigint")
    frontier: DataFrame | None = None
    for group in _groups(sizes):
        parts = [] if frontier is None else [frontier]
        for depth in group:
            at = edges.where(F.col("depth") == depth)
            at = F.broadcast(at) if sizes.get(depth, 0) <= BROADCAST_EDGES else at
            parts = [_step(p, at, depth) for p in parts] + [_spent(words, at, depth)]
        level = stored(reduce(DataFrame.unionByName, parts), "frontier")
        out = out.unionByName(level.where(F.col("other").isNotNull()).select("word", "n", "other", "other_n"))
        frontier = level.where(F.col("other").isNull())
    return out


# ---- words too long for the trie

SIGNED = pa.schema([("id", pa.int64()), ("at", pa.int32()), ("hash", pa.int64())])
BASE = np.uint64(0x9E3779B97F4A7C15)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each word whole (at -1) and without each of its code points."""
    for batch in batches:
        for word_id, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = mixed(np.array([ord(c) for c in word], np.uint64) + np.uint64(1))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * powers(BASE, len(x)), dtype=np.uint64)))
            without = sums[:-1] + (sums[-1] - sums[1:]) * inverse(BASE)
            hashes = mixed(np.concatenate((sums[-1:], without))).view(np.int64)
            at = np.arange(-1, len(x), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), word_id)), pa.array(at), pa.array(hashes)], schema=SIGNED)


def long_neighbours(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) as of the trie, by hashes of the words without one code point.

    A hash is shared by words that differ in one place only, at most one per letter.
    """
    known = words.withColumn("id", F.xxhash64("word"))
    signs = known.select("id", "word").mapInArrow(_signed, "id bigint, at int, hash bigint")
    whole_, less = signs.where("at < 0"), signs.where("at >= 0")
    replaced = less.alias("a").join(less.alias("b"), (F.col("a.hash") == F.col("b.hash")) & (F.col("a.at") == F.col("b.at")))
    replaced = replaced.where(F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.id").alias("other_id"), F.col("a.at").alias("at"), F.lit(True).alias("same"))
    deleted = less.alias("a").join(whole_.alias("b"), F.col("a.hash") == F.col("b.hash"))
    # a run of equal letters gives one hash
    deleted = deleted.groupBy(F.col("a.id").alias("id"), F.col("b.id").alias("other_id")).agg(F.min("a.at").alias("at")).withColumn("same", F.lit(False))
    told = (
        replaced.unionByName(deleted)
        .join(known, "id")
        .join(known.select(F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n")), "other_id")
    )

    def without(word: str) -> Column:
        w, at = F.col(word), F.col("at")
        return F.concat(w.substr(F.lit(1), at), w.substr(at + F.lit(2), F.char_length(w)))

    checked = told.where(without("word") == F.when(F.col("same"), without("other")).otherwise(F.col("other")))
    return checked.select("word", "n", "other", "other_n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): both directions of every pair of words one edit apart."""
    size = F.char_length("word")
    long = long_neighbours(words.where(size >= TRIE_POINTS))
    # two words of TRIE_POINTS each are found in the trie
    long = long.where((F.char_length("word") > TRIE_POINTS) | (F.char_length("other") > TRIE_POINTS))
    pairs = trie_neighbours(words.where(size <= TRIE_POINTS)).unionByName(long)
    back = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.unionByName(back)


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by doubling; n grows along a chain, so it ends."""
    roots = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut_lineage(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = step.drop("moved")
        if step.where("moved").isEmpty():
            return roots


def grouped(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = stored(vocabulary(docs), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word")))
    near = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    often = -F.col("best.minus") >= F.lit(FORM_FACTOR) * F.col("n")
    told = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.minus")).alias("form_n"),
        ),
        "forms",
    )
    roots = rooted(told.where(F.col("form").isNotNull()))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
