"""Source divergence, vantage-point trees and spelling variants, each beside a brute-force version."""

import math
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from corpus_fixtures import TEXTS, awkward, empty, needs_tables, tables  # noqa: E402

from millrace.llm import divergence, vantage, variants  # noqa: E402

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def distinct(rows):
    counted = Counter(tuple(r) for r in rows)
    assert not counted or max(counted.values()) == 1
    return set(counted)


# ---- spelling variants


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c > 1}
    near, less = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            less[(i, w[:i] + w[i + 1 :])].add(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in less.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()}


def planted_words(long=70):
    """Chains of forms, letters beyond ASCII, runs of one letter, and words around the bound of the trie."""
    texts = []
    stem = "abcdefgh" * 12
    for size in (62, 63, 64, 65, 66, long, 5_000):
        w = (stem * 60)[:size]
        texts += [w, w, w[:10] + w[11:], w[:10] + w[11:], w[:20] + "z" + w[21:], w[:20] + "z" + w[21:], w + "y", w + "y"]
    for word, n in (("butterfly", 400), ("butterfy", 40), ("buterfy", 4), ("butterfli", 39), ("Butterflé", 3), ("ÉCOLIERS", 20), ("écoliers", 2), ("ÉCOLIER", 2)):
        texts += [word] * n
    for k in range(6, 40):
        texts += ["a" * k] * 2
    return [(i % 17, " ".join(texts[i::17])) for i in range(17)] + [(None, "butterfly nothing"), (5, None), (6, "")]


def test_variants_equal_brute_force(spark):
    rows = planted_words()
    got = variants.grouped(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert distinct(got.collect()) == brute_variants(rows)


def test_variants_through_shuffled_levels(spark, monkeypatch):
    monkeypatch.setattr(variants, "BROADCAST_EDGES", 3)
    monkeypatch.setattr(variants, "HELD_COUNTS", 5)
    rows = planted_words()[:3] + TEXTS[:7]
    got = variants.grouped(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert distinct(got.collect()) == brute_variants(rows)


@needs_tables
def test_variants_of_the_table(spark):
    docs = tables(spark, "documents")[0]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert distinct(variants.grouped(docs).collect()) == brute_variants(rows)


def test_variants_of_awkward_and_empty_tables(spark):
    assert distinct(variants.grouped(awkward(spark)).collect()) == brute_variants(TEXTS)
    assert variants.grouped(empty(spark)).collect() == []


# ---- source divergence


def brute_divergence(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= 3]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if seen[t] >= 3) for s in {d[1] for d in own}}

        def share(count):
            total = sum(count.values()) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[: 200 if part == "term" else None])}
    return out


def spoken(n=400, sources=9):
    rng = np.random.default_rng(3)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'é' * (i // 100)}" for i in range(300)]
    rows = [
        (["en", "de", None][i % 3], f"s{i % sources}", " ".join(words[int(j)] for j in rng.zipf(1.3, 40) if j < 300))
        for i in range(n)
    ]
    # no term is kept here, and one group has no text at all
    return rows + [("xx", "a", "only once"), ("xx", "b", "never again"), ("en", None, None), ("one", "s", "a a a"), ("one", "s", "A a")]


@pytest.mark.parametrize("chunk, block", [(16_384, 32), (40, 2)])
def test_divergence_equals_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(divergence, "CHUNK_TERMS", chunk)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", block)
    monkeypatch.setattr(divergence, "HELD_COUNTS", 500)
    df = spark.createDataFrame(spoken(), "lang string, source string, text string").repartition(3)
    assert distinct(divergence.audited(df).collect()) == brute_divergence(spoken())


def test_divergence_of_awkward_and_empty_tables(spark):
    rows = [(r.lang, r.source, r.text) for r in awkward(spark).select("lang", "source", "text").collect()]
    assert distinct(divergence.audited(awkward(spark)).collect()) == brute_divergence(rows)
    assert divergence.audited(empty(spark)).collect() == []


def test_shares_do_not_overflow(spark):
    count, total = 4 * 10**15, 9 * 10**15
    want = 1 + 10**9 * (count + 1) // total
    assert divergence.shares(np.array([count]), total)[0] == want
    got = spark.range(1).select(divergence.share(F.lit(count), F.lit(total)).alias("p")).first().p
    assert got == want


# ---- vantage-point trees


def brute_nearest(rows, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, set()).add(tuple(v))
    out = set()
    for i, vectors in good.items():
        if i % 20 == 0:
            scores = {}
            for q in vectors:
                for j, others in good.items():
                    for o in others:
                        if j != i and len(o) == len(q):
                            scores[j] = max(scores.get(j, -math.inf), sum(a * b for a, b in zip(q, o)))
            best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
            out |= {(i, rank + 1, j, s) for rank, (j, s) in enumerate(best)}
    return out


def vectors(n=900, dim=6):
    rng = np.random.default_rng(5)
    # few different values: many ties
    rows = [(i, [float(x) for x in rng.integers(-3, 4, dim)]) for i in range(n)]
    rows += [(5_000 + i, [1.0] * dim) for i in range(300)] + [(6_000 + i, [3.0, 4.0]) for i in range(50)]
    rows += [(20, None), (None, [1.0] * dim), (40_000, [0.0] * dim), (40_020, [1.0, None, 2.0]), (40_040, [math.nan] * dim)]
    rows += [(40_060, [math.inf] + [1.0] * (dim - 1)), (40_080, []), (40, rows[40][1]), (60, [2.0] * dim), (-20, [-1.0] * dim)]
    return rows


def test_trees_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vantage, "LEAF", 4)
    df = spark.createDataFrame(vectors(), "vec_id bigint, embedding array<double>").withColumn("shard", F.lit("x")).withColumn("dim", F.lit(1))
    index = vantage.planted(df, shard_bytes=6_000).persist()
    assert index.count() > 5
    found = vantage.nearest(index, df.where(vantage.is_query()), block_bytes=1_000, batch_bytes=3_000)
    assert distinct(found.collect()) == brute_nearest(vectors())


def test_trees_of_an_empty_table(spark):
    nothing = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vantage.searched(nothing).collect() == []
    assert vantage.searched(spark.createDataFrame([(1, [1.0])], nothing.schema)).collect() == []


def test_pruning_and_recall():
    """Clustered points: factor one is exact and skips most of them, a larger factor skips more and still finds nine tenths."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8))
    x = (centres[rng.integers(0, 40, 8_000)] + rng.normal(scale=0.08, size=(8_000, 8))).astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    order, nodes = vantage.grow(vantage.lengthened(x), 16)
    ids = np.arange(len(x))
    tree = vantage.Tree(8, x[order].tobytes(), ids[order].tobytes(), np.ones(len(x), np.int64).tobytes(), nodes.tobytes())
    queries = np.flatnonzero(ids % 20 == 0)
    scores = x[queries] @ x.T
    scores[np.arange(len(queries)), queries] = -np.inf
    exact = np.sort(scores, axis=1)[:, -20:]
    compared = []
    for stretch, least in ((1.0, 1.0), (1.5, 0.9)):
        search = vantage.Search(queries, x[queries], 20, stretch)
        search.visit(tree)
        who, found, _ = search.held[0]
        hit = scores[who, found] >= exact[who, 0] - 1e-12
        assert hit.sum() >= least * exact.size and len(who) <= exact.size
        compared.append(search.compared / (len(queries) * len(x)))
    assert compared[1] <= compared[0] < 0.5


@needs_tables
def test_recall_of_the_table(spark):
    df = tables(spark, "embeddings")[0]
    index = vantage.planted(df).persist()
    queries = df.where(vantage.is_query())
    exact, quick = (vantage.nearest(index, queries, stretch=s) for s in (1.0, 2.0))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert {r[:3] for r in distinct(exact.collect())} == {r[:3] for r in brute_nearest(rows)}
    assert vantage.recall(quick, exact) >= 0.9
