"""Source divergence audit: how far the term shares of a source lie from every other source and from its language.

Counts of each (lang, source) group become arrays of (term id, count), sorted by
id and cut into chunks of terms.  A pair task holds two groups' arrays of a chunk
and merges them once for both directions; chunks add up to the value of a pair.

Nulls in text, lang and source read as empty.  A group without terms has no count
above zero, yet takes part in every pair of its language.  Repeated rows are
documents of their own.  An empty table gives no rows; a language with one group
gives no pairs; a language that keeps no term has pairs of value 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, stored, whole

#: A term is kept if it stands in so many documents of its language.
LEAST_DOCUMENTS = 3
#: Ranks reported of a group's terms.
TOP_TERMS = 200
#: Parts of the whole in which shares are told.
PARTS = 1_000_000_000
#: Kept terms of a chunk, and sources of a block, on average: two blocks' arrays of a chunk meet in one task.
CHUNK_TERMS = 16_384
BLOCK_SOURCES = 32
#: Counts that a task holds before it passes them on.
HELD_COUNTS = 200_000

#: ASCII letters in lower case, other ASCII as blanks, all else as it is.
LETTERS = bytes((c | 32) if chr(c).isalpha() else 32 for c in range(128)) + bytes(range(128, 256))
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
COUNTED_DDL = "lang string, source string, term string, n bigint, docs bigint"
PRICED = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("ab", pa.int64()), ("ba", pa.int64())])
PRICED_DDL = "lang string, a string, b string, ab bigint, ba bigint"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each (lang, source, term) among the rows of a task."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        flat = [(lang, source, term, n, docs) for (lang, source), terms in held.items() for term, (n, docs) in terms.items()]
        columns = list(zip(*flat))
        columns[2] = pa.array(columns[2], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTED)], schema=COUNTED)

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            terms = held.setdefault((lang, source), {})
            before = len(terms)
            in_text: dict[bytes, int] = {}
            for term in terms_of(text.as_py()):
                in_text[term] = in_text.get(term, 0) + 1
            for term, n in in_text.items():
                seen = terms.get(term)
                if seen is None:
                    terms[term] = [n, 1]
                else:
                    seen[0] += n
                    seen[1] += 1
            size += len(terms) - before
            if size >= HELD_COUNTS:
                yield rows()
                held, size = {}, 0
    if size:
        yield rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts of the kept terms; ``first`` marks one row of each (lang, term)."""
    texts = docs.select(whole("lang").alias("lang"), whole("source").alias("source"), as_bytes("text").alias("text"))
    # summed within the tasks already; the one shuffle serves the groups, the languages and the marks
    parts = texts.mapInArrow(_counted, COUNTED_DDL).repartition("lang", "term")
    groups = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    told = groups.select(
        "lang", "source", "term", "n",
        F.sum("n").over(of_term).alias("lang_n"),
        F.sum("docs").over(of_term).alias("lang_docs"),
        (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"),
    )
    return told.where(F.col("lang_docs") >= LEAST_DOCUMENTS).drop("lang_docs")


def share(count: Column, total: Column) -> Column:
    """1 + floor(PARTS * (count + 1) / total) for count < total, a thousandth at a time, so that nothing overflows."""
    rest, out = count + F.lit(1), F.lit(0).cast("bigint")
    for _ in range(3):
        scaled = rest * F.lit(1000)
        out, rest = out * F.lit(1000) + _div(scaled, total), scaled % total
    return out + F.lit(1)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    rest, out = counts.astype(np.int64) + 1, np.zeros(len(counts), np.int64)
    for _ in range(3):
        scaled = rest * 1000
        out, rest = out * 1000 + scaled // total, scaled % total
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Group:
    """One group's chunk: sorted term ids, the shares of those terms, and the share of any other term."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, total: int) -> None:
        self.ids, self.p = ids, shares(counts, total)
        self.other = shares(np.zeros(1, np.int64), total)

    def inside(self, larger: Group) -> tuple[np.ndarray, np.ndarray]:
        """Places, here and there, of the ids that both hold.

        Searching sorted needles, each search gallops on from where the last one
        ended; the range before the first and behind the last needle is skipped.
        """
        if not len(self.ids) or not len(larger.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(larger.ids, self.ids)
        here = np.flatnonzero(larger.ids[np.minimum(at, len(larger.ids) - 1)] == self.ids)
        return here, at[here]


def priced(a: Group, b: Group, n_terms: int) -> tuple[int, int]:
    """Distance sums of a from b and of b from a over the terms of a chunk."""
    if len(a.ids) <= len(b.ids):
        in_a, in_b = a.inside(b)
    else:
        in_b, in_a = b.inside(a)
    only_a, only_b = np.delete(a.p, in_a), np.delete(b.p, in_b)
    absent = n_terms - len(a.ids) - len(b.ids) + len(in_a)
    sums = []
    for x, y, both_x, both_y, only_x, only_y in (
        (a, b, a.p[in_a], b.p[in_b], only_a, only_b),
        (b, a, b.p[in_b], a.p[in_a], only_b, only_a),
    ):
        sums.append(
            int(distances(both_x, both_y).sum())
            + int(distances(only_x, y.other).sum())
            + int(distances(x.other, only_y).sum())
            + absent * int(distances(x.other, y.other)[0])
        )
    return sums[0], sums[1]


def _pairs(table: pa.Table) -> pa.Table:
    """All unordered pairs of the sources of two blocks (or of one) in a chunk."""
    rows = table.to_pydict()
    low, high = rows["low"][0], rows["high"][0]
    groups: dict[int, dict[str, Group]] = {low: {}, high: {}}
    for block, source, ids, counts, total in zip(rows["block"], rows["source"], rows["ids"], rows["counts"], rows["total"]):
        groups[block][source] = Group(np.array(ids, np.int64), np.array(counts, np.int64), total)
    names = combinations(sorted(groups[low]), 2) if low == high else product(sorted(groups[low]), sorted(groups[high]))
    n_terms, lang = rows["n_terms"][0], rows["lang"][0]
    out = [(lang, a, b, *priced(groups[low][a], groups[high][b], n_terms)) for a, b in names]
    columns = zip(*out) if out else [[] for _ in PRICED]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, PRICED)], schema=PRICED)


def audited(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of all pairs of sources of a language and of each group's leading terms."""
    kept = stored(term_counts(docs), "divergence")
    groups = docs.select(whole("lang").alias("lang"), whole("source").alias("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("lang_n").alias("lang_total"))
    of_lang = Window.partitionBy("lang")
    known = stored(
        groups.join(sums, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["total", "n_kept", "lang_total"])
        .withColumn("n_sources", F.count(F.lit(1)).over(of_lang)),
        "divergence-groups",
    )
    return _pair_part(kept, known).unionByName(_term_part(kept, known))


def _pair_part(kept: DataFrame, known: DataFrame) -> DataFrame:
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_kept") / CHUNK_TERMS)).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_sources") / BLOCK_SOURCES)).cast("int")
    langs = known.select("lang", chunks.alias("chunks")).distinct()
    chunk = F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk")
    told = kept.join(langs, "lang").select("lang", chunk, "source", "term", "n")
    in_chunk = Window.partitionBy("lang", "chunk")
    numbered = told.withColumn("id", F.dense_rank().over(in_chunk.orderBy("term")))
    numbered = numbered.withColumn("n_terms", F.max("id").over(in_chunk))
    arrays = stored(
        numbered.groupBy("lang", "chunk", "source").agg(
            F.sort_array(F.collect_list(F.struct("id", "n"))).alias("counts"), F.first("n_terms").alias("n_terms")
        ),
        "divergence-arrays",
    )
    sizes = arrays.groupBy("lang", "chunk").agg(F.first("n_terms").alias("n_terms"))
    # every group in every chunk of its language, with an empty array where it has none of the terms
    grid = known.select(
        "lang", "source", "n_sources", (F.col("total") + F.col("n_kept")).alias("total"), blocks.alias("blocks"),
        F.explode(F.sequence(F.lit(0), chunks - F.lit(1))).alias("chunk"),
    ).where(F.col("n_sources") > 1)
    full = (
        grid.join(arrays.drop("n_terms"), ["lang", "chunk", "source"], "left")
        .join(sizes, ["lang", "chunk"], "left")
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - F.lit(1))))
    )
    cells = full.select(
        "lang", "chunk", "source", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.coalesce("n_terms", F.lit(0)).cast("bigint").alias("n_terms"),
        # without kept terms any total does, as nothing is priced
        F.greatest("total", F.lit(1)).alias("total"),
        F.coalesce(F.col("counts.id"), F.array().cast("array<int>")).alias("ids"),
        F.coalesce(F.col("counts.n"), F.array().cast("array<bigint>")).alias("counts"),
    )
    sums = (
        cells.groupBy("lang", "chunk", "low", "high")
        .applyInArrow(_pairs, PRICED_DDL)
        .groupBy("lang", "a", "b")
        .agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
    )
    both = F.inline(
        F.array(
            F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")),
            F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")),
        )
    )
    return _ranked(sums.select("lang", both), "pair")


def _term_part(kept: DataFrame, known: DataFrame) -> DataFrame:
    totals = known.select("lang", "source", "total", "n_kept", "lang_total")
    p = share(F.col("n"), F.col("total") + F.col("n_kept"))
    q = share(F.col("lang_n"), F.col("lang_total") + F.col("n_kept"))
    # one row per group, small beside the counts
    told = kept.join(totals, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    high = told.where(F.col("p") > F.col("q")).select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(high, "term").where(F.col("rank") <= TOP_TERMS)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    return rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"),
        F.row_number().over(order).alias("rank"),
    )


SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.n AS lang_n, CAST(coalesce(x.n, 0) AS HUGEINT) AS n FROM g JOIN k USING (lang)
      LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x
      ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT lang, source, term, n,
        1 + {PARTS} * (n + 1) // (sum(n) OVER s + count(*) OVER s) AS p,
        1 + {PARTS} * (lang_n + 1) // (sum(lang_n) OVER s + count(*) OVER s) AS q
      FROM c WINDOW s AS (PARTITION BY lang, source)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(v), 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS i, sum((x.p - y.p) * (x.p - y.p) // y.p) AS v
                    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
         ON f.lang = a.lang AND f.s = a.source AND f.i = b.source GROUP BY ALL),
found AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
