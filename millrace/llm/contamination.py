"""Benchmark items found in documents, re-parameterised ones included.

Numbers, names and units become typed placeholders, words lower case.  Windows of
five template words of the documents are hash-joined with those of the items, and
so are the plain words of a window that holds placeholders: they find a copy in
another case, where names cannot be told.  Windows of one document and item that
lie on one diagonal (the same shift) are taken together, and their slots are
compared: windows that contradict the mapping of values that most windows of the
diagonal follow do not count.  Names are mapped one to one; literally equal values
always count.  A document is contaminated by an item if at least 0.8 of the item's
windows are found in it, by their templates or by their plain words.  An item of
fewer than five words is found where all its plain words stand in a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import row_key, small_side, stored, whole

WINDOW = 5
SIMILARITY = 0.8
#: A window is looked up by its template if so many of its words are no placeholders.
LITERALS = 2

NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
# Units of measure that follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hours hour minutes minute seconds second days day "
    "weeks week months month years year percent dollars dollar euros euro cents cent miles mile meters meter metres metre "
    "kilometers kilometres grams gram kilograms kilogram liters liter litres litre pounds pound feet foot inches inch"
).split()
#: A capitalised word, wherever it stands: names also open sentences.
NAME_PATTERN = r"\p{Lu}(?<![\p{L}\p{M}\p{Nd}]\p{Lu})\p{Ll}++(?![\p{L}\p{M}])"
NUMBER_PATTERN = r"\p{Nd}++(?:[.,]\p{Nd}++)*+"
UNIT_PATTERN = r"(?<=\p{Nd} ?)(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{Nd}])"


def tokens(text: Column) -> Column:
    """The text's words in lower case; names, numbers and units follow the sign of their placeholder."""
    named = F.regexp_replace(text, NAME_PATTERN, f" {NAME}$0 ")
    counted = F.regexp_replace(F.regexp_replace(named, UNIT_PATTERN, f" {UNIT}$0 "), NUMBER_PATTERN, f" {NUMBER}$0 ")
    signed = F.when(text.rlike("[0-9]"), counted).otherwise(named)
    return F.regexp_extract_all(F.lower(signed), F.lit(f"[{NAME}-{UNIT}][^ ]++|[\\p{{L}}\\p{{M}}]++"), F.lit(0))


def _typed(token: Column) -> Column:
    return token < "\u0004"


def _template(token: Column) -> Column:
    return F.when(_typed(token), F.substring(token, 1, 1)).otherwise(token)


def _plain(token: Column) -> Column:
    return F.when(_typed(token), token.substr(F.lit(2), F.length(token))).otherwise(token)


def _prepared(table: DataFrame, text: Column, *carried: Column) -> DataFrame:
    """(carried, tokens_, template_, plain_): the words and the hashes of their templates and plain forms."""
    return table.select(*carried, tokens(text).alias("tokens_")).select(
        "*",
        F.transform("tokens_", lambda t: F.xxhash64(_template(t))).alias("template_"),
        F.transform("tokens_", lambda t: F.xxhash64(_plain(t))).alias("plain_"),
    )


def _windows(rows: DataFrame, width: int, *carried: str) -> DataFrame:
    """(carried, place, template, plain, words) for each window; texts with fewer words have none.

    The hashes of words are zipped with their followers, so that windows are hashed in generated code.
    """
    n = F.size("tokens_")
    shifted = [F.slice(c, k + 1, n - (width - 1)).alias(f"{c}{k}") for c in ("template_", "plain_") for k in range(width)]
    spread = rows.where(n >= width).select(*carried, "tokens_", F.posexplode(F.arrays_zip(*shifted)).alias("place", "w_"))
    hashed = {c: F.xxhash64(*[F.col("w_").getField(f"{c}_{k}") for k in range(width)]) for c in ("template", "plain")}
    return spread.select(*carried, "place", *[h.alias(c) for c, h in hashed.items()], F.slice("tokens_", F.col("place") + 1, width).alias("words"))


def _same(p: Column) -> Column:
    return _plain(p["a"]) == _plain(p["b"])


def _ranked(pairs: Column) -> Column:
    """(votes, literal, a, b) of the distinct pairs of item value and document value; votes are windows."""
    return F.transform(
        F.array_distinct(pairs),
        lambda p: F.struct(
            F.size(F.filter(pairs, lambda q: q == p)).alias("votes"), _same(p).alias("literal"), p["a"].alias("a"), p["b"].alias("b")
        ),
    )


def _fits(p: Column, ranked: Column) -> Column:
    """Whether a pair agrees with the mapping that most windows follow.

    Equal values always do.  Else no pair of more windows may give the item's value
    another meaning; a name of the document may not stand for two names of the item
    either, and stands for itself first.  Numbers and units may meet in one value.
    """
    name = p["a"].startswith(NAME)
    rank = lambda x, *fields: F.struct(*[x[f] for f in fields])
    better = F.exists(
        ranked,
        lambda q: ((q["a"] == p["a"]) & (rank(q, "votes", "literal", "b") > rank(p, "votes", "literal", "b")))
        | (name & (q["b"] == p["b"]) & (rank(q, "literal", "votes", "a") > rank(p, "literal", "votes", "a"))),
    )
    return p["literal"] | ~better


def _hits(rows: DataFrame, items: DataFrame, width: int, whole_only: bool) -> DataFrame:
    """Windows of documents that meet a window of an item, by template or plain words."""
    # a window without placeholders has one hash
    both = F.when(F.col("template") == F.col("plain"), F.array("plain")).otherwise(F.array("template", "plain"))
    windows = _windows(rows, width, "doc_id", "k1", "k2")
    sought = windows.select("doc_id", "k1", "k2", "place", "words", (F.explode(F.array("plain") if whole_only else both)).alias("hash"))
    marked = F.filter(
        F.zip_with("given", "words", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: _typed(p["a"]) | _typed(p["b"])
    )
    return sought.join(small_side(items.drop("n_words")), "hash").select(
        "doc_id", "k1", "k2", "item_id", "item", "at", "sought", (F.col("place") - F.col("at")).alias("shift"), marked.alias("pairs")
    )


def _item_windows(items: DataFrame, width: int, whole_only: bool) -> DataFrame:
    """(item_id, item, at, hash, given, sought): plain windows, and templates with enough plain words (sought)."""
    windows = _windows(items, width, "item_id", "item").withColumnsRenamed({"place": "at", "words": "given"})
    sought = F.lit(False) if whole_only else F.size(F.filter("given", _typed)) <= width - LITERALS
    hashes = F.when(F.col("sought"), F.array_distinct(F.array("template", "plain"))).otherwise(F.array("plain"))
    return windows.withColumn("sought", sought).select(
        "item_id", "item", "at", "given", "sought", F.explode(hashes).alias("hash"), F.lit(width).alias("n_words")
    )


def matches(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    width: int = WINDOW, similarity: float = SIMILARITY,
) -> DataFrame:
    """k1, k2 (the row's key), doc_id, item_id, similarity, n_windows and n_slots per contaminated (document, item).

    Null texts count as empty; items and documents without a word match nothing.
    Items of fewer than ``width`` words match as a whole, with their own values, in
    any case.  Windows with fewer than LITERALS plain words are looked up by their
    plain words only and left out of the share of templates.  Rows that repeat id and
    text give one row; a null id of either side is kept as null; empty tables give
    no rows.  Other columns are not read.  The signs U+0001 to U+0003 in a text are
    read as signs of placeholders.
    """
    wanted = _prepared(benchmark, whole(text), F.col(item_id).alias("item_id"), F.xxhash64(whole(text)).alias("item"))
    wanted = stored(wanted.where(F.size("tokens_") > 0).distinct(), "benchmark")
    # at most width - 1 numbers: the lengths of items shorter than a window
    short = sorted(r[0] for r in wanted.select(F.size("tokens_")).where(F.size("tokens_") < width).distinct().collect())
    parts = [_item_windows(wanted, width, False)]
    parts += [_item_windows(wanted.where(F.size("tokens_") == n), n, True) for n in short]
    items = stored(reduce(DataFrame.union, parts).distinct(), "items")
    sizes = items.groupBy("item_id", "item").agg(
        F.countDistinct("at").alias("n_windows"), F.countDistinct(F.when(F.col("sought"), F.col("at"))).alias("n_sought")
    )
    k1, k2 = row_key(doc_id, text)
    rows = _prepared(docs, whole(text), F.col(doc_id).alias("doc_id"), k1.alias("k1"), k2.alias("k2"))
    hits = reduce(DataFrame.union, [_hits(rows, items.where(F.col("n_words") == n), n, n < width) for n in [width, *short]])
    key = ["doc_id", "k1", "k2", "item_id", "item"]
    diagonals = hits.groupBy(*key, "shift").agg(F.collect_set(F.struct("at", "sought", "pairs")).alias("windows"))
    ranked = diagonals.withColumn("ranked", _ranked(F.flatten(F.transform("windows", lambda w: w["pairs"]))))
    fitting = ranked.withColumn("fits", F.filter("ranked", lambda p: _fits(p, F.col("ranked"))))
    held = lambda p: F.exists("fits", lambda q: (q["a"] == p["a"]) & (q["b"] == p["b"]))
    found = (
        fitting.select(*key, F.size("fits").alias("slots"), F.explode(F.filter("windows", lambda w: F.forall(w["pairs"], held))).alias("w"))
        .groupBy(*key)
        .agg(
            F.countDistinct(F.when(F.col("w.sought"), F.col("w.at"))).alias("met"),
            F.countDistinct(F.when(F.forall("w.pairs", _same), F.col("w.at"))).alias("met_plain"),
            F.max("slots").cast("bigint").alias("n_slots"),
        )
    )
    sized = sizes.select(F.col("item_id").alias("i_"), F.col("item").alias("t_"), "n_windows", "n_sought")
    by_template = F.when(F.col("n_sought") > 0, F.col("met") / F.col("n_sought")).otherwise(0.0)
    return (
        found.join(small_side(sized), (F.col("item") == F.col("t_")) & F.col("item_id").eqNullSafe(F.col("i_")))
        .withColumn("similarity", F.greatest(by_template, F.col("met_plain") / F.col("n_windows")))
        .where(F.col("similarity") >= similarity)
        .select("k1", "k2", "doc_id", "item_id", "similarity", "n_windows", "n_slots")
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, all columns as they are."""
    bad = stored(matches(docs, benchmark, doc_id, text=text).select("k1", "k2").distinct(), "contaminated")
    k1, k2 = row_key(doc_id, text)
    named = docs.select(F.struct("*").alias("row_"), k1.alias("k1"), k2.alias("k2"))
    return named.join(small_side(bad), ["k1", "k2"], "left_anti").select("row_.*")
