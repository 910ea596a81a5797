"""Personal data, and the terms around it that give it away.

Emails, addresses, cards and phone numbers are found by pattern; each distinct one
is a protected entity, and so is what it belongs to: the mail host, the address
or number prefix.  What is too rare to be estimated by itself is estimated by the
coarser entity.  The words of the documents that hold an entity are held
against the corpus: with document counts, PMI(entity; term) / IC(entity) is the
share of the entity's information that the term discloses.  A term that discloses
more than a threshold is generalised to its kind wherever it stands, or removed
beyond a second threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, row_key, small_side, stored, whole

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Possessive forms of the contract's patterns: they match the same and never try again, so a text is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot hold the kind.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: Distinct texts in which entity and term must meet before the estimate is trusted.
SUPPORT = 3
#: Leading digits by which cards and phone numbers are told more coarsely: issuers; exchanges and regions.
CARD_DIGITS, PHONE_DIGITS = (6,), (7, 4)
#: Numbers of an address that name a network.
NETWORK_PARTS = (3, 2)
#: G of the pair's fourfold table that chance reaches about once in a million pairs.
CHANCE = 24.0
#: Shares of the entity's information beyond which a term is generalised, or removed.
GENERALISE, REMOVE = 0.8, 0.95
WORD = r"[\p{L}\p{M}\p{Nd}]++"
#: Stands for a span in a text whose words are read.
MARK = "\u0001"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' checksum is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # leading zeros do not count; what is longer than three digits is over 255 and must not be cast
        def in_range(part: Column) -> Column:
            short = F.regexp_replace(part, "^0+(?=[0-9])", "")
            return F.when(F.length(short) > 3, False).otherwise(F.left(short, F.lit(3)).cast("int") <= 255)

        return F.forall(F.split(match, r"\."), in_range)
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def _found(kind: str, text: Column) -> Column:
    """All matches of the kind's pattern, an empty list for texts that cannot hold one."""
    none = F.array().cast("array<string>")
    can = F.contains(text, F.lit(NEEDED[kind])) if NEEDED[kind] else F.lit(True)
    return F.when(can, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none)


def _starts(text: Column, pattern: str, matches: Column) -> Column:
    """Code points at which the matches start: the lengths of the pieces between them, added up."""
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size")))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        F.filter(steps, lambda s: s["size"].isNotNull()),
        state,
        lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["size"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + s["gap"])).alias("starts")
        ),
        lambda a: a["starts"],
    )


SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """Spans of the kind's valid matches, in order."""
    starts = _starts(text, PATTERNS[kind], matches)
    spans = F.zip_with(
        starts,
        matches,
        lambda s, m: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")),
    )
    return F.when(F.size(matches) > 0, F.filter(spans, lambda x: valid(kind, x["value"]))).otherwise(F.array()).cast(SPANS)


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``spans_``: base spans by kind, then start."""
    found = docs.withColumns({f"m_{k}": _found(k, F.col(text)) for k in KINDS})
    spans = F.concat(*[_spans(k, F.col(text), F.col(f"m_{k}")) for k in KINDS])
    return found.withColumn("spans_", spans).drop(*[f"m_{k}" for k in KINDS])


def _masked(text: Column, spans: Column) -> Column:
    """The text with its spans replaced by a mark, so that no word inside a span is read."""
    plain = F.translate(text, MARK, " ")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    none = F.array().cast("array<string>")
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(a["out"], F.array(F.substring(plain, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.lit(MARK))).alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(plain, a["at"] + 1, F.length(plain))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(plain)


def document_words(text: Column, spans: Column) -> Column:
    """The distinct lower-case words of a text; words that overlap a span are part of it."""
    words = F.array_distinct(F.split(F.lower(_masked(text, spans)), r"[^\p{L}\p{M}\p{Nd}" + MARK + "]+"))
    return F.filter(words, lambda w: (w != "") & ~F.contains(w, F.lit(MARK)))


def _places(text: Column, spans: Column, hits: Column) -> Column:
    """(start, end, share) of all words of the text that ``hits``, pairs of term and share, names.

    Only what is found is appended, so a long text costs its length.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    shares = F.map_from_entries(hits)
    steps = F.zip_with(
        F.split(text, WORD, -1),
        words,
        lambda p, w: F.struct(F.length(p).alias("gap"), F.length(w).alias("size"), F.element_at(shares, F.lower(w)).alias("share")),
    )
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,share:double>>").alias("found"))

    def step(a: Column, s: Column) -> Column:
        start = a["at"] + s["gap"]
        end = start + s["size"]
        own = F.array(F.struct(start.alias("start"), end.alias("end"), s["share"].alias("share")))
        return F.struct(end.alias("at"), F.when(s["share"].isNull(), a["found"]).otherwise(F.concat(a["found"], own)).alias("found"))

    found = F.aggregate(F.filter(steps, lambda s: s["size"].isNotNull()), state, step, lambda a: a["found"])
    return F.filter(found, lambda w: ~F.exists(spans, lambda s: (w["start"] < s["end"]) & (w["end"] > s["start"])))


def _levels(span: Column) -> Column:
    """The entity of a span and the coarser ones that it belongs to.

    Mail hosts and the domains above them, networks of addresses, issuers of cards,
    exchanges and regions of phone numbers.
    """
    kind, value = span["kind"], F.lower(span["value"])
    digits = F.regexp_replace(value, "[^0-9]", "")
    labels = F.split(F.substring_index(value, "@", -1), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda k: F.concat(F.lit("@"), F.array_join(F.slice(labels, k, F.size(labels)), ".")),
    )
    prefixes = F.array(*[F.concat(F.substring_index(value, ".", k), F.lit(".")) for k in NETWORK_PARTS])
    leading = lambda sizes: F.array(*[F.concat(F.left(digits, F.lit(k)), F.lit("-")) for k in sizes])
    coarser = F.when(kind == "email", parents).when(kind == "ip", prefixes).when(kind == "card", leading(CARD_DIGITS)).otherwise(leading(PHONE_DIGITS))
    own = F.when(kind.isin("card", "phone"), digits).otherwise(value)
    return F.transform(F.concat(F.array(own), coarser), lambda v: F.concat_ws(":", kind, v))


def entities(spans: Column) -> Column:
    """The distinct entities of a document's spans, coarser ones included."""
    return F.array_distinct(F.flatten(F.transform(spans, _levels)))


def _looked_up(words: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of ``words`` whose term is given, with the given columns."""
    return words.join(small_side(terms), "term")


def document_counts(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): documents that hold the word, for the given words at least.

    Words are only looked up if the given ones are few enough to go to every task;
    else all are counted, since a count is a smaller shuffle than a lookup.
    """
    spread = found.select(F.explode(document_words(F.col("text_"), F.col("spans_"))).alias("term"))
    if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        spread = spread.join(F.broadcast(terms), "term", "left_semi")
    return spread.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def distinct_texts(owned: DataFrame) -> DataFrame:
    """(h, entities, terms, n): one row for the ``n`` documents of a text, so that its copies cost nothing further on."""
    return owned.groupBy("h").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count(F.lit(1)).alias("n"))


def entity_counts(texts: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity, of_entity): document counts of the entities that stand in at least ``support`` distinct texts."""
    each = texts.select("n", F.explode("entities").alias("entity"))
    counts = each.groupBy("entity").agg(F.sum("n").alias("of_entity"), F.count(F.lit(1)).alias("texts"))
    return counts.where(F.col("texts") >= support).drop("texts")


def met_pairs(texts: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity, of_entity, term, together): document counts of the pairs met in at least ``support`` distinct texts.

    ``texts`` has a row per distinct text with its counted entities, ``known``.
    """
    met = texts.select("n", "known", F.explode("terms").alias("term")).select("n", "term", F.inline("known"))
    pairs = met.groupBy("entity", "of_entity", "term").agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("texts"))
    return pairs.where(F.col("texts") >= support).drop("texts")


def beyond_chance(n_docs: int) -> Column:
    """G of the documents with and without entity and term: twice their information about each other."""
    n, t, e, d = F.lit(float(n_docs)), F.col("together"), F.col("of_entity"), F.col("df")
    cells = ((t, e, d), (e - t, e, n - d), (d - t, n - e, d), (n - e - d + t, n - e, n - d))
    parts = [F.when(seen > 0, seen * F.ln(seen * n / (row * column))).otherwise(0.0) for seen, row, column in cells]
    return 2 * (parts[0] + parts[1] + parts[2] + parts[3])


def _share(n_docs: int) -> tuple[Column, Column]:
    """What the term tells about the entity, and the entity's whole information."""
    gained = F.log2(F.col("together") * F.lit(float(n_docs)) / (F.col("of_entity") * F.col("df")))
    return gained, F.log2(F.lit(float(n_docs)) / F.col("of_entity"))


def telling(n_docs: int, threshold: float) -> Column:
    """Whether a pair discloses the entity, by more than chance; a term in more documents tells less."""
    gained, information = _share(n_docs)
    return (information > 0) & (gained >= threshold * information) & (beyond_chance(n_docs) >= CHANCE)


def disclosures(pairs: DataFrame, n_docs: int, threshold: float = GENERALISE) -> DataFrame:
    """(entity, term, share): how much of the entity's information the term gives away, where above the threshold."""
    gained, information = _share(n_docs)
    return pairs.where(telling(n_docs, threshold)).select("entity", "term", (gained / information).alias("share"))


def _prepared(docs: DataFrame, doc_id: str, text: str, *carried: Column) -> DataFrame:
    k1, k2 = row_key(doc_id, text)
    return base_spans(docs.select(*carried, k1.alias("k1"), k2.alias("k2"), F.xxhash64(whole(text)).alias("h"), whole(text).alias("text_")), "text_")


def risky_terms(found: DataFrame, base: DataFrame, support: int, threshold: float) -> DataFrame:
    """(k1, k2, terms): by row, spans of the terms to hide with their shares; rows that repeat give one.

    Entity and term meet where one document holds both.  A term that discloses an
    entity is hidden wherever it stands, in documents without the entity as well:
    there it gives the entity away just the same.
    """
    n_docs = base.count()
    owned = stored(
        found.where(F.size("spans_") > 0).select("h", entities(F.col("spans_")).alias("entities"), document_words(F.col("text_"), F.col("spans_")).alias("terms")),
        "owned",
    )
    texts = stored(distinct_texts(owned), "texts")
    # a pair that meets in so many texts has an entity that stands in as many
    counts = stored(entity_counts(texts, support), "entities")
    known = (
        texts.select("h", F.explode("entities").alias("entity"))
        .join(small_side(counts), "entity")
        .groupBy("h")
        .agg(F.collect_list(F.struct("entity", "of_entity")).alias("known"))
    )
    texts = stored(texts.drop("entities").join(known, "h"), "known")
    # in the documents with entities alone a term stands no more often than in all: what tells nothing there tells nothing
    own = texts.select("n", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("texts"))
    own = own.where(F.col("texts") >= support).drop("texts")
    pairs = met_pairs(texts, support).join(own, "term")
    pairs = stored(pairs.where(telling(n_docs, threshold)).drop("df"), "pairs")
    counted = pairs.join(document_counts(found, pairs.select("term").distinct()), "term")
    risky = disclosures(counted, n_docs, threshold)
    # a term may disclose two entities: the larger share counts
    shares = stored(risky.groupBy("term").agg(F.max("share").alias("share")), "risky")
    spread = found.select("k1", "k2", F.explode(document_words(F.col("text_"), F.col("spans_"))).alias("term"))
    held = _looked_up(spread, shares).distinct()
    hits = stored(held.groupBy("k1", "k2").agg(F.collect_list(F.struct("term", "share")).alias("hits")), "hits")
    texts = found.select("k1", "k2", "text_", "spans_").join(small_side(hits), ["k1", "k2"])
    placed = texts.select("k1", "k2", _places(F.col("text_"), F.col("spans_"), F.col("hits")).alias("terms"))
    return stored(placed.groupBy("k1", "k2").agg(F.first("terms").alias("terms")), "terms")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, threshold: float = GENERALISE
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_terms per row of ``docs``.

    Null texts count as empty; repeated rows and null ids are rows like others (all
    documents count in the statistics); an empty table gives no rows.  Other
    columns are not read.
    """
    found = _prepared(docs, doc_id, text, F.col(doc_id).alias("doc_id"))
    base = stored(found.select("doc_id", "k1", "k2", "spans_"), "spans")
    terms = small_side(risky_terms(found, base, support, threshold))
    count = lambda kind: F.size(F.filter("spans_", lambda s: s["kind"] == kind)).cast("bigint")
    added = F.transform("terms", lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    own = F.transform("spans_", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    everything = F.concat(own, F.coalesce(added, F.slice(own, 1, 0)))
    return base.join(terms, ["k1", "k2"], "left").select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("spans_")).cast("binary"), 256).alias("base_sha256"),
        _joined(everything).alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("bigint").alias("n_terms"),
    )


def sanitise(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT,
    generalise: float = GENERALISE, remove: float = REMOVE,
) -> DataFrame:
    """``docs`` with personal data replaced by its kind in brackets and disclosing terms generalised or removed.

    A term is generalised to [number], [name] (a capital first) or [term].  Where
    spans overlap, the one that starts first (the longer of two) stands.  A null
    text stays null; other columns stay as they are.
    """
    found = _prepared(docs, doc_id, text, F.struct("*").alias("row_"))
    terms = small_side(risky_terms(found, docs, support, generalise))
    rows = found.join(terms, ["k1", "k2"], "left")
    piece = lambda a, b: F.substring("text_", a + 1, b - a)
    base = F.transform("spans_", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("put")))

    def general(word: Column) -> Column:
        return F.when(word.rlike(r"^\p{Nd}+$"), "[number]").when(word.rlike(r"^\p{Lu}"), "[name]").otherwise("[term]")

    added = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("last"), F.when(t["share"] >= remove, "").otherwise(general(piece(t["start"], t["end"]))).alias("put")))
    edits = F.array_sort(F.concat(base, F.coalesce(added, F.slice(base, 1, 0))))
    done = F.aggregate(
        edits,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, e: F.when(e["start"] < a["at"], a).otherwise(
            F.struct((-e["last"]).alias("at"), F.concat(a["out"], F.array(piece(a["at"], e["start"]), e["put"])).alias("out"))
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring("text_", a["at"] + 1, F.length("text_"))),
    )
    clean = F.when(F.col("row_")[text].isNull(), None).when(F.size(edits) > 0, done).otherwise(F.col("text_"))
    return rows.select(*[clean.alias(c) if c == text else F.col("row_")[c].alias(c) for c in docs.columns])
