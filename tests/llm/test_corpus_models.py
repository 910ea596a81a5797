"""Personal data, quality scores, benchmark items, dated lists, class bigrams, mixing rates and the pipeline."""

import glob
import hashlib
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
from corpus_fixtures import SF, TEXTS, awkward, empty, needs_tables, tables  # noqa: E402

from millrace.llm import brown, contamination, mixing, privacy, quality, urllists  # noqa: E402
from millrace.session import shared_dir  # noqa: E402


def multiset(rows):
    return Counter(tuple(r) for r in rows)


def frame(spark, rows, ddl="doc_id bigint, text string"):
    return spark.createDataFrame(rows, ddl)


# ---- personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c_d@e.f x@y.z. %@-.- a@b @c.d a..b@c.d..e",
    "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0255 00255.0.0.1 256.1.1.1 1.1.1",
    "4111 1111 1111 1111 é +1 (743) 555-3824 +49 30 1234567. +1 +12 3",
    "é@x.de ü a.b@c-d.e1 5500-0000-0000-0004 x4111111111111111y 4111 1111 1111 1111 5 4111  1111",
    "+1 (2) 3456789012345678 +44.20.7946.0958)+1-2-3-4-5-6-7-8 +" + "1" * 15,
    "9" * 400 + ".1.1.1 " + "a" * 3000 + " " + "a." * 500 + "@" + "b.c" * 400,
]


def test_base_spans_equal_brute_force(spark):
    texts = TEXTS + list(enumerate(TRICKY, 100))
    rng = np.random.default_rng(2)
    texts += [(1000 + k, "".join(rng.choice(list("a1 .@+-(é5\n"), 60))) for k in range(300)]
    got = privacy.report(frame(spark, texts)).collect()
    want = []
    for i, t in texts:
        spans = brute_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        n = Counter(k for k, _, _ in spans)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert multiset(r[:6] for r in got) == Counter(w[:6] for w in want)
    assert multiset((r.doc_id, ",".join(x for x in r.spans.split(",") if not x.startswith("term"))) for r in got) == Counter((w[0], w[6]) for w in want)


def test_disclosing_terms(spark, monkeypatch):
    rows = [(k, f"chief zyxgard number {k} wrote from boss@x.org about the plan") for k in range(5)]
    rows += [(k, f"the plan about number {k} wrote nobody chief from") for k in range(10, 60)]
    rows += [(70, "unrelated other@y.org zq"), (71, None), (None, "zyxgard boss@x.org"), (None, "zyxgard boss@x.org")]
    df = frame(spark, rows).withColumn("term", F.lit("clash"))
    got_rows = privacy.report(df).collect()
    got = {r.doc_id: r for r in got_rows}
    # zyxgard is met next to the address in every document that holds it, the others mostly elsewhere
    assert got[0].spans == f"email:{rows[0][1].index('boss')}:{rows[0][1].index('boss') + 10},term:6:13"
    assert all(got[k].n_terms == 1 for k in range(5)) and all(got[k].n_terms == 0 for k in (10, 70, 71))
    out = {r.doc_id: r for r in privacy.sanitise(df).collect()}
    assert out[0].text == "chief  number 0 wrote from [email] about the plan" and out[71].text is None
    assert out[10].text == rows[5][1] and out[0].term == "clash"
    mild = {r.doc_id: r.text for r in privacy.sanitise(df, remove=1.1).collect()}
    assert mild[0] == "chief [term] number 0 wrote from [email] about the plan"
    # counts of all words give the same as looked-up ones
    monkeypatch.setattr(privacy, "BROADCAST_ROWS", 0)
    assert multiset(privacy.report(df).collect()) == multiset(got_rows)
    # too few distinct texts: no estimate is trusted
    few = privacy.report(frame(spark, rows[:1] * 9 + rows[5:])).agg(F.sum("n_terms")).first()[0]
    assert few == 0


def test_disclosure_is_pmi_over_information(spark):
    owned = frame(spark, [(k % 4, ["e"], ["t", "u"] if k == 0 else ["t"]) for k in range(5)], "h int, entities array<string>, terms array<string>")
    texts = privacy.distinct_texts(owned)
    counts = privacy.entity_counts(texts, support=3)
    assert [tuple(r) for r in counts.collect()] == [("e", 5)]
    known = texts.withColumn("known", F.array(F.struct(F.lit("e").alias("entity"), F.lit(5).alias("of_entity"))))
    pairs = privacy.met_pairs(known, support=3).withColumn("df", F.lit(8))
    assert [(r.entity, r.term, r.together, r.of_entity, r.df) for r in pairs.collect()] == [("e", "t", 5, 5, 8)]
    got = privacy.disclosures(pairs, 64, threshold=0.5).collect()
    assert [(r.entity, r.term) for r in got] == [("e", "t")]
    assert got[0].share == pytest.approx(math.log2(5 * 64 / (5 * 8)) / math.log2(64 / 5))
    table = np.array([[5, 0], [3, 56]])
    expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0, keepdims=True) / 64
    g = 2 * sum(o * math.log(o / e) for o, e in zip(table.ravel(), expected.ravel()) if o)
    assert pairs.select(privacy.beyond_chance(64)).first()[0] == pytest.approx(g)
    # told by fewer documents a pair tells more, so a count among some documents bounds it
    shares = [pairs.withColumn("df", F.lit(d)).select(privacy._share(64)[0], privacy.beyond_chance(64)).first() for d in (5, 8, 20, 60)]
    assert all(a[0] > b[0] and a[1] > b[1] for a, b in zip(shares, shares[1:]))


def test_sanitise_keeps_columns(spark):
    df = awkward(spark)
    assert privacy.sanitise(df).columns == df.columns and privacy.sanitise(df).count() == df.count()
    assert privacy.sanitise(empty(spark)).count() == privacy.report(empty(spark)).count() == 0


def test_terms_far_from_the_mention(spark):
    far = " filler" * 40
    rows = [(k, f"boss@x.org wrote number {k}{far} of zyxgard and zyxgard") for k in range(4)]
    rows += [(20, "only Zyxgard here, not the address"), (21, "notzyxgard wrote")] + [(k, f"number {k} wrote{far} of and") for k in range(30, 90)]
    df = frame(spark, rows)
    got = {r.doc_id: r.n_terms for r in privacy.report(df).collect()}
    # every occurrence, beyond any reach and where the address is not written
    assert {i: n for i, n in got.items() if n} == {0: 2, 1: 2, 2: 2, 3: 2, 20: 1}
    out = {r.doc_id: r.text for r in privacy.sanitise(df, remove=1.1).collect()}
    assert out[0] == f"[email] wrote number 0{far} of [term] and [term]"
    assert out[20] == "only [name] here, not the address" and out[21] == rows[5][1]


def test_rare_entities_go_by_coarser_ones(spark):
    rows = [(k, f"user{k}x@mail.corp.org for zyxgard{' pad' * k}") for k in range(4)] + [(k, f"for nobody{' pad' * k}") for k in range(10, 60)]
    rows += [(100 + k, f"from 10.20.{k}.7 by qwert{' pad' * (60 + k)}") for k in range(4)]
    got = {r.doc_id: r.n_terms for r in privacy.report(frame(spark, rows)).collect()}
    assert all(got[k] == 1 for k in (0, 1, 2, 3)) and all(got[k] >= 1 for k in range(100, 104)) and got[10] == 0


def brute_levels(kind, value):
    value, digits = value.lower(), re.sub("[^0-9]", "", value)
    if kind == "email":
        labels = value.split("@")[1].split(".")
        return [value] + ["@" + ".".join(labels[k:]) for k in range(max(len(labels) - 1, 1))]
    if kind == "ip":
        return [value] + [".".join(value.split(".")[:k]) + "." for k in (3, 2)]
    return [digits] + [digits[:k] + "-" for k in ((6,) if kind == "card" else (7, 4))]


def brute_terms(rows):
    """Hidden words per row by counting all pairs of entity and word."""
    words, owned = [], []
    for _, text in rows:
        cut, spans = list(text or ""), brute_spans(text)
        for _, a, b in spans:
            cut[a:b] = "\0" * (b - a)
        words.append([w for w in re.findall("(?:[^\\W_]|\0)+", "".join(cut).lower()) if "\0" not in w])
        owned.append({(k, v) for k, a, b in spans for v in brute_levels(k, text[a:b])})
    n, df, of, together, texts = len(rows), Counter(), Counter(), Counter(), defaultdict(set)
    for (_, text), w, o in zip(rows, words, owned):
        df.update(set(w))
        of.update(o)
        for pair in ((e, t) for e in o for t in set(w)):
            together[pair] += 1
            texts[pair].add(text)
    risky = set()
    for (e, t), x in together.items():
        if len(texts[e, t]) >= 3 and of[e] < n and math.log2(x * n / (of[e] * df[t])) >= 0.8 * math.log2(n / of[e]):
            cells = ((x, of[e], df[t]), (of[e] - x, of[e], n - df[t]), (df[t] - x, n - of[e], df[t]), (n - of[e] - df[t] + x, n - of[e], n - df[t]))
            if 2 * sum(o * math.log(o * n / (r * c)) for o, r, c in cells if o) >= 24:
                risky.add(t)
    return [sum(w in risky for w in x) for x in words]


def test_terms_by_no_zone_and_not_by_chance(spark):
    # every number of a world zone has a word of its own kind, but the zone is nobody; two texts are too few, four of four are not chance
    rng = np.random.default_rng(9)
    digits = ["".join(map(str, rng.integers(0, 10, 9))) for _ in range(60)]
    rows = [(k, f"call +1{d} about zonal {'pad ' * k}") for k, d in enumerate(digits)] + [(100 + k, f"nobody {'x ' * k}") for k in range(60)]
    rows += [(200 + k, f"write to kim@deep.host.org about grobnik {'y ' * k}") for k in range(4)]
    rows += [(300 + k, f"write to lee@other.net about frobnak {'y ' * (k + 9)}") for k in range(2)] + [(310, rows[-1][1])] * 9
    got = {r.doc_id: r.n_terms for r in privacy.report(frame(spark, rows)).collect()}
    assert [n for _, n in sorted((k, n) for k, n in got.items() if k < 200)] == [0] * 120
    assert all(got[200 + k] >= 1 for k in range(4))
    counted = privacy.report(frame(spark, rows)).select("doc_id", "n_terms").collect()
    assert multiset(counted) == Counter(zip((i for i, _ in rows), brute_terms(rows)))


@needs_tables
def test_terms_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # a disclosure planted beside what the table holds
    rows += [(10**6 + k, f"{rows[k][1]} agent zyxgard at zyx@gard.example") for k in range(5)]
    got = privacy.report(frame(spark, rows).repartition(4)).select("doc_id", "n_terms").collect()
    want = Counter(zip((i for i, _ in rows), brute_terms(rows)))
    assert multiset(got) == want and sum(n for (i, n) in want if i >= 10**6) >= 5


# ---- quality


def test_discriminant_equals_gaussian_densities():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = [rng.normal(size=(80, d)) @ rng.normal(size=(d, d)), rng.normal(1, 2, (50, d))]
    n = np.array([80.0, 50.0])
    model = quality.discriminant(n, np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]), 0.2)
    pooled = np.diag(sum(((v - v.mean(0)).T @ (v - v.mean(0)) for v in x)) / 130)
    log = []
    for v in x:
        cov = 0.8 * np.cov(v.T, bias=True) + 0.2 * np.diag(pooled)
        z = x[0] - v.mean(0)
        log.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) + np.linalg.slogdet(cov)[1]) + math.log(len(v)))
    assert np.allclose(model.scores(x[0]), 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))))


def test_quality_edges(spark):
    df = awkward(spark)
    none = frame(spark, [], "doc_id bigint, quality int, toxic int")
    got = quality.scored(df, none).collect()
    assert len(got) == len(TEXTS) and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    some = frame(spark, [(i, i % 2, None) for i in range(1, 11)] + [(1, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.scored(df, some).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {(r.doc_id, r.held_out) for r in got} == {(i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) for i, _ in TEXTS}
    assert quality.scored(empty(spark), some).count() == 0


@needs_tables
def test_quality_on_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    ranks = got.score.rank()
    ones = (got.quality == 1).sum()
    auc = (ranks[got.quality == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(got) - ones))
    assert auc > 0.98 and (got.predicted == got.quality).mean() > 0.95


# ---- benchmark items

ITEM = "well in 12 km we met Anna and Anna paid 5 euros to her friend Bob there today ok"


def test_re_parameterised_items(spark):
    rows = [
        (1, "some text before. " + ITEM + " and after"),
        (2, ITEM.replace("12", "99").replace("Anna", "Rita").replace("Bob", "Tim")),
        (3, ITEM.replace("Anna and Anna", "Rita and Lisa")),
        (4, ITEM.replace("Anna", "Bob")),
        (5, " ".join(ITEM.split()[:9]) + " quite another end of the story than there was before"),
        (6, None),
        (7, "few words"),
        (None, ITEM.upper().lower()),
        (1, "some text before. " + ITEM + " and after"),
    ]
    docs = frame(spark, rows).withColumn("item_id", F.lit("clash")).withColumn("place", F.lit(1))
    items = frame(spark, [(100, ITEM), (101, ""), (102, None), (None, "two words")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in contamination.matches(docs, items).collect()}
    # 3: one name of the item stands for two; 4: two names for one
    assert set(got) == {(1, 100), (2, 100), (None, 100)} and got[None, 100].similarity == 1
    assert got[2, 100].similarity == 1 and got[2, 100].n_slots == 6
    kept = contamination.clean(docs, items)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([3, 4, 5, 6, 7])
    assert contamination.matches(docs.where("false"), items).count() == contamination.matches(docs, items.where("false")).count() == 0
    assert contamination.clean(docs, items.where("false")).count() == len(rows)


def test_contradicting_slots_drop_their_windows_only(spark):
    plain = " and then there were many more words to be read in the same old story until it came to its very end"
    item = "she took 5 of the apples, gave away 5 of the pears, and kept 7 of the plums" + plain + plain
    rows = [
        (1, item.replace("pears, and kept 7", "pears, and kept 5")),
        (2, item.replace("took 5", "took 4").replace("kept 7", "kept 4")),
        (3, item.replace("away 5", "away 6")),
        (4, item.replace("5", "8").replace("7", "8")),
        (5, "she took 5 of the apples, gave away 6 of the pears" + plain),
    ]
    got = {r.doc_id: r.similarity for r in contamination.matches(frame(spark, rows), frame(spark, [(1, item)], "item_id bigint, text string")).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == got[4] == 1 and 0.8 <= got[2] < 1 and got[3] >= 0.8


def test_copies_in_another_case_renamed_openers_and_short_items(spark):
    item = "Tom has 3 boats in the old port. Tom buys 2 more of them from Ada. How many boats has Tom in the port now?"
    rows = [
        (1, item.upper()),
        (2, "he asked: " + item.lower() + " nobody knew"),
        (3, item.replace("Tom", "Eve").replace("Ada", "Kim").replace("3", "8")),
        (4, item.replace("Tom has", "Eve has").replace("Tom buys", "Kim buys").replace("has Tom", "has Lea")),
        (5, "Who WROTE hamlet? nobody"),
        (6, "who has read it? hamlet"),
        (7, "see McDonald and iPhone 7"),
        (8, "see mcdonald and iphone 7"),
        (9, ""),
    ]
    items = frame(spark, [(1, item), (2, "Who wrote Hamlet?"), (3, "McDonald and iPhone 7"), (4, "7"), (5, "...")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in contamination.matches(frame(spark, rows), items).collect()}
    # 4: one name of the item stands for three; a short item is met whole only
    assert set(got) == {(1, 1), (2, 1), (3, 1), (5, 2), (7, 3), (8, 3), (7, 4), (8, 4)}
    assert {r.similarity for r in got.values()} == {1.0} and got[5, 2].n_windows == 1


def brute_windows(text):
    # words of templates and plain words: capitalised words are names, numbers are followed by units
    units = "|".join(sorted(contamination.UNITS, key=len, reverse=True))
    t = re.sub(r"(?<![^\W_])[A-ZÀ-Þ][^\W\d_A-ZÀ-Þ]+(?![^\W\d_])", " \u0001\\g<0> ", text)
    t = re.sub(rf"((?<=\d)|(?<=\d ))(?:{units})(?![^\W_])", " \u0003\\g<0> ", t)
    t = re.sub(r"\d+(?:[.,]\d+)*", " \u0002\\g<0> ", t).lower()
    words = re.findall("[\u0001-\u0003][^ ]+|[^\\W\\d_]+", t)
    kinds = [w[0] if w[0] < "\u0004" else w for w in words]
    plain = [w.lstrip("\u0001\u0002\u0003") for w in words]
    return [(tuple(kinds[i : i + 5]), tuple(plain[i : i + 5])) for i in range(len(words) - 4)]


@needs_tables
def test_decontamination_equals_brute_force(spark):
    docs, items = tables(spark, "documents", "benchmark")
    # copies in another case beside what the table holds
    some = items.limit(20).select((F.col("item_id") + 10**6).alias("doc_id"), F.upper("text").alias("text"))
    docs = docs.select("doc_id", "text").unionByName(some.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)))
    want = set()
    found = [(r.doc_id, brute_windows(r.text or "")) for r in docs.collect()]
    texts = [(d, {t for t, _ in w}, {x for _, x in w}) for d, w in found]
    for r in items.collect():
        own = brute_windows(r.text)
        typed = [t for t, _ in own if sum(x in "\u0001\u0002\u0003" for x in t) <= 5 - contamination.LITERALS]
        for d, kinds, plain in texts:
            if (typed and sum(t in kinds for t in typed) / len(typed) >= 0.8) or (own and sum(x in plain for _, x in own) / len(own) >= 0.8):
                want.add((d, r.item_id))
    got = {(r.doc_id, r.item_id) for r in contamination.matches(docs, items).collect()}
    exact = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text.lower() in (d.text or "").lower()}
    assert got == want and exact <= got and any(d >= 10**6 for d, _ in exact)


# ---- dated lists


def test_dated_lists(spark):
    events = [
        ("spam", "host", "a.b.com", "2024-01-01", "add"), ("spam", "host", "a.b.com", "2024-02-10", "remove"),
        ("spam", "host", "a.b.com", "2024-02-10", "add"), ("spam", "host", "a.b.com", "2024-03-01", "add"),
        ("bad", "domain", "b.com", "2024-01-15", "add"), ("bad", "domain", "b.com", "2024-01-20", "add"),
        ("allow", "url", "a.b.com/ok", "2024-01-16", "add"), ("x", "host", None, "2024-01-01", "add"),
    ]
    events = frame(spark, events, "list string, scope string, pattern string, dated string, action string").withColumn("dated", F.col("dated").cast("date"))
    rows = [
        (1, "http://A.b.com/x?q", "2023-12-31"), (2, "http://A.b.com/x", "2024-01-01"), (3, "https://u@a.b.com:80/x", "2024-02-10"),
        (4, "http://a.b.com/", "2024-03-01"), (5, "http://a.b.com/ok?z#f", "2024-01-17"), (6, "http://c.a.b.com/ok", "2024-01-17"),
        (7, None, "2024-01-17"), (8, "http://a.b.com/", None), (None, "nonsense", "2024-01-17"), (2, "http://A.b.com/x", "2024-01-01"),
        (9, "http://localhost/", "2030-01-01"),
    ]
    pages = frame(spark, rows, "page_id bigint, url string, fetched string").withColumn("pattern", F.lit(1)).withColumn("month", F.lit(2))
    got = multiset((r.page_id, r.n_active, r.lists, r.blocked) for r in urllists.judged(pages, events).collect())
    assert got == Counter([
        (1, 0, "", False), (2, 1, "spam", True), (2, 1, "spam", True), (3, 1, "bad", True), (4, 2, "bad,spam", True),
        (5, 3, "allow,bad,spam", False), (6, 1, "bad", True), (7, 0, "", False), (8, 0, "", False), (None, 0, "", False), (9, 0, "", False),
    ])
    assert urllists.judged(pages.where("false"), events).count() == 0
    assert urllists.judged(pages, events.where("false")).where("n_active > 0").count() == 0
    spans = {(str(r.valid_from), str(r.valid_to)) for r in urllists.validity(events).where("list = 'bad'").collect()}
    assert spans == {("2024-01-15", "2024-01-20"), ("2024-01-20", "9999-12-31")}


# ---- class bigrams


def tokens(text):
    return (text or "").encode().translate(brown.LOWER).split() + [b""]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


@pytest.mark.parametrize("head", [10**6, 40, 0])
def test_base_score_equals_brute_force(spark, head):
    docs = TEXTS + ([(r.doc_id + 100, r.text) for r in tables(spark, "documents")[0].collect()] if os.path.isdir(SF) else [])
    counts = Counter(w for i, t in docs if not held_out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for i, t in docs:
        x = tokens(t)
        want[i].append((held_out(i), len(x), sum(w in counts for w in x), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)))
    got = defaultdict(list)
    for r in brown.perplexities(frame(spark, docs), head_words=head, clustered=60, classes=5).collect():
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score))
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    assert set(got) == set(want)
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


def test_class_model_is_a_distribution_and_follows_classes(spark):
    rng = np.random.default_rng(4)
    # words of two kinds that alternate: classes tell what a unigram cannot
    docs = [(i, " ".join(f"{'ab'[k % 2]}{rng.integers(0, 6)}" for k in range(40))) for i in range(300)]
    got = brown.perplexities(frame(spark, docs), classes=2, clustered=12).toPandas()
    assert got.score[got.held_out].sum() > 0.75 * got.base_score[got.held_out].sum()
    # by brute force from the definition, with the classes that the two kinds are
    train = [tokens(t) for i, t in docs if not held_out(i)]
    of = lambda w: "E" if w == b"" else w[:1]
    pairs = Counter((of(a), of(b)) for x in train for a, b in zip([b""] + x[:-1], x))
    words = Counter(w for x in train for w in x)
    size = Counter(of(w) for w in words)
    total = Counter()
    for w, c in words.items():
        total[of(w)] += c
    left = Counter()
    for (a, _), c in pairs.items():
        left[a] += c
    x = tokens(docs[0][1])
    want = 0.0
    for a, b in zip([b""] + x[:-1], x):
        want += math.log10((pairs[of(a), of(b)] + 0.1) / (left[of(a)] + 0.4))
        want += 0 if b == b"" else math.log10((words[b] + 0.1) / (total[of(b)] + 0.1 * size[of(b)]))
    assert got.score[got.doc_id == 0].item() == pytest.approx(want, rel=1e-9)


def two_kinds(docs, words, length, seed):
    """Texts in which words of two kinds alternate, most of the time."""
    rng = np.random.default_rng(seed)
    kinds = lambda k: "ab"[(k + (rng.random() < 0.1)) % 2]
    return [(i, " ".join(f"{kinds(k)}{min(rng.geometric(0.2), words)}" for k in range(length))) for i in range(docs)]


def likelihood(bigrams, of):
    """Of the classes, up to what they do not change."""
    pairs, left, right = Counter(), Counter(), Counter()
    for (v, w), n in bigrams.items():
        pairs[of[v], of[w]] += n
        left[of[v]] += n
        right[of[w]] += n
    part = lambda c: sum(n * math.log(n) for n in c.values())
    return part(pairs) - part(left) - part(right)


def test_exchange_only_rises_and_comes_near_single_moves(spark):
    texts = [tokens(t) for _, t in two_kinds(80, 12, 30, 5)]
    words = [w for w, _ in Counter(w for x in texts for w in x if w).most_common()]
    number = {w: k for k, w in enumerate(words)} | {b"": len(words) + 1}
    bigrams = Counter((number[a], number[b]) for x in texts for a, b in zip([b""] + x[:-1], x))
    df = frame(spark, [(v, w, n) for (v, w), n in bigrams.items()], "v bigint, w bigint, n bigint")
    k, size, history = 3, len(words), []
    found = brown.exchange(df, size, k, 200, history)
    assert len(history) > 1 and history == sorted(history)
    assert found.value == pytest.approx(likelihood(bigrams, found.of)) and history[-1] == found.value
    # one word at a time, each to the class that is likeliest by the definition, until none moves
    of = [i % k for i in range(size)] + [k, k + 1]
    start = likelihood(bigrams, of)
    moved = True
    while moved:
        moved = False
        for w in range(size):
            best = max(range(k), key=lambda c: likelihood(bigrams, of[:w] + [c] + of[w + 1 :]))
            if likelihood(bigrams, of[:w] + [best] + of[w + 1 :]) > likelihood(bigrams, of) + 1e-9:
                of[w], moved = best, True
    assert found.value - start >= 0.9 * (likelihood(bigrams, of) - start)
    with pytest.raises(RuntimeError):
        brown.exchange(df, size, k, 1)


def test_every_frequent_word_has_a_class_wherever_its_count_is_kept(spark):
    docs = two_kinds(200, 60, 30, 6) + [(i, None) for i in range(300, 303)] + [(None, "a1 b1 unseen"), (5, "a1 b1")]
    scores = {}
    for head in (10**6, 20):
        got = brown.perplexities(frame(spark, docs), head_words=head, clustered=12, classes=3, min_count=3).collect()
        scores[head] = sorted((str(r.doc_id), r.n_known, round(r.base_score, 8), round(r.score, 8)) for r in got)
    assert scores[20] == scores[10**6]
    # beyond the words of the exchange the classes still tell more than the counts
    assert sum(x[3] for x in scores[20]) > sum(x[2] for x in scores[20]) + 300
    assert brown.classes_for(10**6) == 300 and brown.classes_for(10**3) == 30


def test_other_columns_do_not_reach_the_class_model(spark):
    docs = two_kinds(60, 8, 20, 7)
    plain = brown.perplexities(frame(spark, docs), classes=2)
    clash = frame(spark, docs).selectExpr("*", "1 AS row", "'x' AS ids", "'y' AS words", "2 AS n", "3 AS class", "true AS held_out")
    assert sorted(brown.perplexities(clash, classes=2).collect()) == sorted(plain.collect())


def test_class_bigrams_edges(spark):
    assert brown.perplexities(empty(spark)).count() == 0
    only = [i for i in range(200) if held_out(i)][:2]
    got = brown.perplexities(frame(spark, [(i, "a b") for i in only])).collect()
    assert [(r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got] == [(0, 0, 0.0)] * 2


# ---- mixing


@needs_tables
def test_rates_match_targets_and_the_best_fit(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mixed(docs, labels).toPandas()
    n, p, r = got.n_tokens.values, got[[f"p_{d}" for d in mixing.DOMAINS]].values, got.rate.values
    assert np.allclose(p.sum(1), 1) and (r >= 0).all()
    shares = (n * r) @ p / n.sum()
    assert np.abs(shares - [mixing.TARGETS[d] for d in mixing.DOMAINS]).max() < 1e-3
    # plain projected gradient on the same problem, one rate at a time, comes to the same rates
    target, x = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]), np.ones(len(n))
    def loss(x):
        miss = (n * x) @ p / n.sum() - target
        return 0.5 * miss @ miss + 0.5 * mixing.PULL * (n * (x - 1) ** 2).sum() / n.sum()

    for _ in range(20000):
        miss = (n * x) @ p / n.sum() - target
        x = np.maximum(x - 0.9 * (p @ miss + mixing.PULL * (x - 1)), 0)
    assert loss(r) <= loss(x) + 1e-9 and np.abs(r - x)[n > 0].max() < 0.02
    labelled = got.merge(labels.toPandas(), on="doc_id")
    assert labelled.p_toxic[labelled.toxic == 1].mean() > 3 * labelled.p_toxic[labelled.toxic == 0].mean()


def test_rates_that_hit_zero(spark):
    rows = [(k, 100, 0.98, 0.01, 0.01) for k in range(5)] + [(k, 100, 0.01, 0.98, 0.01) for k in range(5, 10)] + [(10, 0, 0.1, 0.1, 0.8)]
    df = frame(spark, rows, "doc_id bigint, n_tokens bigint, p_good double, p_poor double, p_toxic double")
    z, misfit = mixing.fit(df, np.array([1.0, 0.0, 0.0]))
    rates = {r.doc_id: r.r for r in df.select("doc_id", mixing.rate(z).alias("r")).collect()}
    assert rates[5] == 0.0 and rates[0] == pytest.approx(2.04, abs=0.05) and np.abs(misfit).max() < 0.03


def test_mixing_edges(spark):
    df = awkward(spark)
    none = frame(spark, [], "doc_id bigint, quality int, toxic int")
    got = mixing.mixed(df, none, targets={"good": 1, "poor": 1, "toxic": 1}).collect()
    assert len(got) == len(TEXTS) and all(r.p_good == pytest.approx(1 / 3) and r.rate == pytest.approx(1) for r in got)
    some = frame(spark, [(1, 1, 0), (7, 0, 0), (8, 1, 1), (2, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert mixing.mixed(df, some).count() == len(TEXTS)
    assert mixing.mixed(empty(spark), some).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(df, none, targets={"good": -1})


# ---- pipeline


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = tables(spark, "documents")[0]
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    df = docs
    for name, stage in pipeline.STAGES[:-1]:
        df = pipeline.stored(stage(spark, df, SF), name)
        assert df.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in df.collect()}
        assert len(kept[name]) == df.count()
    from test_corpus_texts import brute_components, brute_fingerprint, brute_rules

    passed = {i for i, t in texts.items() if not brute_rules(t)[-1]}
    assert set(kept["quality_rules"]) == passed
    order = sorted(passed)
    label = brute_components([brute_fingerprint(texts[i]) for i in order])
    single = {order[k] for k in set(label)}
    assert set(kept["near_duplicates"]) == single
    items = [r.text for r in tables(spark, "benchmark")[0].collect()]
    assert set(kept["decontamination"]) == {i for i in single if not any(t in texts[i] for t in items)}
    assert set(kept["personal_data"]) == set(kept["decontamination"])
    assert not any(brute_spans(t) for t in kept["personal_data"].values())
    assert all(t == texts[i] for i, t in kept["personal_data"].items() if not brute_spans(texts[i]))
    earlier = set(glob.glob(f"{shared_dir(spark)}/*"))
    got = pipeline.run(spark, SF).collect()
    # only the table that the last stage read is left of the stages
    made = {os.path.basename(p).rpartition("-")[0] for p in set(glob.glob(f"{shared_dir(spark)}/*")) - earlier}
    assert made & {name for name, _ in pipeline.STAGES} == {"personal_data"}
    assert {r.doc_id for r in got} == set(kept["personal_data"]) and all(r.rate >= 0 for r in got)
