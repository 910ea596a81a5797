"""Rules, licences, substring dedup and SimHash, each beside a brute-force version."""

import hashlib
import os
import re
import sys
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from corpus_fixtures import SF, TEXTS, awkward, empty, needs_tables, tables  # noqa: E402, F401

from millrace.llm import host_rules, licenses, simhash, substrings  # noqa: E402

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def all_texts(spark):
    docs = [(r.doc_id, r.text) for r in tables(spark, "documents")[0].collect()] if os.path.isdir(SF) else []
    return TEXTS + [(i + 1000, t) for i, t in docs]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(all_texts(spark), "doc_id bigint, text string")
    return plain.withColumn("source", F.concat(F.lit("h"), F.col("doc_id") % 3)).repartition(3)


def multiset(rows):
    return Counter(tuple(r) for r in rows)


# ---- rules


def brute_rules(text):
    words = SPACES.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if SPACES.search(x)]
    n = len(words)
    base = n < 10 or 100 * len(covered) > 20 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), base)


def test_rules_equal_brute_force(spark, docs):
    got = host_rules.judged(docs).drop("kept").collect()
    assert multiset(got) == Counter((i, *brute_rules(t)) for i, t in all_texts(spark))


def test_windows_twice_with_many_words():
    ids = np.array(list(range(9000)) + list(range(7)) + [3, 4, 5, 6, 7])
    assert host_rules.text_stats is not None
    from millrace.llm.textstats import windows_twice

    # 0..6 repeats as a window of seven, 3..7 as one of five
    assert windows_twice(ids, 9000, 5) == 8 + 7 + 5


def test_bad_host_loses_all_documents_and_others_none(spark):
    good = " ".join(f"w{i}" for i in range(30))
    bad = "### $$$ %%% " * 20 + good
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, good if i < 3 else bad, "spam") for i in range(40)]
    rows += [(200, bad, "one"), (201, good, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r.doc_id: r.kept for r in host_rules.judged(df).collect()}
    assert all(kept[i] for i in range(40)) and kept[201]
    assert not any(kept[100 + i] for i in range(40))
    verdicts = {r.host: r for r in host_rules.host_verdicts(df.select("source", host_rules.text_stats(host_rules.as_bytes("text")).alias("s_"))).collect()}
    # the single bad document of a host is shrunk towards all hosts
    assert verdicts["one"].symbols_rate < 1 and verdicts["spam"].rejected and not verdicts["fine"].rejected
    assert {r.doc_id for r in host_rules.keep_good(df).collect()} == {i for i, k in kept.items() if k}


def test_beta_prior_by_moments():
    mean, strength = host_rules.beta_prior(1, 50, 2500, 10, 0.0)
    assert (mean, strength) == (0.2, host_rules.MOST_PRIOR)
    rng = np.random.default_rng(1)
    p = rng.beta(2, 6, 4000)
    n = rng.integers(20, 60, 4000)
    x = rng.binomial(n, p)
    m = x.sum() / n.sum()
    mean, strength = host_rules.beta_prior(4000, n.sum(), (n * n).sum(), x.sum(), (n * (x / n - m) ** 2).sum())
    assert abs(mean - 0.25) < 0.01 and abs(strength - 8) < 0.8


def test_keep_good_keeps_all_columns(spark):
    df = awkward(spark)
    kept = host_rules.keep_good(df)
    assert kept.schema == df.schema
    # 1, 2, both rows without id, 7 and 8 (10 repeats itself)
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(
        str(i) for i, t in TEXTS if not brute_rules(t)[-1]
    )


# ---- licences

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_base(text):
    words = WORDS.findall(lowered(text))
    found = sorted(
        (i, label)
        for phrase, label in licenses.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))


NOTICES = [
    (901, "Licensed under the GNU General Public License, Version 3 or (at your option) any later version."),
    (902, "licensed under the terms of the GNU general public licence"),
    (903, "MIT License mit license CC BY cc by cc-by Apache License"),
    (904, "This little work is released under the MIT License. Apacheé license"),
    (905, "Licensed under CC BY-NC 4.0. licensed under cc by 3.0"),
]


def test_license_base_equals_brute_force(spark, docs):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(NOTICES, "doc_id bigint, text string"))
    got = licenses.scanned(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert multiset(got) == Counter((i, *brute_base(t)) for i, t in all_texts(spark) + NOTICES)


def test_license_templates(spark):
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(NOTICES, "doc_id bigint, text string")).collect()}
    assert got[901].labels == "gpl,gpl-notice" and got[901].score == 1.0
    assert got[902].labels == "" and got[902].score == 0.0
    assert got[903].labels == "apache,cc-by,mit" and got[903].n_base == 6
    assert got[904].labels == "mit,mit-notice" and got[904].score == pytest.approx(9 / 11)
    assert got[905].labels == "cc-by,cc-by-notice" and got[905].score == 1.0


def expand(tokens):
    """All wordings of a template with small regions, by brute force; a replaced word is written '?'."""
    out, at = [()], 0
    while at < len(tokens):
        t = tokens[at]
        if t == "[[":
            depth, end = 1, at
            while depth:
                end += 1
                depth += (tokens[end] == "[[") - (tokens[end] == "]]")
            inner = expand(tokens[at + 1 : end])
            out = [o + i for o in out for i in [(), *inner]]
            at = end
        elif t.startswith("{{"):
            a, b = map(int, t[2:-2].split(":")[1].split("-"))
            out = [o + ("?",) * k for o in out for k in range(a, b + 1)]
        else:
            out = [o + (t,) for o in out]
        at += 1
    return out


@pytest.mark.parametrize("template", ["a [[b [[c]] ]] d", "[[x]] a {{n:0-2}} b", "a {{n:1-3}}", "a [[a]] [[{{n:1-2}} b]] c"])
def test_automaton_equals_all_wordings(template):
    tokens = re.findall(r"\[\[|\]\]|\{\{[^{}]*\}\}|[^\s\[\]{}]+", template)
    wordings = set(expand(tokens))
    automaton = licenses.Automaton(template)
    rng = np.random.default_rng(3)
    for _ in range(600):
        words = [str(w) for w in rng.choice(list("abcdx"), rng.integers(0, 7))]
        fits = [len(w) for w in wordings if len(w) <= len(words) and all(x in ("?", y) for x, y in zip(w, words))]
        assert automaton.longest([w.encode() for w in words], 0) == max(fits, default=None)


def test_template_needs_a_word_and_balanced_brackets():
    for bad in ("[[a]]", "a [[b", "a ]] b"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)


# ---- substrings


def brute_removal(texts, width):
    counts = Counter()
    split = [SPACES.findall(t or "") for _, t in texts]
    for words in split:
        counts.update(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    for (i, _), words in zip(texts, split):
        gone = {j for k in range(len(words) - width + 1) if counts[tuple(words[k : k + width])] > 1 for j in range(k, k + width)}
        kept = [w for j, w in enumerate(words) if j not in gone]
        yield i, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("width", [35, 4])
def test_substring_dedup_equals_brute_force(spark, docs, width):
    got = substrings.dedup_digest(docs, width=width).drop("n_intervals").collect()
    assert multiset(got) == Counter(brute_removal(all_texts(spark), width))


def test_substring_dedup_in_small_packs_and_many_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(substrings, "PART_BYTES", 5_000)
    got = substrings.dedup_digest(docs).drop("n_intervals").collect()
    assert multiset(got) == Counter(brute_removal(all_texts(spark), 35))
    packs = substrings.packed_rows(*(np.array(x) for x in ([[5, 6]], [9, 9, 8], [0, 0, 0], [0, 0, 0], [0, 1, 2])), 2)
    assert sorted(packs.column("known").to_pylist()) == [False, True]


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**56, 1000, dtype=np.uint64)
    assert (substrings.unpack(substrings.pack(x, 7), 7) == x).all()
    counts = np.array([3, 1, 4])
    places = np.array([5, 9, 11, 0, 2, 3, 70000, 70001])
    assert (substrings.ungapped(substrings.gaps(places, counts), counts) == places).all()
    words = rng.integers(0, 2**64, 200, dtype=np.uint64)
    h = substrings.rolling(words, 35, substrings.BASES[0])
    again = substrings.rolling(np.concatenate((words[100:160], words[:7])), 35, substrings.BASES[0])
    assert (again[: 60 - 34] == h[100 : 100 + 60 - 34]).all() and len(set(h.tolist())) == len(h)


def test_remove_repeats_keeps_columns(spark):
    df = awkward(spark)
    out = substrings.remove_repeats(df, width=5)
    assert out.columns == df.columns
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[1] == by[2] == "" and by[10] == "f g h i j k l m n o p q r s t"


# ---- SimHash


def brute_fingerprint(text):
    words = SPACES.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << k for k in range(64) if 2 * int((h >> np.uint64(k) & np.uint64(1)).sum()) > len(h))


def brute_components(prints):
    """Smallest index reachable over at most two differing bits."""
    x = np.array(prints, np.uint64)
    label = list(range(len(x)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 2):
            a, b = root(i), root(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(x))]


@pytest.mark.parametrize("crowd", [128, 1])
def test_simhash_equals_brute_force(spark, docs, crowd):
    texts = all_texts(spark)
    prints = [brute_fingerprint(t) for _, t in texts]
    groups = {}
    for (i, _), g in zip(texts, brute_components(prints)):
        groups.setdefault(g, []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    want = Counter((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(texts, prints, brute_components(prints)))
    assert multiset(simhash.near_duplicates(docs, crowd=crowd).collect()) == want
    kept = simhash.keep_one(docs, crowd=crowd)
    assert kept.count() == len(groups)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.values())


@pytest.mark.parametrize("crowd", [128, 2])
@pytest.mark.parametrize("segments", [3, 7])
def test_links_of_random_and_crowded_fingerprints(spark, segments, crowd):
    rng = np.random.default_rng(5)
    x = {int(v) for v in rng.integers(0, 2**64, 60, dtype=np.uint64)}
    for v in list(x)[:20]:  # chains of neighbours
        for _ in range(6):
            v ^= (1 << int(rng.integers(0, 64))) | (1 << int(rng.integers(0, 64)))
            x.add(v)
    x = sorted(x)
    signed = [v - 2**64 if v >> 63 else v for v in x]
    prints = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    got = {r.fp: r.root for r in simhash.classes(prints, segments=segments, crowd=crowd).collect()}
    label = brute_components(x)
    for i, v in enumerate(signed):
        mine = {w for j, w in enumerate(signed) if label[j] == label[i]}
        assert got.get(v, v) == min(mine)
    if crowd == 128:
        pairs = {(r.u, r.v) for r in simhash.links(prints, segments=segments).collect()}
        assert pairs == {(max(a, b), min(a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and (x[i] ^ x[j]).bit_count() <= 2}


def test_keep_one_keeps_all_columns(spark):
    df = awkward(spark)
    out = simhash.keep_one(df)
    assert out.schema == df.schema and out.where("doc_id = 9").count() == 1


# ---- empty tables


def test_empty_tables(spark):
    df = empty(spark)
    assert host_rules.judged(df).count() == host_rules.keep_good(df).count() == 0
    assert licenses.scanned(df).count() == substrings.dedup_digest(df).count() == 0
    assert simhash.near_duplicates(df).count() == simhash.keep_one(df).count() == 0
