"""Small tables with the awkward cases every operator has to stand."""

from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

#: Columns whose names operators might use themselves.
CLASHES = "k1 string, k2 int, row_ int, text_ string, s_ double, h int, spans_ string, fp string, hash long, words_ int, place int"
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASHES

LONG = " ".join(f"word{i % 977} and {i}" for i in range(20_000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from here today"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from here today"),
    (3, None),
    (4, ""),
    (5, "   \n\t \n"),
    (6, "x"),
    (None, "a row without an id that still has some words to count in it"),
    (None, "a row without an id that still has some words to count in it"),
    (7, LONG),
    (8, "ünïcödé wörds ÄÖÜ   and wide spaces # * | 12 34"),
    (9, "one two three\none two three\none two three\nfour"),
    (9, "one two three\none two three\none two three\nfour"),
    (10, "a b c d e a b c d e a b c d e f g h i j k l m n o p q r s t"),
]


def rows():
    return [
        (i, t, None if i == 6 else "en", None if i in (3, None) else f"host{(i or 0) % 2}", None if t is None else len(t))
        + ("c", 1, 2, "d", 0.5, 3, "e", "f", 4, 5, 6)
        for i, t in TEXTS
    ]


def awkward(spark):
    return spark.createDataFrame(rows(), DDL)


def empty(spark):
    return spark.createDataFrame([], DDL)


def tables(spark, *names):
    return [spark.read.parquet(f"{SF}/{n}.parquet") for n in names]
