"""Counts over one text, computed on Arrow batches of UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
MARKS = b".,;:!?"

STATS = (
    "n_words n_distinct word_chars n_symbols n_upper n_digits n_marks n_exclaims n_lines n_dup_lines n_repeat_words n_long"
).split()
SCHEMA = T.StructType([T.StructField(s, T.LongType()) for s in STATS])


def windows_twice(ids: np.ndarray, vocabulary: int, width: int) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(ids)
    if n <= width:
        return 0
    if vocabulary**width < 2**62:
        code = ids[: n - width + 1].copy()
        for k in range(1, width):
            code = code * vocabulary + ids[k : n - width + 1 + k]
    else:  # rank the windows that are one word shorter, so that no code overflows
        code = ids
        for k in range(1, width):
            code = np.unique(code[: n - k] * np.int64(vocabulary) + ids[k:], return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + width] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def stats_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, n)
    size = len(text)

    def count(chars: bytes) -> int:
        return size - len(text.translate(None, chars))

    points = size if text.isascii() else int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        n,
        len(numbers),
        points - count(SPACE),
        count(SYMBOLS),
        count(UPPER),
        count(DIGITS),
        count(MARKS),
        text.count(b"!"),
        len(lines),
        len(lines) - len(set(lines)),
        windows_twice(ids, max(len(numbers), 1), 5),
        sum(len(w) for w in numbers if len(w) > 20),
    )


@F.arrow_udf(SCHEMA)
def text_stats(texts: pa.Array) -> pa.Array:
    """One struct of counts for each text given as bytes."""
    rows = [stats_of(t.as_py()) for t in texts]
    columns = zip(*rows) if rows else [[] for _ in STATS]
    return pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=STATS)
