"""Removal of repeated passages: Rabin-Karp hashes of every fixed-length token window.

Pass 1 hashes the windows of each text.  Windows that repeat within one pack
of windows are known at once; one copy of each other window goes, packed
with its place, to the part that its hash names (a hot window reaches that part
at most once per pack).  Pass 2 finds the hashes that came from two places and sends the
places, packed again, to their documents, where they merge into maximal intervals.

A window is told by 56 bits of one polynomial hash and by its part, chosen with a
second one: two different windows are taken for equal about once in 2^56 pairs
that meet in a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, parts_for, row_key, text_bytes

WINDOW = 35
#: Bytes of text whose windows meet in one part.
PART_BYTES = 16_000_000
#: Words whose hashes a task remembers.
CACHED_WORDS = 100_000
HASH_BYTES = 7
#: Windows that a task packs at once.
PACKED_WINDOWS = 500_000

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD95))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


def rolling(x: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """sum of x[i + k] * base^k, modulo 2^64, for every window start i, by differences of prefix sums."""
    n = len(x)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x * powers(base, n), out=sums[1:])
    return (sums[width:] - sums[:-width]) * powers(inverse(base), n - width + 1)


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, first byte of all, then second: high zeros compress away."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def gaps(places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Differences within each document's run of rising places."""
    out = places.copy()
    out[1:] -= places[:-1]
    first = np.cumsum(counts)[:-1]
    out[first] = places[first]
    return out


def ungapped(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.cumsum(steps)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    before = np.where(first > 0, sums[first - 1], 0)
    return sums - np.repeat(before, counts)


PACKED = pa.schema([("part", pa.int32()), ("known", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("hashes", pa.binary()), ("seen", pa.binary())])
PACKED_DDL = "part int, known boolean, keys binary, counts binary, places binary, hashes binary, seen binary"
REPLIES = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
REPLIES_DDL = "bucket int, keys binary, counts binary, places binary"
FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("spans", pa.binary())])
FOUND_DDL = "k1 bigint, k2 bigint, spans binary"


def by_document(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Documents, rows of each, and the packed places of rows sorted by (doc, place)."""
    docs, counts = np.unique(doc, return_counts=True)
    return docs, counts, pack(gaps(place, counts), 4)


def packed_rows(keys: np.ndarray, hashes: np.ndarray, part: np.ndarray, doc: np.ndarray, place: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows for the windows of some documents: those that repeat among them, and by part one copy of each."""
    order = np.lexsort((part, hashes)) if parts > 1 else np.argsort(hashes, kind="stable")
    h, p = hashes[order], part[order]
    same = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
    first = np.concatenate(([True], ~same))
    again = np.zeros(len(h), bool)
    again[1:] |= same
    again[:-1] |= same
    twice = np.sort(order[again])
    seen = order[first & again]
    single = np.sort(order[~again])
    rows = {c: [] for c in PACKED.names}

    def add(part_, known_, docs_, counts_, places_, hashes_, seen_):
        values = (part_, known_, keys[docs_].tobytes(), pack(counts_, 4), places_, pack(hashes_, HASH_BYTES), pack(seen_, HASH_BYTES))
        for c, v in zip(rows, values):
            rows[c].append(v)

    none = np.zeros(0, np.uint64)
    if len(twice):
        docs, counts, places = by_document(doc[twice], place[twice])
        add(int(keys[0, 0] % parts), True, docs, counts, places, none, none)
    single = single[np.argsort(part[single], kind="stable")]
    seen = seen[np.argsort(part[seen], kind="stable")]
    marks = np.arange(parts + 1)
    at, at_seen = np.searchsorted(part[single], marks), np.searchsorted(part[seen], marks)
    for k in np.flatnonzero((at[1:] > at[:-1]) | (at_seen[1:] > at_seen[:-1])):
        own = single[at[k] : at[k + 1]]
        docs, counts, places = by_document(doc[own], place[own])
        add(int(k), False, docs, counts, places, hashes[own], hashes[seen[at_seen[k] : at_seen[k + 1]]])
    return pa.RecordBatch.from_pydict(rows, schema=PACKED)


def windows_of(width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1).astype("<i8")
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for d, text in enumerate(batch.column(2)):
                words = text.as_py().split()
                n = len(words)
                if n < width:
                    continue
                x = np.fromiter(map(known.__getitem__, words), np.uint64, n)
                h = mixed(rolling(x, width, BASES[0])) & np.uint64((1 << 8 * HASH_BYTES) - 1)
                part = (mixed(rolling(mixed(x), width, BASES[1])) % np.uint64(parts)).astype(np.int32)
                held.append((h, part, np.full(len(h), d, np.int32), np.arange(len(h), dtype=np.int32)))
                size += len(h)
                if size >= PACKED_WINDOWS:
                    yield packed_rows(keys, *map(np.concatenate, zip(*held)), parts)
                    held, size = [], 0
            if held:
                yield packed_rows(keys, *map(np.concatenate, zip(*held)), parts)

    return run


def read_places(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, rows of each, and the places of a packed row."""
    keys = np.frombuffer(row["keys"], "<i8").reshape(-1, 2)
    counts = unpack(row["counts"], 4).astype(np.int64)
    places = ungapped(unpack(row["places"], 4).astype(np.int64), counts) if len(counts) else np.zeros(0, np.int64)
    return keys, counts, places


def repeated(parts: int):
    """Places of windows that came from two places or were known to repeat, packed by the bucket of their document."""

    def replies(keys: np.ndarray, counts: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(keys)), counts)
        bucket = keys[:, 0] % parts
        order = np.argsort(bucket[doc], kind="stable")
        doc, places = doc[order], places[order]
        at = np.searchsorted(bucket[doc], np.arange(parts + 1))
        rows = {c: [] for c in REPLIES.names}
        for k in np.flatnonzero(at[1:] > at[:-1]):
            own = slice(at[k], at[k + 1])
            docs, n, packed = by_document(doc[own], places[own])
            for c, v in zip(rows, (int(k), keys[docs].tobytes(), pack(n, 4), packed)):
                rows[c].append(v)
        return pa.RecordBatch.from_pydict(rows, schema=REPLIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_keys, docs, places, hashes, seen, n_docs = [], [], [], [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in PACKED.names}
                keys, counts, own = read_places(row)
                if row["known"]:
                    yield replies(keys, counts, own)
                    continue
                all_keys.append(keys)
                docs.append(np.repeat(np.arange(n_docs, n_docs + len(keys), dtype=np.int32), counts))
                places.append(own.astype(np.uint32))
                hashes.append(unpack(row["hashes"], HASH_BYTES))
                seen.append(unpack(row["seen"], HASH_BYTES))
                n_docs += len(keys)
        if not hashes:
            return
        n = sum(map(len, hashes))
        merged = np.concatenate(hashes + seen)
        del hashes, seen
        order = np.argsort(merged, kind="stable")
        merged = merged[order]
        same = merged[1:] == merged[:-1]
        again = np.zeros(len(merged), bool)
        again[1:] |= same
        again[:-1] |= same
        hit = np.sort(order[again])
        hit = hit[hit < n]
        if len(hit):
            own, counts = np.unique(np.concatenate(docs)[hit], return_counts=True)
            yield replies(np.concatenate(all_keys)[own], counts, np.concatenate(places)[hit].astype(np.int64))

    return run


def gathered(width: int):
    """One row per document: its removal intervals, from the replies of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_keys, docs, places, n_docs = [], [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                keys, counts, own = read_places({c: batch.column(c)[k].as_py() for c in REPLIES.names})
                all_keys.append(keys)
                docs.append(np.repeat(np.arange(n_docs, n_docs + len(keys), dtype=np.int32), counts))
                places.append(own.astype(np.uint32))
                n_docs += len(keys)
        if not places:
            return
        names, number = np.unique(np.concatenate(all_keys), axis=0, return_inverse=True)
        doc = number.reshape(-1)[np.concatenate(docs)].astype(np.int64)
        place = np.concatenate(places)
        del docs, places
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order].astype(np.int64)
        # an interval ends where the next window starts behind it or belongs to another document
        cut = np.flatnonzero((doc[1:] != doc[:-1]) | (np.diff(place) > width))
        first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(doc) - 1]))
        spans = np.stack((place[first], place[last] + width), axis=1).astype("<u4")
        ends = np.searchsorted(doc[first], np.arange(len(names)), side="right")
        begins = np.concatenate(([0], ends[:-1]))
        packed = [spans[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist())]
        for at in range(0, len(packed), 4096):
            some = slice(at, at + 4096)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[some, 0]), pa.array(names[some, 1]), pa.array(packed[some], pa.binary())], schema=FOUND
            )

    return run


def removal_intervals(docs: DataFrame, doc_id: str, text: str, width: int = WINDOW) -> DataFrame:
    """(k1, k2, spans): by row key, packed word intervals covered by windows that start elsewhere too."""
    parts = parts_for(docs, text_bytes(docs, text), PART_BYTES)
    k1, k2 = row_key(doc_id, text)
    packed = docs.select(k1.alias("k1"), k2.alias("k2"), as_bytes(text).alias("text")).mapInArrow(
        windows_of(width, parts), PACKED_DDL
    )
    answered = packed.repartitionById(parts, "part").mapInArrow(repeated(parts), REPLIES_DDL)
    return answered.repartitionById(parts, "bucket").mapInArrow(gathered(width), FOUND_DDL)


RESULT = "struct<n_words:bigint,n_removed:bigint,n_intervals:bigint,kept:binary>"
DIGEST = "struct<n_words:bigint,n_removed:bigint,n_intervals:bigint,kept_sha256:string>"


def remover(digest: bool):
    @F.arrow_udf(DIGEST if digest else RESULT)
    def cut(texts: pa.Array, intervals: pa.Array) -> pa.Array:
        rows = []
        for text, own in zip(texts, intervals):
            words = text.as_py().split()
            n = len(words)
            spans = np.frombuffer(own.as_py() or b"", "<u4").reshape(-1, 2).tolist()
            for a, b in reversed(spans):
                del words[a:b]
            left = b" ".join(words)
            rows.append((n, n - len(words), len(spans), hashlib.sha256(left).hexdigest() if digest else left))
        columns = list(zip(*rows)) if rows else [[]] * 4
        kinds = [pa.int64()] * 3 + [pa.string() if digest else pa.binary()]
        return pa.StructArray.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)],
            names=["n_words", "n_removed", "n_intervals", "kept_sha256" if digest else "kept"],
        )

    return cut


def _cut(docs: DataFrame, doc_id: str, text: str, width: int, digest: bool, carried) -> DataFrame:
    k1, k2 = row_key(doc_id, text)
    found = removal_intervals(docs, doc_id, text, width).withColumnRenamed("spans", "spans_")
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), as_bytes(text).alias("text_"), carried)
    return rows.join(found, ["k1", "k2"], "left").withColumn("cut_", remover(digest)("text_", "spans_"))


def dedup_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, n_intervals, kept_sha256 per row of ``docs``.

    A null text has no words; repeated rows repeat each other's windows, so that
    whatever is long enough goes from all of them; a null id is like any other;
    an empty table gives no rows.  Other columns are not read.
    """
    done = _cut(docs, doc_id, text, width, True, F.col(doc_id).alias("doc_id"))
    return done.select("doc_id", "cut_.n_words", "cut_.n_removed", "cut_.n_intervals", "cut_.kept_sha256")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """``docs`` with every repeated passage taken out of the text; kept words are joined by one space."""
    done = _cut(docs, doc_id, text, width, False, F.struct("*").alias("row_"))
    return done.select(
        *[F.col("cut_.kept").cast("string").alias(c) if c == text else F.col("row_")[c].alias(c) for c in docs.columns]
    )
