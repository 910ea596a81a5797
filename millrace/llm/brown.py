"""Perplexity by a class-based bigram model whose classes come from exchange clustering.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)).  Every word that the training
texts hold at least ``min_count`` times is in a class, and the number of classes
grows with the number of these words.  Exchange clustering runs over the most
frequent ones, a number that grows with the classes, until no move makes the
bigrams likelier; each other word then joins the class that makes its own
neighbours likeliest.  Rarer words form one class, in which a word's emission
follows its own count; the end of a text is a class of its own and stands before
the first word.

Texts are encoded once: numbers of the frequent words, whose counts go to every
task, and the other words of a text as a list that is joined with the table of
words.  All later passes read the numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import as_bytes, crc_fold, discard, stored

FOLDS = 10
#: Words whose counts are sent to every task, at most.
HEAD_WORDS = 262_144
#: Words rarer than this form one class.
MIN_COUNT = 5
#: Classes for each cube root of the number of clustered words.
CLASSES_PER_ROOT = 3
#: Words for each class that take part in the exchange.
CORE_PER_CLASS = 8
#: Rounds of the exchange before it raises.
ROUNDS = 200
#: Gain in nats a bigram below which the exchange has settled.
TOLERANCE = 1e-4
SMOOTHING = 0.1
#: Words that a task counts before it hands the counts on.
COUNTED_WORDS = 400_000
#: Codes that a task counts before it hands the counts on, and rows handed on at once.
COUNTED_CODES = 1_000_000
SLICE_ROWS = 100_000
#: Bytes of text and of packed numbers taken at once.
CHUNK_BYTES = 4_000_000
PACKED_BYTES = 1_000_000
#: Rows of neighbour counts merged at once.
MERGED_ROWS = 2_048
#: The end of a text, as a token; no word is empty.
END = b""
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bins of a doubling in the histogram of counts.
BINS = 8


def classes_for(words: int) -> int:
    return max(2, round(CLASSES_PER_ROOT * words ** (1 / 3)))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            counts.update(tokens(text.as_py()))
            counts[END] += 1
            if len(counts) > COUNTED_WORDS:
                yield flush()
    if counts:
        yield flush()


def bin_of(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * BINS).cast("int")


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Parts of the batches with about CHUNK_BYTES of text, and the tokens of each text."""
    for batch in batches:
        start, size, parts = 0, 0, []
        for k, text in enumerate(batch.column(column)):
            text = text.as_py()
            parts.append(tokens(text))
            size += len(text)
            if size > CHUNK_BYTES:
                yield batch.slice(start, k + 1 - start), parts
                start, size, parts = k + 1, 0, []
        if parts:
            yield batch.slice(start), parts


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the lowest first, the eighth set on all but a value's last byte; and where each value ends."""
    length = 1 + sum((values >= 1 << bits).astype(np.int64) for bits in range(7, 63, 7))
    ends = np.cumsum(length)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for b in range(int(length.max(initial=0))):
        more = np.nonzero(length > b)[0]
        high = (length[more] > b + 1).astype(np.int64) << 7
        out[ends[more] - length[more] + b] = values[more] >> (7 * b) & 127 | high
    return out, ends


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of packed numbers in a row, and where each of its rows starts among them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    last = np.nonzero(data < 128)[0]
    first = np.concatenate(([0], last[:-1] + 1))
    length = last - first + 1
    values = np.zeros(len(last), np.int64)
    for b in range(int(length.max(initial=0))):
        more = np.nonzero(length > b)[0]
        values[more] |= (data[first[more] + b].astype(np.int64) & 127) << (7 * b)
    return values, np.searchsorted(first, offsets[:-1] - offsets[0])


def packed_rows(values: np.ndarray, stops: np.ndarray) -> pa.Array:
    """A column of packed numbers whose rows end at ``stops``."""
    data, ends = packed(values)
    offsets = np.concatenate(([0], ends[stops - 1])).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encode(words):
    """Numbers of each text's tokens and the list of its words that have none.

    Frequent words are 0 to H - 1, the end is H, the j-th word of the list H + 1 + j.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(words.value)}.get
        end = len(words.value)
        for batch, texts in chunks(batches, 2):
            flat, others = [], []
            for text in texts:
                ids = np.fromiter((number(w, -1) for w in text), np.int64, len(text))
                extra: dict[bytes, int] = {}
                for at in np.nonzero(ids < 0)[0]:
                    ids[at] = end + 1 + extra.setdefault(text[at], len(extra))
                flat.append(np.append(ids, end))
                others.append(list(extra))
            out = packed_rows(np.concatenate(flat), np.cumsum([len(x) for x in flat]))
            arrays = [batch.column(0), batch.column(1), out, pa.array(others, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "ids", "words"])

    return run


def pieces(batches: Iterator[pa.RecordBatch], lists: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with about PACKED_BYTES of numbers: the rows, the numbers in a row, and where each text starts.

    With the column ``lists``, the j-th word of a text's list is numbered on through
    the lists of the part.  Column ``ids`` is the first.
    """
    for batch in batches:
        if not len(batch):
            continue
        column = batch.column(0)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(batch) + 1].astype(np.int64)
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PACKED_BYTES, "right")) - 1)
            part = batch.slice(start, stop - start)
            ids, starts = unpacked(part.column(0))
            if lists is not None:
                shift = np.concatenate(([0], np.cumsum(part.column(lists).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
                # the end closes every text, so its number is each text's last
                away = np.nonzero(ids > ids[-1])[0]
                ids[away] += shift[np.searchsorted(starts, away, "right") - 1]
            yield part, ids, starts
            start = stop


def before(ids: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The number that precedes each; the end stands before a text's first."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[starts] = end
    return out


class Tally:
    """Counts of codes."""

    def __init__(self) -> None:
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, codes: np.ndarray) -> None:
        code, n = np.unique(codes, return_counts=True)
        self.codes, at = np.unique(np.concatenate((self.codes, code)), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate((self.counts, n)), len(self.codes)).astype(np.int64)

    def rows(self, most: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes and counts, handed on and forgotten if there are more than ``most``."""
        if len(self.codes) > most:
            codes, counts = self.codes, self.counts
            self.codes, self.counts = codes[:0], counts[:0]
            for at in range(0, len(codes), SLICE_ROWS):
                yield codes[at : at + SLICE_ROWS], counts[at : at + SLICE_ROWS]


def count_pairs(of: np.ndarray | None, size: int, lists: int | None = None):
    """Counts of pairs (v, w) of the texts' numbers, brought to 0 .. ``size`` - 1.

    Frequent words and the end are replaced by ``of``, words of the lists by the classes in the column ``lists``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def out(most: int) -> Iterator[pa.RecordBatch]:
            for codes, n in tally.rows(most):
                yield pa.RecordBatch.from_arrays([pa.array(codes // size), pa.array(codes % size), pa.array(n)], names=["v", "w", "n"])

        for part, ids, starts in pieces(batches, lists):
            if lists is None:
                # every word outside the table is one of the others, which stand before the end
                seen = np.where(ids < len(of), of[np.minimum(ids, len(of) - 1)], size - 2)
            else:
                seen = np.concatenate((of, part.column(lists).flatten().to_numpy(zero_copy_only=False).astype(np.int64)))[ids]
            tally.add(before(seen, starts, size - 1) * size + seen)
            yield from out(COUNTED_CODES)
        yield from out(0)

    return run


def count_profiles(of: np.ndarray, seek: np.ndarray, k: int):
    """How often the words outside the exchange stand before and after each class.

    A row names a frequent word by its number, another by itself, and packs pairs
    (code, count): code c < k + 2 is the class that follows, k + 2 + c the class
    that precedes.
    """
    codes_each = 2 * (k + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        close = len(of) - 1

        def rows(codes: np.ndarray, n: np.ndarray, words: pa.Array | None) -> pa.RecordBatch:
            which, code = np.divmod(codes, codes_each)
            stops = np.append(np.nonzero(np.diff(which))[0] + 1, len(which))
            which = which[stops - 1]
            both = packed_rows(np.column_stack((code, n)).ravel(), 2 * stops)
            number = which if words is None else np.full(len(which), -1)
            named = pa.array([b""] * len(which), pa.binary()) if words is None else words.take(pa.array(which))
            return pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), named, both], names=["id", "word", "beside"])

        for part, ids, starts in pieces(batches, 1):
            seen = np.where(ids <= close, of[np.minimum(ids, close)], k)
            after, prior = np.append(seen[1:], k + 1) + ids * codes_each, before(seen, starts, k + 1) + k + 2 + ids * codes_each
            head, away = np.nonzero((ids <= close) & seek[np.minimum(ids, close)])[0], np.nonzero(ids > close)[0]
            tally.add(np.concatenate((after[head], prior[head])))
            if len(away):
                codes, n = np.unique(np.concatenate((after[away], prior[away])) - (close + 1) * codes_each, return_counts=True)
                yield rows(codes, n, part.column(1).flatten())
            for codes, n in tally.rows(COUNTED_CODES):
                yield rows(codes, n, None)
        for codes, n in tally.rows():
            yield rows(codes, n, None)

    return run


def gains(after: np.ndarray, prior: np.ndarray, pairs: np.ndarray, total: np.ndarray, k: int) -> np.ndarray:
    """Log-likelihood of each word's neighbours and of itself in each class, smoothed."""
    smooth = pairs + SMOOTHING
    right = np.log(smooth / smooth.sum(axis=1, keepdims=True))  # class after, given class
    # a word in class b: its followers by row b, itself after its predecessors by column b, and its share of b
    return after @ right[:k].T + prior @ right[:, :k] - prior.sum(axis=1)[:, None] * np.log(total[:k] + SMOOTHING)[None, :]


def assign(pairs: np.ndarray, total: np.ndarray, k: int, min_count: int):
    """The class of each word that occurs ``min_count`` times, from its rows, which stand together; of equal ones the first."""
    width = k + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, beside = pa.array([], pa.int32()), pa.array([], pa.binary()), np.zeros((0, 2 * width))

        def out() -> pa.RecordBatch:
            # every token has one class before it, so these sum to the word's count
            often = np.nonzero(beside[:, width:].sum(axis=1) >= min_count)[0]
            found = gains(beside[often, :width], beside[often, width:], pairs, total, k).argmax(axis=1).astype(np.int32)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(often)), words.take(pa.array(often)), pa.array(found)], names=["id", "word", "class"])

        for batch in batches:
            for at in range(0, len(batch), MERGED_ROWS):
                part = batch.slice(at, MERGED_ROWS)
                # the last word so far may go on
                keys = [pa.concat_arrays([x, y]) for x, y in zip((ids, words), part.columns[:2])]
                changes = [pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False) for x in keys]
                word = np.concatenate(([0], np.cumsum(changes[0] | changes[1])))
                values, starts = unpacked(part.column(2))
                row = np.repeat(word[len(ids) :], np.diff(np.append(starts, len(values))) // 2)
                size = word[-1] + 1
                sums = np.bincount(row * 2 * width + values[::2], values[1::2], size * 2 * width).reshape(size, 2 * width)
                sums[: len(beside)] += beside
                firsts = np.searchsorted(word, np.arange(size))
                ids, words, beside = keys[0].take(pa.array(firsts)), keys[1].take(pa.array(firsts)), sums
                if size > 1:
                    last = ids[-1:], words[-1:], beside[-1:]
                    ids, words, beside = ids[:-1], words[:-1], beside[:-1]
                    yield out()
                    ids, words, beside = last
        yield out()

    return run


class Classes:
    """Class of each number, counts of class pairs, counts of each number with the classes after and before it.

    Classes are 0..k-1, k for other words, k+1 for the end.
    """

    def __init__(self, beside: DataFrame, of: np.ndarray, k: int) -> None:
        self.of = of
        self.after, self.prior = profiles(beside, of, k)
        self.own = self.prior.sum(axis=1)
        self.pairs = np.zeros((k + 2, k + 2))
        np.add.at(self.pairs, of, self.after)
        self.total = np.bincount(of, self.own, k + 2)
        #: log-likelihood of the bigrams, up to what no choice of classes changes (natural logarithm)
        part = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
        self.value = part(self.pairs) - part(self.pairs.sum(axis=1)) - part(self.total)


def neighbours(bigrams: DataFrame) -> DataFrame:
    """(id, side, others, n): the numbers after (side 0) and before (side 1) each number; no list is longer than there are numbers."""
    sides = []
    for side, (one, other) in enumerate((("v", "w"), ("w", "v"))):
        lists = bigrams.groupBy(F.col(one).alias("id")).agg(F.collect_list(other).alias("others"), F.collect_list("n").alias("n"))
        sides.append(lists.select("id", F.lit(side).alias("side"), "others", "n"))
    return sides[0].unionByName(sides[1])


def count_beside(of: np.ndarray, width: int):
    """Counts of the classes beside each number, as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, n = (batch.column(c).flatten().to_numpy() for c in (2, 3))
            row = np.repeat(np.arange(len(batch)), batch.column(2).value_lengths().to_numpy())
            counts = np.bincount(row * width + of[others], n, len(batch) * width).reshape(len(batch), width)
            out = pa.array([c.tobytes() for c in counts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=["id", "side", "counts"])

    return run


def profiles(beside: DataFrame, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each number with the classes after it and before it, from :func:`neighbours`.

    Every side of the result is bounded by the words of the exchange and the classes.
    """
    out = np.zeros((2, len(of), k + 2))
    met = beside.mapInArrow(count_beside(of, k + 2), "id bigint, side int, counts binary").toArrow()
    for i, side, counts in zip(*(met.column(c).to_pylist() for c in ("id", "side", "counts"))):
        out[side, i] = np.frombuffer(counts)
    return out[0], out[1]


def exchange(bigrams: DataFrame, size: int, k: int, rounds: int, history: list[float] | None = None) -> Classes:
    """Batch exchange: in each round some of the words that gain by it move to their best class.

    Words start dealt out by frequency rank.  A round that does not make the
    bigrams likelier is taken back and half as many words move in the next, so the
    likelihood only rises; accepted values go to ``history``.  It ends when no word
    gains, when a single move does not help, or when a round gains less than
    TOLERANCE for all words; beyond ``rounds`` it raises.
    """
    beside = stored(neighbours(bigrams), "neighbours")
    best = Classes(beside, np.concatenate((np.arange(size) % k, [k, k + 1])), k)
    history = [] if history is None else history
    history.append(best.value)
    tokens_seen = max(best.own.sum(), 1.0)
    share = 2
    for r in range(rounds):
        wanted = gains(best.after[:size], best.prior[:size], best.pairs, best.total, k).argmax(axis=1)
        movers = np.nonzero(wanted != best.of[:size])[0]
        if share > 2 * len(movers):
            return best
        moved = movers[r % min(share, len(movers)) :: share]
        of = best.of.copy()
        of[moved] = wanted[moved]
        found = Classes(beside, of, k)
        if found.value <= best.value:
            share *= 2
            continue
        gain = (found.value - best.value) / tokens_seen
        best = found
        history.append(best.value)
        if gain * share < TOLERANCE:
            return best
        share = max(share // 2, 2)
    raise RuntimeError(f"classes did not settle in {rounds} rounds")


def score_texts(own: np.ndarray, of: np.ndarray, transitions: np.ndarray, totals: np.ndarray, plain: float):
    """Per row: tokens, known tokens, unigram and class log10 probability.

    ``own`` and ``of`` are counts and classes of the frequent words and of the end;
    a text's other words bring theirs.  ``totals`` is log10 of each class's denominator.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = len(totals) - 1
        for part, ids, starts in pieces(batches, 3):
            counts = np.concatenate((own, part.column(3).flatten().to_numpy(zero_copy_only=False)))[ids].astype(float)
            classes = np.concatenate((of, part.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)))[ids]
            logs = np.log10(counts + SMOOTHING)
            steps = transitions[before(classes, starts, end), classes] + np.where(classes == end, 0.0, logs - totals[classes])
            length = np.diff(np.append(starts, len(ids)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(1), part.column(2), pa.array(length), pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(logs - plain, starts)), pa.array(np.add.reduceat(steps, starts)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def perplexities(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, head_words: int = HEAD_WORDS,
    clustered: int | None = None, classes: int | None = None, rounds: int = ROUNDS, min_count: int = MIN_COUNT,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity per row of ``docs``.

    base_score is the unigram sum, score the class model's log10 probability of the
    text with its end.  ``classes`` and the words of the exchange (``clustered``)
    follow the number of words with ``min_count`` occurrences if not given.  Null
    texts count as empty: one token, the end.  Repeated rows and null ids are rows
    like others.  Without training rows every count is zero and the base score is
    that of a one-word vocabulary.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), (crc_fold(doc_id, folds) == 0).alias("held_out"), as_bytes(text).alias("text"))
    counts = stored(
        rows.where(~F.col("held_out")).select("text")
        .mapInArrow(count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).withColumn("bin", bin_of(F.col("n"))),
        "words",
    )
    of_end = F.col("word") == F.lit(END)
    total = counts.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(of_end, F.col("n"))).alias("ends"),
        F.count(F.when(~of_end & (F.col("n") >= min_count), 1)).alias("often"),
    ).first()
    n, v, ends = total["n"] or 0, total["v"], total["ends"] or 0
    cut, taken = 1 << 30, 0
    for r in sorted(counts.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
        taken += r["count"]
        if taken > head_words:
            break
        cut = r["bin"]
    top = counts.where((F.col("bin") >= cut) & ~of_end).select("word", "n").toArrow()
    order = sorted(zip(top.column("word").to_pylist(), top.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    own = np.array([c for _, c in order] + [ends], np.int64)
    head, often = len(order), int((own[:-1] >= min_count).sum())
    k = classes or classes_for(total["often"])
    size = min(clustered or CORE_PER_CLASS * k, often)
    k = max(min(k, size), 1)

    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = rows.mapInArrow(encode(spark.sparkContext.broadcast([w for w, _ in order])), f"doc_id {kind}, held_out boolean, ids binary, words array<binary>")
    encoded = stored(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    train = encoded.where(~F.col("held_out"))

    # the exchange, over numbers 0 .. size - 1, size for other words, size + 1 for the end
    number = np.concatenate((np.minimum(np.arange(head), size), [size + 1]))
    pair_counts = train.select("ids").mapInArrow(count_pairs(number, size + 2), "v bigint, w bigint, n bigint")
    bigrams = stored(pair_counts.groupBy("v", "w").agg(F.sum("n").alias("n")), "bigrams")
    model = exchange(bigrams, size, k, rounds)
    discard(bigrams)

    # the class of every other word that occurs often enough
    of = np.full(head + 1, k, np.int64)
    of[:size], of[head] = model.of[:size], k + 1
    seek = np.concatenate((np.arange(head) < often, [False])) & (of == k)
    beside = train.select("ids", "words").mapInArrow(count_profiles(of, seek, k), "id int, word binary, beside binary")
    beside = beside.repartition("id", "word").sortWithinPartitions("id", "word")
    assigned = stored(beside.mapInArrow(assign(model.pairs, model.total, k, min_count), "id int, word binary, class int"), "classes")
    # at most the frequent words
    found = assigned.where("id >= 0").select("id", "class").toArrow()
    of[found.column("id").to_numpy()] = found.column("class").to_numpy()

    # counts and classes of the other words, in the order of each text's list
    known = counts.where((F.col("bin") < cut) & ~of_end).select("word", "n").join(assigned.where("id < 0").select("word", "class"), "word", "left")
    away = encoded.where(F.size("words") > 0).select("row", F.posexplode("words").alias("j", "word")).join(known, "word", "left")
    entry = F.struct("j", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(k)).alias("class"))
    lists = away.groupBy("row").agg(F.sort_array(F.collect_list(entry)).alias("x"))
    texts = encoded.select("row", "ids", "doc_id", "held_out").join(lists, "row", "left")
    texts = stored(texts.select("ids", "doc_id", "held_out", F.col("x.n").alias("n"), F.col("x.class").alias("class")), "numbered")
    discard(encoded)

    width = k + 2
    pair_counts = texts.where(~F.col("held_out")).select("ids", "class").mapInArrow(count_pairs(of, width, 1), "v bigint, w bigint, n bigint")
    met = pair_counts.groupBy("v", "w").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros((width, width))
    pairs[met.column("v").to_numpy(), met.column("w").to_numpy()] = met.column("n").to_numpy()
    smooth = pairs + SMOOTHING
    transitions = np.log10(smooth / smooth.sum(axis=1, keepdims=True))
    members = np.bincount(of[:head], minlength=width)
    for r in assigned.where("id < 0").groupBy("class").count().collect():
        members[r["class"]] += r["count"]
    # the others: all words seen but in no class, and one for those not seen
    members[k] = v - (ends > 0) - members[:k].sum() + 1
    in_class = pairs.sum(axis=0)
    totals = np.log10(np.maximum(in_class + SMOOTHING * members, SMOOTHING))
    plain = float(np.log10(n + SMOOTHING * (v + 1)))

    scored = texts.select("ids", "doc_id", "held_out", "n", "class").mapInArrow(
        score_texts(own, of, transitions, totals, plain),
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double",
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast(T.LongType()).alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
