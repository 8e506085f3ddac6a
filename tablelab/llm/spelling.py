"""Spelling variants: words one edit apart, found with search schemes on a bidirectional FM-index.

Two words are near if one inserted, deleted or replaced code point makes one the
other. Cut the asked word into halves: the edit lies in one of them, so a near
word begins with the left half or ends with the right half. That gives two search
schemes: match the left half exactly from the word's beginning and extend across
the right half with one error allowed, or match the right half exactly from the
word's end and extend across the left half.

The index is a pair of FM-indexes over the delimited vocabulary, one for each
direction: in the index of the reversed text a backward step makes a match longer
on the right, in the index of the text on the left. A match is an interval of
suffix ranks; a step looks up where the interval's rows with a symbol begin and
end among the rows sorted by the symbol before them. Every word's delimiter ranks
by its place, so that suffixes are compared up to the end of their word only.

Spark cuts the vocabulary into blocks of about ``BLOCK`` words (fewer, if they are longer than 16 code points), ranges of the
sorted words for the first scheme and of the sorted reversed words for the second.
A word is asked in the blocks that its exact half can fall into, which are
neighbours; the two schemes are the same code on words and reversed words. The
driver holds the first word of each block (one word in ``BLOCK``), cut to ``EDGE``
code points.

Counting is a map-side combined aggregate of words, so that a frequent word is a
row a task. Roots follow forms by doubling: forms grow at least fivefold in count,
so that a handful of joins is enough.

Defined cases: null and empty texts hold no words; the id of a null ``id`` is the
empty text; repeated rows count each time; very long words are searched like
others; ties of the count go to the smaller word in code-point order; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelab.session import materialise

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
BLOCK, EDGE, STEP = 1 << 15, 64, 1 << 12
NOISE, SIZE, COUNT, RATIO = 199, 6, 5, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``run``: every run of letters of every whole text, A-Z in lower case."""
    found = F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    return rows.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))


def misspelt(id: Column, run: Column, noise: int = NOISE) -> Column:
    """The run; where its checksum with the id is divisible by ``noise``, without one code point."""
    h = F.crc32(F.concat(id, F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % noise == 0, shorter).otherwise(run)


def vocabulary(words: DataFrame, size: int = SIZE, count: int = COUNT) -> DataFrame:
    """``word`` and ``n`` of the words that are long and frequent enough."""
    counted = words.filter(F.length("word") >= size).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= count)


class Index:
    """FM-index of words delimited by their ends; steps go backwards, so it is built on words read backwards."""

    def __init__(self, words: list[np.ndarray]) -> None:
        sizes = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(sizes) - 1
        n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        text[np.ones(n, bool) if not n else ~np.isin(np.arange(n), ends)] = np.concatenate(words)
        self.symbols = np.unique(text[text > 0])
        code = np.searchsorted(self.symbols, text) + 1
        code[ends] = 0
        self.owner = np.repeat(np.arange(len(words)), sizes)
        rank = code + len(words)
        rank[ends] = np.arange(len(words))  # delimiters differ: no comparison goes beyond its word
        self.left = np.repeat(ends, sizes) - np.arange(n)  # code points up to the delimiter
        step, order = 1, np.argsort(rank, kind="stable")
        rank = self._dense(rank[order], order)
        while step <= sizes.max() and rank.max() + 1 < n:
            ahead = np.where(self.left >= step, np.arange(n) + step, 0)
            second = np.where(self.left >= step, rank[ahead] + 1, 0)
            key = rank * (n + 1) + second
            order = np.argsort(key, kind="stable")
            rank = self._dense(key[order], order)
            step *= 2
        self.suffix = np.argsort(rank, kind="stable")
        self.n, self.words = n, len(words)
        self.before = code[self.suffix - 1]  # the first suffix of all has the last delimiter before it
        self.by_symbol = np.argsort(self.before, kind="stable")
        self.steps = self.before[self.by_symbol] * (n + 1) + self.by_symbol

    @staticmethod
    def _dense(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(np.concatenate([[0], sorted_keys[1:] != sorted_keys[:-1]]))
        return out

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; one that the index does not hold gets a symbol that no row has."""
        at = np.minimum(np.searchsorted(self.symbols, points), len(self.symbols) - 1)
        return np.where(self.symbols[at] == points, at + 1, len(self.symbols) + 1)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one more symbol."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.steps, base + low), np.searchsorted(self.steps, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) of the symbols before the rows of each interval, delimiters left out."""
        size, sigma = high - low, len(self.symbols)
        few = np.flatnonzero(size <= sigma)
        which = np.repeat(few, size[few])
        rows = np.arange(len(which)) - np.repeat(np.cumsum(size[few]) - size[few], size[few]) + low[which]
        pairs = np.unique(which * (sigma + 1) + self.before[rows])
        many = np.flatnonzero(size > sigma)
        which, symbol = np.repeat(many, sigma), np.tile(np.arange(1, sigma + 1), len(many))
        which, symbol = np.concatenate([pairs // (sigma + 1), which]), np.concatenate([pairs % (sigma + 1), symbol])
        return which[symbol > 0], symbol[symbol > 0]

    def ended(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, word) of the words that begin where the interval's suffixes do."""
        first, last = np.searchsorted(self.steps, low), np.searchsorted(self.steps, high)
        which = np.repeat(np.arange(len(low)), last - first)
        at = np.arange(len(which)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[which]
        return which, self.owner[self.suffix[self.by_symbol[at]]]


def one_error(index: Index, asked: list[np.ndarray], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asked, word) of the words one edit apart that agree in the first ``exact`` code points; the index holds words read backwards."""
    sizes = np.array([len(a) for a in asked])
    starts = np.cumsum(sizes) - sizes
    symbols = index.codes(np.concatenate(asked))
    q, low, high = np.arange(len(asked)), np.zeros(len(asked), np.int64), np.full(len(asked), index.words)
    for j in range(int(exact.max(initial=0))):
        on = exact[q] > j
        low[on], high[on] = index.step(symbols[starts[q[on]] + j], low[on], high[on])
        alive = low < high
        q, low, high = q[alive], low[alive], high[alive]
    place, found = exact[q], []
    erred = (np.empty(0, np.int64),) * 4  # asked word, place, interval, after the error

    def further(q, place, low, high):
        """Matches that go on without an error, until the asked word ends."""
        open_ = place < sizes[q]
        done = ~open_
        which, word = index.ended(low[done], high[done])
        found.append(np.stack([q[done][which], word], axis=1))
        q, place, low, high = q[open_], place[open_], low[open_], high[open_]
        low, high = index.step(symbols[starts[q] + place], low, high)
        alive = low < high
        return q[alive], place[alive] + 1, low[alive], high[alive]

    while len(q) or len(erred[0]):
        if len(q):
            rest = place < sizes[q]
            which, symbol = index.branches(low, high)
            here = np.where(rest, symbols[np.minimum(starts[q] + place, len(symbols) - 1)], -1)
            to = index.step(symbol, low[which], high[which])
            swapped = rest[which] & (symbol != here[which])
            new = [
                (q[rest], place[rest] + 1, low[rest], high[rest]),  # the word lacks the code point
                (q[which], place[which], *to),  # the word has one more
                (q[which][swapped], place[which][swapped] + 1, to[0][swapped], to[1][swapped]),
            ]
            erred = tuple(np.concatenate([e, *parts]) for e, *parts in zip(erred, *new))
        erred = further(*erred)
        on = place < sizes[q]
        q, place, low, high = q[on], place[on], low[on], high[on]
        low, high = index.step(symbols[starts[q] + place], low, high)
        alive = low < high
        q, place, low, high = q[alive], place[alive] + 1, low[alive], high[alive]
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _points(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64) for w in column.to_pylist()]


def _half(word: Column) -> Column:
    return F.floor(F.length(word) / 2).cast("int")


def _scheme(words: DataFrame, exact: Column, label: str) -> DataFrame:
    """``word``, ``near``, ``near_n`` of the near words that agree in the first ``exact`` code points of ``key``."""
    spark = words.sparkSession
    total, points = words.agg(F.count("*"), F.sum(F.length("word"))).first()
    blocks = max(1, -(-total // BLOCK), -(-(points or 0) // (16 * BLOCK)))
    cut = words.repartitionByRange(blocks, "key").select("word", "n", "key", F.spark_partition_id().alias("block"))
    cut = materialise(cut, label)  # block numbers are written down: a sample of ranges drawn again would differ
    edges = cut.groupBy("block").agg(F.substring(F.min("key"), 1, EDGE).alias("low"), F.substring(F.max("key"), 1, EDGE).alias("high"))
    shared = spark.sparkContext.broadcast(sorted(tuple(r) for r in edges.collect()))  # one row a block

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.array([b for b, _, _ in shared.value], np.int64)
        low, high = (np.array([r[i].encode() for r in shared.value], object) for i in (1, 2))
        for batch in batches:
            heads = [h[:EDGE].encode() for h in batch.column(2).to_pylist()]
            first = np.array([np.searchsorted(high, h) for h in heads], np.int64)
            last = np.array([np.searchsorted(low, h + b"\xff", "right") for h in heads], np.int64)
            for i in range(0, batch.num_rows, STEP):
                n = np.maximum(last[i : i + STEP] - first[i : i + STEP], 0)
                row = np.repeat(np.arange(len(n)), n)
                block = numbers[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[i : i + STEP][row]]
                part = batch.slice(i, STEP)
                taken = [part.column(c).take(pa.array(row)) for c in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *taken], names=["block", "word", "key", "exact"])

    queries = cut.select("word", "key", F.substr("key", F.lit(1), exact).alias("head"), exact.alias("exact"))
    queries = queries.mapInArrow(routed, "block int, word string, key string, exact int")
    both = cut.select("block", F.lit(0).alias("asked"), "word", "key", "n", F.lit(0).alias("exact"))
    both = both.unionByName(queries.select("block", F.lit(1).alias("asked"), "word", "key", F.lit(0).cast("long").alias("n"), "exact"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index, names, counts = None, [], None, None, None
        for batch in batches:
            numbers, asked = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            turns = np.flatnonzero(np.diff(numbers * 2 + asked)) + 1
            for a, z in zip([0, *turns], [*turns, len(numbers)]):
                part = batch.slice(a, z - a)
                if not len(part):
                    continue
                if numbers[a] != block:
                    block, held, index = numbers[a], [], None
                if not asked[a]:
                    held.append(part)
                    continue
                if index is None:
                    table = pa.Table.from_batches(held)
                    names, counts = table.column(2).combine_chunks(), table.column(4).combine_chunks()
                    index, held = Index([p[::-1] for p in _points(table.column(3).combine_chunks())]), []
                for i in range(0, len(part), STEP):
                    some = part.slice(i, STEP)
                    q, w = one_error(index, _points(some.column(3)), some.column(5).to_numpy(zero_copy_only=False).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([some.column(2).take(pa.array(q)), names.take(pa.array(w)), counts.take(pa.array(w))], names=["word", "near", "near_n"])

    sorted_rows = both.repartition(max(1, blocks), "block").sortWithinPartitions("block", "asked")
    return sorted_rows.mapInArrow(match, "word string, near string, near_n long")


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n``: all pairs of words one edit apart, in both directions."""
    left = _scheme(words.withColumn("key", F.col("word")), _half("word"), "words")
    right = _scheme(words.withColumn("key", F.reverse("word")), F.length("word") - _half("word"), "reversed")
    return left.unionByName(right).distinct()


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form`` and ``form_n`` of every word: its near word of largest count, if that is ``ratio`` times its own."""
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best")
    )
    strong = -F.col("best.n") >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.w")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n"),
    )


def with_roots(found: DataFrame) -> DataFrame:
    """``found`` with ``root``: the last word that forms lead to."""
    links = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        links = materialise(links, "roots")
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(on, "root", "left_semi").isEmpty():
            break
        links = links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every long and frequent word of ``docs``."""
    words = runs(docs, id, text).select(misspelt(F.col("id"), F.col("run")).alias("word"))
    words = materialise(vocabulary(words), "vocabulary")
    return with_roots(materialise(forms(words), "forms")).select("word", "form", "root", "n", "n_near", "form_n")
