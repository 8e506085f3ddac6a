"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

A document is contaminated if some stretch of its words has an edit distance of
at most ``1 - similarity`` times the item's number of words to a benchmark item
(words in lower case, punctuation left out; each character of a script without
spaces, such as Chinese, Japanese or Thai, is a word).

Items are cut into chunks of at most ``CHUNK`` words. A match within the limit
holds, by the pigeonhole principle, a chunk within the chunk's own limit, so
only chunks are searched, whatever the length of the item, and the whole item is
verified. The random walk of Chakraborty, Goldenberg and Koucky (2016) copies the
current word of a chunk or of a window of its size, and moves on or stays by a
random bit of step and word: edits then cost few differing places, so that
sampling places is a hash for edit distance. Half of the repetitions walk from the
end. Only the first n steps of n words are sampled, which every walk reaches
before it runs out, so that windows of unrelated words differ there. Each
repetition, with a walk of its own, samples ``SAMPLED`` places; a window that
equals its chunk in all of them in any repetition is a candidate. The number of
repetitions follows from the target recall and the share of equal places at the
distance limit (AGREE, below the least over all lengths, 0.73 as the tests measure it).
Candidates are verified by the exact distance to the best stretch around them.

Only windows that can match are embedded: a chunk with at most e edits leaves
one of its e + 1 pieces as it is, so windows start where a piece stands, at most
e words to either side. This loses nothing and spares the walk for nearly all
positions of the corpus.

Items are taken in blocks of ``BLOCK_CHARS`` characters (a larger one by itself),
which bounds what the driver holds and what is broadcast; each block is one pass
over the documents.

Defined cases: null and empty texts are clean; items without words, null ones too,
are found nowhere; items so short that the limit allows no edit (below five words
at a similarity of 0.8) are found where their words stand one after another. Such
words stand in ordinary prose, too: ``contaminated`` reports them, while
``drop_contaminated`` drops no document for an item with fewer than ``drop_words``
words. Equal items are each reported; repeated rows are reported each time; of
several stretches of a document for one item the one with the least distance
counts, then the first; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tablelab.llm import kernels

AGREE, SAMPLED, RECALL = 0.65, 4, 0.99
CHUNK, MIN_WORDS, BLOCK_CHARS = 19, 5, 4_000_000
AT_ONCE, CELLS = 2048, 1 << 21
_FILTER_LOG = 20
#: Thai, Lao, Myanmar, Khmer, kana, and the Han blocks; then the punctuation that goes with them.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3041}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
MARKS = r"\x{3000}-\x{3040}\x{30FB}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}"


def prepared(text: Column) -> Column:
    """Texts in lower case, with spaces around each character of a script without spaces and instead of its punctuation."""
    text = F.lower(text.cast("string"))
    apart = F.regexp_replace(F.regexp_replace(text, f"[{MARKS}]", " "), f"([{UNSPACED}])", " $1 ")
    return F.when(text.rlike(f"[{UNSPACED}{MARKS}]"), apart).otherwise(text)


def repetitions(recall: float = RECALL, agree: float = AGREE, sampled: int = SAMPLED) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled))


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each position on, across the ends of rows, too."""
    weights, n = kernels.numbers(21, 64), len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        out += hashes[j : j + len(out)] * weights[j % 64] * np.uint64(2 * (j // 64) + 1)
    return kernels.mix(out)


def _cut(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The words from ``begin`` to ``end``, one row each, zeros beyond."""
    at = begin[:, None] + np.arange(width)
    return np.where(at < end[:, None], hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))


def walk_keys(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, sizes: np.ndarray, reps: int) -> np.ndarray:
    """LSH keys, one row a repetition, of the words from ``begin`` to ``end``, for chunks of ``sizes`` words."""
    n, width = len(begin), int(sizes.max(initial=1)) + 1
    part = np.linspace(0, 1, 4096, endpoint=False)[(kernels.numbers(31, reps * SAMPLED) >> np.uint64(52)).astype(np.int64)]
    part = (np.arange(SAMPLED).reshape(SAMPLED, 1, 1) + part.reshape(SAMPLED, reps, 1)) / SAMPLED
    place = np.floor(part * sizes).astype(np.int64)
    ahead = _cut(hashes, begin, end, width)
    back = _cut(hashes[::-1], len(hashes) - end, len(hashes) - begin, width)
    text = np.stack([ahead, back])
    side, rows = (np.arange(reps) % 2)[:, None], np.arange(n)
    at, keys = np.zeros((reps, n), np.int64), np.zeros((reps, n), np.uint64)
    for step in range(int(place.max(initial=-1)) + 1):
        here = text[side, rows, at]
        for s in range(SAMPLED):
            hit = place[s] == step
            keys[hit] += here[hit] * kernels.numbers(41, SAMPLED)[s]
        bits = (here * kernels.numbers(1000 + step, reps)[:, None]) >> np.uint64(63)
        at += bits.astype(np.int64)  # below the next step, so within the row
    return kernels.mix(keys)


def edit_spans(item: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``text``: the least edit distance of ``item`` to a stretch of it, the stretch's start and end."""
    one, width = np.int64(1) << np.int64(32), text.shape[1] + 1
    along = np.arange(width) * one
    best = np.broadcast_to(np.arange(width), (len(text), width)).astype(np.int64)  # cost above, start below
    for word in item:
        step = best + one
        step[:, 1:] = np.minimum(step[:, 1:], best[:, :-1] + np.where(text == word, 0, one))
        best = np.minimum.accumulate(step - along, axis=1) + along
    end = best.argmin(axis=1)
    found = best[np.arange(len(text)), end]
    return found >> np.int64(32), found & np.int64(0xFFFFFFFF), end


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float, recall: float) -> None:
        self.hashes, _, rows = _words(pa.array(texts, pa.string()))
        held = np.flatnonzero(np.diff(rows))
        self.ids = np.array(ids, np.int64)[held]
        self.first, self.sizes = rows[:-1][held], np.diff(rows)[held]
        self.edits = self._allowed(self.sizes, similarity)
        parts = -(-self.sizes // CHUNK)  # of nearly equal size
        self.owner = np.repeat(np.arange(len(held)), parts)
        nth = np.arange(len(self.owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.offset = self.sizes[self.owner] * nth // parts[self.owner]
        self.length = self.sizes[self.owner] * (nth + 1) // parts[self.owner] - self.offset
        self.slack = self._allowed(self.length, similarity)
        self.exact = ((self.edits == 0) & (parts == 1))[self.owner]  # its only piece is the item
        self.reps = repetitions(recall)
        begin = self.first[self.owner] + self.offset
        self.keys = np.zeros((self.reps, len(begin)), np.uint64)
        walked = np.flatnonzero(~self.exact)
        for i in range(0, len(walked), AT_ONCE):
            own = walked[i : i + AT_ONCE]
            self.keys[:, own] = walk_keys(self.hashes, begin[own], begin[own] + self.length[own], self.length[own], self.reps)
        pieces = self.slack + 1
        chunk = np.repeat(np.arange(len(begin)), pieces)
        nth = np.arange(len(chunk)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        low = self.length[chunk] * nth // pieces[chunk]
        k = self.length[chunk] * (nth + 1) // pieces[chunk] - low
        self.pieces = {}
        for size in np.unique(k).tolist():
            own = np.flatnonzero(k == size)
            key = _grams(self.hashes, size)[begin[chunk[own]] + low[own]]
            order = np.argsort(key, kind="stable")
            marks = np.zeros(1 << _FILTER_LOG, bool)
            marks[key >> np.uint64(64 - _FILTER_LOG)] = True
            self.pieces[size] = (key[order], np.stack([chunk[own], low[own]], axis=1)[order], marks)

    @staticmethod
    def _allowed(sizes: np.ndarray, similarity: float) -> np.ndarray:
        return np.floor(sizes * (1 - similarity) + 1e-9).astype(np.int64)

    def windows(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(row, chunk, start) of all windows in which a piece of a chunk stands at its place."""
        out = [np.empty((0, 3), np.int64)]
        for k, (key, owner, marks) in self.pieces.items():
            grams = _grams(hashes, k)
            at = np.flatnonzero(marks[grams >> np.uint64(64 - _FILTER_LOG)])
            low, high = np.searchsorted(key, grams[at], "left"), np.searchsorted(key, grams[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            row = np.searchsorted(rows, at, "right") - 1
            whole = at + k <= rows[row + 1]
            at, low, n, row = at[whole], low[whole], n[whole], row[whole]
            hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.stack([np.repeat(row, n), owner[hit, 0], np.repeat(at, n) - owner[hit, 1]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def candidates(self, windows: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The windows that equal their chunk in all sampled places of a repetition, moved by no more words than the chunk allows edits."""
        passed = np.zeros(len(windows), bool)
        for i in range(0, len(windows), AT_ONCE):
            row, chunk, start = windows[i : i + AT_ONCE].T
            shifts = 2 * self.slack[chunk] + 1
            base = np.repeat(np.arange(len(row)), shifts)
            moved = np.arange(len(base)) - np.repeat(np.cumsum(shifts) - shifts, shifts) - self.slack[chunk[base]]
            row, chunk, start = row[base], chunk[base], start[base] + moved
            begin, end = np.maximum(start, rows[row]), np.minimum(start + self.length[chunk], rows[row + 1])
            keys = walk_keys(hashes, begin, end, self.length[chunk], self.reps)
            passed[i + base[(keys == self.keys[:, chunk]).any(axis=0)]] = True
        return windows[passed]

    def matches(self, hashes: np.ndarray, rows: np.ndarray) -> list[tuple]:
        """(row, item, distance, first word, end word) of each contaminated row and item, words counted within the row."""
        found: dict[tuple, tuple] = {}
        windows = self.windows(hashes, rows)
        exact = self.exact[windows[:, 1]]
        row, chunk, start = windows[exact].T
        _, once = np.unique(windows[exact][:, :2], axis=0, return_index=True)  # windows are sorted: the first of each
        for r, c, x in zip(row[once], chunk[once], start[once] - rows[row[once]]):
            found[r, self.owner[c]] = (0, int(x), int(x + self.length[c]))
        row, chunk, start = self.candidates(windows[~exact], hashes, rows).T
        item, start = self.owner[chunk], start - self.offset[chunk]
        order = np.lexsort([start, row, item])
        row, item, start = row[order], item[order], start[order]
        # Places of an item close to each other are verified as one stretch, up to the item's length.
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(start) > self.edits[item[1:]])
        part = (start - start[new][np.cumsum(new) - 1]) // self.sizes[item]
        new[1:] |= part[1:] != part[:-1]
        lead = np.flatnonzero(new)
        tail = np.append(lead, len(row))[1:] - 1
        row, item, edits = row[lead], item[lead], self.edits[item[lead]]
        begin = np.maximum(start[lead] - edits, rows[row])
        end = np.minimum(start[tail] + self.sizes[item] + edits, rows[row + 1])
        for which in np.unique(item):
            own = np.flatnonzero(item == which)
            words, limit = self.hashes[self.first[which] : self.first[which] + self.sizes[which]], self.edits[which]
            width = int((end - begin)[own].max())
            for i in range(0, len(own), max(1, CELLS // width)):
                part = own[i : i + max(1, CELLS // width)]
                around = _cut(hashes, begin[part], end[part], width)
                for r, x, cost, left, right in zip(row[part], begin[part] - rows[row[part]], *edit_spans(words, around)):
                    if cost <= limit:
                        spot = (int(cost), int(x + left), int(x + right))
                        found[r, which] = min(spot, found.get((r, which), spot))
        return [(int(r), int(which), *spot) for (r, which), spot in sorted(found.items())]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return kernels.words(*kernels.byte_rows(column), kernels.MARKS)


def _blocks(items: DataFrame, id: str, text: str) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    rows = items.select(F.col(id).alias("id"), prepared(F.col(text)).alias("t")).filter("t IS NOT NULL AND id IS NOT NULL")
    for row in rows.toLocalIterator():
        if ids and size + len(row.t) > BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        size += len(row.t)
        ids.append(row.id)
        texts.append(row.t)
    if ids:
        yield ids, texts


def contaminated(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    similarity: float = 0.8, recall: float = RECALL,
) -> DataFrame:
    """One row a document and item found in it: ``id``, ``item_id``, ``distance``, ``similarity`` and the words ``from_word`` to ``to_word`` (left out)."""
    rows = docs.select(F.col(id).alias("id"), prepared(F.col(text)).alias("text"))
    names = ["id", "item_id", "distance", "similarity", "from_word", "to_word"]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item_id long, distance long, similarity double, from_word long, to_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, texts in _blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Items(ids, texts, similarity, recall))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block: Items = shared.value
            for batch in batches:
                for part in kernels.slices(batch, 1):
                    hashes, _, at = _words(part.column(1))
                    found = block.matches(hashes, at)
                    row, item, cost, left, right = (np.array(x, np.int64) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 5
                    known = block.ids[item]
                    near = 1 - cost / block.sizes[item]
                    columns = [part.column(0).take(pa.array(row)), *map(pa.array, (known, cost, near, left, right))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        out = out.unionAll(rows.mapInArrow(search, schema))
    return out.withColumnRenamed("id", id)


def _clean(shared: Broadcast, drop_words: int):
    """A function of texts: whether no item of at least ``drop_words`` words is found."""

    @F.arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        block: Items = shared.value
        kept, first = np.ones(len(column), bool), 0
        for part in kernels.slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0):
            hashes, _, at = _words(part.column(0))
            kept[[first + x[0] for x in block.matches(hashes, at) if block.sizes[x[1]] >= drop_words]] = False
            first += part.num_rows
        return pa.array(kept)

    return clean


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8,
    recall: float = RECALL, drop_words: int = MIN_WORDS,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item of at least ``drop_words`` words is found."""
    for ids, texts in _blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Items(ids, texts, similarity, recall))
        docs = docs.filter(_clean(shared, drop_words)(prepared(F.col(text))))
    return docs
