"""Suffix-array dedup: bytes covered by long strings that occur more than once, by distributed prefix doubling.

A position is repeated if the ``size`` bytes from it on also start anywhere else.
Prefix doubling finds these positions: the rank of a position at length h is the
pair of the ranks of its two halves (64-bit fingerprints stand for ranks, so that
equal strings have equal ranks in every task), Spark sorts position-rank rows,
and only positions whose rank is not unique go on to the next length, until
``size`` is reached.

Two things keep the rows few without losing a position. First, a length below
``size`` is ranked only at sampled positions: of all positions at which a string
of that length fits into a window of ``size`` bytes, the one with the smallest
rank. Equal windows sample the same place, so a window whose sample is unique is
unique. Second, the last step ranks runs of neighbouring windows that share their
sample (of ``size - SPREAD`` bytes) together, by the fingerprint of all their
bytes: equal runs are repeated as a whole, and only runs that differ while their
sample is shared, one for each content, are ranked window by window.

Rows of one rank are read as a sorted stream. Repeats within a slice of a task's
input are found there and send one row on, so that a string that a third of all
documents hold reaches its task as a row for each slice.

The same search over words instead of bytes tells which documents share a passage:
a run of ``words`` words (runs of bytes other than space and 0x09-0x0D, A-Z in lower
case) that another document holds, too. A document's own repeats don't count there,
but a repeated row does. Its rows are ranked at a quarter and at half of that length.

Defined cases: texts are their UTF-8 bytes; a null text is empty; matches never
cross documents; overlapping matches and matches within one document count; all
are judged on the input; repeated rows are documents of their own; an empty table
gives an empty result; other columns are ignored. Cutting may split a character,
so what is kept is binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablelab.llm import kernels
from tablelab.session import materialise, release, written

SIZE, FIRST, SPREAD = 400, 100, 64
CHUNK, ROWS = 1 << 20, 1 << 16
_BASE, _BYTES = kernels.numbers(61, 1)[0], kernels.numbers(62, 256)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_KEY = "id long, h long"


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        row = np.full(n, base, np.uint64)
        row[:1] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


class Prints:
    """Fingerprints of the stretches of a string of at most ``CHUNK + size`` bytes, or hashes of words, from sums over its prefixes."""

    def __init__(self, data: np.ndarray, size: int) -> None:
        up, self.back = _powers(CHUNK + size + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTES[data] if data.dtype == np.uint8 else data) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return kernels.mix((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        return kernels.mix((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length])

    def ranks(self, length: int) -> np.ndarray:
        """The rank at ``length`` of every position: the pair of the ranks of its halves."""
        half = self.all(length // 2)
        return kernels.mix(half[: -(length // 2)] * kernels.numbers(63, 2)[0] + half[length // 2 :] * kernels.numbers(63, 2)[1])


def window_minima(values: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The place of the smallest value, the first on ties, of each run of ``width`` values.

    Values are compared by their upper bits; the place takes the lower ``bits``, so that one minimum a step finds both.
    """
    bits = np.uint64(bits)
    low, span = ((values >> bits) << bits) | np.arange(len(values), dtype=np.uint64), 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[step:], low[:-step])
        span += step
    return (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _asked(at: np.ndarray, spans: pa.Array | None, size: int) -> np.ndarray:
    """Which windows of some documents, one behind the other, are still asked for: all that lie in a document, or those in its spans."""
    if spans is None:
        long = np.flatnonzero(np.diff(at) >= size)
        return _marked(at, at[long], at[long + 1] - size + 1)
    owner, low, high = _flat(spans)
    return _marked(at, at[owner] + low, at[owner] + high + 1)


def _marked(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    steps = np.zeros(int(at[-1]) + 2, np.int32)
    np.add.at(steps, low, 1)
    np.add.at(steps, high, -1)
    return np.cumsum(steps) > 0


def sampled(data: np.ndarray, asked: np.ndarray, length: int, size: int) -> np.ndarray:
    """Rank of the sample, first and last window, fingerprint of all bytes and the sample's place in them: of each run of windows."""
    out = [np.empty((0, 4), np.uint64)]
    for at in range(0, len(data) - size + 1, CHUNK):
        here = data[at : at + CHUNK + size - 1]
        own = asked[at : at + len(here) - size + 1]
        if not own.any():
            continue
        prints = Prints(here, size)
        ranks = prints.ranks(length)
        place = window_minima(ranks, size - length + 1, (CHUNK + size).bit_length())
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        first, last = first[own[first]], last[own[first]]
        run = kernels.mix(prints.of(first, last + size) + (place[first] - first).astype(np.uint64) * kernels.numbers(64, 1)[0])
        out.append(np.stack([ranks[place[first]], (first + at).astype(np.uint64), (last + at).astype(np.uint64), run], axis=1))
    return np.concatenate(out)


def _flat(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and last window of all spans of a column."""
    sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    cells = spans.flatten()
    return np.repeat(np.arange(len(spans)), sizes), *(cells.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))


def _units(texts: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, or hashes of the words, of all texts one behind the other, and where each text's start."""
    data, at = kernels.byte_rows(texts)
    if words:
        data, _, at = kernels.words(data, at)
    return data, at


def _once(owner: np.ndarray, *columns: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """The first row of those that are alike within one document, one marked in ``last`` only if all are."""
    order = np.lexsort((*([] if last is None else [last]), *columns, owner))
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in (owner, *columns)], axis=0)
    return np.sort(order[new])


def _positions(docs: DataFrame, length: int, size: int, runs: bool, squeezed: bool, words: bool = False) -> DataFrame:
    """Rows ``rank``, ``run``, ``id``, ``h``, ``lo``, ``hi``, ``known``: runs of windows by their sample; ``known``: repeated within the slice.

    Of the rows of a slice that are alike only one keeps the rank as ``key``.
    Runs of words that are alike in one document are one row.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, 2, (1 if squeezed else 8) << 20):
                data, at = _units(kernels.expanded(part.column(2)) if squeezed else part.column(2), words)
                rows = sampled(data, _asked(at, part.column(3) if squeezed else None, size), length, size)
                owner = np.searchsorted(at, rows[:, 1].astype(np.int64), "right") - 1
                rows[:, 1:3] -= at[owner].astype(np.uint64)[:, None]
                if words and runs:
                    first = _once(owner, rows[:, 0], rows[:, 3])
                    rows, owner = rows[first], owner[first]
                rank, run = rows[:, 0], rows[:, 3] if runs else rows[:, 0]
                order = np.lexsort((run, rank))
                alike = (rank[order][1:] == rank[order][:-1]) & (run[order][1:] == run[order][:-1])
                known, second = np.zeros(len(order), bool), np.zeros(len(order), bool)
                known[order[1:]] |= alike
                known[order[:-1]] |= alike
                second[order[1:]] = alike
                key = np.where(second, kernels.mix(rank + rows[:, 1] + kernels.mix(owner.astype(np.uint64) + rank)), rank)
                columns = [key.view(np.int64), run.view(np.int64), rows[:, 1].view(np.int64), rows[:, 2].view(np.int64), known]
                owner = pa.array(owner, pa.int64())
                arrays = [*(pa.array(np.ascontiguousarray(c)) for c in columns[:2]), part.column(0).take(owner), part.column(1).take(owner)]
                arrays += [pa.array(np.ascontiguousarray(c)) for c in columns[2:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "run", "id", "h", "lo", "hi", "known"])

    return docs.mapInArrow(scan, f"key long, run long, {_KEY}, lo long, hi long, known boolean")


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows whose key and run are not unique (``whole``), and one of each run whose key has several (``mixed``), as a sorted stream."""
    names = ["id", "h", "lo", "hi", "whole", "mixed"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, later = None, None, False  # the row that waits for its successor, the one before it, whether that one's run is not its key's first
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_batches([held, batch]) if held is not None else batch
            yield from judge(table, before, later, False)
            n = table.num_rows
            key, run = (table.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if n > 1:
                later, before = bool(kinds(key, run, before, later)[-2]), (key[-2], run[-2])
            held = table.slice(n - 1)
        if held is not None:
            yield from judge(held, before, later, True)

    def kinds(key, run, before, later) -> np.ndarray:
        """Whether each row's run is not the first of its key."""
        first_key = np.concatenate([[before is None or key[0] != before[0]], key[1:] != key[:-1]])
        if not first_key[0] and before is not None:
            changed0 = later or run[0] != before[1]
        else:
            changed0 = False
        changed = np.concatenate([[changed0], (run[1:] != run[:-1]) & (key[1:] == key[:-1])])
        groups = np.cumsum(first_key)
        total = np.cumsum(changed)
        opening = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        base = total[opening] - changed[opening]
        return total - np.repeat(base, np.diff(opening, append=len(key))) > 0

    def judge(table: pa.RecordBatch, before, later, end: bool) -> Iterator[pa.RecordBatch]:
        key, run, known = (table.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 6))
        n = len(key) if end else len(key) - 1
        if not n:
            return
        as_before = np.concatenate([[before is not None and key[0] == before[0] and run[0] == before[1]], (key[1:] == key[:-1]) & (run[1:] == run[:-1])])
        as_next = np.append(as_before[1:], False)
        same_key_next = np.append(key[1:] == key[:-1], False)
        whole = known | as_before | as_next
        mixed = ~as_next & (same_key_next | kinds(key, run, before, later))
        kept = np.flatnonzero((whole | mixed)[:n])
        out = [table.column(i).take(pa.array(kept)) for i in (2, 3, 4, 5)]
        yield pa.RecordBatch.from_arrays([*out, pa.array(whole[kept]), pa.array(mixed[kept])], names=names)

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "run")
    return sorted_rows.mapInArrow(stream, f"{_KEY}, lo long, hi long, whole boolean, mixed boolean")


def _windows(docs: DataFrame, size: int, words: bool = False) -> DataFrame:
    """One row a window of the spans that are to be looked at singly; ``known`` if the window is repeated already.

    Windows of words that are alike in one document are one row.
    """

    def keys(data: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(data) - size + 1, CHUNK):
            here = data[at : at + CHUNK + size - 1]
            own = np.flatnonzero(asked[at : at + len(here) - size + 1])
            if len(own):
                yield Prints(here, size).all(size)[own].view(np.int64), own + at

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, 2, 1 << 20):
                data, at = _units(kernels.expanded(part.column(2)), words)
                owner, low, high = _flat(part.column(3))
                low, high, whole = at[owner] + low, at[owner] + high + 1, part.column(3).flatten().field(2).to_numpy(zero_copy_only=False)
                known, found = _marked(at, low[whole], high[whole]), keys(data, _marked(at, low, high))
                if words:  # a document's own repeats are one row
                    key, starts = (np.concatenate(c) for c in zip(*found))
                    first = _once(np.searchsorted(at, starts, "right") - 1, key, last=~known[starts])
                    found = [(key[first], starts[first])]
                for key, starts in found:
                    for i in range(0, len(key), ROWS):
                        some = starts[i : i + ROWS]
                        owner = np.searchsorted(at, some, "right") - 1
                        one, own, place = pa.array(owner), pa.array(key[i : i + ROWS]), pa.array(some - at[owner])
                        yield pa.RecordBatch.from_arrays(
                            [own, own, part.column(0).take(one), part.column(1).take(one), place, place, pa.array(known[some])],
                            names=["key", "run", "id", "h", "lo", "hi", "known"],
                        )

    return docs.mapInArrow(scan, f"key long, run long, {_KEY}, lo long, hi long, known boolean")


def _by_document(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("id", "h").agg(F.collect_list(F.struct("lo", "hi", *columns)).alias("spans"))


def _with(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    same = F.col("d.id").eqNullSafe(F.col("s.id")) & F.col("d.h").eqNullSafe(F.col("s.h"))
    return docs.alias("d").join(spans.alias("s"), same, how).select("d.*", *(f"s.{c}" for c in spans.columns if c not in ("id", "h")))


def _squeezed(docs: DataFrame) -> DataFrame:
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kernels.squeezed(batch.column(2))], names=["id", "h", "text"])

    return docs.mapInArrow(squeeze, f"{_KEY}, text binary")


def _passages(stored: DataFrame, words: int) -> DataFrame:
    """Runs of windows of words as :func:`_repeated` tells them, of the documents that have any to look at."""
    docs = stored.filter("passages IS NOT NULL").select("id", "h", "text", "passages")
    return _repeated(_positions(docs, words // 4 * 2, words, True, True, True))


def _sharing(stored: DataFrame, runs: DataFrame, words: int) -> DataFrame:
    """``id`` and ``h`` of the documents that share a run of words with another one."""
    mixed = _with(stored.select("id", "h", "text"), _by_document(runs.filter("mixed"), "whole"), "inner")
    single = _repeated(_windows(mixed, words, True)).filter("whole")
    return runs.filter("whole").select("id", "h").unionAll(single.select("id", "h")).distinct()


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, first: int = FIRST, words: int | None = None) -> DataFrame:
    """One row a document: ``id``, ``kept`` (the bytes that are left), ``spans`` (removed, start and end) and ``n_bytes``.

    With ``words`` (4 at least) also ``shares_passage``: whether another document holds that many of its words in a row.
    """
    if words is not None and words < 4:
        raise ValueError("passages have four words at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("string").alias("text"))
    spread, length = min(SPREAD, size // 4), first // 2 * 2
    joined = _with(_squeezed(rows), _by_document(_repeated(_positions(rows, length, size, False, False)).filter("whole")), "left")
    sharing = None
    if words is not None:
        passages = _repeated(_positions(rows, words // 8 * 2 or 2, words, False, False, True)).filter("whole")
        joined = _with(joined, _by_document(passages).withColumnRenamed("spans", "passages"), "left")
    stored = materialise(joined, "doubling")
    texts = written(spark)[-1:]
    if words is not None:
        runs = materialise(_passages(stored, words), "passages")
        done_with = written(spark)[-1:]
        sharing = materialise(_sharing(stored, runs, words), "sharing").withColumn("shares", F.lit(True))
        release(spark, done_with)
        stored = stored.drop("passages")
    while 2 * length <= size - spread:
        length *= 2
        spans = _by_document(_repeated(_positions(stored.filter("spans IS NOT NULL"), length, size, False, True)).filter("whole"))
        stored = materialise(_with(stored.drop("spans"), spans, "left"), "doubling")
        release(spark, texts)  # the copy before is read no more
        texts = written(spark)[-1:]

    longest = (size - spread) // 2 * 2
    runs = materialise(_repeated(_positions(stored.filter("spans IS NOT NULL"), longest, size, True, True)), "runs")
    mixed = _with(stored.drop("spans"), _by_document(runs.filter("mixed"), "whole"), "inner")
    single = _repeated(_windows(mixed, size)).filter("whole")
    final = _by_document(runs.filter("whole").select("id", "h", "lo", "hi").unionAll(single.select("id", "h", "lo", "hi")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, 2, 1 << 20):
                data, at = kernels.byte_rows(kernels.expanded(part.column(2)))
                owner, low, high = _flat(part.column(3))
                steps = np.zeros(len(data) + 1, np.int32)
                np.add.at(steps, at[owner] + low, 1)
                np.add.at(steps, at[owner] + high + size, -1)
                gone = np.cumsum(steps)[:-1] > 0
                # A run of removed bytes ends with its document.
                first, last = gone.copy(), gone.copy()
                first[1:] &= ~gone[:-1]
                last[:-1] &= ~gone[1:]
                opening = at[:-1][at[:-1] < at[1:]]
                first[opening] = gone[opening]
                last[opening[1:] - 1] = gone[opening[1:] - 1]
                start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
                places = np.searchsorted(start, at)
                of = np.repeat(at[:-1], np.diff(places))
                cells = pa.StructArray.from_arrays([pa.array(start - of), pa.array(end - of)], names=["start", "end"])
                kept = np.concatenate([[0], np.cumsum(~gone)])[at].astype(np.int64)
                left = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(kept.tobytes()), pa.py_buffer(data[~gone].tobytes())])
                arrays = [part.column(0), left.cast(pa.binary()), pa.ListArray.from_arrays(pa.array(places, pa.int32()), cells), pa.array(np.diff(at))]
                arrays += [pc.fill_null(c, False) for c in part.columns[4:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "kept", "spans", "n_bytes", "shares_passage"][: len(arrays)])

    done = _with(stored.drop("spans"), final, "left")
    schema = "id long, kept binary, spans array<struct<start:long,end:long>>, n_bytes long"
    if sharing is not None:
        done, schema = _with(done, sharing, "left"), schema + ", shares_passage boolean"
    done = done.mapInArrow(cut, schema)
    return done.withColumnRenamed("id", id)
