"""Numpy on Arrow buffers: words, shingles and fingerprints of whole texts, many rows at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: All of ASCII but letters and digits.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=256)
def numbers(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that look random and depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_PLACES = numbers(13, 64)
_KEPT_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row starts (one more entry for the end). Null: empty."""
    values = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def words(data: np.ndarray, at: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows, A-Z in lower case: their hashes, their first bytes, and where each row's words start.

    A word is a run of bytes that are not marked in ``between``: space and
    0x09-0x0D. Hashing takes eight bytes of every word at a time.
    """
    inside = ~between[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    opening = at[:-1][at[:-1] < at[1:]]
    first[opening] = inside[opening]
    last[opening[1:] - 1] = inside[opening[1:] - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    text = eights(_FOLD[data])
    hashes = mix(sizes.astype(np.uint64) + _PLACES[61])
    left, here = np.arange(len(starts)), 0
    while len(left):
        chunk = text[starts[left] + here] & _KEPT_BYTES[np.minimum(sizes[left] - here, 8)]
        hashes[left] = mix(hashes[left] * _PLACES[60] + chunk)
        here += 8
        left = left[sizes[left] > here]
    return hashes, starts, np.searchsorted(starts, at)


def word_sizes(data: np.ndarray, starts: np.ndarray, between: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of the words that begin at ``starts``."""
    outside = np.flatnonzero(between[data])
    ends = np.concatenate([outside, [len(data)]])[np.searchsorted(outside, starts)]
    return np.minimum(ends, at[np.searchsorted(at, starts, "right")]) - starts


def distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, sorted, and where each row starts."""
    out = hashes.copy()
    for i in range(len(rows) - 1):
        out[rows[i] : rows[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[rows[:-1][rows[:-1] < rows[1:]]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[rows]


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each row, and where each row's start; a shorter row with words has one, the whole of it."""
    n = np.diff(rows)
    end = np.repeat(rows[1:], n)
    place = np.arange(len(hashes))
    kept = (place + k <= end) | ((place == np.repeat(rows[:-1], n)) & (np.repeat(n, n) < k))
    out = np.minimum(end - place, k).astype(np.uint64) * _PLACES[63]
    for j in range(k):
        part = hashes[j:] * _PLACES[j]
        out[: len(part)] += np.where(place[: len(part)] + j < end[: len(part)], part, np.uint64(0))
    per_row = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    return mix(out[kept]), np.concatenate([[0], np.cumsum(per_row)])


def set_keys(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One number for each row's set of values, whatever their order."""
    n = np.diff(rows)
    sums = np.zeros(len(n), np.uint64)
    if len(values):
        sums[n > 0] = np.add.reduceat(mix(values ^ _PLACES[62]), rows[:-1][n > 0])
    return mix(sums ^ n.astype(np.uint64))


def slices(batch: pa.RecordBatch, column: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about ``size`` bytes of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
        yield batch.slice(i, j - i)
        i = j


def squeezed(column: pa.Array) -> pa.Array:
    """Each text compressed by itself, for a shuffle. Null: empty."""
    codec = pa.Codec("zstd", 1)
    texts = (v.as_buffer() or b"" for v in pc.fill_null(column.cast(pa.large_binary()), b""))
    return pa.array([len(t).to_bytes(8) + (codec.compress(t, asbytes=True) if len(t) else b"") for t in texts], pa.binary())


def expanded(column: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd", 1)
    values = (v.as_py() for v in column)
    return pa.array([codec.decompress(v[8:], int.from_bytes(v[:8]), asbytes=True) if len(v) > 8 else b"" for v in values], pa.large_binary())


def whole_groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.Array]]:
    """The columns of rows that are sorted by the first column, cut between its values, ``size`` batches at a time at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key, key[-1]))  # where the group that may go on begins
        if len(held) > size and last:
            held[-1] = batch.slice(0, last)
            yield [pa.concat_arrays(c) for c in zip(*(b.columns for b in held))]
            held = [batch.slice(last)]
    if held:
        yield [pa.concat_arrays(c) for c in zip(*(b.columns for b in held))]
