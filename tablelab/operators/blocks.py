"""Matrices that tasks make, brought together without many of them in one place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = "key int, block binary"
MERGERS = 8

Merge = Callable[[np.ndarray, np.ndarray], np.ndarray]


def block_batch(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    keys, cells = list(found), [np.ascontiguousarray(a, dtype=float).tobytes() for a in found.values()]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(cells, pa.binary())], names=["key", "block"])


def merged(blocks: DataFrame, width: int, merge: Merge) -> dict[int, np.ndarray]:
    """One matrix of ``width`` columns a key: merged on executors first, then the few that are left one after another."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.frombuffer(cells.as_buffer(), float).reshape(-1, width)
                held[key] = merge(held[key], one) if key in held else one
        yield block_batch(held)

    out: dict[int, np.ndarray] = {}
    for row in blocks.repartition(MERGERS).mapInArrow(step, BLOCK).toLocalIterator(prefetchPartitions=True):
        one = np.frombuffer(row["block"], float).reshape(-1, width)
        out[row["key"]] = merge(out[row["key"]], one) if row["key"] in out else one
    return out


def r_factor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The triangular factor of two factors on top of each other."""
    return np.linalg.qr(np.vstack([a, b]), mode="r")
