"""Sufficient statistics of a linear fit, from one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelab.functions.columns import col
from tablelab.operators.blocks import BLOCK, block_batch, merged, r_factor
from tablelab.operators.features import FeatureSpec
from tablelab.session import small_table

NARROW = 16  # design columns up to which plain sums are used
FACTOR_ROWS = 4096  # least rows that are added to a triangular factor at once
EIGEN_CUT = 1e-11  # relative size below which an eigenvalue counts as zero


@dataclass
class Gram:
    """Sums over rows of ``(1, x, y - shift)`` times its transpose."""

    names: list[str]
    cross: np.ndarray
    shift: float

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.names, self.cross + other.cross, self.shift)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.names, self.cross - other.cross, self.shift)

    @property
    def n(self) -> int:
        return int(round(self.cross[0, 0]))

    @property
    def sums(self) -> np.ndarray:
        return self.cross[0, 1:-1]

    @property
    def xx(self) -> np.ndarray:
        return self.cross[1:-1, 1:-1]

    def first(self, width: int) -> Gram:
        """The sums of the first ``width`` columns only."""
        keep = [*range(width + 1), len(self.cross) - 1]
        return Gram(self.names[:width], self.cross[np.ix_(keep, keep)], self.shift)

    @property
    def y_mean(self) -> float:
        return self.shift + self.cross[0, -1] / self.n

    def centred(self) -> tuple[np.ndarray, np.ndarray, float]:
        """X'X, X'y and y'y about the means."""
        s = self.cross[0, 1:]
        c = self.cross[1:, 1:] - np.outer(s, s) / self.n
        return c[:-1, :-1], c[:-1, -1], float(c[-1, -1])


def pseudo_inverse(a: np.ndarray) -> tuple[np.ndarray, int]:
    """Inverse on the space where a symmetric matrix is not numerically zero, and its rank."""
    values, vectors = np.linalg.eigh(a)
    keep = values > max(values.max(initial=0.0), 0.0) * EIGEN_CUT
    keep &= values > 0
    v = vectors[:, keep]
    return (v / values[keep]) @ v.T, int(keep.sum())


def _cross_of(row: Sequence[float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    upper = np.triu_indices(size)
    out[upper] = row
    return out + np.triu(out, 1).T


def grams(
    df: DataFrame,
    spec: FeatureSpec,
    target: str,
    shift: float,
    degree: int = 1,
    fold: Column | None = None,
) -> dict[int, Gram]:
    """The sums for each fold (fold 0 when there are none).

    Narrow designs are sums of products inside generated code. Wide ones are
    matrix products of Arrow batches, one partial matrix per task and fold,
    added up on executors.
    """
    width = spec.expanded_width(degree)
    fold = F.lit(0) if fold is None else fold
    y = col(target) - F.lit(float(shift))
    size = width + 2
    names = spec.names if degree == 1 else [f"z{i}" for i in range(width)]
    if width <= NARROW:
        z = [F.lit(1.0), *spec.products(degree), F.col("_y")]
        rows = spec.encode(df.withColumn("_fold", fold).withColumn("_y", y))
        flat = rows.select(F.col("_fold").alias("fold"), *[e.alias(f"z{i}") for i, e in enumerate(z)])
        products = [F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i in range(size) for j in range(i, size)]
        rows = flat.groupBy("fold").agg(F.array(*products).alias("g")).collect()
        return {r["fold"]: Gram(names, _cross_of(r["g"], size), shift) for r in rows}

    block, k = spec.reader(degree), len(spec.compact())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y = batch.column(k).to_numpy(zero_copy_only=False)
            z = np.column_stack([np.ones(len(y)), block(batch), y])
            of = batch.column(k + 1).to_numpy(zero_copy_only=False)
            for f in np.unique(of):
                part = z[of == f]
                total[int(f)] = total.get(int(f), 0) + part.T @ part
        yield block_batch(total)

    packed = df.select(*spec.compact(), y.alias("y"), fold.cast("int").alias("fold"))
    found = merged(packed.mapInArrow(partial, BLOCK), size, np.add)
    return {f: Gram(names, g, shift) for f, g in sorted(found.items())}


def triangle(df: DataFrame, spec: FeatureSpec, target: str, shift: float, degree: int = 1) -> np.ndarray:
    """The triangular factor of the rows ``(1, x, y - shift)``; with ``degree`` 2, x holds the squares and products, too.

    It has the singular values of the rows themselves, where cross products
    would square them. Each task reduces its batches to a factor of its own,
    many rows at a time. Only the columns that can differ are factored
    (:meth:`FeatureSpec.expansion`); the others are zero or copies, in the factor as in the rows.
    """
    block, k = spec.reader(), len(spec.compact())
    left, right, place = spec.expansion(degree)
    size = spec.width + len(left) + 2
    many = max(size, FACTOR_ROWS)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, waiting, rows = np.zeros((0, size)), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, many):
                part = batch.slice(at, many)
                x, y = block(part), part.column(k).to_numpy(zero_copy_only=False)
                waiting.append(np.column_stack([np.ones(len(y)), x, x[:, left] * x[:, right], y]))
                rows += len(y)
                if rows >= many:
                    r, waiting, rows = r_factor(r, np.vstack(waiting)), [], 0
        if rows:
            r = r_factor(r, np.vstack(waiting))
        yield block_batch({0: r} if len(r) else {})

    packed = df.select(*spec.compact(), (col(target) - F.lit(float(shift))).alias("y"))
    r = merged(packed.mapInArrow(reduce, BLOCK), size, r_factor).get(0, np.zeros((0, size)))
    at = np.concatenate([[0], np.where(place < 0, size, place + 1), [size - 1]])
    return np.column_stack([r, np.zeros(len(r))])[:, at]


def leading(factor: np.ndarray, width: int) -> np.ndarray:
    """The factor of the constant, the first ``width`` columns and the target, from that of more columns."""
    top = factor[: width + 1]
    rest = np.zeros((1, width + 2))
    rest[0, -1] = np.linalg.norm(factor[width + 1 :, -1])
    return np.vstack([np.column_stack([top[:, : width + 1], top[:, -1]]), rest])


def gram(df: DataFrame, spec: FeatureSpec, target: str, shift: float = 0.0, degree: int = 1) -> Gram:
    return grams(df, spec, target, shift, degree)[0]


def gram_table(df: DataFrame, spec: FeatureSpec, target: str) -> DataFrame:
    """The sums of products as rows ``(row, col, value)``."""
    g = gram(df, spec, target)
    labels = ["const", *g.names, target]
    rows = [(labels[i], labels[j], float(g.cross[i, j])) for i in range(len(labels)) for j in range(i, len(labels))]
    return small_table(df.sparkSession, rows, "row string, col string, value double")
