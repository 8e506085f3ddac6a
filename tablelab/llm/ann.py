"""Approximate nearest neighbours with randomly rotated one-bit codes (RaBitQ; Gao and Long, 2024).

A vector x becomes the unit vector of x - c (c: the mean of all), turned by a
random rotation; the signs of its components are its code, packed to one bit
each. With the length of x - c and the inner product of the unit vector and its
code (a correction scalar), the code gives an unbiased estimate of the inner
product with any query, and a bound for its error. Within each block, the vectors
with the best estimates are measured first; then every vector whose bound says
that it may still be among the nearest is measured exactly, in double precision
on the original components.

Every row is indexed. Queries go against all rows in blocks (``QUERIES`` queries
by ``ROWS`` rows a group), spread by Spark; a task holds one block of queries and
a batch of rows. Equal vectors are searched once: of each vector only the k + 1
smallest ids can appear in a result, and equal queries share theirs.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component take no part, nor do rows without id and vectors of another length
than the most frequent one (the longer on ties); repeated rows count once; ties
go to the smaller id; with fewer candidates all are returned; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelab.session import materialise

QUERIES, ROWS, STEP = 1024, 8192, 1024
#: Standard errors of an estimate that the bound allows for.
ERRORS = 1.9
SEED = 20240521


def _matrix(column: pa.Array) -> np.ndarray:
    size = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, center: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths and correction scalars."""
    x = x - center
    length = np.linalg.norm(x, axis=1)
    unit = (x / np.where(length > 0, length, 1)[:, None]) @ turn.T
    return np.packbits(unit > 0, axis=1), length, np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])


class _Best:
    """The nearest rows so far of a block of queries."""

    def __init__(self, keys: np.ndarray, queries: np.ndarray, k: int, center: np.ndarray, turn: np.ndarray) -> None:
        self.keys, self.queries, self.k = keys, queries, k
        self.turned = (queries - center) @ turn.T
        self.length = np.linalg.norm(self.turned, axis=1)
        self.q, self.id, self.far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def limit(self) -> np.ndarray:
        """Per query the distance of its k-th row, infinite before."""
        out = np.full(len(self.keys), np.inf)
        count = np.bincount(self.q, minlength=len(self.keys))
        ends = np.cumsum(count) - 1
        full = count == self.k
        out[full] = self.far[ends[full]]
        return out

    def measure(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        far = np.empty(len(q))
        for i in range(0, len(q), 1 << 16):
            part = slice(i, i + (1 << 16))
            far[part] = np.sqrt(((rows[x[part]] - self.queries[q[part]]) ** 2).sum(axis=1))
        q, id, far = np.concatenate([self.q, q]), np.concatenate([self.id, ids[x]]), np.concatenate([self.far, far])
        order = np.lexsort((id, far, q))
        q, id, far = q[order], id[order], far[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.q, self.id, self.far = (v[rank < self.k] for v in (q, id, far))

    def add(self, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, length: np.ndarray, scalar: np.ndarray) -> None:
        size = rows.shape[1]
        signs = np.unpackbits(codes, axis=1, count=size).astype(np.float64) * 2 - 1
        scalar = np.maximum(scalar, 1e-9)
        inner = (self.turned @ signs.T) / (np.sqrt(size) * scalar)
        error = ERRORS * self.length[:, None] * np.sqrt(np.maximum(1 - scalar**2, 0) / (scalar**2 * max(size - 1, 1)))
        whole = self.length[:, None] ** 2 + length**2
        first = min(self.k, len(ids))
        near = np.argpartition(whole - 2 * length * inner, first - 1, axis=1)[:, :first]
        seen = np.zeros(inner.shape, bool)
        np.put_along_axis(seen, near, True, axis=1)
        self.measure(*np.nonzero(seen), ids, rows)
        least = whole - 2 * length * (inner + error)
        self.measure(*np.nonzero(~seen & (least <= (self.limit()[:, None] * (1 + 1e-9)) ** 2)), ids, rows)


def _usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda v: v != 0), F.lit(False))


def _mean(rows: DataFrame, size: int) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for batch in batches:
            if batch.num_rows:
                total, n = total + _matrix(batch.column(0)).sum(axis=0), n + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([n])], names=["total", "n"])

    total, n = np.zeros(size), 0
    for row in rows.select("vector").mapInArrow(add, "total array<double>, n long").toLocalIterator():
        total, n = total + np.array(row.total), n + row.n
    return total / max(n, 1)


def build_index(rows: DataFrame, center: np.ndarray, turn: np.ndarray) -> DataFrame:
    """``id``, ``vector`` and their packed ``code``, ``length`` and ``scalar``."""
    shared = rows.sparkSession.sparkContext.broadcast((center, turn))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, length, scalar = encode(_matrix(batch.column(1)), *shared.value)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(length), pa.array(scalar)], names=names)

    names = ["id", "vector", "code", "length", "scalar"]
    return rows.select("id", "vector").mapInArrow(apply, "id long, vector array<double>, code binary, length double, scalar double")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For the rows that ``is_query`` marks, their ``k`` nearest other rows: ``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance)."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("vector"))).distinct()
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = sizes.size if sizes else 1
    rows = materialise(rows.filter(F.size("vector") == size), "vectors")

    same = Window.partitionBy("vector").orderBy("id")
    kept = rows.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1)
    center, turn = _mean(rows, size), rotation(size)
    index = materialise(build_index(kept, center, turn), "codes")
    queries = materialise(rows.filter("is_query").groupBy("vector").agg(F.min("id").alias("id")), "queries")
    blocks = max(1, -(-queries.count() // QUERIES)), max(1, -(-index.count() // ROWS))

    own = F.pmod(F.xxhash64("id"), F.lit(blocks[0]))
    asked = queries.select(own.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1))).alias("rb"), F.lit(False).alias("row"), "id", "vector")
    for name, kind in (("code", "binary"), ("length", "double"), ("scalar", "double")):
        asked = asked.withColumn(name, F.lit(None).cast(kind))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks[1]))
    stored = index.select(F.explode(F.sequence(F.lit(0), F.lit(blocks[0] - 1))).alias("qb"), own.alias("rb"), F.lit(True).alias("row"), "id", "vector", "code", "length", "scalar")
    shared = vectors.sparkSession.sparkContext.broadcast((center, turn))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, group, waiting = None, None, []
        for batch in batches:
            qb, rb, is_row = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            turns = np.concatenate([[True], (np.diff(qb) != 0) | (np.diff(rb) != 0) | (np.diff(is_row) != 0)]) if len(qb) else []
            starts = np.flatnonzero(turns)
            cuts = sorted({*starts.tolist(), *[int(s) + i for s, e in zip(starts, [*starts[1:], len(qb)]) for i in range(0, int(e - s), STEP)]})
            for a, z in zip(cuts, [*cuts[1:], len(qb)]):
                part, now = batch.slice(a, z - a), (qb[a], rb[a])
                if now != group:
                    if best is not None:
                        yield _found(best)
                    best, group, waiting = None, now, []
                ids, x = part.column(3).to_numpy(zero_copy_only=False), _matrix(part.column(4))
                if not is_row[a]:
                    waiting.append((ids, x))
                    continue
                if best is None:
                    if not waiting:
                        continue
                    best = _Best(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), k + 1, *shared.value)
                codes = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(len(ids), -1)
                best.add(ids, x, codes, *(part.column(i).to_numpy(zero_copy_only=False) for i in (6, 7)))
        if best is not None:
            yield _found(best)

    both = asked.unionByName(stored).repartition("qb", "rb").sortWithinPartitions("qb", "rb", "row")
    found = both.mapInArrow(search, "asked long, vec_id long, score double")
    by_nearness = Window.partitionBy("asked").orderBy("score", "vec_id")
    found = found.withColumn("place", F.row_number().over(by_nearness)).filter(F.col("place") <= k + 1).drop("place")
    askers = rows.filter("is_query").select("vector", F.col("id").alias("query_id")).join(queries.withColumnRenamed("id", "asked"), "vector")
    answers = askers.select("query_id", "asked").join(found, "asked").filter(F.col("query_id") != F.col("vec_id"))
    by_nearness = Window.partitionBy("query_id").orderBy("score", "vec_id")
    answers = answers.withColumn("rank", F.row_number().over(by_nearness)).filter(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(best: _Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(best.keys[best.q]), pa.array(best.id), pa.array(best.far)], names=["asked", "vec_id", "score"])
