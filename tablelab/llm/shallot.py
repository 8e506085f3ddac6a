"""Centroid clustering: exact k-means on integer vectors, assigned by Shallot search (Borgelt, 2020).

A component x becomes the integer floor(64 x). Every vector remembers its nearest
and its second-nearest centroid, an upper bound of the distance to the first and
a lower bound of the distance to all others. After the centroids have moved, the
bounds are widened by how far; where they still lie apart, the vector keeps its
centroid and nothing is measured. Else both remembered centroids are measured,
and the search starts from the closer one: its neighbours among the centroids are
looked at in order of their distance from it, as long as that distance is at most
the sum of the distances from the vector to the start and to the second best so
far. The ball shrinks with every better centroid found. Bounds are floating-point
numbers with a margin for rounding; centroids inside the ball are compared by
exact squared distances in integers, ties by the smaller number.

Rows with their state are written after every round, so that a lost executor
repeats its own tasks only. Sums and counts are combined on executors; the driver
holds the centroids (``k`` times the vector length) and nothing of the rows.

Defined cases: vectors that are null, have another length or hold a null or
non-finite component are left out; scaled components beyond +-2**27 count as that
value, for a squared distance must fit into 64 bits; with fewer than ``k`` vectors
there are as many centroids; empty clusters keep their centroid; repeated rows
count and are returned each time; rows without an id are clustered, and become
first centroids only if ids do not suffice; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelab.session import materialise, small_table

CLUSTERS, ROUNDS, SIZE, SCALE = 16, 3, 64, 64
LIMIT = 1 << 27
MARGIN = 1e-9
STATE = "id long, vector array<long>, nearest int, second int, upper double, lower double"


def scaled(vectors: DataFrame, id: str, vector: str, size: int = SIZE) -> DataFrame:
    """``id`` and the integer ``vector`` of the rows that take part."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce((F.size("v") == size) & sound, F.lit(False)))
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("long"))
    return rows.select("id", whole.alias("vector"))


def first_centroids(rows: DataFrame, k: int, size: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    chosen = rows.orderBy(hashed.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return np.array([r.vector for r in chosen], np.int64).reshape(len(chosen), size)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Neighbours:
    """The centroids, the distances between them and, for each, the others in order of distance."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.at = centroids
        k = len(centroids)
        gaps = np.array([[squared(a[None], b[None])[0] for b in centroids] for a in centroids], np.int64).reshape(k, k)
        self.gaps = np.sqrt(gaps.astype(float))
        self.order = np.argsort(self.gaps + np.where(np.eye(k, dtype=bool), -1.0, 0.0), axis=1, kind="stable")


def search(x: np.ndarray, nearest: np.ndarray, second: np.ndarray, c: Neighbours) -> tuple[np.ndarray, ...]:
    """Nearest and second-nearest centroid of every row of ``x`` and the squared distances, from what each remembers."""
    k = len(c.at)
    d1, d2 = squared(x, c.at[nearest]), squared(x, c.at[second])
    swap = (second != nearest) & ((d2 < d1) | ((d2 == d1) & (second < nearest)))
    nearest, second = np.where(swap, second, nearest), np.where(swap, nearest, second)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, reach = nearest.copy(), np.sqrt(d1.astype(float))
    alone = second == nearest  # one remembered centroid only: the ball is open until a second one is measured
    left = np.arange(len(x))
    for step in range(1, k):
        other = c.order[start[left], step]
        ball = np.where(alone[left], np.inf, (reach[left] + np.sqrt(d2[left].astype(float))) * (1 + MARGIN))
        inside = c.gaps[start[left], other] <= ball
        left, other = left[inside], other[inside]  # the next ones lie further out, and the ball only shrinks
        if not len(left):
            break
        new = (other != nearest[left]) & ((other != second[left]) | alone[left])
        rows, other = left[new], other[new]
        d = squared(x[rows], c.at[other])
        first = (d < d1[rows]) | ((d == d1[rows]) & (other < nearest[rows]))
        next_best = ~first & (alone[rows] | (d < d2[rows]) | ((d == d2[rows]) & (other < second[rows])))
        second[rows], d2[rows] = (
            np.where(first, nearest[rows], np.where(next_best, other, second[rows])),
            np.where(first, d1[rows], np.where(next_best, d, d2[rows])),
        )
        nearest[rows], d1[rows] = np.where(first, other, nearest[rows]), np.where(first, d, d1[rows])
        alone[rows] = False
    return nearest, second, d1, d2


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """Each row with its new state after the centroids have moved by ``moved``."""
    size, c = centroids.shape[1], Neighbours(centroids)
    # The largest move of any centroid but one's own.
    others = np.array([np.delete(moved, i).max(initial=0.0) for i in range(len(moved))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), size)
            nearest, second = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            upper, lower = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (4, 5))
            upper += moved[nearest]
            lower -= others[nearest]
            open_ = upper * (1 + MARGIN) >= lower * (1 - MARGIN)
            n, s, d1, d2 = search(x[open_], nearest[open_], second[open_], c)
            nearest[open_], second[open_] = n, s
            upper[open_], lower[open_] = np.sqrt(d1.astype(float)), np.where(n == s, np.inf, np.sqrt(d2.astype(float)))
            arrays = [pa.array(nearest, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "vector", "nearest", "second", "upper", "lower"])

    return state.mapInArrow(apply, STATE)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floored means of the clusters; an empty one stays. The result has ``k`` rows."""
    size = centroids.shape[1]
    sums = state.groupBy("nearest").agg(F.count("*").alias("n"), *[F.sum(F.col("vector")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(size)])
    out = centroids.copy()
    for row in sums.collect():
        out[row["nearest"]] = [int(row[f"s{i}"]) // row["n"] for i in range(size)]
    return out


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, id: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """``id``, ``cluster`` and squared ``distance`` of every vector after ``rounds`` moves of the centroids, and these."""
    rows = scaled(vectors, id, vector, size)
    centroids = first_centroids(rows, k, size)
    start = [F.lit(0).alias("nearest"), F.lit(0).alias("second"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")]
    state = rows.select("id", "vector", *start)
    if not len(centroids):
        return state.select(F.col("id").alias(id), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    moved = np.zeros(len(centroids))
    for _ in range(rounds):
        state = materialise(assign(state, centroids, moved), "clusters")
        before, centroids = centroids, moved_centroids(state, centroids)
        moved = np.sqrt(squared(centroids, before).astype(float)) * (1 + MARGIN)
    state = assign(state, centroids, moved)
    final = F.array(*[F.array(*[F.lit(int(v)) for v in c]).cast("array<long>") for c in centroids])
    off = F.zip_with("vector", F.get(final, F.col("nearest")), lambda a, b: (a - b) * (a - b))
    distance = F.aggregate(off, F.lit(0).cast("long"), lambda a, b: a + b)
    return materialise(state.select(F.col("id").alias(id), F.col("nearest").alias("cluster"), distance.alias("distance")), "clusters"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of :func:`cluster` with the distance sums of their cluster and of all, and their centroid's digest."""
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(i, sums.get(i, 0), sum(sums.values()), d) for i, d in enumerate(digests)]
    of = small_table(found.sparkSession, rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster")  # as many rows as centroids
