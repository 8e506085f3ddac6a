"""Packing: optimal length buckets and token-budget batches.

The lengths are counted once over all documents. Dynamic programming over that
histogram chooses at most ``buckets`` boundaries with the least padding when
each piece is padded to the boundary of its bucket. A histogram has at most
``max_length`` entries, as longer documents are cut into pieces of that length,
so that it fits the driver at any size of the table. Inside a bucket, pieces get
consecutive positions from per-shard counts, and each run of
``budget // boundary`` positions is one batch: no bucket is sorted as a whole.

Defined cases: a document without tokens gets one row with ``n_tokens`` 0 and no
bucket, batch or slot; repeated rows are packed each time; a null id is kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelab.llm.tokens import VOCABULARY, token_lengths
from tablelab.session import materialise

SHARD_ROWS = 20_000


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """The boundaries that minimise padding, ascending, and that padding."""
    order = np.argsort(lengths)
    size, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(size):
        return [], 0
    rows, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    never = np.iinfo(np.int64).max // 4
    best = np.where(np.arange(len(size) + 1) == 0, 0, never)
    choices = []
    for _ in range(min(buckets, len(size))):
        found, came = best.copy(), np.full(len(size) + 1, -1)
        for j in range(1, len(size) + 1):
            cost = best[:j] + size[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            if cost[i] < found[j]:
                found[j], came[j] = cost[i], i
        choices.append(came)
        best = found
    j, out = len(size), []
    for came in reversed(choices):
        if came[j] >= 0:
            out.append(int(size[j - 1]))
            j = int(came[j])
    return out[::-1], int(best[-1])


def bucket_of(n: Column, boundaries: list[int]) -> Column:
    found = F.lit(None).cast("int")
    for i, boundary in reversed(list(enumerate(boundaries))):
        found = F.when(n <= boundary, i).otherwise(found)
    return F.when(n > 0, found)


def pack(
    docs: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = 16, budget: int = 65_536, max_length: int = 8192,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """One row a piece: ``id``, ``piece``, ``start``, ``n_tokens``, ``bucket``, ``padded_to``, ``batch``, ``slot``."""
    lengths = materialise(token_lengths(docs, id, text, vocabulary).withColumnRenamed(id, "id"), "lengths")
    last = F.greatest(F.ceil(F.col("n_tokens") / max_length) - 1, F.lit(0)).cast("int")
    pieces = lengths.select("id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * max_length
    pieces = pieces.select("id", "piece", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(max_length)).alias("n_tokens"))

    histogram = [(r.n_tokens, r.n) for r in pieces.filter("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()]
    boundaries, _ = best_boundaries([s for s, _ in histogram], [n for _, n in histogram], buckets)
    in_bucket = [sum(n for s, n in histogram if low < s <= high) for low, high in zip([0, *boundaries], boundaries)]

    def of_bucket(values: list[int], kind: str) -> Column:
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("bucket")) if values else F.lit(None).cast(kind)

    shards = of_bucket([n // SHARD_ROWS + 1 for n in in_bucket], "long")
    rows = pieces.withColumn("bucket", bucket_of(F.col("n_tokens"), boundaries)).withColumn("h", F.xxhash64("id", "piece"))
    rows = rows.withColumn("shard", F.pmod(F.col("h"), shards))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.filter("bucket IS NOT NULL").groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    offsets = offsets.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "shard").orderBy("h", "id", "piece")
    packed = rows.filter("bucket IS NOT NULL").withColumn("place", F.row_number().over(inside)).join(offsets, ["bucket", "shard"])
    place = F.col("offset") + F.col("place") - 1
    per_batch = of_bucket([max(1, budget // b) for b in boundaries], "long")
    packed = packed.select(
        "id", "piece", "start", "n_tokens", "bucket", of_bucket(boundaries, "int").alias("padded_to"),
        F.floor(place / per_batch).alias("batch"), (place % per_batch).cast("int").alias("slot"),
    )
    empty = rows.filter("bucket IS NULL").select(
        "id", "piece", "start", "n_tokens", "bucket", F.lit(None).cast("int").alias("padded_to"),
        F.lit(None).cast("long").alias("batch"), F.lit(None).cast("int").alias("slot"),
    )
    return packed.unionByName(empty).withColumnRenamed("id", id)
