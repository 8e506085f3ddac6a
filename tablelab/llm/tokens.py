"""Token counts from an exact histogram of encoded lengths.

Every whole text is encoded once and only its length is kept. Documents are then
added up by length, and two-level suffix sums over the histogram answer, for
every context limit, how many documents are longer and how many tokens remain
when each document is cut at the limit. No document is read a second time.

Defined cases: a null or empty text has 0 tokens and counts as a document;
repeated rows count each time; an empty table gives an empty histogram; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tablelab.session import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that cuts text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space before and after a space: there, and only there, the pattern can keep a space and what stands before it in one piece.
_BLANK = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{b}"
JOINED = rf"[{_BLANK}] ([{_BLANK}]|\z)"
KEPT_WORDS = 1 << 19
BLOCK = 1024


class _Counter(dict):
    """Token counts of words together with the space before them, where the pattern always cuts."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> int:
        n = len(self.encoding.encode_ordinary(" " + word))
        if len(self) < KEPT_WORDS and len(word) < 64:
            self[word] = n
        return n

    def count(self, text: str, by_words: bool) -> int:
        if not by_words:
            return len(self.encoding.encode_ordinary(text))
        first, *words = text.split(" ")
        return (len(self.encoding.encode_ordinary(first)) if first else 0) + sum(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def counter(path: str) -> _Counter:
    return _Counter(path)


def token_lengths(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id`` and ``n_tokens`` of every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            by_words = pc.invert(pc.match_substring_regex(texts, JOINED))
            lengths = pa.array(map(count, texts.to_pylist(), by_words.to_pylist()), type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths], names=["id", "n_tokens"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"id {kind}, n_tokens long").withColumnRenamed("id", id)


def length_histogram(lengths: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    return lengths.groupBy(F.col(n_tokens).alias("n_tokens")).agg(F.count("*").alias("docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as context limit:

    ``docs`` of that length, ``docs_up_to`` and ``docs_over`` the limit,
    ``tokens_over`` (tokens of the longer documents) and ``tokens_kept`` when
    every document is cut at the limit. Between two lengths that occur,
    ``tokens_kept`` is linear with slope ``docs_over``.
    """
    histogram = materialise(histogram, "histogram")
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(all_rows).alias("d_all"),
        F.sum("t").over(all_rows).alias("t_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("d_in", F.coalesce(F.sum("docs").over(inside), F.lit(0)))
    rows = rows.withColumn("t_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(blocks, "block")
    over, tokens_over = F.col("d_after") + F.col("d_in"), F.col("t_after") + F.col("t_in")
    return rows.select(
        "n_tokens",
        "docs",
        (F.col("d_all") - over).alias("docs_up_to"),
        over.alias("docs_over"),
        tokens_over.alias("tokens_over"),
        (F.col("t_all") - tokens_over + over * F.col("n_tokens")).alias("tokens_kept"),
    )


def tokens_kept(table: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens that remain when each document is cut at ``limit``."""
    above = F.col("n_tokens") >= limit
    at_or_above = F.sum(F.when(above, F.col("docs")))
    below = F.sum(F.when(~above, F.col("docs") * F.col("n_tokens")))
    return table.agg((F.coalesce(below, F.lit(0)) + F.coalesce(at_or_above, F.lit(0)) * limit).alias("tokens_kept"))


def length_quantile(table: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least ``share`` of the documents do not exceed."""
    total = F.col("docs_up_to") + F.col("docs_over")
    return table.filter(F.col("docs_up_to") >= F.ceil(F.lit(share) * total)).agg(F.min("n_tokens").alias("n_tokens"))
