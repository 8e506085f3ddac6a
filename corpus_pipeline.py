"""A corpus through four filters and packing: each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelab.llm import decontaminate, jaccard, packing, pii, toxicity
from tablelab.llm.queries import PII_KEY, table, toxicity_chain
from tablelab.session import materialise, release, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return toxicity.drop_rejected(docs, toxicity_chain(docs, table(spark, sf_dir, "labels")), "toxic")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that sets of five words and a similarity of 0.8 link."""
    return jaccard.keep_one(docs, k=5, share=(80, 100))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced and ``n_chars`` counted again."""
    new = pii.replace_pii(docs, PII_KEY)
    return new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else new


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of the documents that are left."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii", with_surrogates),
    ("packing", packed),
]

#: Classifiers, walks, keyed noise and tokenisers are not SQL: the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = len(written(spark))
        kept = written(spark)[before - 1 : before] if name != STAGES[0][0] else []
        docs = materialise(stage(spark, docs, sf_dir), name)
        # The stage's own tables and its input are of no use once its output is written.
        release(spark, kept + written(spark)[before:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
