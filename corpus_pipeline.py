"""A corpus through five stages: toxicity, near duplicates, benchmark decontamination, secrets, mixing.

Every stage works on all that its predecessor kept. The first four return the columns of
``documents``; the last says how much of each document the mixture takes.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from granary.llm import jaccard, mixing, phrases, secrets, toxicity
from granary.llm.common import forget, forget_since, kept, small_batches, stored, table

#: Rows of an Arrow batch in the stages: an executor holds batches of two tasks, in the JVM and in Python workers that stay on from one stage to the next.
BATCH_ROWS = 128


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, learned from the labelled ones, doesn't reject."""
    small_batches(spark, BATCH_ROWS)
    return toxicity.not_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by 0.8 of their five-word shingles or more."""
    small_batches(spark, BATCH_ROWS)
    return jaccard.one_of_each(docs, 5, Fraction(8, 10))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item (or the whole of a shorter one)."""
    small_batches(spark, BATCH_ROWS)
    return phrases.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    small_batches(spark, BATCH_ROWS)
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document its words and how many the mixture of the sources takes."""
    small_batches(spark, BATCH_ROWS)
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Three of the stages (a learned model, graph components, entropy windows) are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each one's rows written to the shared folder and read again, and what it worked with deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, given = kept(), docs
        docs = stored(stage(spark, given, sf_dir), name)
        forget_since(before, docs)
        forget(given)
    return STAGES[-1][1](spark, docs, sf_dir)
