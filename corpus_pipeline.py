"""A training-corpus pipeline: five stages over `documents`, each on all that the stage before kept.

toxicity: documents that score 0.7 or more go. neardup: one document of each
class stays. decontam: documents that hold a benchmark passage go. pii: spans
are replaced by placeholders. mix: each document is repeated to its source's
target; copy_no is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholia.llm.decontam import drop_contaminated
from scholia.llm.mixing import mix
from scholia.llm.neardup import keep_one
from scholia.llm.pii import redact
from scholia.llm.toxicity import drop_toxic
from scholia.session import Scratch, read_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [("toxicity", toxicity), ("neardup", neardup), ("decontam", decontam), ("pii", pii), ("mixing", mixing)]

#: Learned scores, signatures and the pattern graph have no SQL. Near-duplicates, templates, base spans and mixing are tested against brute force; toxicity by held-out accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
