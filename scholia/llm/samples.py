"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bound of the text bytes of a sample.
FIT_BYTES = 128_000_000
#: Longer texts are scored like all others but take no part in a sample, so that none crowds out the rest.
LONG_BYTES = 2_000_000


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents and FIT_BYTES of text, chosen by hash of doc_id.

    usable is a condition on doc_id. The chosen ids are at most `rows`, which
    bounds what is broadcast. Of labels that repeat a doc_id the largest counts,
    of texts that do the smallest.
    """
    ids = labels.filter(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("size").alias("size"))
    sizes = sizes.filter(F.coalesce("size", F.lit(0)) <= LONG_BYTES)
    # At most `rows` rows of three numbers meet in this window.
    filled = F.sum(F.coalesce("size", F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fitting = sizes.withColumn("filled", filled).filter(F.col("filled") <= FIT_BYTES).select("doc_id", "label")
    return docs.select("doc_id", "text").join(F.broadcast(fitting), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
