"""The driver's tables in the roles of the engine's stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators.chunking import chunk_pages, number_chunks
from scholia.session import read_table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, project_id, filename, text, n_chars)."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("project_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"), "text", "n_chars")


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with status: READY where labelled good, FAILED where labelled bad, else PROCESSING."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), "quality")
    status = F.when(F.col("quality") == 1, "READY").when(F.col("quality") == 0, "FAILED").otherwise("PROCESSING")
    return documents(spark, sf_dir).join(labels, "document_id", "left").withColumn("status", status).drop("quality")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("document_id", "project_id", F.lit(None).cast("int").alias("page"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_chunks(chunk_pages(pages(spark, sf_dir)))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))


def line_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as sentences: (request_id = project, document_id, position, text)."""
    rows = documents(spark, sf_dir).select(F.col("project_id").alias("request_id"), "document_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.trim("text") != "")
    return rows.select("request_id", "document_id", (F.col("document_id") * 2**31 + F.col("line")).alias("position"), "text")
