"""Readers, upload rules, extractors and writers of the stored tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.text import content_type_of, safe_filename

MAX_BYTES = 40 * 1024 * 1024
#: Files that a stream takes in as one batch, and so the paths that a driver holds at once.
MOST_FILES = 10_000
_FILES = "path string, modificationTime timestamp, length long, content binary"
# Extensions that may be uploaded.
EXTENSIONS = ("pdf", "txt", "md", "markdown")

#: Extractors by content type: functions of files (path, content) that give (path, page, text), and error where a file can't be read.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def plain_pages(files: DataFrame) -> DataFrame:
    """A whole UTF-8 file as one page without a number."""
    return files.select("path", F.lit(None).cast("int").alias("page"), F.col("content").cast("string").alias("text"))


EXTRACTORS["text/plain"] = plain_pages
EXTRACTORS["text/markdown"] = plain_pages


def extractor(content_type: str) -> Callable[[DataFrame], DataFrame]:
    """The extractor of a content type. PDF text needs a library that is not shipped: register a function."""
    if content_type not in EXTRACTORS:
        raise LookupError(f"No text extractor available for {content_type}; register one in EXTRACTORS")
    return EXTRACTORS[content_type]


def filename_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def rejection(path: Column, length: Column) -> Column:
    """Why a file is not taken in; null if it is."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(length == 0, "The file is empty").when(length > MAX_BYTES, "The file is larger than 40 MB").when(~extension.isin(*EXTENSIONS), "Only PDF, text and Markdown files are taken")


def read_uploads(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """Files of <folder>/<project>/: (path, project_id, filename, content_type, size_bytes, uploaded_at, content, rejected).

    A stream has no content: what a batch of a stream selects or filters does
    not reach its file source, which would open every file, large ones too. See
    with_content. Spark's file source gives no row for a file without bytes.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", MOST_FILES) if streaming else spark.read
    files = reader.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*").option("recursiveFileLookup", "true").load(folder)
    name = filename_of(F.col("path"))
    facts = files.select("path", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("project_id"), safe_filename(name).alias("filename"), content_type_of(name).alias("content_type"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("uploaded_at"), "content", rejection(F.col("path"), F.col("length")).alias("rejected"))
    return facts.drop("content") if streaming else facts


def with_content(files: DataFrame) -> DataFrame:
    """Rows of a streaming batch (at most MOST_FILES) with their content; longer files than MAX_BYTES are not opened."""
    paths = [r["path"] for r in files.select("path").distinct().collect()]
    if not paths:
        return files.withColumn("content", F.lit(None).cast("binary"))
    plain = [re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in paths]  # names, not patterns
    opened = files.sparkSession.read.format("binaryFile").schema(_FILES).load(plain).filter(F.col("length") <= MAX_BYTES)
    return files.join(opened.select("path", "content"), "path")


def extract_pages(files: DataFrame) -> DataFrame:
    """(path, page, text, error) of accepted files of all registered content types; error is null where all went well."""
    parts = [run(files.filter(F.col("content_type") == kind)) for kind, run in EXTRACTORS.items()]
    parts = [x if "error" in x.columns else x.withColumn("error", F.lit(None).cast("string")) for x in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def put_upload(spark: SparkSession, folder: str, project: str, name: str, content: bytes) -> str:
    """Store one upload where read_uploads finds it, under a name of its own; ValueError where the rules refuse it."""
    row = spark.range(1).select(safe_filename(F.lit(name)).alias("name"), rejection(F.lit(name), F.lit(len(content))).alias("why")).first()
    if row["why"]:
        raise ValueError(row["why"])
    path = f"{folder}/{project}/{uuid.uuid4().hex}-{row['name']}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    return path


def append(df: DataFrame, path: str) -> None:
    """Append to a stored table; tables with a project are laid out by it."""
    writer = df.write.mode("append")
    (writer.partitionBy("project_id") if "project_id" in df.columns else writer).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Import of a relational store; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
