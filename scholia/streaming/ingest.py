"""Incremental ingestion: a file stream into a snapshot store, one version per batch, failures set apart.

A batch makes two commits. The first says that its files were seen (PENDING) and
are being read (PROCESSING); the second holds the chunks, their vectors, their
index rows, the documents and how they ended, and marks the batch as done. A
batch that was done is passed over when the stream replays it; one that was not
left nothing that a reader sees but its documents' states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholia.operators.bm25 import ANALYZER_VERSION, english_terms
from scholia.operators.catalog import content_hash, dense_vectors, latest, safe_message, stale_chunks, upserted_vectors
from scholia.operators.chunking import OVERLAP, TARGET, chunk_pages, number_chunks
from scholia.operators.index import index_rows
from scholia.operators.vectors import DIMENSIONS, hashed_features
from scholia.session import checkpointed
from scholia.sources.io import EXTRACTORS, MAX_BYTES, extract_pages, read_uploads, with_content
from scholia.sources.store import Snapshot, Store

#: The model that ingestion embeds with.
MODEL = "hashing"
#: The states of a document in the order in which it takes them; the last two end it.
STATES = ("PENDING", "PROCESSING", "READY", "FAILED")
#: The mark under which a store keeps the last batch that was taken in.
BATCH = "ingest_batch"


def prepare(files: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of a batch of uploads. A document without a chunk, rejected, or with an error on any page, is FAILED with its reason.

    What fails leaves no chunks, and none of the other documents of the batch with it.

    created_at is the time of the file, so a batch that runs again gives the same rows.
    """
    kept = files.withColumn("document_id", F.sha2("path", 256))
    # The bounds are said outright, so that the file source passes over large files without opening them.
    fits = (F.col("size_bytes") > 0) & (F.col("size_bytes") <= MAX_BYTES)
    good = kept.filter(fits & F.col("rejected").isNull() & F.col("content_type").isin(*EXTRACTORS))
    good = good if "content" in good.columns else with_content(good)
    pages = checkpointed(extract_pages(good).withColumn("document_id", F.sha2("path", 256)).join(kept.select("document_id", "project_id"), "document_id"))
    errors = pages.filter("error IS NOT NULL").groupBy("document_id").agg(F.min("error").alias("error"))
    whole = pages.join(errors.select("document_id"), "document_id", "left_anti")
    chunks = number_chunks(chunk_pages(whole.select("document_id", "project_id", "page", "text"), target, overlap))
    found = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("page").alias("page_count"))
    reason = F.coalesce("rejected", F.when(~F.col("content_type").isin(*EXTRACTORS), F.concat(F.lit("No text extractor available for "), "content_type")), "error", F.when(F.col("n_chunks").isNull(), "No readable text"))
    documents = kept.join(found, "document_id", "left").join(errors, "document_id", "left").select("document_id", "project_id", "filename", "content_type", "size_bytes", "page_count", F.col("path").alias("stored_path"), F.when(reason.isNull(), "READY").otherwise("FAILED").alias("status"), safe_message(reason, F.lit(None).cast("string")).alias("error_message"), F.col("uploaded_at").alias("created_at"))
    return documents, chunks


def states(documents: DataFrame, state: str | None = None, at: str | None = None) -> DataFrame:
    """(document_id, project_id, status, at): a row of the status log for each document."""
    when = F.col(at) if at else F.current_timestamp()
    return documents.select("document_id", "project_id", F.lit(state).alias("status") if state else F.col("status"), when.cast("timestamp").alias("at"))


def settled(log: DataFrame) -> DataFrame:
    """(document_id, project_id, status, at): the last state that each document took; a state that was logged twice counts once, when it was taken first."""
    order = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status"))
    taken = log.groupBy("document_id", "project_id", "status").agg(F.min("at").alias("at")).withColumn("place", order)
    return latest(taken, "document_id", "place").drop("place")


def publish(batch: DataFrame, batch_id: int, store: Store, target: int, overlap: int) -> None:
    """Take in a batch under its number; a batch that is done is passed over."""
    base = store.snapshot()
    if base.marks.get(BATCH, -1) >= batch_id:
        return
    seen = batch.select(F.sha2("path", 256).alias("document_id"), "project_id", "uploaded_at")
    base = store.commit(base, {"document_status": states(seen, "PENDING", "uploaded_at").unionByName(states(seen, "PROCESSING"))})
    documents, chunks = prepare(batch, target, overlap)
    documents, chunks = checkpointed(documents), checkpointed(chunks)
    vectors = dense_vectors(chunks, hashed_features, MODEL, DIMENSIONS).join(chunks.select("chunk_id", content_hash(F.col("content")).alias("content_sha256")), "chunk_id")
    store.commit(base, {"chunks": chunks, "chunk_embeddings": vectors, **index_rows(chunks, english_terms, ANALYZER_VERSION, True, True), "documents": documents, "document_status": states(documents)}, marks={BATCH: batch_id})


def embed_stale(snapshot: Snapshot, model: str = MODEL, embed=hashed_features, dims: int = DIMENSIONS) -> tuple[Snapshot, int]:
    """(snapshot, how many): chunks whose text changed since their vector was made, or that have none of the model, get one; others keep theirs and their files."""
    held = snapshot.read("chunk_embeddings")
    old = checkpointed(stale_chunks(snapshot.read("chunks"), held, model))
    n = old.count()
    if not n:
        return snapshot, 0
    hashes = old.select("chunk_id", content_hash(F.col("content")).alias("content_sha256"))
    fresh = upserted_vectors(held.limit(0), old, embed, model, dims).drop("content_sha256").join(hashes, "chunk_id")
    return snapshot.store.upsert(snapshot, "chunk_embeddings", fresh.select(*held.columns), "chunk_id"), n


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, target: int = TARGET, overlap: int = OVERLAP) -> StreamingQuery:
    """Take in what is new in a folder of <project>/<file>, then stop; progress is kept in checkpoint.

    One stream writes a store at a time. A document, its chunks, vectors and
    index rows become visible at once.
    """
    files = read_uploads(spark, folder, streaming=True)
    return files.writeStream.foreachBatch(lambda df, n: publish(df, n, Store(df.sparkSession, store), target, overlap)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the newest version."""
    return Store(spark, store).snapshot().read(name)
