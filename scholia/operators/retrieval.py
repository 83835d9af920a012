"""Rank fusion and hybrid retrieval over both rankings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.operators import bm25, vectors
from scholia.operators.best import best_rows
from scholia.session import checkpointed, stored

RRF_K = 60
TOP_K = 8


def overfetch(k: int) -> int:
    return max(3 * k, 10)


def fuse(lists: list[DataFrame], k: int, group: list[str], key: str = "chunk_id", rrf_k: int = RRF_K) -> DataFrame:
    """(group, key, score, rank): reciprocal rank fusion of ranked lists (group, key, rank from 1).

    Ties keep the order of the lists, then the rank within the first of them.
    """
    parts = [x.select(*group, key, (1.0 / (rrf_k + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").cast("int").alias("rank")).alias("place")) for i, x in enumerate(lists)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    fused = both.groupBy(*group, key).agg(F.round(F.sum("part"), 12).alias("score"), F.min("place").alias("place"))
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "place", key)
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("place")


def feature_rows(chunks: DataFrame, *keep: str) -> DataFrame:
    """(keep, dim, weight): sparse hashed vectors of chunks (chunk_id, content and what is kept)."""
    others = tuple(c for c in keep if c != "chunk_id")
    return vectors.feature_lists(chunks, "chunk_id", "content", keep=others).select(*others, "chunk_id", F.inline("features")).select(*keep, "dim", "weight")


def query_features(queries: DataFrame) -> DataFrame:
    """(query_id, dim, qweight, and project_id where queries have one)."""
    asked = vectors.hashed_features(queries, "query_id", "content").select("query_id", "dim", F.col("weight").alias("qweight"))
    return asked.join(queries.select("query_id", "project_id"), "query_id") if "project_id" in queries.columns else asked


def features_topk(asked: DataFrame, features: DataFrame, k: int, few: bool) -> DataFrame:
    """(query_id, project_id, chunk_id, score, rank): the k chunks of greatest cosine; asked is query_features, features is feature_rows of (project_id, chunk_id).

    few: whether the queries were counted to be at most vectors.BROADCAST_QUERIES.
    """
    keys = ["dim", *[c for c in ("project_id",) if c in asked.columns]]
    scored = features.join(F.broadcast(asked) if few else asked, keys).groupBy("query_id", "project_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("qweight")), 6).alias("score"))
    order = Window.partitionBy("query_id", "project_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hashed_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, project_id, chunk_id, score, rank): the k chunks of greatest cosine of hashed vectors, per query and project.

    Chunks are scored where they lie; where queries are too many for a matrix
    of bm25.DENSE numbers, or projects for a grid with them, rows are joined.
    """
    asked = checkpointed(query_features(queries))
    own = [c for c in ("project_id",) if c in queries.columns]
    n_queries = asked.select("query_id", *own).distinct().count()
    homes = chunks.select("project_id").filter("project_id IS NOT NULL").distinct().limit(bm25.DENSE + 1)
    n_projects = homes.count()
    if n_queries * max(vectors.DIMENSIONS, n_projects) > bm25.DENSE or n_projects > bm25.DENSE:
        return features_topk(asked, feature_rows(chunks, "project_id", "chunk_id"), k, queries.count() <= vectors.BROADCAST_QUERIES)
    questions = asked.collect()  # at most DENSE numbers
    keys = {q: i for i, q in enumerate(dict.fromkeys((r["query_id"], r["project_id"] if own else None) for r in questions))}
    asks = np.zeros((vectors.DIMENSIONS, len(keys)))
    for r in questions:
        asks[r["dim"], keys[r["query_id"], r["project_id"] if own else None]] = r["qweight"]

    def rows(batch: pa.RecordBatch, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs, row = batch.column("features").flatten(), pc.list_parent_indices(batch.column("features")).to_numpy()
        return row, pairs.field("dim").to_numpy(), pairs.field("weight").to_numpy()

    projects = [r["project_id"] for r in homes.collect()]
    return best_rows(vectors.feature_lists(chunks, "chunk_id", "content", keep=("project_id",)), rows, asks, list(keys), projects, queries.schema["query_id"].dataType, k, 6)


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, embeddings: bool = True) -> DataFrame:
    """(query_id, project_id, chunk_id, score, rank) of queries (query_id, content, and project_id where one is meant).

    BM25 and hashed vectors over the same chunks, over-fetched and fused; BM25
    alone where embeddings are off.
    """
    chunks = stored(chunks.select("project_id", "chunk_id", "content"))
    lists = [bm25.search_chunks(queries, chunks, overfetch(k), bm25.english_terms)]
    if embeddings:
        lists.append(hashed_topk(queries, chunks, overfetch(k)))
    return fuse(lists, k, ["query_id", "project_id"])


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks, by rank; hits whose chunk is gone are dropped."""
    return hits.join(chunks, ["project_id", "chunk_id"])
