"""The stored index: postings, sparse vectors and statistics that a question reads without the chunks' text.

Rows are made once, when chunks are stored. Postings carry the length of their
chunk; statistics are sums per project, so those of two batches add up and those
of deleted chunks come with a minus. Postings lie by hash of their term, vectors
by hash of their dimension: a question opens the folders of its terms and
projects. A folder names a chunk once, with the list of its terms there (see
sources.store).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from scholia.operators import bm25, retrieval, services
from scholia.operators.vectors import BROADCAST_QUERIES, feature_lists
from scholia.session import Scratch, checkpointed, stored
from scholia.sources.store import LIST, MOST_PARTED, Snapshot, grouped, slice_of, unpacked

#: So many terms, dimensions or projects of a batch of questions are named in its filters; beyond that the joins alone pick.
MOST_NAMED = 2_000


def index_rows(chunks: DataFrame, terms: Callable[..., DataFrame] = bm25.english_terms, version: str = bm25.ANALYZER_VERSION, embeddings: bool = True, lists: bool = False) -> dict[str, DataFrame]:
    """The tables postings, features (where embeddings are on) and index_statistics of chunks (project_id, document_id, chunk_id, content).

    As lists they are one row per chunk, which is how a store keeps them.
    """
    keys = ("project_id", "document_id", "chunk_id")
    counted = stored(bm25.counted_terms(terms(chunks, *keys), *keys))
    sums = counted.groupBy("project_id").agg(F.count("*").alias("n"), F.sum("dl").alias("words"))
    tables = {
        "postings": _postings(counted, version),
        **({"features": feature_lists(chunks, "chunk_id", "content", keep=("project_id", "document_id")).select(*keys, F.col("features").alias(LIST))} if embeddings else {}),
        "index_statistics": sums.select("project_id", "n", F.coalesce("words", F.lit(0)).cast("long").alias("words"), F.lit(version).alias("analyzer_version")),
    }
    return tables if lists else {name: unpacked(rows) for name, rows in tables.items()}


def _postings(counted: DataFrame, version: str) -> DataFrame:
    return counted.select("project_id", "document_id", "chunk_id", F.col("counts").cast("array<struct<term:string,tf:bigint>>").alias(LIST), "dl", F.lit(version).alias("analyzer_version"))


def rows_from_stored(chunks: DataFrame, terms: Callable[..., DataFrame] = bm25.english_terms, version: str = bm25.ANALYZER_VERSION) -> dict[str, DataFrame | Callable]:
    """What a commit takes as the tables chunks, postings and index_statistics: the last two are made from what it has written of the tables before, so nothing is kept twice."""
    keys = ("project_id", "document_id", "chunk_id")

    def postings(written: Callable[[str], DataFrame]) -> DataFrame:
        return _postings(bm25.counted_terms(terms(written("chunks"), *keys), *keys), version)

    def sums(written: Callable[[str], DataFrame]) -> DataFrame:
        counts = written("chunks").groupBy("project_id").agg(F.count("*").alias("n"))
        words = written("postings").select(F.col("project_id").alias("other"), F.explode(F.col(LIST)["tf"]).alias("tf")).groupBy("other").agg(F.sum("tf").alias("words"))
        rows = counts.join(words, F.col("project_id").eqNullSafe(F.col("other")), "left")
        return rows.select("project_id", "n", F.coalesce("words", F.lit(0)).cast("long").alias("words"), F.lit(version).alias("analyzer_version"))

    return {"chunks": chunks, "postings": postings, "index_statistics": sums}


def statistics(snapshot: Snapshot, projects: list | None = None) -> DataFrame:
    """(project_id, n, avgdl, analyzer_version): the sums of all batches and deletes; projects without a chunk left have no row."""
    sums = snapshot.read("index_statistics", projects).groupBy("project_id").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("analyzer_version").alias("analyzer_version"))
    return sums.filter("n > 0").select("project_id", "n", (F.col("words") / F.col("n")).alias("avgdl"), "analyzer_version")


def _named(rows: DataFrame, column: str) -> list | None:
    """The distinct values of a column, or None where they are more than MOST_NAMED."""
    found = [r[0] for r in rows.select(column).distinct().limit(MOST_NAMED + 1).collect()]
    return found if len(found) <= MOST_NAMED else None


def _keyed(snapshot: Snapshot, name: str, asked: DataFrame, column: str, projects: list | None) -> DataFrame:
    """The rows of an index table that have one of the asked values of a column, from their folders alone."""
    slices = [r[0] for r in asked.select(slice_of(F.col(column), snapshot.store.slices)).distinct().collect()]  # at most as many as there are slices
    rows = snapshot.read(name, projects, slices)
    values = _named(asked, column)
    return rows.filter(F.col(column).isin(values)) if values else rows.join(asked.select(column).distinct(), column, "left_semi")


def _counted(snapshot: Snapshot, asked: DataFrame, projects: list | None) -> DataFrame:
    """(project_id, document_id, chunk_id, dl, counts): what the chunks of the index hold of the asked terms, a row per chunk, from the terms' folders alone."""
    slices = [r[0] for r in asked.select(slice_of(F.col("term"), snapshot.store.slices)).distinct().collect()]  # at most as many as there are slices
    keys = ("project_id", "document_id", "chunk_id", "dl")
    rows = snapshot.lists("postings", projects, slices).filter("project_id IS NOT NULL").select(*keys, LIST)
    named = [r[0] for r in asked.select("term").limit(bm25.BROADCAST_TERMS + 1).collect()]
    if len(named) > bm25.BROADCAST_TERMS:
        return rows.groupBy(*keys).agg(F.flatten(F.collect_list(LIST)).alias("counts"))
    values = pa.array(named, pa.string())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, lengths = batch.column(LIST).flatten(), pc.list_value_length(batch.column(LIST)).to_numpy()
            place = pc.index_in(pairs.field("term"), value_set=values)
            kept = place.is_valid()
            ends = pa.array(np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])[np.concatenate([[0], np.cumsum(lengths)])], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x.filter(kept).cast(pa.int32())) for x in (place, pairs.field("tf"))]
            own = pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], *lists], [*keys, "places", "tfs"])
            yield own.filter(pc.greater(pc.list_value_length(lists[0]), 0))

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ends = batch.column("places"), np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("places")).to_numpy())])
            pairs = pa.StructArray.from_arrays([values.take(places.flatten()), batch.column("tfs").flatten()], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], [*keys, "counts"])

    own = rows.select(*keys).schema.fields
    # Between tasks a term is its place among the asked ones.
    found = rows.mapInArrow(numbered, StructType([*own]).add("places", ArrayType(IntegerType())).add("tfs", ArrayType(IntegerType())))
    found = found.groupBy(*keys).agg(F.collect_list(F.struct("places", "tfs")).alias("parts")).select(*keys, F.flatten("parts.places").alias("places"), F.flatten("parts.tfs").alias("tfs"))
    return found.mapInArrow(worded, StructType([*own]).add("counts", bm25.COUNTS))


def _counted_in_parts(snapshot: Snapshot, asked: DataFrame, sums: DataFrame, projects: list | None) -> DataFrame:
    """The rows of _counted, written project by project (small ones together), so the disk holds the shuffle of one part only. sums: (project_id, n)."""
    sizes = dict(sums.select("project_id", "n").filter("project_id IS NOT NULL").limit(MOST_PARTED + 1).collect())
    groups = grouped(sizes) if 0 < len(sizes) <= MOST_PARTED else [projects]
    scratch = Scratch(snapshot.store.spark, "counted")
    parts = [scratch.write(_counted(snapshot, asked, group), f"part-{i}") for i, group in enumerate(groups)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def search_stored(snapshot: Snapshot, queries: DataFrame, k: int = retrieval.TOP_K, terms: Callable[..., DataFrame] = bm25.english_terms, embeddings: bool = True) -> DataFrame:
    """What retrieval.hybrid_search gives over the stored chunks, from the index alone: (query_id, project_id, chunk_id, score, rank, document_id).

    queries: (query_id, content), and project_id where one is meant. The index
    has to be of the same terms.
    """
    queries = checkpointed(queries)
    projects = _named(queries, "project_id") if "project_id" in queries.columns else None
    asked = checkpointed(terms(queries, "query_id").select(F.explode("terms").alias("term")).distinct())
    sums = statistics(snapshot, projects)
    counted = _counted_in_parts(snapshot, asked, sums, projects)
    deep = retrieval.overfetch(k) if embeddings else k
    lists = [bm25.search_counted(queries, counted, sums, deep, terms)]
    homes = counted.select("project_id", "chunk_id", "document_id")
    if embeddings:
        dims = checkpointed(retrieval.query_features(queries))
        features = _keyed(snapshot, "features", dims, "dim", projects)
        few = queries.count() <= BROADCAST_QUERIES
        ranked = checkpointed(retrieval.features_topk(dims, features, deep, few))
        lists.append(ranked)
        homes = homes.unionByName(features.select("project_id", "chunk_id", "document_id").join(ranked.select("chunk_id"), "chunk_id", "left_semi"))
    hits = retrieval.fuse(lists, k, ["query_id", "project_id"]) if embeddings else lists[0]
    hits = checkpointed(hits)
    return hits.join(homes.join(hits.select("chunk_id"), "chunk_id", "left_semi").distinct(), ["project_id", "chunk_id"])


def stored_hits(snapshot: Snapshot, hits: DataFrame) -> DataFrame:
    """Hits with their chunks, read from the folders of their documents alone; hits whose chunk is gone are dropped."""
    projects = _named(hits, "project_id")
    slices = [r[0] for r in hits.select(slice_of(F.col("document_id"), snapshot.store.slices)).distinct().collect()]
    chunks = snapshot.read("chunks", projects, slices)
    ids = _named(hits, "chunk_id")
    chunks = chunks.filter(F.col("chunk_id").isin(ids)) if ids else chunks
    found = hits.drop("document_id")
    found = F.broadcast(found) if hits.count() <= bm25.BROADCAST_TERMS else found  # a hit is as short as a term
    return found.join(chunks, ["project_id", "chunk_id"])


def ask_stored(snapshot: Snapshot, asked: DataFrame, k: int = retrieval.TOP_K, embeddings: bool = True) -> tuple[DataFrame, DataFrame]:
    """services.ask over a snapshot: of the chunks' text only the hits' is read."""
    own = services.asked_questions(asked, snapshot.read("chat_sessions"))
    hits = checkpointed(search_stored(snapshot, services.as_queries(own), k, embeddings=embeddings))
    found = stored_hits(snapshot, hits)
    return services.replies(own, checkpointed(services.as_sources(found)))


def rebuild_stale(snapshot: Snapshot, terms: Callable[..., DataFrame] = bm25.english_terms, version: str = bm25.ANALYZER_VERSION) -> Snapshot:
    """A version in which the projects that another analyzer indexed are indexed anew, in one commit; other projects' folders stay."""
    old = statistics(snapshot).filter(~F.col("analyzer_version").eqNullSafe(version)).select("project_id")
    projects = _named(old, "project_id")  # None where they are many: then every project is indexed anew
    if projects == []:
        return snapshot
    chunks = snapshot.read("chunks", projects)
    names = ("postings", "features", "index_statistics")
    drop = None
    for name in names:
        own = snapshot.lists(name, projects).select(F.lit(name).alias("name"), "p_commit", "p_project", "p_slice").distinct()
        drop = own if drop is None else drop.unionByName(own)
    return snapshot.store.commit(snapshot, index_rows(chunks, terms, version, True, True), drop)
