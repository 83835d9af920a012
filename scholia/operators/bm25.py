"""Keyword retrieval: postings, statistics per project, BM25."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from scholia.functions import lexicons as L
from scholia.functions.stemmer import stem
from scholia.functions.text import tokenize
from scholia.operators.best import best_rows, ranked
from scholia.session import checkpointed, stored

K1, B = 1.2, 0.75
ANALYZER_VERSION = "english-v1"
#: A query term row is under 200 bytes: at most 40 MB of query terms are broadcast.
BROADCAST_TERMS = 200_000
#: The most numbers of a matrix that goes to the tasks: 32 MB.
DENSE = 4_000_000
#: Scores are rounded to so many digits before they are ranked.
DIGITS = 9
COUNTS = ArrayType(StructType().add("term", "string").add("tf", "integer"))
ENGLISH_TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"


def english_words(text: Column) -> Column:
    """Lower-case words without a final 's and without search stop words; stemming comes after."""
    words = F.transform(F.regexp_extract_all(text, F.lit(ENGLISH_TOKEN), F.lit(0)), lambda w: F.lower(F.regexp_replace(w, "['’][sS]$", "")))
    return F.filter(words, lambda w: ~w.isin(*L.SEARCH_STOPWORDS))


@F.arrow_udf(ArrayType(StringType()))
def stems(words: pa.Array) -> pa.Array:
    """Lists of words as lists of their stems: each distinct word of a batch is stemmed once."""
    coded = words.flatten().dictionary_encode()
    stemmed = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stemmed.take(coded.indices))


def _present(terms: Column) -> Column:
    return F.coalesce(terms, F.array().cast("array<string>"))


def plain_terms(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, terms): the tokens of column content, as often as they stand there."""
    return rows.select(*keep, _present(tokenize(F.col("content"))).alias("terms"))


def english_terms(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, stems(_present(english_words(F.col("content")))).alias("terms"))


def counted_terms(rows: DataFrame, *keep: str, firsts: bool = False) -> DataFrame:
    """(keep, dl, counts) of rows (keep, terms): counts holds each distinct term with its tf and, where asked for, the place that it has first.

    A row is counted where it lies, so no token meets a shuffle.
    """
    schema = StructType([*rows.select(*keep).schema.fields]).add("dl", "long").add("counts", ArrayType(StructType([*COUNTS.elementType.fields]).add("first_at", "integer")) if firsts else COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            coded = lists.flatten().dictionary_encode()
            size = max(1, len(coded.dictionary))
            owner = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            keys, first, tf = np.unique(owner * size + coded.indices.to_numpy(), return_index=True, return_counts=True)
            fields = {"term": coded.dictionary.take(pa.array(keys % size)), "tf": pa.array(tf, pa.int32())}
            if firsts:
                fields["first_at"] = pa.array(first - np.searchsorted(owner, keys // size), pa.int32())
            pairs = pa.StructArray.from_arrays(list(fields.values()), list(fields))
            ends = np.searchsorted(keys // size, np.arange(len(batch) + 1))
            columns = [*[batch.column(c) for c in keep], pc.list_value_length(lists).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "dl", "counts"])

    return rows.select(*keep, "terms").mapInArrow(run, schema)


def postings_of(counted: DataFrame, *keep: str) -> DataFrame:
    """(keep, dl, term, tf): one row per distinct term of rows (keep, dl, counts)."""
    rows = counted.select(*keep, "dl", F.explode("counts").alias("c"))
    return rows.select(*keep, "dl", F.col("c.term").alias("term"), F.col("c.tf").cast("long").alias("tf"))


def _statistics(counted: DataFrame, version: str) -> DataFrame:
    return counted.groupBy("project_id").agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl")).withColumn("analyzer_version", F.lit(version))


def build_index(chunks: DataFrame, terms: Callable[..., DataFrame] = plain_terms, version: str = "plain-v1") -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of chunks (project_id, chunk_id, content).

    postings: project_id, term, chunk_id, tf, dl. statistics: project_id, n,
    avgdl, analyzer_version. Both are per project. Term counts are the index:
    they are written once, a row per chunk, and all that follows reads them.
    """
    counted = stored(counted_terms(terms(chunks, "project_id", "chunk_id"), "project_id", "chunk_id"))
    postings = postings_of(counted, "project_id", "chunk_id")
    return postings.select("project_id", "chunk_id", "term", "tf", "dl"), _statistics(counted, version)


def stale_projects(statistics: DataFrame, version: str = ANALYZER_VERSION) -> DataFrame:
    """Projects whose index another analyzer wrote."""
    return statistics.filter(~F.col("analyzer_version").eqNullSafe(version)).select("project_id")


def rebuilt_index(postings: DataFrame, statistics: DataFrame, chunks: DataFrame, terms: Callable[..., DataFrame] = english_terms, version: str = ANALYZER_VERSION) -> tuple[DataFrame, DataFrame]:
    """The index with the projects that another analyzer wrote indexed anew from their chunks; the rest stays."""
    stale = checkpointed(stale_projects(statistics, version))
    fresh, counts = build_index(chunks.join(stale, "project_id", "left_semi"), terms, version)
    return postings.join(stale, "project_id", "left_anti").unionByName(fresh), statistics.join(stale, "project_id", "left_anti").unionByName(counts)


def search(queries: DataFrame, postings: DataFrame, statistics: DataFrame, k: int, terms: Callable[..., DataFrame] = plain_terms) -> DataFrame:
    """(query_id, project_id, chunk_id, score, rank): the k best chunks per query and project.

    queries: (query_id, content), and project_id where a query is for one project
    only. Terms are joined by OR; a term that a query repeats counts again. Query
    terms are broadcast when counted to be few.
    """
    own = [c for c in ("project_id",) if c in queries.columns]
    asked = _asked(queries, terms)
    side = F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked
    wanted = side.select("term", *own).distinct()
    postings = postings.join(F.broadcast(wanted) if side is not asked else wanted, ["term", *own], "left_semi")
    weights = _weights(postings, statistics)
    hits = postings.join(weights, ["project_id", "term"])
    gain = F.col("idf") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.select("project_id", "chunk_id", "term", gain.alias("gain")).join(side, ["term", *own]).groupBy("query_id", "project_id", "chunk_id").agg(F.sum(F.col("gain") * F.col("qtf")).alias("score"))
    return ranked(scored, k, DIGITS)


def _asked(queries: DataFrame, terms: Callable[..., DataFrame]) -> DataFrame:
    """(query_id, project_id where queries have one, term, qtf)."""
    own = [c for c in ("project_id",) if c in queries.columns]
    return terms(queries, "query_id", *own).select("query_id", *own, F.explode("terms").alias("term")).groupBy("query_id", *own, "term").agg(F.count("*").alias("qtf"))


def _weights(postings: DataFrame, statistics: DataFrame) -> DataFrame:
    """(project_id, term, avgdl, idf) of the terms of postings."""
    frequency = postings.groupBy("project_id", "term").agg(F.count("*").alias("df")).join(statistics.select("project_id", "n", "avgdl"), "project_id")
    return frequency.select("project_id", "term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def search_chunks(queries: DataFrame, chunks: DataFrame, k: int, terms: Callable[..., DataFrame] = plain_terms) -> DataFrame:
    """What search gives over an index of chunks (project_id, chunk_id, content), scored where each chunk's counts lie.

    Queries score in one matrix product per block of chunks, and a task passes
    on no more than k rows per query and project. Where the queries or projects
    are too many for a matrix of DENSE numbers, postings are joined instead.
    """
    counted = stored(counted_terms(terms(chunks, "project_id", "chunk_id"), "project_id", "chunk_id").filter("project_id IS NOT NULL"))
    return search_counted(queries, counted, _statistics(counted, ""), k, terms)


def search_counted(queries: DataFrame, counted: DataFrame, statistics: DataFrame, k: int, terms: Callable[..., DataFrame] = plain_terms) -> DataFrame:
    """The same over rows (project_id, chunk_id, dl, counts), one per chunk and none without a project; terms that no query has may be left out of counts."""
    asked = checkpointed(_asked(queries, terms))
    own = [c for c in ("project_id",) if c in queries.columns]
    n_terms, n_queries = asked.select(F.countDistinct("term"), F.countDistinct("query_id", *own)).first()
    postings = postings_of(counted, "project_id", "chunk_id")
    n_projects = statistics.count()
    if max(n_queries, n_projects) * n_terms > DENSE or n_queries * n_projects > DENSE:
        return search(queries, postings, statistics, k, terms)
    weights = _weights(postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi"), statistics).collect()  # at most DENSE rows
    if not weights:
        return search(queries, postings, statistics, k, terms)
    questions = asked.collect()
    places = {t: i for i, t in enumerate(dict.fromkeys(r["term"] for r in questions))}
    keys = {q: i for i, q in enumerate(dict.fromkeys((r["query_id"], r["project_id"] if own else None) for r in questions))}
    projects = {p: i for i, p in enumerate(dict.fromkeys(r["project_id"] for r in weights))}
    asks, idf, mean = np.zeros((len(places), len(keys))), np.zeros((len(projects), len(places))), np.ones(len(projects))
    for r in questions:
        asks[places[r["term"]], keys[r["query_id"], r["project_id"] if own else None]] = r["qtf"]
    for r in weights:
        idf[projects[r["project_id"]], places[r["term"]]], mean[projects[r["project_id"]]] = r["idf"], r["avgdl"]
    named = pa.array(list(places), pa.string())

    def rows(batch: pa.RecordBatch, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, gain) of the asked terms of a batch."""
        lists = batch.column("counts")
        pairs, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        term = pc.fill_null(pc.index_in(pairs.field("term"), named), -1).to_numpy()
        kept = (term >= 0) & (owners[row] >= 0)
        row, term, tf = row[kept], term[kept], pairs.field("tf").to_numpy()[kept]
        at = owners[row]
        length = batch.column("dl").to_numpy()[row] / mean[at]
        return row, term, idf[at, term] * tf / (tf + K1 * (1 - B + B * length))

    return best_rows(counted.select("project_id", "chunk_id", "dl", "counts"), rows, asks, list(keys), list(projects), queries.schema["query_id"].dataType, k, DIGITS)
