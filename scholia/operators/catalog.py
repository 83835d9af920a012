"""Reads, writes and deletes over the stored tables, as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import feedback, grade, normalised_timestamp
from scholia.operators.vectors import LISTS, dense_form


def newest_first(rows: DataFrame, project: str | None = None) -> DataFrame:
    """Projects, documents, sessions, quizzes or summaries, newest first, ids last."""
    own = rows if project is None else rows.filter(F.col("project_id") == project)
    return own.orderBy(F.desc("created_at"), "id")


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def ready_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of READY documents, by document and ordinal."""
    ready = documents.filter("status = 'READY'").select("document_id")
    return chunks.join(ready, "document_id").orderBy("document_id", "ordinal")


def chunks_of_documents(chunks: DataFrame, project: str, ids: DataFrame) -> DataFrame:
    """Chunks of named documents of a project, whatever their status."""
    return chunks.filter(F.col("project_id") == project).join(ids.select("document_id").distinct(), "document_id", "left_semi").orderBy("document_id", "ordinal")


def chunks_without_vector(chunks: DataFrame, documents: DataFrame, vectors: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """READY chunks that have no vector of the model, by project, document and ordinal."""
    missing = chunks.join(documents.filter("status = 'READY'").select("document_id"), "document_id").join(vectors.filter(F.col("model") == model).select("chunk_id"), "chunk_id", "left_anti")
    ordered = missing.orderBy("project_id", "document_id", "ordinal")
    return ordered if limit is None else ordered.limit(limit)


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row per key of an event log: updates and upserts."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("newest", F.row_number().over(w)).filter("newest = 1").drop("newest")


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows replace stored ones of the same key; of fresh rows that share a key, the greatest by their other columns stays."""
    rest = [c for c in fresh.columns if c != key]
    single = fresh.groupBy(key).agg(F.max(F.struct(*rest)).alias("row")).select(key, "row.*") if rest else fresh.distinct()
    return stored.join(single.select(key), key, "left_anti").unionByName(single)


def vectors_of(vectors: DataFrame, project: str, model: str) -> DataFrame:
    """The stored vectors of a project under one model."""
    return vectors.filter((F.col("project_id") == project) & (F.col("model") == model))


def vector_counts(vectors: DataFrame) -> DataFrame:
    """(project_id, model, n): how many vectors each project has under each model."""
    return vectors.groupBy("project_id", "model").agg(F.count("*").alias("n"))


def upserted_vectors(stored: DataFrame, chunks: DataFrame, embed: Callable[..., DataFrame], model: str, dims: int) -> DataFrame:
    """stored (chunk_id, project_id, model, dims, vector) with a vector of the model for each of chunks.

    A chunk has one vector: a new one replaces that of any model. embed gives
    sparse rows (chunk_id, dim, weight); a chunk without features has the zero
    vector. Backfill passes chunks_without_vector or stale_chunks as chunks.
    """
    fresh = dense_vectors(chunks, embed, model, dims)
    kept = stored.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh, allowMissingColumns=True)


def content_hash(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def stale_chunks(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of the model made from the text that they have now: new ones, changed ones, and those of another model.

    vectors: (chunk_id, model, content_sha256).
    """
    held = vectors.filter(F.col("model") == model).select("chunk_id", F.col("content_sha256").alias("held_sha256"))
    return chunks.withColumn("held_sha256", content_hash(F.col("content"))).join(held, ["chunk_id", "held_sha256"], "left_anti").select(*chunks.columns)


def dense_vectors(chunks: DataFrame, embed: Callable[..., DataFrame], model: str, dims: int) -> DataFrame:
    """(chunk_id, project_id, model, dims, vector) of chunks."""
    if embed in LISTS:
        return LISTS[embed](chunks, "chunk_id", "content", dims, ("project_id",)).select("chunk_id", "project_id", F.lit(model).alias("model"), F.lit(dims).alias("dims"), dense_form(dims)(F.col("features")).alias("vector"))
    parts = embed(chunks, "chunk_id", "content").groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", F.col("weight").cast("float")))).alias("parts"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("parts", i), F.lit(0.0).cast("float")))
    return chunks.select("chunk_id", "project_id").join(parts, "chunk_id", "left").select("chunk_id", "project_id", F.lit(model).alias("model"), F.lit(dims).alias("dims"), dense.alias("vector"))


def summary_citations(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """Citations of summaries with the name of their document, null where that is gone."""
    return citations.join(documents.select("document_id", "filename"), "document_id", "left").orderBy("summary_id", "citation_id")


def graded_question(questions: DataFrame, quiz: str, question: str, answer: Column) -> DataFrame:
    """(question_id, correct, verdict, feedback) of an answer to a stored question; no row if the quiz has none of that id."""
    own = questions.filter((F.col("quiz_id") == quiz) & (F.col("question_id") == question))
    judged = own.select("question_id", "answer", grade(F.col("answer"), answer).alias("g"))
    return judged.select("question_id", "g.correct", "g.verdict", feedback(F.col("g.verdict"), F.col("answer")).alias("feedback"))


def messages_with_citations(messages: DataFrame, citations: DataFrame, documents: DataFrame) -> DataFrame:
    """Messages, oldest first, each with its citations in order; a citation may outlive its document."""
    named = citations.join(documents.select("document_id", "filename"), "document_id", "left")
    lists = named.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("citation_order", "document_id", "filename", "page", "quoted_text"))).alias("citations"))
    kind = lists.schema["citations"].dataType
    return messages.join(lists, "message_id", "left").withColumn("citations", F.coalesce("citations", F.array().cast(kind))).orderBy("session_id", "created_at", "message_id")


def sessions_by_last_update(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions by their newest message, or their own time where they have none."""
    last = messages.groupBy("session_id").agg(F.max("created_at").alias("last_at"))
    return sessions.join(last, "session_id", "left").withColumn("updated_at", F.coalesce("last_at", "created_at")).drop("last_at").orderBy(F.desc("updated_at"), "session_id")


def with_children(parents: DataFrame, children: DataFrame, key: str, name: str, order: str = "ordinal") -> DataFrame:
    """Parents with their children as an ordered list: quizzes with questions, summaries with citations."""
    rest = [c for c in children.columns if c not in (key, order)]
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))
    kind = lists.schema[name].dataType
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


#: Tables by the chain of parents whose deletion deletes them: (table, own key, parent table, parent key).
CASCADE = (
    ("documents", "document_id", "projects", "project_id"),
    ("chunks", "chunk_id", "documents", "document_id"),
    ("chunk_embeddings", "chunk_id", "chunks", "chunk_id"),
    ("postings", "chunk_id", "chunks", "chunk_id"),
    ("features", "chunk_id", "chunks", "chunk_id"),
    ("document_status", "document_id", "documents", "document_id"),
    ("chat_sessions", "session_id", "projects", "project_id"),
    ("chat_messages", "message_id", "chat_sessions", "session_id"),
    ("message_citations", "citation_id", "chat_messages", "message_id"),
    ("quizzes", "quiz_id", "projects", "project_id"),
    ("quiz_questions", "question_id", "quizzes", "quiz_id"),
    ("summaries", "summary_id", "projects", "project_id"),
    ("summary_citations", "citation_id", "summaries", "summary_id"),
)


def cascade_delete(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting rows of one and all that hangs from them, by anti-joins alone."""
    key = ids.columns[0]
    out = dict(tables)
    gone = {table: ids.select(key).distinct()}
    out[table] = out[table].join(gone[table], key, "left_anti")
    for child, own, parent, link in CASCADE:
        if parent in gone and child in out:
            lost = gone[parent].select(link) if link in gone[parent].columns else None
            if lost is None:
                continue
            hit = tables[child].join(lost, link, "left_semi").select(own, *([link] if link != own else [])).distinct()
            gone[child] = hit
            out[child] = out[child].join(lost, link, "left_anti")
    return out


def deleted_counts(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """(document_id, n_deleted): how many chunks go with each document that is deleted."""
    gone = ids.select("document_id").distinct().join(chunks.select("document_id", F.lit(1).alias("one")), "document_id", "left")
    return gone.groupBy("document_id").agg(F.count("one").alias("n_deleted"))


def missing_ids(requested: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(found.select(key), key, "left_anti")


def normalised_timestamps(rows: DataFrame, *columns: str) -> DataFrame:
    """Text timestamps of other than 30 characters rewritten; the rest untouched."""
    def fixed(c: str) -> Column:
        return F.when(F.length(c) == 30, F.col(c)).otherwise(normalised_timestamp(F.col(c))).alias(c)

    return rows.select(*[fixed(c) if c in columns else F.col(c) for c in rows.columns])


def read_list(text: Column) -> Column:
    """JSON text to a list of strings; null and blank are empty."""
    return F.coalesce(F.when(F.trim(text) != "", F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def write_list(items: Column) -> Column:
    return F.to_json(F.coalesce(items, F.array().cast("array<string>")))


#: Questions of a quiz where none are asked for, and at most.
USUAL_QUESTIONS, MOST_QUESTIONS = 5, 20


def question_count(asked: Column) -> Column:
    return F.when(asked.isNull() | (asked < 1), USUAL_QUESTIONS).otherwise(F.least(asked, F.lit(MOST_QUESTIONS)))


def safe_message(text: Column, kind: Column) -> Column:
    return F.substring(F.coalesce(text, kind), 1, 500)
