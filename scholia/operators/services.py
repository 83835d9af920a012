"""Ask, summarise and quiz as batches: requests in, rows of the stored tables out.

Every result is keyed by a hash of its request, so a batch that runs again gives the
same rows, and sources.io.append or catalog.upsert stores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import is_testable
from scholia.operators import answers as A
from scholia.operators import catalog, quiz, retrieval, sentences
from scholia.session import checkpointed

# Replies and titles that users see.
NO_HITS = "I couldn't find anything in this project's documents that relates to that question. Try uploading the relevant material, or rephrasing the question."
NEW_CHAT = "New chat"
SUMMARY_TITLE, QUIZ_TITLE = "Summary of ", "Key terms: "


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")) == ""


def session_title(title: Column) -> Column:
    return F.when(is_blank(title), NEW_CHAT).otherwise(F.trim(title))


def source_title(filename: Column, page: Column) -> Column:
    """The file name, with the page where there is one."""
    return F.concat(filename, F.when(page.isNull(), "").otherwise(F.concat(F.lit(" — p. "), page.cast("string"))))


def _id(*parts: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def ask(asked: DataFrame, sessions: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = retrieval.TOP_K, embeddings: bool = True) -> tuple[DataFrame, DataFrame]:
    """(messages, citations) of asked (request_id, session_id, question, created_at).

    Each question becomes a USER message and, a microsecond later, an ASSISTANT
    message, from the chunks of the session's project. Questions to unknown
    sessions give no rows, nor do blank ones.
    """
    own = asked_questions(asked, sessions)
    hits = retrieval.hybrid_search(as_queries(own), chunks, k, embeddings)
    held = retrieval.hydrate(hits, chunks).join(documents.select("document_id"), "document_id", "left_semi")
    return replies(own, checkpointed(as_sources(held)))


def asked_questions(asked: DataFrame, sessions: DataFrame) -> DataFrame:
    """Questions that are not blank, of sessions that there are, with the session's project."""
    own = asked.join(sessions.select("session_id", "project_id"), "session_id").filter(~is_blank(F.col("question")))
    return checkpointed(own.select(F.col("request_id").cast("string").alias("request_id"), "session_id", "project_id", "question", "created_at"))


def as_queries(own: DataFrame) -> DataFrame:
    return own.select(F.col("request_id").alias("query_id"), "project_id", F.col("question").alias("content"))


def as_sources(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("query_id").alias("request_id"), F.col("rank").alias("source_order"), "chunk_id", "document_id", "page", "content")


def replies(own: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, citations) of asked_questions, from the chunks that were found for them."""
    found = sources.select("request_id").distinct()
    said = A.answers(own.join(found, "request_id", "left_semi").select("request_id", "question"), sources)
    told = own.join(said, "request_id", "left").withColumn("message_id", _id("session_id", "request_id", F.lit("ASSISTANT")))
    told = checkpointed(told.select("message_id", "session_id", F.lit("ASSISTANT").alias("role"), F.coalesce("text", F.lit(NO_HITS)).alias("content"), (F.col("created_at") + F.expr("INTERVAL 1 MICROSECOND")).alias("created_at"), "citations"))
    users = own.select(_id("session_id", "request_id", F.lit("USER")).alias("message_id"), "session_id", F.lit("USER").alias("role"), F.col("question").alias("content"), "created_at")
    cited = told.select("message_id", F.explode("citations").alias("c")).select(_id("message_id", F.col("c.citation_order").cast("string")).alias("citation_id"), "message_id", "c.*")
    return users.unionByName(told.drop("citations")), cited


def refusals(requests: DataFrame, wanted: DataFrame, documents: DataFrame, empty_is_all: bool) -> DataFrame:
    """(request_id, problem): requests that name no document (unless that means all), an unknown or a foreign one."""
    named = wanted.join(requests.select("request_id", "project_id"), "request_id")
    bad = A.request_problems(named, documents).groupBy("request_id").agg(F.max("problem").alias("problem"))
    if empty_is_all:
        return bad
    return bad.unionByName(requests.join(wanted, "request_id", "left_anti").select("request_id", F.lit("empty").alias("problem")))


def _sources(requests: DataFrame, wanted: DataFrame, chunks: DataFrame, documents: DataFrame, most: int) -> DataFrame:
    """Chunks of the requested documents, or of all READY ones where none is named, spread evenly and joined to their documents."""
    named = wanted.join(requests.select("request_id", "project_id"), "request_id").select("request_id", "project_id", "document_id").distinct()
    ready = documents.filter("status = 'READY'").select("project_id", "document_id")
    every = requests.join(wanted, "request_id", "left_anti").select("request_id", "project_id").join(ready, "project_id").select("request_id", "project_id", "document_id")
    rows = named.unionByName(every).join(chunks, ["project_id", "document_id"])
    picked = sentences.even_stride(rows, "request_id", most, "document_id", "ordinal")
    order = Window.partitionBy("request_id").orderBy("document_id", "ordinal")
    placed = picked.withColumn("source_order", F.row_number().over(order)).join(documents.select("document_id", "filename"), "document_id")
    return checkpointed(placed.select("request_id", "source_order", "chunk_id", "document_id", "filename", "page", "content"))


def _head(requests: DataFrame, sources: DataFrame, key: str, title: str) -> DataFrame:
    """(key, request_id, project_id, title, document_ids, created_at) of the requests that have sources."""
    names = A.joined_names(sources, "request_id", "filename", "source_order")
    ids = sources.groupBy("request_id", "document_id").agg(F.min("source_order").alias("first")).groupBy("request_id")
    ids = ids.agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "document_id"))), lambda x: x["document_id"]).alias("document_ids"))
    rows = requests.join(names, "request_id").join(ids, "request_id")
    return rows.select(_id("project_id", F.col("request_id").cast("string"), F.lit(key)).alias(key), "request_id", "project_id", F.concat(F.lit(title), F.col("names")).alias("title"), "document_ids", "created_at")


def summarise(requests: DataFrame, wanted: DataFrame, chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summaries, citations, refused) of requests (request_id, project_id, created_at) for documents wanted (request_id, document_id).

    refused: (request_id, problem). Requests without material are refused as `no material`.
    """
    requests, wanted = checkpointed(requests), checkpointed(wanted)
    bad = checkpointed(refusals(requests, wanted, documents, empty_is_all=False))
    good = checkpointed(requests.join(bad, "request_id", "left_anti"))
    sources = _sources(good, wanted.join(good, "request_id", "left_semi"), chunks, documents, A.SUMMARY_CHUNKS)
    made = A.summaries(sources).withColumnRenamed("request_id", "made_for")
    head = _head(good, sources, "summary_id", SUMMARY_TITLE)
    rows = checkpointed(head.join(made, F.col("request_id").cast("string") == F.col("made_for")))
    cited = rows.select("summary_id", F.explode("citations").alias("c")).select(_id("summary_id", F.col("c.citation_order").cast("string")).alias("citation_id"), "summary_id", "c.*")
    none = good.join(rows, "request_id", "left_anti").select("request_id", F.lit("no material").alias("problem"))
    return rows.select("summary_id", "project_id", "title", "document_ids", F.col("text").alias("content"), "created_at"), cited, bad.unionByName(none)


def make_quizzes(requests: DataFrame, wanted: DataFrame, chunks: DataFrame, documents: DataFrame, types: tuple[str, ...] = quiz.TYPES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(quizzes, questions, refused) of requests (request_id, project_id, asked, created_at); asked is the number of questions, or null.

    A request without a row in wanted is for all READY documents of its project.
    """
    requests, wanted = checkpointed(requests), checkpointed(wanted)
    bad = checkpointed(refusals(requests, wanted, documents, empty_is_all=True))
    good = checkpointed(requests.join(bad, "request_id", "left_anti"))
    sources = _sources(good, wanted.join(good, "request_id", "left_semi"), chunks, documents, quiz.QUIZ_CHUNKS)
    corpus = checkpointed(sentences.sentence_corpus(sources, quiz.CANDIDATES))
    made = quiz.quiz(sentences.with_fallback(corpus, "request_id", is_testable(F.col("text"))), catalog.MOST_QUESTIONS, types)
    made = made.join(good.select("request_id", catalog.question_count(F.col("asked")).alias("most")), "request_id").filter("ordinal < most")
    made = made.join(corpus.select("request_id", "position", "filename", "page"), ["request_id", "position"])
    head = _head(good, sources, "quiz_id", QUIZ_TITLE)
    rows = checkpointed(made.join(head.select("request_id", "quiz_id"), "request_id"))
    questions = rows.select(_id("quiz_id", F.col("ordinal").cast("string")).alias("question_id"), "quiz_id", "ordinal", "type", "prompt", "choices", "answer", "explanation", F.col("document_id").alias("source_document_id"), F.col("filename").alias("source_filename"), F.col("page").alias("source_page"))
    none = good.join(rows, "request_id", "left_anti").select("request_id", F.lit("no material").alias("problem"))
    return head.join(rows, "quiz_id", "left_semi").drop("request_id"), questions, bad.unionByName(none)
