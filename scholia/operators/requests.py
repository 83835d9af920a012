"""Requests about projects, sessions, questions and documents over stored tables, in batches, with their refusals.

Each function takes requests as rows and gives what is to be stored, and the
refused requests with the reason. Ids are hashes of the request, so a batch that
runs again gives the same rows and an upsert by id stores them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import feedback, grade
from scholia.operators.index import statistics
from scholia.operators.services import is_blank, session_title
from scholia.sources.store import Snapshot
from scholia.streaming.ingest import MODEL, STATES, settled

# What a refused request is told.
NO_NAME, NO_ANSWER = "Project name is required.", "must not be blank"
UNKNOWN_PROJECT, UNKNOWN_QUESTION = "Project not found: ", "Question not found: "


def _split(requests: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): refused is (request_id, reason)."""
    judged = requests.withColumn("refusal", reason)
    return judged.filter("refusal IS NULL").drop("refusal"), judged.filter("refusal IS NOT NULL").select("request_id", F.col("refusal").alias("reason"))


def new_projects(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, refused) of requests (request_id, name, description, created_at); names are trimmed, blank ones refused."""
    good, bad = _split(requests, F.when(is_blank(F.col("name")), NO_NAME))
    return good.select(F.sha2(F.concat_ws("|", F.lit("project"), F.col("request_id").cast("string")), 256).alias("project_id"), F.trim("name").alias("name"), F.trim("description").alias("description"), "created_at"), bad


def new_sessions(requests: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chat_sessions, refused) of requests (request_id, project_id, title, created_at); a project that is not there is refused."""
    known = projects.select("project_id").distinct().withColumn("known", F.lit(True))
    good, bad = _split(requests.join(known, "project_id", "left"), F.when(F.col("known").isNull(), F.concat(F.lit(UNKNOWN_PROJECT), F.coalesce(F.col("project_id").cast("string"), F.lit("null")))))
    return good.select(F.sha2(F.concat_ws("|", F.lit("session"), F.col("request_id").cast("string")), 256).alias("session_id"), "project_id", session_title(F.col("title")).alias("title"), "created_at", F.col("created_at").alias("updated_at")), bad


def graded_answers(requests: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grades, refused) of requests (request_id, quiz_id, question_id, student_answer).

    Blank answers are refused, and questions that the quiz does not have.
    """
    own = questions.select("quiz_id", "question_id", "answer", F.lit(True).alias("known"))
    missing = F.when(F.col("known").isNull(), F.concat(F.lit(UNKNOWN_QUESTION), F.coalesce(F.col("question_id").cast("string"), F.lit("null"))))
    good, bad = _split(requests.join(own, ["quiz_id", "question_id"], "left"), F.coalesce(F.when(is_blank(F.col("student_answer")), NO_ANSWER), missing))
    judged = good.select("request_id", "question_id", "answer", grade(F.col("answer"), F.col("student_answer")).alias("g"))
    return judged.select("request_id", "question_id", "g.correct", "g.verdict", feedback(F.col("g.verdict"), F.col("answer")).alias("feedback")), bad


def project_status(log: DataFrame) -> DataFrame:
    """(project_id, pending, processing, ready, failed, settled): how many documents are in each state, and whether none is still on its way."""
    counts = settled(log).groupBy("project_id").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in STATES])
    return counts.withColumn("settled", (F.col("pending") == 0) & (F.col("processing") == 0))


def embedding_status(snapshot: Snapshot, model: str = MODEL) -> DataFrame:
    """(project_id, chunks, embedded, model, analyzer_version): how far search by meaning is, per project; model is `none` where no vector is."""
    chunks = snapshot.read("chunks").groupBy("project_id").agg(F.count("*").alias("chunks"))
    held = snapshot.read("chunk_embeddings").filter(F.col("model") == model).groupBy("project_id").agg(F.count("*").alias("embedded"))
    rows = chunks.join(held, "project_id", "left").join(statistics(snapshot).select("project_id", "analyzer_version"), "project_id", "left")
    embedded = F.coalesce("embedded", F.lit(0))
    return rows.select("project_id", "chunks", embedded.alias("embedded"), F.when(embedded > 0, model).otherwise("none").alias("model"), "analyzer_version")
