from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scholia.operators import bm25, services
from scholia.sources import io
from scholia.streaming.ingest import ingest, stored

AT = datetime(2024, 5, 1)
WATER = " ".join(f"Osmosis number {w} moves water molecules through a thin membrane of the plant cell." for w in ("alpha", "beta", "gamma", "delta"))
STONE = " ".join(f"Granite layer {w} formed slowly while magma cooled deep below the mountain range." for w in ("upper", "lower", "outer", "inner"))


@pytest.fixture
def store(spark):
    documents = spark.createDataFrame([("d1", "p1", "water.txt", "READY"), ("d2", "p2", "stone.txt", "READY"), ("d3", "p2", "late.txt", "PROCESSING")], "document_id string, project_id string, filename string, status string")
    chunks = spark.createDataFrame([("c1", "d1", "p1", 0, 4, WATER), ("c2", "d2", "p2", 0, None, STONE)], "chunk_id string, document_id string, project_id string, ordinal int, page int, content string")
    return documents, chunks


@pytest.mark.parametrize("embeddings", [True, False])
def test_ask_stores_question_and_reply(spark, store, embeddings):
    documents, chunks = store
    sessions = spark.createDataFrame([("s1", "p1"), ("s2", "p2"), ("s3", "p3")], "session_id string, project_id string")
    asked = spark.createDataFrame([(1, "s1", "What moves water through a membrane?", AT), (2, "s2", "What moves water through a membrane?", AT), (3, "s3", "Anything?", AT), (4, "gone", "Anything?", AT), (5, "s1", " \n", AT)], "request_id int, session_id string, question string, created_at timestamp")
    messages, cited = services.ask(asked, sessions, chunks, documents, embeddings=embeddings)
    rows = messages.orderBy("session_id", "created_at").collect()
    assert [(r.session_id, r.role) for r in rows] == [(s, role) for s in ("s1", "s2", "s3") for role in ("USER", "ASSISTANT")]
    assert "Osmosis" in rows[1].content and "Osmosis" not in rows[3].content and rows[5].content == services.NO_HITS
    by_message = {}
    for c in cited.collect():
        by_message.setdefault(c.message_id, []).append(c)
    assert {c.document_id for c in by_message[rows[1].message_id]} == {"d1"} and {c.page for c in by_message[rows[1].message_id]} == {4}
    assert rows[5].message_id not in by_message
    again, _ = services.ask(asked, sessions, chunks, documents, embeddings=embeddings)
    assert {r.message_id for r in again.collect()} == {r.message_id for r in rows}


def test_summaries_are_stored_or_refused(spark, store):
    documents, chunks = store
    requests = spark.createDataFrame([(i, "p2", AT) for i in range(1, 6)], "request_id int, project_id string, created_at timestamp")
    wanted = spark.createDataFrame([(1, "d2"), (1, "d3"), (2, "d1"), (3, "nowhere"), (5, "d3")], "request_id int, document_id string")
    rows, cited, refused = services.summarise(requests, wanted, chunks, documents)
    made = rows.collect()
    assert [(r.title, r.document_ids, r.project_id) for r in made] == [("Summary of stone.txt", ["d2"], "p2")] and made[0].content.startswith("## stone.txt\n- ")
    assert {c.document_id for c in cited.collect()} == {"d2"}
    assert {r.request_id: r.problem for r in refused.collect()} == {2: "foreign", 3: "unknown", 4: "empty", 5: "no material"}


def test_quizzes_are_stored_or_refused(spark, store):
    documents, chunks = store
    requests = spark.createDataFrame([(1, "p1", 2, AT), (2, "p2", None, AT), (3, "p3", None, AT), (4, "p1", 3, AT)], "request_id int, project_id string, asked int, created_at timestamp")
    wanted = spark.createDataFrame([(4, "d2")], "request_id int, document_id string")
    quizzes, questions, refused = services.make_quizzes(requests, wanted, chunks, documents)
    heads = {r.title: r for r in quizzes.collect()}
    assert set(heads) == {"Key terms: water.txt", "Key terms: stone.txt"}
    own = questions.filter(F.col("quiz_id") == heads["Key terms: water.txt"].quiz_id).orderBy("ordinal").collect()
    assert 0 < len(own) <= 2 and [q.ordinal for q in own] == list(range(len(own)))
    assert {(q.source_filename, q.source_page) for q in own} == {("water.txt", 4)}
    assert {r.request_id: r.problem for r in refused.collect()} == {3: "no material", 4: "foreign"}


def test_no_requests_give_no_rows(spark, store):
    documents, chunks = store
    requests = spark.createDataFrame([], "request_id int, project_id string, asked int, created_at timestamp")
    wanted = spark.createDataFrame([], "request_id int, document_id string")
    for make in (services.summarise, services.make_quizzes):
        assert [df.count() for df in make(requests, wanted, chunks, documents)] == [0, 0, 0]


def test_queries_of_a_project_meet_only_its_chunks(spark, store):
    _, chunks = store
    postings, statistics = bm25.build_index(chunks.select("project_id", "chunk_id", "content"), bm25.english_terms)
    asked = spark.createDataFrame([(1, "p1", "water magma"), (2, "p2", "water magma")], "query_id int, project_id string, content string")
    hits = bm25.search(asked, postings, statistics, 3, bm25.english_terms).collect()
    assert {(h.query_id, h.project_id, h.chunk_id) for h in hits} == {(1, "p1", "c1"), (2, "p2", "c2")}


def test_uploads_are_stored_where_the_stream_reads(spark, tmp_path):
    path = io.put_upload(spark, str(tmp_path), "p1", "../a?b.txt", "Napoleon".encode())
    assert open(path).read() == "Napoleon" and path.startswith(f"{tmp_path}/p1/") and path.endswith("-a_b.txt")
    for name, content in (("a.exe", b"x"), ("a.txt", b"")):
        with pytest.raises(ValueError):
            io.put_upload(spark, str(tmp_path), "p1", name, content)


def test_a_broken_file_fails_alone(spark, tmp_path, monkeypatch):
    def pages(files):
        two = files.select("path", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"), F.col("content").cast("string").alias("text"))
        return two.withColumn("error", F.when((F.col("page") == 2) & F.col("text").contains("broken"), "page 2 can't be read"))

    monkeypatch.setitem(io.EXTRACTORS, "application/pdf", pages)
    for name, text in (("good.pdf", "Osmosis moves water. "), ("bad.pdf", "broken ")):
        io.put_upload(spark, str(tmp_path / "in"), "p1", name, (text * 30).encode())
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck"), 50, 10).awaitTermination()
    docs = {r.filename.split("-")[1]: r for r in stored(spark, str(tmp_path / "store"), "documents").collect()}
    assert (docs["good.pdf"].status, docs["good.pdf"].page_count, docs["bad.pdf"].status, docs["bad.pdf"].error_message) == ("READY", 2, "FAILED", "page 2 can't be read")
    chunks = stored(spark, str(tmp_path / "store"), "chunks")
    vectors = stored(spark, str(tmp_path / "store"), "chunk_embeddings")
    assert {r.document_id for r in chunks.select("document_id").collect()} == {docs["good.pdf"].document_id}
    assert chunks.count() == vectors.filter("size(vector) = 1024 AND model = 'hashing'").count() > 0
    assert stored(spark, str(tmp_path / "store"), "postings").filter("term = 'osmosi' AND analyzer_version = 'english-v1'").count() > 0
