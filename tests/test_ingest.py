import os
import shutil

import pytest
from pyspark.sql import functions as F

from scholia.operators import catalog, index, retrieval, services
from scholia.operators.vectors import DIMENSIONS
from scholia.sources import io
from scholia.sources.store import Store
from scholia.streaming import ingest as I
from scholia.streaming.ingest import embed_stale, ingest, settled, stored


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


OSMOSIS = "Osmosis moves water through a membrane from a dilute to a concentrated solution. " * 12
FRANCE = "Napoleon was crowned emperor of the French in the cathedral of Paris in 1804. " * 5
PLANTS = "Photosynthesis stores the energy of light in sugar, which plants make from water and air. " * 8


def run(spark, base):
    ingest(spark, str(base / "in"), str(base / "store"), str(base / "ck"), 30, 6).awaitTermination()
    return Store(spark, str(base / "store")).snapshot()


@pytest.fixture(scope="module")
def taken(spark, tmp_path_factory):
    """Two batches through one stream, then a document deleted: (folder, first snapshot, second, last, counts)."""
    base = tmp_path_factory.mktemp("ingest")
    folder = base / "in"
    put(folder, "p1/notes.txt", OSMOSIS)
    put(folder, "p2/plants.md", PLANTS)
    put(folder, "p2/blank.md", " \n ")
    put(folder, "p2/slides.pdf", "%PDF")
    put(folder, "p2/tool.exe", "x")
    one = run(spark, base)
    put(folder, "p1/mo[r]e {1}*?.txt", FRANCE)
    put(folder, "p1/again.txt", OSMOSIS + FRANCE)
    two = run(spark, base)
    gone = two.read("documents").filter("filename = 'again.txt'").select("document_id")
    last, counts, documents = two.store.delete(two, "documents", gone)
    return base, one, two, last, counts, documents


def branch(spark, snapshot, tmp_path):
    """The same version in a store of its own."""
    shutil.copytree(snapshot.store.root, tmp_path / "copy")
    store = Store(spark, str(tmp_path / "copy"))
    for version in store.versions():
        if version > snapshot.version:
            for path in (tmp_path / "copy" / "versions").glob(f"*{version:012d}*"):
                path.unlink()
    return store.snapshot()


def test_files_become_chunks_and_failures_stay_apart(spark, taken):
    base, one, two, _, _, _ = taken
    docs = {r.filename: r for r in one.read("documents").collect()}
    assert docs["notes.txt"].status == "READY" and docs["notes.txt"].project_id == "p1"
    assert {n for n, r in docs.items() if r.status == "FAILED"} == {"blank.md", "slides.pdf", "tool.exe"}
    assert "extractor" in docs["slides.pdf"].error_message
    chunks = one.read("chunks")
    assert chunks.select("document_id").distinct().count() == 2 and chunks.count() > 4
    later = two.read("documents")
    assert later.count() == 7 and later.select("document_id").distinct().count() == 7
    assert one.read("documents").count() == 5  # a reader keeps its version
    assert stored(spark, str(base / "store"), "documents").count() == 6


def test_documents_go_through_their_states(taken):
    _, _, two, last, _, _ = taken
    log = two.read("document_status").collect()
    for document in {r.document_id for r in log}:
        own = sorted((r.at, I.STATES.index(r.status)) for r in log if r.document_id == document)
        assert [s for _, s in own][:2] == [0, 1] and len(own) == 3 and own[2][1] in (2, 3)
    by_id = {r.document_id: r.status for r in two.read("documents").collect()}
    assert {r.document_id: r.status for r in settled(two.read("document_status")).collect()} == by_id
    assert last.read("document_status").select("document_id").distinct().count() == 6


def test_between_the_commits_documents_are_processing(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "p1/a.txt", OSMOSIS)

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(I, "index_rows", crash)
    query = ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck"), 30, 6)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    half = Store(spark, str(tmp_path / "store")).snapshot()
    assert half.tables() == ["document_status"] and [r.status for r in settled(half.read("document_status")).collect()] == ["PROCESSING"]
    monkeypatch.undo()
    whole = run(spark, tmp_path)  # the stream replays the batch
    assert [r.status for r in settled(whole.read("document_status")).collect()] == ["READY"]
    assert whole.read("documents").count() == 1 and whole.marks[I.BATCH] == 0
    batch = io.read_uploads(spark, str(tmp_path / "in"))
    I.publish(batch, 0, whole.store, 30, 6)  # and once more: nothing is repeated
    assert whole.store.snapshot().version == whole.version


QUESTIONS = [("q1", "Who was crowned emperor in Paris?", "p1"), ("q2", "water through a membrane", "p1"), ("q3", "energy of light", "p2"), ("q4", "the of and", "p1"), ("q5", "nothing anyone wrote down", "p2")]


@pytest.mark.parametrize("one_project", [True, False])
@pytest.mark.parametrize("embeddings", [True, False])
def test_stored_search_equals_a_rebuild_after_two_batches_and_a_delete(spark, taken, one_project, embeddings):
    last = taken[3]
    queries = spark.createDataFrame(QUESTIONS, "query_id string, content string, project_id string")
    queries = queries if one_project else queries.drop("project_id")
    want = retrieval.hybrid_search(queries, last.read("chunks"), 4, True)
    if not embeddings:
        want = retrieval.hybrid_search(queries, last.read("chunks"), 4, False)
        postings, statistics = index.bm25.build_index(last.read("chunks"), index.bm25.english_terms)
        want = index.bm25.search(queries, postings, statistics, 4, index.bm25.english_terms)
    got = index.search_stored(last, queries, 4, embeddings=embeddings)
    columns = ["query_id", "project_id", "chunk_id", "score", "rank"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect())) and got.count() > 3
    owners = {r.chunk_id: r.document_id for r in last.read("chunks").collect()}
    assert all(owners[r.chunk_id] == r.document_id for r in got.collect())


def test_a_question_opens_only_its_folders(spark, taken):
    last = taken[3]
    queries = spark.createDataFrame([("q1", "emperor", "p1")], "query_id string, content string, project_id string")
    hits = index.search_stored(last, queries, 2)
    found = index.stored_hits(last, hits)
    assert found.count() == 2 and all("Napoleon" in r.content for r in found.collect())
    every = set(last.read("chunks").inputFiles())
    assert set(found.inputFiles()) & every < every
    term = index._keyed(last, "postings", spark.createDataFrame([("emperor",)], "term string"), "term", ["p1"])
    assert {r.term for r in term.collect()} <= {"emperor"} and len(term.inputFiles()) < len(last.read("postings").inputFiles()) / 4


def test_ask_over_the_store_equals_ask_over_the_chunks(spark, taken, tmp_path):
    last = branch(spark, taken[3], tmp_path)
    sessions = spark.createDataFrame([("s1", "p1", "x"), ("s2", "p2", "y")], "session_id string, project_id string, title string")
    now = last.store.commit(last, {"chat_sessions": sessions})
    asked = spark.createDataFrame([("r1", "s1", "Who was crowned emperor of the French?"), ("r2", "s2", "What stores the energy of light?"), ("r3", "s2", "qqq zzz"), ("r4", "nobody", "water"), ("r5", "s1", " ")], "request_id string, session_id string, question string").withColumn("created_at", F.lit("2024-05-01 10:00:00").cast("timestamp"))
    messages, citations = index.ask_stored(now, asked)
    want_messages, want_citations = services.ask(asked, sessions, now.read("chunks"), now.read("documents"))
    assert sorted(map(repr, messages.collect())) == sorted(map(repr, want_messages.collect()))
    assert sorted(map(repr, citations.collect())) == sorted(map(repr, want_citations.collect()))
    said = {r.message_id: r for r in messages.filter("role = 'ASSISTANT'").collect()}
    assert len(said) == 3 and sum(services.NO_HITS == r.content for r in said.values()) == 1 and citations.count() >= 2


def test_delete_reaches_every_table_and_the_upload(taken):
    base, _, two, last, counts, documents = taken
    gone = {r.document_id for r in documents.collect()}
    assert len(gone) == 1 and counts["documents"] == 1 and counts["chunks"] == two.read("chunks").join(documents.select("document_id"), "document_id").count()
    for name in ("documents", "chunks", "postings", "features", "document_status"):
        own = {r.document_id for r in last.read(name).select("document_id").distinct().collect()}
        assert not own & gone and own == {r.document_id for r in two.read(name).select("document_id").distinct().collect()} - gone
    assert last.read("chunk_embeddings").count() == last.read("chunks").count() == two.read("chunks").count() - counts["chunks"]
    for name in ("documents", "chunks", "postings"):
        before, after = set(two.read(name).inputFiles()), set(last.read(name).inputFiles())
        assert before & after  # folders of other documents keep their files
    path = base / "in" / "p1" / "again.txt"
    assert path.exists() and last.store.remove_uploads(documents) == 1 and not path.exists()
    assert last.store.remove_uploads(documents) == 0


def test_only_changed_chunks_are_embedded_again(spark, taken, tmp_path):
    last = branch(spark, taken[3], tmp_path)
    assert embed_stale(last)[1] == 0
    chunks = last.read("chunks")
    one = chunks.orderBy("chunk_id").limit(1)
    changed = last.store.upsert(last, "chunks", one.withColumn("content", F.lit("Something else is said here now.")), "chunk_id")
    files = set(changed.read("chunk_embeddings").inputFiles())
    now, n = embed_stale(changed)
    assert n == 1 and len(files - set(now.read("chunk_embeddings").inputFiles())) == 1
    old, new = ({r.chunk_id: r.vector for r in s.read("chunk_embeddings").collect()} for s in (last, now))
    key = one.first().chunk_id
    assert set(old) == set(new) and old[key] != new[key] and all(old[k] == new[k] for k in old if k != key)
    assert embed_stale(now)[1] == 0
    other, n = embed_stale(now, model="second")
    assert n == len(new) and other.read("chunk_embeddings").count() == n and {r.model for r in other.read("chunk_embeddings").select("model").distinct().collect()} == {"second"}
    assert other.read("chunk_embeddings").filter(F.size("vector") != DIMENSIONS).count() == 0


def test_stale_projects_are_indexed_anew(spark, taken, tmp_path):
    two = branch(spark, taken[2], tmp_path)
    chunks = two.read("chunks")
    plain = index.index_rows(chunks, index.bm25.plain_terms, "plain-v1")
    now = two.store.commit(two, {"postings": plain["postings"].filter("project_id = 'p2'")})
    assert index.rebuild_stale(now).version == now.version  # all are of this analyzer
    other = index.rebuild_stale(now, index.bm25.plain_terms, "plain-v2")
    assert {r.analyzer_version for r in index.statistics(other).collect()} == {"plain-v2"}
    assert {r.analyzer_version for r in other.read("postings").select("analyzer_version").distinct().collect()} == {"plain-v2"}
    assert sorted(map(repr, other.read("postings").drop("analyzer_version").collect())) == sorted(map(repr, plain["postings"].drop("analyzer_version").collect()))


def test_a_project_goes_with_all_that_hangs_from_it(spark, tmp_path):
    store = Store(spark, str(tmp_path), slices=2)
    graph = {
        "projects": [("project_id",), [("a",), ("b",)]],
        "documents": [("document_id", "project_id", "stored_path"), [("d1", "a", "/none/x"), ("d2", "b", None)]],
        "chunks": [("chunk_id", "document_id", "project_id"), [("c1", "d1", "a"), ("c2", "d1", "a"), ("c3", "d2", "b")]],
        "chunk_embeddings": [("chunk_id", "project_id"), [("c1", "a"), ("c3", "b")]],
        "postings": [("chunk_id", "document_id", "project_id", "term", "tf"), [("c1", "d1", "a", "x", 2), ("c3", "d2", "b", "x", 1)]],
        "features": [("chunk_id", "project_id", "dim"), [("c1", "a", 3), ("c3", "b", 3)]],
        "index_statistics": [("project_id", "n", "words", "analyzer_version"), [("a", 2, 2, "v"), ("b", 1, 1, "v")]],
        "document_status": [("document_id", "project_id", "status"), [("d1", "a", "READY"), ("d2", "b", "READY")]],
        "chat_sessions": [("session_id", "project_id"), [("s1", "a"), ("s2", "b")]],
        "chat_messages": [("message_id", "session_id"), [("m1", "s1"), ("m2", "s2")]],
        "message_citations": [("citation_id", "message_id", "document_id"), [("i1", "m1", "d1"), ("i2", "m2", "d1")]],
        "quizzes": [("quiz_id", "project_id"), [("z1", "a"), ("z2", "b")]],
        "quiz_questions": [("question_id", "quiz_id"), [("u1", "z1"), ("u2", "z2")]],
        "summaries": [("summary_id", "project_id"), [("y1", "a"), ("y2", "b")]],
        "summary_citations": [("citation_id", "summary_id", "document_id"), [("j1", "y1", "d1"), ("j2", "y2", "d1")]],
    }
    first = store.commit(store.snapshot(), {name: spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c in ('n', 'words', 'tf', 'dim') else 'string'}" for c in columns)) for name, (columns, rows) in graph.items()})
    last, counts, documents = store.delete(first, "projects", spark.createDataFrame([("a",)], "project_id string"), ["a"])
    assert counts == {n: (2 if n == "chunks" else 1) for n in graph if n != "index_statistics"}
    for name, (_, rows) in graph.items():
        if name != "index_statistics":
            assert sorted(map(tuple, last.read(name).collect())) == sorted(rows[1:] if name != "chunks" else rows[2:])
            assert len(first.read(name).collect()) == len(rows)
    assert [(r.project_id, r.n) for r in index.statistics(last).collect()] == [("b", 1)]
    assert [r.stored_path for r in documents.collect()] == ["/none/x"]
    again, counts, _ = store.delete(last, "projects", spark.createDataFrame([("a",)], "project_id string"))
    assert again.version == last.version and not any(counts.values())
    session, counts, _ = store.delete(last, "chat_sessions", spark.createDataFrame([("s2",)], "session_id string"))
    assert {n: c for n, c in counts.items() if c} == {"chat_sessions": 1, "chat_messages": 1, "message_citations": 1} and session.read("quizzes").count() == 1


def test_a_huge_upload_is_refused_alone(spark, tmp_path):
    put(tmp_path / "in", "p1/a.txt", OSMOSIS)
    huge = tmp_path / "in" / "p1" / "huge.txt"
    huge.touch()
    os.truncate(huge, 3 << 30)  # sparse: longer than the file source's own limit
    docs = {r.filename: r for r in run(spark, tmp_path).read("documents").collect()}
    huge.unlink()
    assert docs["a.txt"].status == "READY" and docs["huge.txt"].status == "FAILED" and "40 MB" in docs["huge.txt"].error_message


def test_upload_rules(spark):
    rows = spark.createDataFrame([("a/b.TXT", 5), ("a/b.txt", 0), ("a/b.pdf", 41 << 20), ("a/b.exe", 5)], "path string, length long")
    got = [r.r for r in rows.select(io.rejection(F.col("path"), F.col("length")).alias("r")).collect()]
    assert got[0] is None and "empty" in got[1] and "40 MB" in got[2] and "Only" in got[3]


def test_unknown_types_are_named():
    with pytest.raises(LookupError, match="application/pdf"):
        io.extractor("application/pdf")


def test_cascade_names_every_table():
    assert {c for c, *_ in catalog.CASCADE} >= {"features", "document_status", "postings"}
