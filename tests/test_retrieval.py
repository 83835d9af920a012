import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.operators import answers, bm25, catalog, quiz, retrieval, vectors

CHUNKS = [
    ("a", "c1", "Mitochondria release energy for the cell by breaking down sugar."),
    ("a", "c2", "The French Revolution began in the year 1789 in Paris."),
    ("a", "c3", "Cells producing energy need oxygen and sugar."),
    ("b", "c4", "Mitochondria release energy for the cell by breaking down sugar."),
]


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "project_id string, chunk_id string, content string")


def search(spark, chunks, text, terms=bm25.english_terms, k=3):
    postings, statistics = bm25.build_index(chunks, terms)
    asked = spark.createDataFrame([(1, text)], "query_id int, content string")
    return bm25.search(asked, postings, statistics, k, terms).orderBy("project_id", "rank").collect()


def test_projects_stay_apart(spark, chunks):
    hits = search(spark, chunks, "mitochondria energy")
    assert [h.chunk_id for h in hits if h.project_id == "b"] == ["c4"]
    assert "c2" not in [h.chunk_id for h in hits]


def test_stemming_and_stop_words(spark, chunks):
    assert {h.chunk_id for h in search(spark, chunks, "which cell produces the energy") if h.project_id == "a"} == {"c1", "c3"}


def test_scores_follow_the_formula(spark, chunks):
    own = chunks.filter("project_id = 'b'")
    hit = search(spark, own, "energy", bm25.plain_terms)[0]
    assert hit.score == pytest.approx(math.log(1 + 0.5 / 1.5) * 1 / (1 + 1.2), abs=1e-8)


def test_blank_query_finds_nothing(spark, chunks):
    assert search(spark, chunks, "  ") == []


def test_fusion_uses_ranks_only(spark):
    one = spark.createDataFrame([("q", "x", 900.0, 1), ("q", "y", 800.0, 2)], "q string, chunk_id string, score double, rank int")
    two = spark.createDataFrame([("q", "y", 0.9, 1), ("q", "z", 0.8, 2)], "q string, chunk_id string, score double, rank int")
    fused = retrieval.fuse([one, two], 3, ["q"]).orderBy("rank").collect()
    assert [f.chunk_id for f in fused] == ["y", "x", "z"]
    assert fused[0].score == pytest.approx(1 / 62 + 1 / 61)


def test_hashing_embedding_matches_the_dense_form(spark):
    texts = ["Photosynthesis stores light energy in sugar", "light energy", "the of and", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sparse = vectors.hashed_features(rows).collect()
    for i, text in enumerate(texts):
        dense = np.zeros(1024)
        for r in sparse:
            if r.id == i:
                dense[r.dim] = r.weight
        assert np.allclose(dense, vectors.hash_embed(text))
    assert np.linalg.norm(vectors.hash_embed(texts[0])) == pytest.approx(1)
    assert vectors.hash_embed(texts[0]) @ vectors.hash_embed(texts[1]) > 0.08


def test_codec_and_dot(spark):
    rows = spark.createDataFrame([([1.0, 2.5], [2.0, 2.0]), (None, None)], "a array<float>, b array<float>")
    got = rows.select(vectors.from_bytes(vectors.to_bytes("a")).alias("a"), vectors.dot(F.col("a"), F.col("b")).alias("d")).collect()
    assert got[0].a == [1.0, 2.5] and got[0].d == 7.0 and got[1].a is None


def test_missing_weights_are_named():
    with pytest.raises(LookupError, match="weights"):
        vectors.embedder("local")


def _sources(spark, *texts):
    rows = [("r", i, f"c{i}", f"d{i}", f"f{i}.txt", None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "request_id string, source_order int, chunk_id string, document_id string, filename string, page int, content string")


def test_answers_and_declines(spark):
    sources = _sources(spark, "Mitochondria release energy from sugar in cells. Napoleon was born in Corsica long ago.", "Water moves through membranes by osmosis.")
    asked = spark.createDataFrame([("r", "What releases energy in cells?")], "request_id string, question string")
    got = answers.answers(asked, sources).first()
    assert got.answered and "Mitochondria release energy from sugar in cells. [1]" in got.text
    assert got.citations[0].document_id == "d0" and got.citations[0].citation_order == 0
    other = spark.createDataFrame([("r", "Who won the football championship yesterday?")], "request_id string, question string")
    assert not answers.answers(other, sources).first().answered
    empty = spark.createDataFrame([("s", "Anything?")], "request_id string, question string")
    assert answers.answers(empty, sources).first().text == answers.NOTHING


def test_mmr_is_the_greedy_loop():
    x = np.random.default_rng(3).standard_normal((40, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(axis=0) / np.linalg.norm(x.mean(axis=0))
    picks = []
    for _ in range(6):
        score = {i: 0.7 * x[i] @ mean - 0.3 * max([0.0, *(x[i] @ x[j] for j in picks)]) for i in range(40) if i not in picks}
        picks.append(max(score, key=lambda i: (round(score[i], 9), -i)))
    assert answers.mmr(x, 6) == picks


def test_summary_groups_by_file(spark):
    sources = _sources(spark, "Office hours: Tuesday at noon in the hall. Mitochondria release energy from sugar in cells.", "Water moves through membranes by osmosis.")
    text = answers.summaries(sources).first().text
    assert "## f0.txt" in text and "## f1.txt" in text and "Office hours" not in text


def test_quiz_spans_documents_and_cycles_types(spark):
    body = {
        "bio": ["Mitochondria are the organelles which release usable energy from sugar molecules.", "Photosynthesis stores light energy inside sugar molecules within the green chloroplast.", "Osmosis moves water molecules through a membrane towards the stronger solution."],
        "his": ["Napoleon was crowned emperor of the French people during the winter ceremony.", "Versailles hosted the assembly where the deputies swore their famous tennis oath."],
    }
    rows = [("r", d, 10 * i + j, t) for i, (d, ts) in enumerate(body.items()) for j, t in enumerate(ts)]
    sentences = spark.createDataFrame(rows, "request_id string, document_id string, position long, text string")
    got = quiz.quiz(sentences, 4).orderBy("ordinal").collect()
    assert [g.type for g in got] == ["MULTIPLE_CHOICE", "SHORT_ANSWER", "FLASHCARD", "MULTIPLE_CHOICE"]
    assert {g.document_id for g in got} == {"bio", "his"}
    assert all("_____" in g.prompt and g.answer not in g.prompt for g in got)
    assert all(len(set(g.choices)) == 4 and g.answer in g.choices for g in got if g.type == "MULTIPLE_CHOICE")


def test_cascade_empties_the_graph(spark):
    def table(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    tables = {
        "projects": table("project_id string", ("p",), ("q",)),
        "documents": table("document_id string, project_id string", ("d", "p"), ("e", "q")),
        "chunks": table("chunk_id string, document_id string", ("c", "d"), ("f", "e")),
        "chunk_embeddings": table("chunk_id string", ("c",)),
        "chat_sessions": table("session_id string, project_id string", ("s", "p")),
        "chat_messages": table("message_id string, session_id string", ("m", "s")),
        "message_citations": table("citation_id string, message_id string", ("x", "m")),
        "quizzes": table("quiz_id string, project_id string", ("z", "p")),
        "quiz_questions": table("question_id string, quiz_id string", ("k", "z")),
        "summaries": table("summary_id string, project_id string", ("u", "p")),
        "summary_citations": table("citation_id string, summary_id string", ("y", "u")),
    }
    left = catalog.cascade_delete(tables, "projects", table("project_id string", ("p",)))
    assert {k: v.count() for k, v in left.items()} == {"projects": 1, "documents": 1, "chunks": 1} | dict.fromkeys(list(tables)[3:], 0)


def test_messages_keep_citations_without_documents(spark):
    messages = spark.createDataFrame([("m", "s", 1), ("n", "s", 2)], "message_id string, session_id string, created_at int")
    citations = spark.createDataFrame([("m", 1, "gone", None, "b"), ("m", 0, "d", 3, "a")], "message_id string, citation_order int, document_id string, page int, quoted_text string")
    documents = spark.createDataFrame([("d", "f.txt")], "document_id string, filename string")
    got = catalog.messages_with_citations(messages, citations, documents).collect()
    assert [(c.quoted_text, c.filename) for c in got[0].citations] == [("a", "f.txt"), ("b", None)] and got[1].citations == []


def test_lists_upserts_and_stamps(spark):
    row = spark.createDataFrame([(None, " ", '["a","b"]')], "a string, b string, c string").select(*[catalog.read_list(F.col(c)).alias(c) for c in "abc"]).first()
    assert (row.a, row.b, row.c) == ([], [], ["a", "b"])
    stored = spark.createDataFrame([(1, "old"), (2, "keep")], "k int, v string")
    fresh = spark.createDataFrame([(1, "new")], "k int, v string")
    assert {(r.k, r.v) for r in catalog.upsert(stored, fresh, "k").collect()} == {(1, "new"), (2, "keep")}
    stamps = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("junk",)], "t string")
    assert [r.t for r in catalog.normalised_timestamps(stamps, "t").collect()] == ["2024-01-02T03:04:05.000000000Z", "junk"]
    asked = spark.createDataFrame([(None,), (0,), (7,), (90,)], "n int").select(catalog.question_count(F.col("n")).alias("n")).collect()
    assert [r.n for r in asked] == [5, 5, 7, 20]
