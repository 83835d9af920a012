"""A folder of the index names a chunk once, and what a delete leaves goes back without a shuffle."""

import pytest
from pyspark.sql import functions as F

from scholia.operators import bm25, index
from scholia.sources.store import LIST, Store

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """(chunks, store before, store after the documents d3 and d4 were deleted, rows deleted by table)."""
    rows = [(f"p{i % 2}", f"d{i // 4}", f"c{i:02d}", " ".join(WORDS[(i * j + j) % len(WORDS)] for j in range(i % 13))) for i in range(40)]
    chunks = spark.createDataFrame(rows, "project_id string, document_id string, chunk_id string, content string")
    documents = chunks.select("document_id").distinct()
    store = Store(spark, str(tmp_path_factory.mktemp("lists")), slices=4)
    own = index.index_rows(chunks, bm25.plain_terms, "plain-v1", True, True)
    before = store.commit(store.snapshot(), {"documents": documents, "chunks": chunks, **own}, lying=("chunks", "postings"))
    after, gone, _ = store.delete(before, "documents", documents.filter("document_id IN ('d3', 'd4')"))
    return chunks, before, after, gone


def test_a_folder_names_a_chunk_once(kept):
    chunks, before, after, gone = kept
    want = index.index_rows(chunks, bm25.plain_terms, "plain-v1")
    for snapshot, here in ((before, F.lit(True)), (after, ~F.col("document_id").isin("d3", "d4"))):
        for name in ("postings", "features"):
            own, rows = snapshot.read(name), want[name].filter(here)
            assert own.columns == rows.columns and own.exceptAll(rows).count() == 0 and rows.exceptAll(own).count() == 0
            lists = snapshot.lists(name)
            assert lists.count() == lists.select("chunk_id", "p_project", "p_slice").distinct().count() < own.count()
            assert lists.agg(F.sum(F.size(LIST))).first()[0] == own.count() == snapshot.entries.filter(F.col("name") == name).agg(F.sum("n")).first()[0]
    assert gone["postings"] == want["postings"].filter("document_id IN ('d3', 'd4')").count()


def test_rows_that_stay_meet_no_shuffle(kept, monkeypatch):
    _, _, after, _ = kept
    store, plans, write = after.store, {}, after.store._write

    def seen(name, rows, *rest):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString()
        return write(name, rows, *rest)

    monkeypatch.setattr(store, "_write", seen)
    store.delete(after, "documents", after.read("documents").filter("document_id = 'd5'"))
    for name in ("chunks", "postings", "features"):
        assert "SortMergeJoin" not in plans[name] and "REBALANCE" not in plans[name].upper() and plans[name].count("BroadcastHashJoin") == 2


def test_stored_search_equals_a_search_over_the_chunks(spark, kept):
    chunks, _, after, _ = kept
    queries = spark.createDataFrame([(1, "alpha alpha kappa"), (2, "zeta unheard"), (3, "unheard"), (4, "")], "query_id int, content string")
    columns = ["query_id", "project_id", "chunk_id", "score", "rank"]
    want = bm25.search_chunks(queries, chunks.filter("document_id NOT IN ('d3', 'd4')"), 5, bm25.plain_terms).select(*columns)
    got = index.search_stored(after, queries, 5, bm25.plain_terms, embeddings=False)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.collect())) and got.count() > 10
    assert index.search_stored(after, queries.filter("query_id > 2"), 5, bm25.plain_terms, embeddings=False).count() == 0
