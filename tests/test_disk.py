"""What is stored, deleted and searched keeps little beside the store itself on disk."""

import os

import pytest
from pyspark.sql import functions as F

from scholia.operators import bm25, index
from scholia.operators.chunking import chunk_pages, number_chunks, numbered_chunks
from scholia.session import Scratch
from scholia.sources.store import Store, grouped

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def table(spark, n=48):
    rows = [(None if i % 6 == 5 else f"p{i % 6}", f"d{i // 6 * 6 + i % 6}", f"c{i:02d}", " ".join(WORDS[(i * j + j) % len(WORDS)] for j in range(i % 13))) for i in range(n)]
    return spark.createDataFrame(rows, "project_id string, document_id string, chunk_id string, content string")


@pytest.fixture()
def store(spark, tmp_path):
    chunks = table(spark)
    store = Store(spark, str(tmp_path), slices=2)
    documents = chunks.select("project_id", "document_id").distinct()
    rows = {"documents": documents, **index.rows_from_stored(chunks, bm25.plain_terms, "plain-v1")}
    return store, store.commit(store.snapshot(), rows, lying=("postings",)), chunks


def test_chunks_of_one_page_meet_no_shuffle(spark):
    text = " ".join(f"w{i}" for i in range(70)) + "\n\n" + " ".join(f"v{i}" for i in range(40))
    rows = [(1, "a", None, text), (2, "a", 2, text[:90]), (2, "a", 1, text), (2, "a", None, text[:150]), (3, "b", 7, text[:200]), (4, "b", 1, ""), (None, "b", 1, text), (None, "b", 2, text), (5, None, None, None)]
    pages = spark.createDataFrame(rows, "document_id long, project_id string, page int, text string")
    for own in (pages, pages.filter("document_id <> 2")):
        assert same(numbered_chunks(own, 30, 6), number_chunks(chunk_pages(own, 30, 6)))
        assert numbered_chunks(own, 30, 6).schema.names == number_chunks(chunk_pages(own, 30, 6)).schema.names
    plan = numbered_chunks(pages.filter("document_id <> 2"), 30, 6)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_an_index_is_made_from_what_is_stored(store, monkeypatch):
    own, snapshot, chunks = store
    want = index.index_rows(chunks, bm25.plain_terms, "plain-v1", embeddings=False)
    for name in ("postings", "index_statistics"):
        assert same(snapshot.read(name), want[name]) and snapshot.read(name).dtypes == want[name].dtypes
    monkeypatch.setattr(Scratch, "write", lambda *_: pytest.fail("a table was written twice"))
    again = own.commit(snapshot, index.rows_from_stored(chunks, bm25.plain_terms, "plain-v1"), lying=("postings",))
    assert again.read("postings").count() == 2 * want["postings"].count()


def test_a_delete_in_parts_keeps_one_part_twice(spark, store, monkeypatch):
    own, snapshot, chunks = store
    doomed = chunks.filter("chunk_id < 'c06' OR chunk_id = 'c40'").select("document_id").distinct()
    want = {name: snapshot.read(name).join(doomed, "document_id", "left_anti").select(*snapshot.read(name).columns).collect() for name in ("documents", "chunks", "postings")}
    counts = {name: snapshot.read(name).count() - len(rows) for name, rows in want.items()}
    left = chunks.join(doomed, "document_id", "left_anti").localCheckpoint()

    def weight():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(f"{own.root}/data") for f in names if f.endswith(".parquet"))

    seen, publish, whole = [], own._publish, weight()

    def published(*args):
        seen.append(weight())
        return publish(*args)

    monkeypatch.setattr(own, "_publish", published)
    after, gone, documents = own.delete_in_parts(snapshot, "documents", doomed)
    assert {n: gone[n] for n in counts} == counts and documents.count() == counts["documents"] == doomed.count()
    assert all(sorted(map(repr, after.read(n).collect())) == sorted(map(repr, rows)) for n, rows in want.items())
    sums = index.index_rows(left, bm25.plain_terms, "plain-v1", embeddings=False)["index_statistics"].filter("project_id IS NOT NULL").select("project_id", "n")
    assert sorted(map(tuple, index.statistics(after).filter("project_id IS NOT NULL").select("project_id", "n").collect())) == sorted(map(tuple, sums.collect()))
    assert len(seen) > 2 and max(seen) < 1.6 * whole and weight() < 1.2 * whole
    assert own.versions() == [after.version] and own.vacuum() == []
    again, gone, _ = own.delete_in_parts(after, "documents", doomed)
    assert again.version == after.version and not any(gone.values())


def test_a_search_shuffles_one_part_at_a_time(spark, store, monkeypatch):
    own, snapshot, chunks = store
    parts, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: (parts.append(name), write(self, df, name))[1])
    queries = spark.createDataFrame([(1, "alpha alpha kappa"), (2, "zeta unheard")], "query_id int, content string")
    columns = ["query_id", "project_id", "chunk_id", "score", "rank"]
    got = index.search_stored(snapshot, queries, 5, bm25.plain_terms, embeddings=False).select(*columns)
    assert len([p for p in parts if p.startswith("part-")]) > 2
    assert same(got, bm25.search_chunks(queries, chunks, 5, bm25.plain_terms)) and got.count() > 10


def test_groups_are_no_larger_than_the_largest():
    sizes = {"a": 50, "b": 9, "c": 30, "d": 21, "e": 40, None: 1}
    groups = grouped(sizes)
    assert sorted(map(str, (k for g in groups for k in g))) == sorted(map(str, sizes)) and max(sum(sizes[k] for k in g) for g in groups) == 50
    assert len(grouped({i: 1 for i in range(800)})) == 8
