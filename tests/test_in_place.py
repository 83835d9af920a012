"""What is counted, hashed and scored where a row lies equals what joins and groups over rows give."""

import pytest
from pyspark.sql import functions as F

from scholia.operators import best, bm25, catalog, retrieval, vectors

WORDS = "alpha Beta gamma's the of running runs ran élan 𝒳y naïve cell cells energy".split()


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(None if i % 17 == 0 else f"p{i % 3}", f"c{i:03d}", " ".join(WORDS[(i * j + j) % len(WORDS)] for j in range(i % 23)) if i % 19 else None) for i in range(200)]
    return spark.createDataFrame(rows, "project_id string, chunk_id string, content string").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "alpha energy energy"), (2, "running cells"), (3, ""), (4, "unheard"), (5, "𝒳y beta of")], "query_id int, content string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("terms", [bm25.plain_terms, bm25.english_terms])
def test_chunks_are_searched_as_postings_are(chunks, queries, terms, monkeypatch):
    monkeypatch.setattr(best, "BLOCK", 30)
    monkeypatch.setattr(best, "HELD", 20)
    for asked in (queries, queries.withColumn("project_id", F.concat(F.lit("p"), (F.col("query_id") % 2).cast("string")))):
        got = bm25.search_chunks(asked, chunks, 4, terms).orderBy("query_id", "project_id", "rank").select("query_id", "project_id", "chunk_id", "score", "rank").collect()
        want = bm25.search(asked, *bm25.build_index(chunks, terms), 4, terms).orderBy("query_id", "project_id", "rank").select("query_id", "project_id", "chunk_id", "score", "rank").collect()
        assert got and got == want
    monkeypatch.setattr(bm25, "DENSE", 1)
    assert bm25.search_chunks(queries, chunks, 4, terms).count() == bm25.search(queries, *bm25.build_index(chunks, terms), 4, terms).count()


def test_terms_are_counted_without_a_shuffle(chunks):
    counted = bm25.counted_terms(bm25.plain_terms(chunks, "chunk_id"), "chunk_id")
    rows = bm25.postings_of(counted, "chunk_id")
    assert plan(rows).count("Exchange") == plan(chunks).count("Exchange")
    want = chunks.select("chunk_id", F.explode(bm25.tokenize(F.col("content"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    assert rows.select("chunk_id", "term", "tf").exceptAll(want).count() == 0 and want.exceptAll(rows.select("chunk_id", "term", "tf")).count() == 0


def test_an_index_keeps_chunks_without_project(chunks):
    postings, statistics = bm25.build_index(chunks)
    assert postings.filter("project_id IS NULL").count() > 0 and statistics.filter("project_id IS NULL").count() == 1


def test_listed_features_equal_rows(chunks, queries):
    lists = vectors.feature_lists(chunks, "chunk_id", "content")
    assert plan(lists).count("Exchange") == plan(chunks).count("Exchange") and lists.count() == 200
    got, want = lists.select("chunk_id", F.inline("features")), vectors.hashed_features(chunks, "chunk_id", "content")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    near = retrieval.hashed_topk(queries, chunks, 4).orderBy("query_id", "project_id", "rank").collect()
    rows = retrieval.features_topk(retrieval.query_features(queries), retrieval.feature_rows(chunks, "project_id", "chunk_id"), 4, True).filter("project_id IS NOT NULL")
    assert near == rows.select(*near[0].asDict()).orderBy("query_id", "project_id", "rank").collect()


def test_dense_vectors_of_lists_equal_those_of_rows(chunks):
    def rows(*args):
        return vectors.hashed_features(*args)

    lists = catalog.dense_vectors(chunks, vectors.hashed_features, "m", 1024)
    assert plan(lists).count("Exchange") == plan(chunks).count("Exchange")
    assert sorted(lists.select("chunk_id", "vector").collect()) == sorted(catalog.dense_vectors(chunks, rows, "m", 1024).select("chunk_id", "vector").collect())
