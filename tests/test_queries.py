import duckdb
import pytest

import __spark_entry__ as entry
from scholia.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*columns).collect())
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert got == sorted(repr(tuple(plain(x) for x in r)) for r in want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"extractive_answers", "hybrid_topk"}))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_registry_is_whole():
    assert set(entry.oracle_sql()) <= set(entry.queries())
