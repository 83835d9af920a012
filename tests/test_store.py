import os

import pytest
from pyspark.sql import functions as F

from scholia.sources import store as S
from scholia.sources.store import Conflict, Store


def rows(spark, n, project=lambda i: f"p{i % 3}", text="t"):
    return spark.createDataFrame([(f"d{i}", project(i), f"{text}{i}") for i in range(n)], "document_id string, project_id string, text string")


def held(snapshot, name="documents"):
    return sorted(tuple(r) for r in snapshot.read(name).select("document_id", "text").collect())


def files(store, name):
    root = f"{store.root}/data/{name}"
    return {os.path.join(at, f): os.path.getmtime(os.path.join(at, f)) for at, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_versions_and_pruned_reads(spark, tmp_path):
    store = Store(spark, str(tmp_path), slices=4)
    assert store.snapshot().version == 0 and store.snapshot().tables() == []
    odd = lambda i: [None, "a/b=c %41", "12", ""][i % 4]
    one = store.commit(store.snapshot(), {"documents": rows(spark, 40, odd)}, marks={"batch": 3})
    two = store.commit(one, {"documents": rows(spark, 5, odd, "u"), "chunks": rows(spark, 3)})
    assert (one.version, two.version, two.marks) == (1, 2, {"batch": 3})
    assert len(held(one)) == 40 and len(held(two)) == 45 and len(held(store.snapshot(1))) == 40
    for project in (None, "a/b=c %41", "12", ""):
        got = two.read("documents", [project])
        assert {r.project_id for r in got.collect()} == {project}
        assert set(got.inputFiles()) < set(two.read("documents").inputFiles())
    own = two.rows("documents", slices=[1]).withColumn("want", S.slice_of(F.col("document_id"), 4))
    assert own.filter("want <> 1").count() == 0 and own.count() > 0
    assert two.read("documents", ["nobody"]).count() == 0
    assert dict(two.read("documents").dtypes) == dict(rows(spark, 1).dtypes)


def test_more_folders_than_paths(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), slices=4)
    one = store.commit(store.snapshot(), {"documents": rows(spark, 40)})
    two, _, _ = store.delete(one, "documents", spark.createDataFrame([("d3",)], "document_id string"))
    want = held(two)
    monkeypatch.setattr(S, "MOST_PATHS", 2)
    assert held(two) == want and len(want) == 39


@pytest.mark.parametrize("step", ["first table", "last table", "manifest", "pointer"])
def test_a_crash_between_any_two_writes_is_invisible(spark, tmp_path, monkeypatch, step):
    store = Store(spark, str(tmp_path), slices=2)
    one = store.commit(store.snapshot(), {"documents": rows(spark, 10), "chunks": rows(spark, 4)}, marks={"batch": 1})
    before = held(one), held(one, "chunks")

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    whole = store._write

    def write(name, *rest):
        if step == "first table" or (step == "last table" and name == "chunks"):
            raise Crash
        return whole(name, *rest)

    monkeypatch.setattr(store, "_write", write)
    if step == "manifest":
        monkeypatch.setattr(store, "_write_manifest", crash)
    if step == "pointer":
        monkeypatch.setattr(store, "_publish", crash)
    with pytest.raises(Crash):
        store.commit(one, {"documents": rows(spark, 3, text="u"), "chunks": rows(spark, 2, text="u")}, marks={"batch": 2})
    fresh = Store(spark, str(tmp_path), slices=2)
    seen = fresh.snapshot()
    assert (seen.version, seen.marks, (held(seen), held(seen, "chunks"))) == (1, {"batch": 1}, before)
    again = fresh.commit(seen, {"documents": rows(spark, 3, text="u"), "chunks": rows(spark, 2, text="u")}, marks={"batch": 2})
    assert len(held(again)) == 13 and len(held(again, "chunks")) == 6 and again.marks == {"batch": 2}
    left = fresh.vacuum()
    assert bool(left) == (step != "first table") and len(held(fresh.snapshot())) == 13


def test_one_of_two_writers_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path), slices=2)
    base = store.snapshot()
    store.commit(base, {"documents": rows(spark, 2)})
    with pytest.raises(Conflict):
        store.commit(base, {"documents": rows(spark, 5)})
    assert len(held(store.snapshot())) == 2


def test_upserts_leave_untouched_files(spark, tmp_path):
    store = Store(spark, str(tmp_path), slices=8)
    one = store.commit(store.snapshot(), {"documents": rows(spark, 60)})
    before = files(store, "documents")
    two = store.upsert(one, "documents", spark.createDataFrame([("d1", "p1", "new"), ("d99", "p9", "more")], "document_id string, project_id string, text string"), "document_id")
    got = dict(held(two))
    assert len(got) == 61 and got["d1"] == "new" and got["d99"] == "more" and got["d2"] == "t2"
    after = {x.removeprefix("file://").removeprefix("file:") for x in two.read("documents").inputFiles()}
    kept = set(before) & after
    assert len(kept) == len(before) - 1 and all(os.path.getmtime(f) == before[f] for f in kept)


def test_compaction_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path), slices=2)
    now = store.snapshot()
    for i in range(4):
        now = store.commit(now, {"documents": rows(spark, 6, text=f"b{i}-")})
    small = store.compact(now, "documents")
    assert held(small) == held(now) and small.entries.count() < now.entries.count()
    assert small.entries.groupBy("p_project", "p_slice").count().filter("count > 1").count() == 0
    assert store.compact(small, "documents").version == small.version
    assert len(store.vacuum()) == 4 and held(store.snapshot()) == held(small)
    assert store.versions() == [small.version]
