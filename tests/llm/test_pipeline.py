import collections
import re

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "copy_no"]
    rows = out.collect()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    copies = collections.Counter(r.doc_id for r in rows)
    assert copies and set(copies) <= ids and max(copies.values()) <= 3
    assert sorted(r.copy_no for r in rows if copies[r.doc_id] == 2) == [0] * sum(c == 2 for c in copies.values()) + [1] * sum(c == 2 for c in copies.values())
    assert len({r.text for r in rows}) == len({r.doc_id for r in rows})  # no exact copy is left under two ids
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text or "") for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows if "[EMAIL]" in (r.text or ""))
