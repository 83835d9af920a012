"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from scholia.plans.registry import QUERIES
from scholia.session import local_session

HEADLINE = "chunk_fixed_windows tokenize_counts content_terms chunks_missing_vectors session_messages_nested cosine_topk rrf_fusion even_stride_sample term_df content_filter_flags lexical_grade cascade_delete_counts bm25_topk_english mmr_summary cloze_quiz".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
