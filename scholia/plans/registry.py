"""Every query of the engine by name, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from scholia.plans import queries as Q
from scholia.plans.oracles import ORACLES as ORACLES

_NAMES = """
chunk_fixed_windows chunk_counts tokenize_counts content_terms identity_dedup ready_chunks chunks_missing_vectors
docs_newest_first session_messages_nested latest_sessions upsert_latest bm25_topk_plain bm25_topk_english
centroid_by_label cosine_topk hash_embed_sparse vector_codec_roundtrip rrf_fusion hybrid_topk content_filter_flags
filter_with_fallback even_stride_sample sentence_corpus extractive_answers mmr_summary term_df term_salience
cloze_candidates cloze_quiz distractors lexical_grade term_overlap timestamp_normalise json_list_roundtrip
cascade_delete_counts foreign_document_ids filename_rules vector_counts vector_backfill postings_after_delete
documents_by_ids summary_citations stale_rebuild message_citations chunks_of_documents deleted_chunk_counts
joined_names request_defaults upload_rules error_messages vectors_of_project graded_question stored_summaries search_stored stored_delete_counts
""".split()

QUERIES = {name: getattr(Q, name) for name in _NAMES}
