"""DuckDB SQL for the queries that SQL can express exactly."""

from __future__ import annotations

from scholia.functions import lexicons as L


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
TERMS = rf"list_distinct(list_filter({TOKENS}, lambda t: length(t) > 2 AND NOT list_contains({_list(L.STOPWORDS)}, t)))"

CHUNKS = r"""
paged AS (
  SELECT doc_id, source, text, regexp_extract_all(text, '\S+') AS words, regexp_split_to_array(text, '\S+') AS gaps
  FROM documents WHERE text IS NOT NULL
), measured AS (
  SELECT doc_id, source, text, gaps, len(words) AS n, [length(gaps[i]) + length(words[i]) FOR i IN range(1, len(words) + 1)] AS reach
  FROM paged WHERE len(words) > 0
), windowed AS (
  SELECT *, unnest(range(0, CAST(greatest(0, ceil((n - 180) / 150.0)) AS BIGINT) + 1)) AS ordinal FROM measured
), placed AS (
  SELECT *, ordinal * 150 AS s, least(n, ordinal * 150 + 180) AS e FROM windowed
), chunks AS (
  SELECT doc_id, source, ordinal, CAST(e - s AS INT) AS n_words,
    CAST(coalesce(list_sum(reach[1:s]), 0) + length(gaps[s + 1]) AS INT) AS char_start, CAST(list_sum(reach[1:e]) AS INT) AS char_end, text,
    sha256(CAST(doc_id AS VARCHAR) || '|' || CAST(ordinal AS VARCHAR)) AS chunk_id
  FROM placed
)"""

STATUS = "CASE WHEN l.quality = 1 THEN 'READY' WHEN l.quality = 0 THEN 'FAILED' ELSE 'PROCESSING' END"

LINES = r"""
lines AS (
  SELECT doc_id, source, idx - 1 AS line, raw[idx] AS text
  FROM (SELECT doc_id, source, raw, unnest(range(1, len(raw) + 1)) AS idx FROM (SELECT doc_id, source, string_split(text, chr(10)) AS raw FROM documents))
  WHERE trim(raw[idx], ' ') <> ''
)"""

_FLAGS = {
    "front_matter": rf"(?i)^\s*({'|'.join(L.FRONT_MATTER_LABELS)})\s*[:\-–—]",
    "contact": f"(?i){L.CONTACT}",
    "administrative": rf"(?i)\b({'|'.join(L.ADMINISTRATION)})\b",
    "course_talk": "(?i)" + "|".join(rf"\b({p})\b" for p in L.COURSE_TALK),
    "personal": rf"^\s*I\b|\bI ({L.PERSONAL_VERBS})\b",
    "course_code": rf"\b{L.COURSE_CODE}\b",
}
_NUMBERS = r"""(regexp_matches(lower(t), '\b\d{1,2}[:.]\d{2}\b') OR regexp_matches(lower(t), '\b\d{1,2}\s*(am|pm)\b')
  OR (length(regexp_replace(t, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(t, '[^\p{Nd}]', '', 'g')) > length(regexp_replace(t, '[^\p{L}]', '', 'g')) // 2))"""
FLAGGED = f"""
flagged AS (
  SELECT doc_id, {', '.join(f"CAST(regexp_matches(t, {_quoted(p)}) AS INT) AS {n}" for n, p in _FLAGS.items())}, CAST({_NUMBERS} AS INT) AS numbers
  FROM (SELECT doc_id, trim(text, ' ') AS t FROM lines)
), tested AS (
  SELECT *, CASE WHEN {' + '.join(_FLAGS)} + numbers = 0 THEN 1 ELSE 0 END AS testable FROM flagged
)"""

# Terms of lines, as quizzes see them: t (one row per term of a line), salient, candidates. Only ASCII letters match in either case.
SALIENT = rf"""
spoken AS (
  SELECT source, doc_id, doc_id * 2147483648 + line AS position, text, list_transform(regexp_extract_all(text, '\b\p{{L}}[\p{{L}}\-]{{4,}}\b'), lambda w: lower(w)) AS tokens FROM lines
), totals AS (SELECT source, count(*) AS total FROM spoken GROUP BY source),
terms AS (
  SELECT source, position, text, len(tokens) AS length, unnest(tokens) AS term, unnest(range(0, len(tokens))) AS place FROM spoken
), t AS (SELECT source, position, text, length, term, count(*) AS tf, min(place) AS first_at FROM terms GROUP BY ALL),
dfs AS (SELECT source, term, count(*) AS df FROM t GROUP BY ALL),
salient AS (
  SELECT source, position, term, tf, df, CAST(first_at AS INT) AS first_at, round(
    tf * ln(total / df) * CASE WHEN length(term) >= 6 THEN 1.2::DOUBLE ELSE 1.0 END
    * CASE WHEN length <= 1 THEN 1.0 ELSE 1.0 + 1.2::DOUBLE * (1.0 - first_at / (length - 1)) END
    * CASE WHEN regexp_matches(text, '[^.!?]\s\b' || upper(term[1]) || regexp_replace(term[2:], '([a-z])', '(?i:\1)', 'g') || '\b') THEN 1.35::DOUBLE ELSE 1.0 END
    * CASE WHEN regexp_matches(term, '({'|'.join(L.DESCRIBING_SUFFIXES)})$') THEN 0.5::DOUBLE ELSE 1.0 END, 9) AS salience
  FROM t JOIN dfs USING (source, term) JOIN totals USING (source)
  WHERE NOT list_contains({_list((*L.STOPWORDS, *L.WEAK_BLANKS))}, term) AND df <= greatest(2, total // 4)
)"""
CANDIDATES = rf"""
best AS (SELECT *, row_number() OVER (PARTITION BY source, position ORDER BY salience DESC, first_at) AS n FROM salient WHERE salience > 0),
candidates AS (
  SELECT s.source, s.doc_id, s.position, s.text, coalesce(nullif(regexp_extract(s.text, '\b' || regexp_replace(b.term, '([a-z])', '(?i:\1)', 'g') || '\b'), ''), b.term) AS term,
    round(b.salience + CASE WHEN regexp_matches(s.text, '(?i)\b({'|'.join(L.DEFINITION_VERBS)})\b') THEN 2.0 ELSE 0.0 END, 9) AS score
  FROM spoken s JOIN best b ON b.source = s.source AND b.position = s.position AND b.n = 1
  WHERE len(regexp_extract_all(s.text, '\S+')) BETWEEN 8 AND 45
    AND NOT list_contains({_list(L.DANGLING_ENDINGS)}, regexp_replace(lower(list_last(regexp_split_to_array(trim(s.text, ' '), '\s+'))), '[^\p{{L}}]', '', 'g'))
)"""

#: The 32-bit finaliser over column h, as nested steps.
def _mixed(h: str) -> str:
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = f"CAST(CAST(xor({h}, ({h}) >> {shift}) AS HUGEINT) * {factor} % 4294967296 AS BIGINT)"
    return f"xor({h}, ({h}) >> 16)"


_FILLERS = "|".join(L.GRADING_FILLERS)


def _graded(column: str) -> str:
    bare = rf"regexp_replace(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}\s]', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '\b({_FILLERS})\b', ' ', 'g'), '\s+', ' ', 'g'), ' ')"


def _terms(column: str) -> str:
    return f"list_distinct(list_filter(string_split({column}, ' '), lambda t: length(t) > 2 AND NOT list_contains({_list(L.STOPWORDS)}, t)))"


ORACLES = {
    "chunk_fixed_windows": f"WITH {CHUNKS} SELECT doc_id AS document_id, ordinal, n_words, char_start, char_end, substring(text, char_start + 1, char_end - char_start) AS content, chunk_id FROM chunks",
    "chunk_counts": f"WITH {CHUNKS} SELECT source AS project_id, count(DISTINCT doc_id) AS documents, count(*) AS chunks, CAST(sum(n_words) AS BIGINT) AS words FROM chunks GROUP BY source",
    "tokenize_counts": f"SELECT doc_id AS document_id, CAST(len({TOKENS}) AS INT) AS n_tokens, CAST(len(list_distinct({TOKENS})) AS INT) AS n_distinct FROM documents",
    "content_terms": f"SELECT doc_id AS document_id, CAST(len({TERMS}) AS INT) AS n_terms, md5(array_to_string(list_sort({TERMS}), ' ')) AS terms_md5 FROM documents",
    "identity_dedup": r"SELECT source AS project_id, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')) AS identity, min(doc_id) AS first_id, count(*) AS sightings FROM documents GROUP BY 1, 2",
    "ready_chunks": f"WITH {CHUNKS} SELECT c.doc_id AS document_id, ordinal, n_words FROM chunks c JOIN labels l ON c.doc_id = l.doc_id WHERE l.quality = 1",
    "chunks_missing_vectors": f"WITH {CHUNKS} SELECT source AS project_id, c.doc_id AS document_id, ordinal FROM chunks c JOIN labels l ON c.doc_id = l.doc_id WHERE l.quality = 1 AND NOT (ordinal = 0 AND EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = c.doc_id))",
    "docs_newest_first": f"SELECT source AS project_id, d.doc_id AS document_id, {STATUS} AS status, CAST(row_number() OVER (PARTITION BY source ORDER BY d.doc_id DESC) AS INT) AS place FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "session_messages_nested": "SELECT conv_id, CAST(count(*) AS INT) AS n_messages, string_agg(role, ',' ORDER BY turn, role, text) AS roles, md5(string_agg(text, chr(10) ORDER BY turn, role, text)) AS texts_md5 FROM conversations GROUP BY conv_id",
    "latest_sessions": "SELECT conv_id AS session_id, max(turn) AS updated_at FROM conversations GROUP BY conv_id",
    "upsert_latest": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "bm25_topk_plain": rf"""WITH {CHUNKS}, tokens AS (
  SELECT source, chunk_id, unnest(regexp_extract_all(lower(substring(text, char_start + 1, char_end - char_start)), '[\p{{L}}\p{{N}}]+')) AS term FROM chunks
), postings AS (SELECT source, chunk_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT source, chunk_id, sum(tf) AS dl FROM postings GROUP BY ALL),
stats AS (SELECT c.source, count(*) AS n, sum(coalesce(dl, 0)) / count(*) AS avgdl FROM chunks c LEFT JOIN lengths USING (chunk_id) GROUP BY c.source),
df AS (SELECT source, term, count(*) AS df FROM postings GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, p.source, p.chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
  FROM postings p JOIN asked USING (term) JOIN df ON df.source = p.source AND df.term = p.term JOIN stats s ON s.source = p.source JOIN lengths l ON l.chunk_id = p.chunk_id
  GROUP BY ALL
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, chunk_id) AS INT) AS rank FROM scored)
SELECT item_id AS query_id, source AS project_id, chunk_id, score, rank FROM ranked WHERE rank <= 8""",
    "centroid_by_label": """WITH parts AS (
  SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings
), means AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS x FROM parts GROUP BY ALL)
SELECT label, CAST(dim AS INT) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS value FROM means""",
    "cosine_topk": """WITH parts AS (
  SELECT vec_id, label, unnest(range(0, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings
), means AS (SELECT label, dim, avg(x) AS x FROM parts GROUP BY ALL), unit AS (SELECT label, dim, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS q FROM means),
scored AS (SELECT label, vec_id, round(sum(x * q), 6) AS score FROM parts JOIN unit USING (label, dim) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT label AS query_id, label AS project_id, vec_id AS chunk_id, score, rank FROM ranked WHERE rank <= 8""",
    "rrf_fusion": """WITH lists AS (
  SELECT source, doc_id, 0 AS list, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents
  UNION ALL SELECT source, doc_id, 1, row_number() OVER (PARTITION BY source ORDER BY doc_id) FROM documents
), fused AS (
  SELECT source, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(list * 1000000 + rank) AS place FROM lists WHERE rank <= 24 GROUP BY ALL
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, place, doc_id) AS INT) AS rank FROM fused)
SELECT source AS project_id, doc_id AS chunk_id, score, rank FROM ranked WHERE rank <= 8""",
    "content_filter_flags": f"WITH {LINES}, {FLAGGED} SELECT doc_id AS document_id, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in (*_FLAGS, 'numbers', 'testable'))}, count(*) AS n_lines FROM tested GROUP BY doc_id",
    "filter_with_fallback": f"WITH {LINES}, {FLAGGED} SELECT doc_id AS document_id, CAST(CASE WHEN sum(testable) = 0 THEN count(*) ELSE sum(testable) END AS BIGINT) AS kept FROM tested GROUP BY doc_id",
    "even_stride_sample": f"""WITH {CHUNKS}, numbered AS (
  SELECT source, doc_id, ordinal, row_number() OVER (PARTITION BY source ORDER BY doc_id, ordinal) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM chunks
), picks AS (SELECT DISTINCT source, CAST(floor(k * (n - 1) / 59.0 + 0.5) AS BIGINT) AS i FROM (SELECT DISTINCT source, n FROM numbered), range(0, 60) AS r(k))
SELECT source AS project_id, doc_id AS document_id, ordinal FROM numbered WHERE n <= 60 OR (source, i) IN (SELECT (source, i) FROM picks)""",
    "term_df": rf"""WITH {LINES}, totals AS (SELECT source, count(*) AS total FROM lines GROUP BY source),
terms AS (SELECT source, unnest(list_distinct(list_transform(regexp_extract_all(text, '\b\p{{L}}[\p{{L}}\-]{{4,}}\b'), lambda w: lower(w)))) AS term FROM lines)
SELECT source AS request_id, term, count(*) AS df, any_value(total) AS total FROM terms JOIN totals USING (source) GROUP BY source, term""",
    "lexical_grade": f"""WITH pairs AS (
  SELECT conv_id, turn, {_graded('text')} AS own, {_graded('reference')} AS ref
  FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS reference FROM conversations) WHERE reference IS NOT NULL
), shared AS (
  SELECT *, {_terms('ref')} AS wanted, {_terms('own')} AS said FROM pairs
), judged AS (
  SELECT conv_id, turn, CASE WHEN own = '' THEN 'blank'
    WHEN own = ref OR contains(own, ref) OR (contains(ref, own) AND length(own) >= greatest(3, length(ref) // 2)) THEN 'match'
    WHEN len(wanted) > 0 AND CAST(len(list_intersect(wanted, said)) AS DOUBLE) / len(wanted) >= 0.6 THEN 'covered'
    WHEN len(list_intersect(wanted, said)) > 0 THEN 'partial' ELSE 'wrong' END AS verdict FROM shared
) SELECT conv_id, turn, verdict IN ('match', 'covered') AS correct, verdict FROM judged""",
    "term_overlap": f"""WITH t AS (SELECT source, doc_id, {TERMS} AS terms FROM documents), f AS (SELECT source, arg_min(terms, doc_id) AS first_terms FROM t GROUP BY source)
SELECT doc_id AS document_id, CAST(len(list_intersect(terms, first_terms)) AS INT) AS shared FROM t JOIN f USING (source)""",
    "timestamp_normalise": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'junk ' || CAST(event_id AS VARCHAR) ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000000000Z' END AS stamp FROM events",
    "json_list_roundtrip": f"SELECT doc_id AS document_id, CAST(len({TERMS}) AS INT) AS n, md5(array_to_string(list_sort({TERMS}), ' ')) AS terms_md5 FROM documents",
    "search_stored": rf"""WITH {CHUNKS}, kept AS (SELECT * FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)), tokens AS (
  SELECT source, chunk_id, unnest(regexp_extract_all(lower(substring(text, char_start + 1, char_end - char_start)), '[\p{{L}}\p{{N}}]+')) AS term FROM kept
), postings AS (SELECT source, chunk_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT source, chunk_id, sum(tf) AS dl FROM postings GROUP BY ALL),
stats AS (SELECT c.source, count(*) AS n, sum(coalesce(dl, 0)) / count(*) AS avgdl FROM kept c LEFT JOIN lengths USING (chunk_id) GROUP BY c.source),
df AS (SELECT source, term, count(*) AS df FROM postings GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, p.source, p.chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
  FROM postings p JOIN asked USING (term) JOIN df ON df.source = p.source AND df.term = p.term JOIN stats s ON s.source = p.source JOIN lengths l ON l.chunk_id = p.chunk_id
  GROUP BY ALL
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, chunk_id) AS INT) AS rank FROM scored)
SELECT r.item_id AS query_id, r.source AS project_id, r.chunk_id, c.doc_id AS document_id, r.score, r.rank, md5(substring(c.text, char_start + 1, char_end - char_start)) AS content_md5 FROM ranked r JOIN kept c ON c.chunk_id = r.chunk_id WHERE rank <= 8""",
    "stored_delete_counts": rf"""WITH {CHUNKS}, tokens AS (
  SELECT doc_id, chunk_id, unnest(regexp_extract_all(lower(substring(text, char_start + 1, char_end - char_start)), '[\p{{L}}\p{{N}}]+')) AS term FROM chunks
), postings AS (SELECT doc_id, chunk_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
every AS (
  SELECT 'documents' AS table_name, doc_id, 1 AS n FROM documents UNION ALL SELECT 'chunks', doc_id, 1 FROM chunks
  UNION ALL SELECT 'postings', doc_id, 1 FROM postings UNION ALL SELECT 'statistics_chunks', doc_id, 1 FROM chunks UNION ALL SELECT 'statistics_words', doc_id, tf FROM postings
)
SELECT table_name, CAST(sum(CASE WHEN l.quality = 0 THEN n ELSE 0 END) AS BIGINT) AS n_deleted, CAST(sum(CASE WHEN l.quality = 0 THEN 0 ELSE n END) AS BIGINT) AS n_left FROM every e LEFT JOIN labels l ON l.doc_id = e.doc_id GROUP BY table_name""",
    "cascade_delete_counts": f"""WITH {CHUNKS}, gone AS (SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0)
SELECT 'documents' AS table_name, count(*) AS n_left FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'chunk_embeddings', count(*) FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id WHERE ordinal = 0 AND doc_id NOT IN (SELECT doc_id FROM gone)""",
    "vector_counts": "SELECT label AS project_id, 'stored' AS model, count(*) AS n FROM embeddings GROUP BY label",
    "vector_backfill": f"""WITH {CHUNKS}, worded AS (
  SELECT source, chunk_id, l.quality = 1 AS ready, ordinal = 0 AND EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = c.doc_id) AS held,
    len(list_filter({TOKENS.replace('text', 'substring(c.text, char_start + 1, char_end - char_start)')}, lambda t: NOT list_contains({_list(L.STOPWORDS)}, t))) AS n_tokens
  FROM chunks c LEFT JOIN labels l ON l.doc_id = c.doc_id
) SELECT source AS project_id, count(*) AS n, CAST(sum(CASE WHEN NOT held AND n_tokens > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_embedded FROM worded WHERE held OR ready GROUP BY source""",
    "postings_after_delete": rf"""WITH {CHUNKS}, tokens AS (
  SELECT source, chunk_id, unnest(regexp_extract_all(lower(substring(text, char_start + 1, char_end - char_start)), '[\p{{L}}\p{{N}}]+')) AS term
  FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
), postings AS (SELECT source, chunk_id, term, count(*) AS tf FROM tokens GROUP BY ALL)
SELECT source AS project_id, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_terms FROM postings GROUP BY source""",
    "documents_by_ids": "SELECT doc_id AS document_id, source AS project_id, 'doc-' || doc_id AS filename FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
    "summary_citations": "SELECT c.conv_id AS summary_id, c.turn AS citation_id, c.conv_id * 10 + c.turn AS document_id, 'doc-' || d.doc_id AS filename FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 10 + c.turn",
    "filename_rules": r"""WITH bare AS (
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '^.*[/\\]', ''), '[\x00-\x1F\x7F\x{2028}\x{2029}]', '', 'g'), '[\\/:*?"<>|]', '_', 'g'), ' ') AS base FROM pages
), named AS (SELECT page_id, substring(CASE WHEN regexp_full_match(base, '\.*') THEN 'upload' ELSE base END, 1, 120) AS filename FROM bare)
SELECT page_id, filename, CASE WHEN suffix(lower(filename), '.pdf') THEN 'application/pdf' WHEN suffix(lower(filename), '.md') OR suffix(lower(filename), '.markdown') THEN 'text/markdown' ELSE 'text/plain' END AS content_type FROM named""",
    "vector_codec_roundtrip": "SELECT vec_id, CAST(4 * len(embedding) AS INT) AS n_bytes, CASE WHEN embedding IS NOT NULL THEN true END AS same FROM embeddings",
    "hash_embed_sparse": f"""WITH worded AS (
  SELECT item_id, list_filter({TOKENS}, lambda t: NOT list_contains({_list(L.STOPWORDS)}, t)) AS tokens FROM benchmark
), features AS (
  SELECT item_id, unnest(tokens) AS feature, 1.0::DOUBLE AS w FROM worded
  UNION ALL SELECT item_id, unnest([tokens[i] || ' ' || tokens[i + 1] FOR i IN range(1, len(tokens))]), 0.5::DOUBLE FROM worded
), counted AS (SELECT item_id, feature, sum(w) AS w FROM features GROUP BY ALL),
named AS (SELECT DISTINCT feature FROM counted),
summed AS (SELECT feature, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(feature, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) & 4294967295) AS g FROM named),
hashed AS (SELECT feature, {_mixed('g')} AS h FROM summed),
signed AS (SELECT feature, (((h + 2147483648) % 4294967296) - 2147483648) AS s, CASE WHEN {_mixed('h')} & 1 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM hashed),
dims AS (SELECT item_id, CAST(((s % 1024) + 1024) % 1024 AS INT) AS dim, sum(w * sign) AS w FROM counted JOIN signed USING (feature) GROUP BY ALL)
SELECT item_id AS query_id, dim, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM dims WHERE w <> 0""",
    "term_salience": f"WITH {LINES}, {SALIENT} SELECT source AS request_id, position, term, tf, df, first_at, salience FROM salient",
    "cloze_candidates": f"WITH {LINES}, {SALIENT}, {CANDIDATES} SELECT source AS request_id, doc_id AS document_id, position, text, term, score FROM candidates",
    "distractors": f"""WITH {LINES}, {SALIENT}, {CANDIDATES}, turns AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY score DESC, position) AS round, min(position) OVER (PARTITION BY source, doc_id) AS seen FROM candidates
), unused AS (SELECT *, row_number() OVER (PARTITION BY source, lower(term) ORDER BY round, seen) AS use FROM turns),
picked AS (SELECT source, term AS answer, row_number() OVER (PARTITION BY source ORDER BY round, seen) - 1 AS ordinal FROM unused WHERE use = 1),
firsts AS (SELECT source, position, term, row_number() OVER (PARTITION BY source, lower(term) ORDER BY position) AS n FROM candidates),
few AS (SELECT source, position, term, row_number() OVER (PARTITION BY source, length(term) ORDER BY position) AS n FROM firsts WHERE n = 1),
chosen AS (
  SELECT p.source, p.ordinal, f.term, row_number() OVER (PARTITION BY p.source, p.ordinal ORDER BY abs(length(f.term) - length(p.answer)), f.position) AS n
  FROM picked p JOIN few f ON f.source = p.source AND f.n <= 4 AND lower(f.term) <> lower(p.answer) WHERE p.ordinal < 20
)
SELECT source AS request_id, CAST(ordinal AS INT) AS ordinal, list(term ORDER BY n) AS distractors FROM chosen WHERE n <= 3 GROUP BY source, ordinal""",
    "foreign_document_ids": "SELECT item_id AS request_id, item_id * 37 AS document_id, CASE WHEN d.doc_id IS NULL THEN 'unknown' ELSE 'foreign' END AS problem FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 37 WHERE d.source IS DISTINCT FROM 'src1'",
    "stale_rebuild": rf"""WITH {CHUNKS}, tokens AS (
  SELECT source, chunk_id, unnest(regexp_extract_all(lower(substring(text, char_start + 1, char_end - char_start)), '[\p{{L}}\p{{N}}]+')) AS term FROM chunks
), postings AS (SELECT source, chunk_id, term, count(*) AS tf FROM tokens GROUP BY ALL), totals AS (SELECT source, count(*) AS n FROM chunks GROUP BY source)
SELECT source AS project_id, 'plain-v1' AS analyzer_version, n, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_terms FROM postings JOIN totals USING (source) GROUP BY source, n""",
    "message_citations": """WITH turns AS (SELECT conv_id, turn, conv_id || '-' || turn AS message_id FROM conversations),
cited AS (SELECT message_id, 0 AS place, conv_id * 10 + turn AS doc_id FROM turns WHERE turn % 2 = 1 UNION ALL SELECT message_id, 1, conv_id FROM turns WHERE turn % 2 = 1),
lists AS (SELECT message_id, count(*) AS n, string_agg(coalesce('doc-' || d.doc_id, '?'), ',' ORDER BY place) AS names FROM cited c LEFT JOIN documents d USING (doc_id) GROUP BY message_id)
SELECT conv_id AS session_id, message_id, coalesce(n, 0) AS n_citations, coalesce(names, '') AS filenames FROM turns LEFT JOIN lists USING (message_id)""",
    "chunks_of_documents": f"WITH {CHUNKS} SELECT doc_id AS document_id, count(*) AS chunks, max(ordinal) AS last FROM chunks WHERE source = 'src1' AND doc_id IN (SELECT item_id FROM benchmark) GROUP BY doc_id",
    "deleted_chunk_counts": f"WITH {CHUNKS} SELECT d.doc_id AS document_id, count(c.doc_id) AS n_deleted FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 0 LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY d.doc_id",
    "joined_names": "SELECT conv_id, string_agg(role, ', ' ORDER BY first, role) AS names FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id",
    "request_defaults": """SELECT conv_id, turn, turn % 3 = 0 AS refused, CASE WHEN turn % 3 = 0 THEN 'New chat' ELSE role END AS title,
  CAST(CASE WHEN turn * 7 - 1 < 1 THEN 5 ELSE least(turn * 7 - 1, 20) END AS BIGINT) AS questions,
  CASE conv_id % 4 WHEN 0 THEN 'MULTIPLE_CHOICE' WHEN 1 THEN 'MULTIPLE_CHOICE' WHEN 2 THEN 'FLASHCARD' ELSE 'SHORT_ANSWER' END AS type,
  role || CASE WHEN turn % 2 = 1 THEN ' — p. ' || turn ELSE '' END AS source FROM conversations""",
    "upload_rules": r"""SELECT page_id, CASE WHEN coalesce(length(html), 0) = 0 THEN 'The file is empty' WHEN length(html) > 41943040 THEN 'The file is larger than 40 MB'
  WHEN lower(regexp_extract(CASE WHEN page_id % 3 = 0 THEN url || '.TXT' ELSE url END, '\.([^./]+)$', 1)) NOT IN ('pdf', 'txt', 'md', 'markdown') THEN 'Only PDF, text and Markdown files are taken' END AS rejected FROM pages""",
    "error_messages": "SELECT doc_id AS document_id, CAST(length(substring(coalesce(text, 'IOError'), 1, 500)) AS INT) AS n_chars, md5(substring(coalesce(text, 'IOError'), 1, 500)) AS message_md5 FROM documents",
    "vectors_of_project": "SELECT vec_id AS chunk_id, CAST(len(embedding) AS INT) AS dims FROM embeddings WHERE label = 3 AND vec_id % 5 <> 0",
}

#: The second turn of conversation 1 graded against the first.
ORACLES["graded_question"] = f"SELECT CAST(0 AS BIGINT) AS question_id, correct, verdict FROM ({ORACLES['lexical_grade']}) WHERE conv_id = 1 AND turn = 1"
