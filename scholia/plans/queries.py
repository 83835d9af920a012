"""The engine's queries over the driver's tables, each over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.operators import answers as A
from scholia.operators import bm25, catalog, index, quiz, retrieval, sentences, services, vectors
from scholia.operators.chunking import numbered_chunks
from scholia.plans import binding as B
from scholia.session import Scratch, checkpointed, read_table, settings, stored
from scholia.sources import io
from scholia.sources.store import TASK_BYTES, Snapshot, Store


def chunk_fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chunks(spark, sf_dir).select("document_id", F.col("ordinal").cast("long").alias("ordinal"), "n_words", "char_start", "char_end", "content", "chunk_id")


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chunks(spark, sf_dir).groupBy("project_id").agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("chunks"), F.sum("n_words").alias("words"))


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = B.documents(spark, sf_dir).select("document_id", T.tokenize(F.col("text")).alias("tokens"))
    return tokens.select("document_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = B.documents(spark, sf_dir).select("document_id", F.array_sort(T.content_terms(F.col("text"))).alias("terms"))
    return terms.select("document_id", F.size("terms").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


def identity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = B.documents(spark, sf_dir).select("project_id", "document_id", F.md5(T.identity_key(F.col("text"))).alias("identity"))
    return keyed.groupBy("project_id", "identity").agg(F.min("document_id").alias("first_id"), F.count("*").alias("sightings"))


def ready_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ready_chunks(B.chunks(spark, sf_dir), B.statuses(spark, sf_dir)).select("document_id", F.col("ordinal").cast("long").alias("ordinal"), "n_words")


def _stored_vectors(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """A stored vector stands for the first chunk of the document of its id."""
    own = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"))
    return own.join(chunks.filter("ordinal = 0").select("document_id", "chunk_id"), "document_id").select("chunk_id", F.lit("stored").alias("model"))


def chunks_missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = B.chunks(spark, sf_dir)
    missing = catalog.chunks_without_vector(chunks, B.statuses(spark, sf_dir), _stored_vectors(spark, sf_dir, chunks), "stored")
    return missing.select("project_id", "document_id", F.col("ordinal").cast("long").alias("ordinal"))


def docs_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = Window.partitionBy("project_id").orderBy(F.desc("document_id"))
    return B.statuses(spark, sf_dir).select("project_id", "document_id", "status", F.row_number().over(place).alias("place"))


def session_messages_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nested = catalog.with_children(turns.select("conv_id").distinct(), turns, "conv_id", "messages", "turn")
    return nested.select("conv_id", F.size("messages").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.md5(F.array_join(F.transform("messages", lambda m: m["text"]), "\n")).alias("texts_md5"))


def latest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"))
    sessions = turns.select("session_id").distinct().withColumn("created_at", F.lit(-1).cast("long"))
    return catalog.sessions_by_last_update(sessions, turns).select("session_id", "updated_at")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return catalog.latest(events, "user_id", "event_id")


def _bm25(spark: SparkSession, sf_dir: str, k: int, terms) -> DataFrame:
    chunks = B.chunks(spark, sf_dir).select("project_id", "chunk_id", "content")
    return bm25.search_chunks(B.questions(spark, sf_dir), chunks, k, terms)


def bm25_topk_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, retrieval.TOP_K, bm25.plain_terms)


def bm25_topk_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, retrieval.TOP_K, bm25.english_terms)


def _stored_corpus(spark: SparkSession, sf_dir: str, scratch: Scratch) -> tuple[DataFrame, Snapshot, dict[str, int]]:
    """(statistics before, snapshot after, deleted): documents and chunks stored in two batches, by even and odd id, then the FAILED documents deleted, project by project."""
    store = Store(spark, f"{scratch.root}/store", slices=4)
    docs = B.statuses(spark, sf_dir).select("document_id", "project_id", "filename", "status")
    now = store.snapshot()
    for batch in (0, 1):
        own = F.pmod("document_id", F.lit(2)) == batch
        part = numbered_chunks(B.pages(spark, sf_dir).filter(own)).select("project_id", "document_id", "chunk_id", "ordinal", "content")
        rows = index.rows_from_stored(part, bm25.plain_terms, "plain-v1")
        # Chunks are brought together by folder once, as they are stored; their postings are made from there and written where they lie.
        with settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES}):
            now = store.commit(now, {**rows, "documents": docs.filter(own)}, marks={"batch": batch}, lying=("postings",))
    before = checkpointed(now.read("index_statistics").agg(F.sum("n").alias("n"), F.sum("words").alias("words")))
    after, deleted, _ = store.delete_in_parts(now, "documents", docs.filter("status = 'FAILED'").select("document_id"))
    return before, after, deleted


def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top 8 per question and project from the stored index, after two batches and a delete, with the hits' chunks."""
    scratch = Scratch(spark, "stored")
    _, snapshot, _ = _stored_corpus(spark, sf_dir, scratch)
    hits = checkpointed(index.search_stored(snapshot, B.questions(spark, sf_dir), retrieval.TOP_K, bm25.plain_terms, embeddings=False))
    found = checkpointed(index.stored_hits(snapshot, hits).select("query_id", "project_id", "chunk_id", "document_id", "score", "rank", F.md5("content").alias("content_md5")))
    scratch.drop()
    return found


def stored_delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stored tables that the delete of all FAILED documents took and left, and what the index statistics lost and hold."""
    scratch = Scratch(spark, "stored")
    before, after, deleted = _stored_corpus(spark, sf_dir, scratch)
    rows = [after.read(name).agg(F.lit(name).alias("table_name"), F.lit(deleted[name]).cast("long").alias("n_deleted"), F.count("*").alias("n_left")) for name in ("documents", "chunks", "postings")]
    for column in ("n", "words"):
        sums = before.select(F.col(column).alias("held")).crossJoin(after.read("index_statistics").agg(F.sum(column).alias("n_left")))
        rows.append(sums.select(F.lit(f"statistics_{'chunks' if column == 'n' else column}").alias("table_name"), (F.col("held") - F.col("n_left")).alias("n_deleted"), "n_left"))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    out = checkpointed(out)
    scratch.drop()
    return out


def _labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("label").alias("project_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = vectors.mean_vectors(_labelled_vectors(spark, sf_dir), "project_id", "vector")
    return means.select(F.col("project_id").alias("label"), F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled_vectors(spark, sf_dir)
    asked = vectors.mean_vectors(rows, "project_id", "vector").select(F.col("project_id").alias("query_id"), "project_id", F.col("centroid").alias("qvector"))
    return vectors.vector_topk(asked, rows, retrieval.TOP_K)


def hash_embed_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.hashed_features(B.questions(spark, sf_dir), "query_id", "content").select("query_id", "dim", F.round("weight", 6).alias("weight"))


def vector_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vectors.to_bytes("embedding").alias("blob"))
    return rows.select("vec_id", F.length("blob").alias("n_bytes"), (vectors.from_bytes("blob") == F.col("embedding")).alias("same"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of each project's documents, by size and by name, fused."""
    docs = B.documents(spark, sf_dir).select("project_id", F.col("document_id").alias("chunk_id"), "n_chars")
    k = retrieval.overfetch(retrieval.TOP_K)
    own = Window.partitionBy("project_id")
    by_size = docs.withColumn("rank", F.row_number().over(own.orderBy(F.desc("n_chars"), "chunk_id"))).filter(F.col("rank") <= k)
    by_name = docs.withColumn("rank", F.row_number().over(own.orderBy("chunk_id"))).filter(F.col("rank") <= k)
    return retrieval.fuse([by_size, by_name], retrieval.TOP_K, ["project_id"])


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid_search(B.questions(spark, sf_dir), B.chunks(spark, sf_dir))


def content_filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.line_sentences(spark, sf_dir).select("document_id", F.trim("text").alias("text"))
    names = list(T.content_flags(F.col("text")))
    # One array holds the flags, so that no expression runs again for `testable`.
    flags = lines.select("document_id", F.array(*[f.cast("int") for f in T.content_flags(F.col("text")).values()]).alias("flags"))
    flags = flags.groupBy("document_id", "flags").agg(F.count("*").alias("n")).select("document_id", "n", *[(F.col("flags")[i] * F.col("n")).alias(c) for i, c in enumerate(names)], F.when(F.array_max("flags") == 0, F.col("n")).otherwise(0).alias("testable"))
    return flags.groupBy("document_id").agg(*[F.sum(c).alias(c) for c in (*names, "testable")], F.sum("n").alias("n_lines"))


def filter_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.line_sentences(spark, sf_dir).withColumn("request_id", F.col("document_id")).withColumn("text", F.trim("text"))
    return sentences.with_fallback(lines, "request_id", T.is_testable(F.col("text"))).groupBy("document_id").agg(F.count("*").alias("kept"))


def _project_sources(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """Each project as one request over an even-stride sample of its chunks."""
    rows = B.chunks(spark, sf_dir).withColumn("request_id", F.col("project_id"))
    picked = sentences.even_stride(rows, "request_id", most, "document_id", "ordinal")
    order = Window.partitionBy("request_id").orderBy("document_id", "ordinal")
    return picked.select("request_id", F.row_number().over(order).alias("source_order"), "chunk_id", "document_id", F.concat(F.lit("doc-"), F.col("document_id").cast("string")).alias("filename"), "page", "content")


def even_stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.even_stride(B.chunks(spark, sf_dir), "project_id", A.SUMMARY_CHUNKS, "document_id", "ordinal").select("project_id", "document_id", F.col("ordinal").cast("long").alias("ordinal"))


def sentence_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_corpus(_project_sources(spark, sf_dir, quiz.QUIZ_CHUNKS), quiz.CANDIDATES).select("request_id", "position", "document_id", "text", "previous", "searchable")


def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question to every project, from the hybrid top 8 chunks."""
    chunks = stored(B.chunks(spark, sf_dir).select("project_id", "document_id", "chunk_id", "page", "content"))
    hits = checkpointed(retrieval.hybrid_search(B.questions(spark, sf_dir), chunks))
    request = F.concat_ws("|", F.col("query_id").cast("string"), "project_id")
    sources = retrieval.hydrate(hits, chunks).select(request.alias("request_id"), F.col("rank").alias("source_order"), "chunk_id", "document_id", "page", "content")
    asked = hits.select("query_id", "project_id").distinct().join(B.questions(spark, sf_dir), "query_id").select(request.alias("request_id"), F.col("content").alias("question"))
    return A.answers(asked, sources)


def mmr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summaries(_project_sources(spark, sf_dir, A.SUMMARY_CHUNKS))


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz.term_frequencies(B.line_sentences(spark, sf_dir))


def term_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz.term_salience(B.line_sentences(spark, sf_dir))


def cloze_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz.cloze_candidates(B.line_sentences(spark, sf_dir))


def cloze_quiz(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = checkpointed(sentences.sentence_corpus(_project_sources(spark, sf_dir, quiz.QUIZ_CHUNKS), quiz.CANDIDATES))
    return quiz.quiz(sentences.with_fallback(corpus, "request_id", T.is_testable(F.col("text"))), 10)


def distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = stored(quiz.cloze_candidates(B.line_sentences(spark, sf_dir)))
    return quiz.distractors(quiz.round_robin(pool, 20), pool)


def lexical_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as an answer, graded against the turn before it."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = Window.partitionBy("conv_id").orderBy("turn", "text")
    pairs = turns.withColumn("reference", F.lag("text").over(before)).filter("reference IS NOT NULL")
    return pairs.select("conv_id", "turn", T.grade(F.col("reference"), F.col("text")).alias("g")).select("conv_id", "turn", "g.correct", "g.verdict")


def term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content terms that each document shares with the first document of its project."""
    docs = B.documents(spark, sf_dir).select("project_id", "document_id", T.content_terms(F.col("text")).alias("terms"))
    firsts = docs.groupBy("project_id").agg(F.min("document_id").alias("document_id")).join(docs, ["project_id", "document_id"]).select("project_id", F.col("terms").alias("first_terms"))
    return docs.join(firsts, "project_id").select("document_id", F.size(F.array_intersect("terms", "first_terms")).alias("shared"))


def timestamp_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))
    mixed = raw.withColumn("stamp", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("junk "), F.col("event_id").cast("string"))).otherwise(F.col("stamp")))
    return catalog.normalised_timestamps(mixed, "stamp")


def json_list_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = B.documents(spark, sf_dir).select("document_id", F.array_sort(T.content_terms(F.col("text"))).alias("terms"))
    written = lists.select("document_id", "terms", catalog.write_list(F.col("terms")).alias("json"))
    return written.select("document_id", F.size(catalog.read_list(F.col("json"))).alias("n"), F.md5(F.array_join(catalog.read_list(F.col("json")), " ")).alias("terms_md5"))


def cascade_delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table after all FAILED documents are deleted."""
    chunks = B.chunks(spark, sf_dir)
    docs = B.statuses(spark, sf_dir)
    tables = {"documents": docs.select("document_id", "project_id"), "chunks": chunks.select("chunk_id", "document_id"), "chunk_embeddings": _stored_vectors(spark, sf_dir, chunks).select("chunk_id")}
    left = catalog.cascade_delete(tables, "documents", docs.filter("status = 'FAILED'").select("document_id"))
    counts = [df.agg(F.count("*").alias("n_left")).select(F.lit(name).alias("table_name"), "n_left") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def vector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.vector_counts(_labelled_vectors(spark, sf_dir).withColumn("model", F.lit("stored")))


def vector_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors per project after every READY chunk without one got its hashing vector; of those, how many are of unit length."""
    chunks = B.chunks(spark, sf_dir)
    stored = _stored_vectors(spark, sf_dir, chunks)
    missing = catalog.chunks_without_vector(chunks, B.statuses(spark, sf_dir), stored, "stored")
    empty = F.array().cast("array<float>")
    held = stored.join(chunks.select("chunk_id", "project_id"), "chunk_id").select("chunk_id", "project_id", "model", F.lit(0).alias("dims"), empty.alias("vector"))
    every = catalog.upserted_vectors(held, missing, vectors.hashed_features, "stored", vectors.DIMENSIONS)
    unit = F.abs(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) - 1) < 1e-5
    return every.groupBy("project_id").agg(F.count("*").alias("n"), F.sum(unit.cast("long")).alias("n_embedded"))


def postings_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings per project once the FAILED documents, their chunks and index rows are deleted."""
    chunks = B.chunks(spark, sf_dir).select("project_id", "document_id", "chunk_id", "content")
    docs = B.statuses(spark, sf_dir)
    postings, _ = bm25.build_index(chunks)
    left = catalog.cascade_delete({"documents": docs, "chunks": chunks, "postings": postings}, "documents", docs.filter("status = 'FAILED'").select("document_id"))
    return left["postings"].groupBy("project_id").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_terms"))


def documents_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share their id with a question."""
    ids = B.questions(spark, sf_dir).select(F.col("query_id").alias("document_id"))
    return catalog.by_ids(B.documents(spark, sf_dir), ids, "document_id").select("document_id", "project_id", "filename")


def summary_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as citations of their conversation; turn t of conversation c cites document 10 c + t, which may be missing."""
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("summary_id"), F.col("turn").alias("citation_id"), (F.col("conv_id") * 10 + F.col("turn")).alias("document_id"))
    return catalog.summary_citations(turns, B.documents(spark, sf_dir)).select("summary_id", "citation_id", "document_id", "filename")


def foreign_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question asks the project src1 for the document of 37 times its own id."""
    asked = B.questions(spark, sf_dir).select(F.col("query_id").alias("request_id"), (F.col("query_id") * 37).alias("document_id"), F.lit("src1").alias("project_id"))
    return A.request_problems(asked, B.documents(spark, sf_dir))


def filename_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls as upload names: sanitised, with the guessed content type."""
    rows = read_table(spark, sf_dir, "pages").select("page_id", T.safe_filename(F.col("url")).alias("filename"))
    return rows.select("page_id", "filename", T.content_type_of(F.col("filename")).alias("content_type"))


def stale_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects whose name ends in an even digit hold an index of content terms; it is rebuilt of plain tokens."""
    chunks = B.chunks(spark, sf_dir).select("project_id", "chunk_id", "content")
    even = F.col("project_id").rlike("[02468]$")

    def old_terms(rows: DataFrame, *keep: str) -> DataFrame:
        return rows.select(*keep, F.coalesce(T.content_terms(F.col("content")), F.array().cast("array<string>")).alias("terms"))

    old, old_counts = bm25.build_index(chunks.filter(even), old_terms, "terms-v0")
    new, new_counts = bm25.build_index(chunks.filter(~F.coalesce(even, F.lit(False))), bm25.plain_terms, "plain-v1")
    postings, statistics = bm25.rebuilt_index(old.unionByName(new), old_counts.unionByName(new_counts), chunks, bm25.plain_terms, "plain-v1")
    sizes = postings.groupBy("project_id").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_terms"))
    return statistics.join(sizes, "project_id").select("project_id", "analyzer_version", "n", "n_postings", "n_terms")


def message_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages; turn t of conversation c cites the documents 10 c + t and c, either of which may be missing."""
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"))
    cited = F.array(F.col("session_id") * 10 + F.col("created_at"), F.col("session_id"))
    rows = turns.filter("created_at % 2 = 1").select("message_id", F.posexplode(cited).alias("citation_order", "document_id")).withColumns({"page": F.lit(None).cast("int"), "quoted_text": F.lit("")})
    nested = catalog.messages_with_citations(turns, rows, B.documents(spark, sf_dir))
    names = F.transform("citations", lambda c: F.coalesce(c["filename"], F.lit("?")))
    return nested.select("session_id", "message_id", F.size("citations").cast("long").alias("n_citations"), F.array_join(names, ",").alias("filenames"))


def chunks_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of the project src1 that shares its id with a question: its chunks, whatever its status."""
    ids = B.questions(spark, sf_dir).select(F.col("query_id").alias("document_id"))
    return catalog.chunks_of_documents(B.chunks(spark, sf_dir), "src1", ids).groupBy("document_id").agg(F.count("*").alias("chunks"), F.max("ordinal").cast("long").alias("last"))


def deleted_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = B.statuses(spark, sf_dir).filter("status = 'FAILED'").select("document_id")
    return catalog.deleted_counts(B.chunks(spark, sf_dir), gone)


def joined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of each conversation, in first-seen order."""
    return A.joined_names(read_table(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), "conv_id", "role", "turn")


def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as requests: title, number of questions, question type and source title after defaults; some are blank or out of range."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 3 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), "role", F.lit(" "))).alias("name"))
    kinds = F.array(*[F.lit(x) for x in (" MCQ", "Multiple-Choice", "flash card", "essay")])
    return turns.select(
        "conv_id", "turn", services.is_blank(F.col("name")).alias("refused"), services.session_title(F.col("name")).alias("title"),
        catalog.question_count(F.col("turn") * 7 - 1).cast("long").alias("questions"),
        T.question_type(F.element_at(kinds, (F.col("conv_id") % 4 + 1).cast("int"))).alias("type"),
        services.source_title(F.col("role"), F.when(F.col("turn") % 2 == 1, F.col("turn"))).alias("source"),
    )


def upload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads of their url, of which every third gets an extension that is taken."""
    rows = read_table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".TXT"))).otherwise(F.col("url")).alias("path"), F.coalesce(F.length("html"), F.lit(0)).alias("length"))
    return rows.select("page_id", io.rejection(F.col("path"), F.col("length")).alias("rejected"))


def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as error messages; null texts give the kind of error."""
    rows = B.documents(spark, sf_dir).select("document_id", catalog.safe_message(F.col("text"), F.lit("IOError")).alias("message"))
    return rows.select("document_id", F.length("message").alias("n_chars"), F.md5("message").alias("message_md5"))


def vectors_of_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the project 3, of which every fifth is another model's."""
    rows = _labelled_vectors(spark, sf_dir).withColumn("model", F.when(F.col("chunk_id") % 5 == 0, "other").otherwise("stored"))
    return catalog.vectors_of(rows, 3, "stored").select("chunk_id", F.size("vector").alias("dims"))


def graded_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of conversation 1 as a stored question, answered by the turn after it."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    stored = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("quiz_id"), F.col("turn").alias("question_id"), F.col("text").alias("answer"), after.alias("reply"))
    return catalog.graded_question(stored, 1, 0, F.col("reply")).select("question_id", "correct", "verdict")


def stored_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary of each project's READY documents as it is stored."""
    docs = B.statuses(spark, sf_dir)
    requests = docs.select("project_id").distinct().filter("project_id IS NOT NULL").select(F.col("project_id").alias("request_id"), "project_id", F.lit(None).cast("timestamp").alias("created_at"))
    wanted = docs.filter("status = 'READY'").select(F.col("project_id").alias("request_id"), "document_id")
    rows, cited, _ = services.summarise(requests, wanted, B.chunks(spark, sf_dir), docs)
    return rows.join(cited.groupBy("summary_id").agg(F.count("*").alias("n_citations")), "summary_id", "left").select("project_id", "title", "content", "n_citations")
