"""Language-model scoring: stupid-backoff scores from n-gram count tables partitioned by hash.

Documents are laid into blocks, which hold their words as places in the block's
own vocabulary of word hashes, not the texts again. A block asks for the counts
of its distinct n-grams: one row per hash range holds their sorted hashes, as
differences, and how often the block has them. A range adds up what all blocks have and answers each block in
the same order, so an answer carries counts alone. The answers then meet their
block, whose n-grams look up their counts and are summed per document. A
frequent n-gram is one entry per block, so no key is hot.

The score of a word is c(n-gram) / c(prefix) for the longest n-gram of up to
ORDER words that the corpus has LEAST times or more (single words: any number),
times BACKOFF for each word of context given up; single words have c / N. A
document's score is the sum of logarithms. Counts are over all documents, so
every n-gram of a scored document is in them; LEAST = 2 asks for one more
occurrence than the document's own, and `least=1` for none.

Defined results: null and empty texts have no words, a sum of 0 and a null
mean; a null doc_id is kept; repeated rows are counted and scored each; empty
tables give empty results; ids keep their type. Words are runs of other than
ASCII white space. count_table gives the counts themselves. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.wordhash import U, chunks, hashed, ngrams, raw_bytes
from scholia.session import Scratch, checkpointed, read_table, settings

ORDER = 3
BACKOFF = 0.4
LEAST = 2
BLOCK_BYTES = 4_000_000
BLOCK_ROWS = 20_000
#: A range of hashes for every so many blocks keeps what one range holds alike at every size.
BLOCKS_PER_RANGE = 4
#: Words are hashed in pieces of so many bytes; hashing takes about 40 times as much memory.
HASH_BYTES = 500_000
CODEC = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(CODEC.decompress(packed[8:], 8 * n, asbytes=True), dtype=np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=U(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=U)


def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of few rows, for rows of megabytes."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, ids, vocabulary, places, counts, words) of docs (id, text), one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = raw_bytes(batch.column("text"))
            for first, last in chunks(offsets, BLOCK_BYTES, BLOCK_ROWS):
                own = batch.slice(first, last - first)
                words, counts = block_words(own.column("text"))
                vocabulary, places = np.unique(words, return_inverse=True)
                ids = pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), own.column("id"))
                packed = [pa.array([x], pa.binary()) for x in (pack_sorted(vocabulary), pack(places), pack(counts))]
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), ids, *packed, pa.array([len(words)], pa.int64())], names=["block", "ids", "vocabulary", "places", "counts", "words"])
                number += 1

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"block long, ids array<{kind}>, vocabulary binary, places binary, counts binary, words long")


def block_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, in order, and the words per row."""
    parts = [(words, counts) for _, _, words, counts in hashed(texts, HASH_BYTES)]
    return np.concatenate([np.zeros(0, dtype=U), *[p[0] for p in parts]]), np.concatenate([np.zeros(0, dtype=np.int64), *[p[1] for p in parts]])


def unpacked_block(vocabulary: bytes, places: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What block_words gave."""
    return unpack_sorted(vocabulary)[unpack(places).astype(np.int64)], unpack(counts).astype(np.int64)


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges ascend with the hash, so sorted hashes have sorted ranges."""
    return ((hashes >> U(32)) * U(ranges)) >> U(32)


def asked_counts(blocks: DataFrame, orders: list[int], ranges: int) -> DataFrame:
    """(range, block, n, hashes, times): what each block asks of each range, and adds to it, for n in orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = unpacked_block(row["vocabulary"], row["places"], row["counts"])
                for n in orders:
                    own, times = np.unique(ngrams(words, counts, n)[0], return_counts=True)
                    if not len(own):
                        continue
                    place = _range_of(own, ranges)
                    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                    ends = np.append(cut[1:], len(own))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(place[cut].astype(np.int64)),
                            pa.array([row["block"]] * len(cut), pa.int64()),
                            pa.array([n] * len(cut), pa.int32()),
                            pa.array([pack_sorted(own[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()),
                            pa.array([pack(times[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()),
                        ],
                        names=["range", "block", "n", "hashes", "times"],
                    )

    return blocks.select("block", "vocabulary", "places", "counts").mapInArrow(run, "range long, block long, n int, hashes binary, times binary")


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (range, n), which come one after the other."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and (held[-1]["range"], held[-1]["n"]) != (r["range"], r["n"]):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def range_totals(held: list[dict]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(distinct hashes, the place of each asked hash among them by row, how often all blocks have them)."""
    hashes = [unpack_sorted(r["hashes"]) for r in held]
    grams, where = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = np.bincount(where, weights=np.concatenate([unpack(r["times"]) for r in held]), minlength=len(grams))
    cut = np.cumsum([0, *map(len, hashes)])
    return grams, [where[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], sums


def answered_counts(asked: DataFrame) -> DataFrame:
    """(block, n, range, counts): corpus counts in the order of the hashes asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_range(batches):
            _, places, sums = range_totals(held)
            yield pa.RecordBatch.from_arrays([pa.array([r["block"] for r in held], pa.int64()), pa.array([r["n"] for r in held], pa.int32()), pa.array([r["range"] for r in held], pa.int64()), pa.array([pack(sums[own]) for own in places], pa.binary())], names=["block", "n", "range", "counts"])

    return asked.repartition("range", "n").sortWithinPartitions("range", "n").mapInArrow(run, "block long, n int, range long, counts binary")


def score_blocks(blocks: DataFrame, answers: DataFrame, total: int, order: int, backoff: float = BACKOFF, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, log_score) of every document of the blocks."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, scores, sizes = [], [], []
        tables: dict[int, np.ndarray] = {}
        for n in range(1, order + 1):
            own = [r for r in right.to_pylist() if r["n"] == n]
            parts = [unpack(r["counts"]) for r in sorted(own, key=lambda r: r["range"])]
            tables[n] = np.concatenate(parts).astype(float) if parts else np.zeros(0)
        for i in range(left.num_rows):
            words_at, counts = unpacked_block(*(left.column(c)[i].as_py() for c in ("vocabulary", "places", "counts")))
            per = {n: tables[n][np.unique(ngrams(words_at, counts, n)[0], return_inverse=True)[1]] for n in range(1, order + 1)}
            words = int(counts.sum())
            ends = np.cumsum(counts)
            inside = np.arange(words) - np.repeat(ends - counts, counts)  # words of context at hand
            value = per[1] / total
            settled = np.zeros(words, dtype=bool)
            penalty = np.minimum(inside, order - 1)
            out = np.log(value, where=value > 0, out=np.zeros(words)) + penalty * np.log(backoff)
            for n in range(order, 1, -1):
                last = np.flatnonzero(inside >= n - 1)  # the last words of the n-grams, in order
                before = np.flatnonzero((inside >= n - 2) & (np.repeat(ends, counts) - 1 > np.arange(words)))
                lower = np.zeros(words)
                lower[np.flatnonzero(inside >= n - 2)] = per[n - 1]
                ratio = per[n] / np.maximum(lower[before], 1.0)
                use = (per[n] >= least) & ~settled[last]
                at = last[use]
                out[at] = np.log(ratio[use]) + (penalty[at] - (n - 1)) * np.log(backoff)
                settled[at] = True
            rows = np.repeat(np.arange(len(counts)), counts)
            scores.append(np.bincount(rows, weights=out, minlength=len(counts)))
            sizes.append(counts)
            ids.append(left.column("ids").combine_chunks()[i].values)
        return pa.table({"doc_id": pa.chunked_array(ids, left.schema.field("ids").type.value_type), "n_words": pa.array(np.concatenate([*sizes, np.zeros(0)]).astype(np.int64)), "log_score": pa.array(np.concatenate([*scores, np.zeros(0)]))})

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.select("block", "ids", "vocabulary", "places", "counts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id {kind}, n_words long, log_score double")


def backoff_scores(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", order: int = ORDER, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) per row of docs; doc_id has the type of key."""
    spark = docs.sparkSession
    blocks = scratch.write(blocks_of(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))), "blocks")
    facts = blocks.agg(F.count("*").alias("n"), F.sum("words").alias("words")).first()
    with small_batches(spark, 16):
        # One order after the other, so that the shuffle files of one are gone before the next.
        ranges = max(16, facts["n"] // BLOCKS_PER_RANGE)
        answers = [scratch.write(answered_counts(asked_counts(blocks, [n], ranges)), f"answers{n}") for n in range(1, order + 1)]
        scored = scratch.write(score_blocks(blocks, reduce(DataFrame.unionByName, answers), facts["words"] or 1, order, least=least), "scores")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def count_table(docs: DataFrame, scratch: Scratch, text: str = "text", order: int = ORDER) -> DataFrame:
    """(n, gram, count): how often the documents have each n-gram of 1 to order words, by its 64-bit hash."""
    blocks = scratch.write(blocks_of(docs.select(F.lit(None).cast("long").alias("id"), F.col(text).alias("text"))), "count-blocks")
    with small_batches(docs.sparkSession, 16):
        asked = asked_counts(blocks, list(range(1, order + 1)), max(16, blocks.count() // BLOCKS_PER_RANGE))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in by_range(batches):
                grams, _, sums = range_totals(held)
                yield pa.RecordBatch.from_arrays([pa.array([held[0]["n"]] * len(grams), pa.int32()), pa.array(grams.view(np.int64)), pa.array(sums.astype(np.int64))], names=["n", "gram", "count"])

        ranged = asked.repartition("range", "n").sortWithinPartitions("range", "n")
        return scratch.write(ranged.mapInArrow(run, "n int, gram long, count long"), "counts")


def op5_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "lmscore")
    scored = backoff_scores(read_table(spark, sf_dir, "documents"), scratch)
    result = checkpointed(scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score")))
    scratch.drop()
    return result


OP5_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), places AS (
  SELECT row_id, unnest(range(1, len(words) + 1)) AS i, words FROM texts
), grams AS (
  SELECT row_id, i, words[i] AS w1, CASE WHEN i > 1 THEN words[i - 1] END AS w2, CASE WHEN i > 2 THEN words[i - 2] END AS w3 FROM places
), ones AS (SELECT w1, count(*) AS n FROM grams GROUP BY ALL
), twos AS (SELECT w2, w1, count(*) AS n FROM grams WHERE i > 1 GROUP BY ALL
), threes AS (SELECT w3, w2, w1, count(*) AS n FROM grams WHERE i > 2 GROUP BY ALL
), scored AS (
  SELECT g.row_id, CASE
    WHEN three.n >= 2 THEN ln(three.n / before_two.n)
    WHEN two.n >= 2 THEN ln(two.n / before_one.n) + CASE WHEN g.i > 2 THEN ln(0.4) ELSE 0 END
    ELSE ln(one.n / (SELECT sum(n) FROM ones)) + least(g.i - 1, 2) * ln(0.4) END AS s
  FROM grams g JOIN ones one ON one.w1 = g.w1
    LEFT JOIN twos two ON two.w2 = g.w2 AND two.w1 = g.w1
    LEFT JOIN ones before_one ON before_one.w1 = g.w2
    LEFT JOIN threes three ON three.w3 = g.w3 AND three.w2 = g.w2 AND three.w1 = g.w1
    LEFT JOIN twos before_two ON before_two.w2 = g.w3 AND before_two.w1 = g.w2
), sums AS (SELECT row_id, sum(s) AS s FROM scored GROUP BY row_id)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, round(coalesce(s.s, 0.0), 6) AS log_score,
  CASE WHEN len(t.words) > 0 THEN round(s.s / len(t.words), 6) END AS mean_log_score
FROM texts t LEFT JOIN sums s ON s.row_id = t.row_id
"""

QUERIES = {"op5_lmscore": op5_lmscore}
ORACLES = {"op5_lmscore": OP5_SQL}
