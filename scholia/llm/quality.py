"""Quality: naive Bayes support vectors over hashed n-gram indicators.

Features are indicators of byte n-grams, of words and word pairs, and of bins
of the shares of repeated five-word runs and of repeated neighbouring words and
of the length. Log-count ratios of
the two classes scale the indicators, a linear hinge-loss model is fitted on
them by dual coordinate descent, and isotonic calibration turns margins into
probabilities. The model is fitted on at most FIT_ROWS labelled rows, chosen by
hash; scoring reads every whole text in one pass without a shuffle.

Defined results: null and empty texts have only the bin features and get the
score of those; a null doc_id is kept; repeated rows get equal scores; without
labels of both classes every score is the base rate; empty tables give empty
results. Only the columns named here are read from the inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scholia.llm.learn import Isotonic, hinge_dual, sigmoid
from scholia.llm.samples import fold, labelled_sample
from scholia.llm.wordhash import U, chunks, mix, ngrams, raw_bytes, word_hashes, word_spans
from scholia.session import read_table

#: Bound of the labelled rows that the model is fitted on.
FIT_ROWS = 12_000
BITS = 16
WIDTH = 1 << BITS
FOLDS = 5
THRESHOLD = 0.3
SMOOTH = 1.0
CHUNK = 1_000_000


def _bins(values: np.ndarray, edges: list[float], label: int) -> np.ndarray:
    return mix(np.searchsorted(np.array(edges), values, side="right").astype(U) + U(label * 1000 + 17))


def indicators(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, feature of each entry, entries per row): distinct features by row, sorted."""
    data, offsets = raw_bytes(texts)
    for first, last in chunks(offsets, CHUNK):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        n = last - first
        sizes = np.diff(at)
        row_of = np.repeat(np.arange(n, dtype=np.uint32), sizes)
        starts, ends, counts = word_spans(part, at)
        words = word_hashes(part, starts, ends)
        keys = []
        for width in (2, 3):
            if len(part) >= width:
                code = np.zeros(len(part) - width + 1, dtype=np.uint32)
                for k in range(width):
                    code = (code << np.uint32(8)) | part[k : len(part) - width + 1 + k]
                code = (code * np.uint32(2654435761) + np.uint32(width * 0x9E3779B)) >> np.uint32(32 - BITS)
                whole = row_of[: len(code)] == row_of[width - 1 :]
                keys.append((row_of[: len(code)][whole] << np.uint32(BITS)) | code[whole])
        for size in (1, 2):
            grams, rows = ngrams(words, counts, size)
            keys.append((rows.astype(np.uint32) << np.uint32(BITS)) | ((grams + U(size)) >> U(64 - BITS)).astype(np.uint32))
        five, five_rows = ngrams(words, counts, 5)
        total = np.bincount(five_rows, minlength=n)
        order = np.lexsort((five, five_rows))
        same = np.zeros(len(five), dtype=bool)
        same[1:] = (five[order][1:] == five[order][:-1]) & (five_rows[order][1:] == five_rows[order][:-1])
        repeated = np.bincount(five_rows[order][same], minlength=n) / np.maximum(total, 1)
        word_rows = np.repeat(np.arange(n), counts)
        twice = (words[1:] == words[:-1]) & (word_rows[1:] == word_rows[:-1])
        twins = np.bincount(word_rows[1:][twice], minlength=n) / np.maximum(counts, 1)
        shares = [0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95]
        for values, edges, label in ((twins, shares, 4), (repeated, shares, 1), (np.log2(1.0 + counts), [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12], 2), (np.log2(1.0 + sizes), [1, 3, 5, 7, 9, 11, 13, 15], 3)):
            keys.append((np.arange(n, dtype=np.uint32) << np.uint32(BITS)) | (_bins(values, edges, label) >> U(64 - BITS)).astype(np.uint32))
        entries = np.unique(np.concatenate(keys))  # a chunk has fewer rows than the high bits hold
        yield first, last, (entries & np.uint32(WIDTH - 1)).astype(np.int64), np.bincount(entries >> np.uint32(BITS), minlength=n)


class QualityModel:
    """Weights per feature (ratio times hinge weight), bias and calibration."""

    def __init__(self, weights: np.ndarray, bias: float, calibration: Isotonic):
        self.weights, self.bias, self.calibration = weights, bias, calibration

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, last, features, counts in indicators(texts):
            rows = np.repeat(np.arange(last - first), counts)
            out[first:last] = np.bincount(rows, weights=self.weights[features], minlength=last - first) / np.sqrt(np.maximum(counts, 1)) + self.bias
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        margins = self.margins(texts)
        return np.clip(0.99 * self.calibration.predict(margins) + 0.01 * sigmoid(margins), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel:
    """Fit on labelled rows whose crc32 fold is not 0, at most `rows` of them."""
    sample = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), FOLDS) != 0, rows)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, features, counts in indicators(batch.column("text")):
                cut = np.concatenate(([0], np.cumsum(counts)))
                packed = [features[a:b].astype(np.uint16).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, last - first).cast(pa.int64()), "label": batch.column("label").slice(first, last - first).cast(pa.int32()), "x": pa.array(packed, pa.binary())})

    got = sample.mapInArrow(featurise, "doc_id long, label int, x binary").toArrow().sort_by("doc_id")
    y = got.column("label").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        rate = float(y.mean()) if len(y) else 0.5
        return QualityModel(np.zeros(WIDTH), 0.0, Isotonic().fit(np.zeros(1), np.array([rate])))
    # The features stay two bytes each, end to end; rows are slices.
    packed = got.column("x").combine_chunks()
    starts = np.concatenate(([0], np.cumsum([len(x.as_buffer()) // 2 for x in packed])))
    flat = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in packed])
    del got, packed
    rows_of = [flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    aside = np.arange(len(y)) % 4 == 3
    t = np.where(y == 1, 1.0, -1.0)
    counts, sides = {}, {}
    for side in (1.0, -1.0):
        mine = np.flatnonzero(~aside & (t == side))
        counts[side], sides[side] = np.full(WIDTH, SMOOTH), len(mine) + 2 * SMOOTH
        for i in mine:
            counts[side][rows_of[i]] += 1
    ratio = np.log(counts[1.0] / sides[1.0]) - np.log(counts[-1.0] / sides[-1.0])
    fitted = np.flatnonzero(~aside)
    own_starts = np.concatenate(([0], np.cumsum([len(rows_of[i]) for i in fitted])))
    own_flat = np.concatenate([rows_of[i] for i in fitted])
    weights, bias = hinge_dual(own_flat, own_starts, ratio, 1.0 / np.sqrt(np.maximum(np.diff(own_starts), 1)), t[fitted])
    model = QualityModel(ratio * weights, bias, Isotonic())
    margins = [model.weights[rows_of[i]].sum() / np.sqrt(max(len(rows_of[i]), 1)) + bias for i in np.flatnonzero(aside)]
    model.calibration.fit(np.array(margins), y[aside])
    return model


def score(docs: DataFrame, model: QualityModel, *keep: str) -> DataFrame:
    """The columns `keep` of docs and quality_score, one row per row of docs."""
    schema = StructType([*docs.select(*keep).schema.fields, StructField("quality_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(model.score(batch.column("quality_text")), pa.float64())], names=[*keep, "quality_score"])

    return docs.select(*keep, F.col("text").alias("quality_text")).mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")), "doc_id")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict = {}
