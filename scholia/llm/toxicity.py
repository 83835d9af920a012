"""Toxicity: boosted trees over dense text features, with isotonic calibration.

Features per text: densities of a fixed and of an induced lexicon, proximity of
lexicon words to second-person words, capitals, punctuation and obfuscation
rates. The induced lexicon holds words and word openings that labelled toxic
rows have significantly more often; it, the trees and the calibration are
fitted on at most FIT_ROWS labelled rows, chosen by hash. Scoring reads every
whole text in one pass without a shuffle.

Defined results: null and empty texts have the features of no words and get
that score; a null doc_id is kept; repeated rows get equal scores; without
labels of both classes every score is the base rate; empty tables give empty
results. Only the columns named here are read from the inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scholia.llm.learn import BoostedTrees, Isotonic, sigmoid
from scholia.llm.samples import fold, labelled_sample
from scholia.session import as_row, read_table

#: Bound of the labelled rows that the model is fitted on.
FIT_ROWS = 20_000
#: Bound of the induced lexicon.
LEXICON_TERMS = 2_000
#: Log-likelihood ratio and log odds that an induced term must reach.
LEAST_G2, LEAST_ODDS = 25.0, 2.0
FOLDS = 3
THRESHOLD = 0.7
NEAR = 5
CACHE_WORDS = 200_000

LEXICON = frozenset("idiot idiots moron morons loser losers scum trash stupid pathetic worthless disgusting clown clowns dumb imbecile jerk pig vermin garbage filth coward fool freak hate kill shut ugly".split())
SECOND = frozenset("you your yours yourself youre u ur du dich dir dein deine euch ihr tu te toi vous ton ta votre usted ustedes tuyo vos".split())
WORD = re.compile(r"[^\W\d_]+")
_PART = r"A-Za-z0-9@$*!|.\-_"
# Possessive, and tried at the start of a token only: a token of any length is passed over once.
MIXED = re.compile(rf"(?<![{_PART}])[*!|.\-_]*+(?:[A-Za-z]++[0-9@$*!|.\-_]++(?=[{_PART}]*[A-Za-z])[{_PART}]++|[0-9@$]++[A-Za-z][A-Za-z0-9@$*!|]*+)")
LEET = str.maketrans("013457@$!|", "oieastasii", "*.-_")
UPPER, LOWER, MARKS = (np.zeros(256, dtype=bool) for _ in range(3))
UPPER[ord("A") : ord("Z") + 1] = True
LOWER[ord("a") : ord("z") + 1] = True
MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
FEATURES = ("words", "fixed_density", "fixed_hits", "induced_density", "induced_hits", "near_second", "second_density", "capitals", "marks", "exclaims", "mark_run", "mixed", "obfuscated", "word_length")
OPENINGS = (5, 6, 7)


def terms(text: str | None) -> set[str]:
    """Words and word openings of a text; openings end in '-'."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:n] + "-" for w in words for n in OPENINGS if len(w) >= n}


class Features:
    """Feature rows of texts under an induced lexicon. The word cache is bounded."""

    def __init__(self, induced: frozenset[str]):
        self.induced = induced
        self.cache: dict[str, int] = {}

    def kind(self, word: str) -> int:
        """Bits: 1 fixed, 2 induced, 4 second person."""
        got = (word in LEXICON) | (2 * (word in self.induced or any(word[:n] + "-" in self.induced for n in OPENINGS if len(word) >= n))) | 4 * (word in SECOND)
        if len(self.cache) < CACHE_WORDS:
            self.cache[word] = got
        return got

    def row(self, text: str | None) -> list[float]:
        text = text or ""
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        words = WORD.findall(text.lower())
        get, kind = self.cache.get, self.kind
        kinds = [got if (got := get(w)) is not None else kind(w) for w in words]
        tally = Counter(kinds)
        fixed = sum(v for k, v in tally.items() if k & 1)
        induced = sum(v for k, v in tally.items() if k & 2)
        second = sum(v for k, v in tally.items() if k & 4)
        near = 0
        if second and fixed + induced:
            own = np.array(kinds)
            you = np.flatnonzero(own & 4)
            bad = np.flatnonzero(own & 3)
            right = np.searchsorted(you, bad)
            gap = np.minimum(np.abs(bad - you[np.minimum(right, len(you) - 1)]), np.abs(bad - you[np.maximum(right - 1, 0)]))
            near = int((gap <= NEAR).sum())
        mixed = MIXED.findall(text)
        hidden = sum(1 for m in mixed if (w := m.lower().translate(LEET)) in LEXICON or w.rstrip("s") in LEXICON)
        n, size = max(len(words), 1), max(len(raw), 1)
        marks = MARKS[raw] if len(raw) else np.zeros(0, dtype=bool)
        upper, lower = int(UPPER[raw].sum()), int(LOWER[raw].sum())
        edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
        run = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
        return [np.log1p(len(words)), fixed / n, min(fixed, 20), induced / n, min(induced, 20), near / n, second / n, upper / max(upper + lower, 1), marks.sum() / size, text.count("!") / size, min(run, 10), len(mixed) / n, hidden / n, sum(map(len, words)) / n]

    def rows(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.row(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))


class ToxicityModel:
    """score() gives calibrated probabilities; ties within a calibration block keep the trees' order."""

    def __init__(self, induced: frozenset[str], trees: BoostedTrees, calibration: Isotonic):
        self.induced, self.trees, self.calibration = induced, trees, calibration

    def score(self, features: np.ndarray) -> np.ndarray:
        raw = self.trees.decision(features)
        return np.clip(0.99 * self.calibration.predict(raw) + 0.01 * sigmoid(raw), 0.0, 1.0)


def _g2(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float) -> np.ndarray:
    """Log-likelihood ratio of document frequencies a of n_a and b of n_b."""
    def part(k: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        return k * np.log(np.clip(p, 1e-12, 1)) + (n - k) * np.log(np.clip(1 - p, 1e-12, 1))

    both = (a + b) / (n_a + n_b)
    return 2 * (part(a, n_a, a / n_a) + part(b, n_b, b / n_b) - part(a, n_a, both) - part(b, n_b, both))


def induce_lexicon(sample: DataFrame, limit: int = LEXICON_TERMS) -> frozenset[str]:
    """Terms that the toxic rows of sample (text, label) have significantly more often."""
    by_label = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = by_label.get(1, 0), by_label.get(0, 0)
    if not n_bad or not n_good:
        return frozenset()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                tally[label].update(terms(text))
        names = list(tally[1])
        yield pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "bad": pa.array([tally[1][t] for t in names], pa.int64()), "good": pa.array([tally[0][t] for t in names], pa.int64())})
        rest = [t for t in tally[0] if t not in tally[1]]
        # toxic rows of other parts may have them
        yield pa.RecordBatch.from_pydict({"term": pa.array(rest, pa.string()), "bad": pa.array([0] * len(rest), pa.int64()), "good": pa.array([tally[0][t] for t in rest], pa.int64())})

    parts = sample.select("text", "label").mapInArrow(count, "term string, bad long, good long")
    found = parts.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter("bad >= 3 and bad * 2 > good").orderBy(F.desc("bad"), "term").limit(20 * limit).toPandas()
    if not len(found):
        return frozenset()
    bad, good = found["bad"].to_numpy(float), found["good"].to_numpy(float)
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    strength = _g2(bad, good, n_bad, n_good)
    keep = found.assign(strength=strength)[(odds >= LEAST_ODDS) & (strength >= LEAST_G2)].sort_values(["strength", "term"], ascending=[False, True])
    return frozenset(keep["term"].head(limit))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on labelled rows whose crc32 fold is not 1, at most `rows` of them."""
    sample = labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), FOLDS) != 1, rows)
    induced = induce_lexicon(sample)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(induced)
        for batch in batches:
            x = features.rows(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "label": batch.column("label").cast(pa.int32()), "x": pa.array(list(x), pa.list_(pa.float64()))})

    got = sample.mapInArrow(featurise, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id")
    y = got["label"].to_numpy(float)
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(y), len(FEATURES))
    aside = np.arange(len(y)) % 4 == 3
    trees = BoostedTrees().fit(x[~aside], y[~aside])
    return ToxicityModel(induced, trees, Isotonic().fit(trees.decision(x[aside]), y[aside]))


def score(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """The columns `keep` of docs and tox_score, one row per row of docs."""
    schema = StructType([*docs.select(*keep).schema.fields, StructField("tox_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.induced)
        for batch in batches:
            scores = model.score(features.rows(batch.column("tox_text").to_pylist())) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(scores, pa.float64())], names=[*keep, "tox_score"])

    return docs.select(*keep, F.col("text").alias("tox_text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more."""
    rows = docs.select(as_row(docs).alias("row"), "text")
    return score(rows, fit(docs, labels), "row").filter(F.col("tox_score") < threshold).select("row.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    scored = score(docs, model, "doc_id")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 1).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict = {}
