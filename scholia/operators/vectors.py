"""Vectors: hashing embeddings as sparse rows, dense dot products, means, exact top-k, codecs, embedders."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.text import matching_tokens

DIMENSIONS = 1024
FLOOR = {"hashing": 0.08, "minilm": 0.25}
#: A query vector of 1024 doubles is 8 kB, so at most 8 MB are broadcast; beyond it the query side is shuffled.
BROADCAST_QUERIES = 1_000
_MASK = 4294967295
FEATURES = T.ArrayType(T.StructType().add("dim", "integer").add("weight", "double"))
# The two multipliers and three shifts of the 32-bit finaliser.
_FIRST, _SECOND = 0x85EBCA6B, 0xC2B2AE35


def _times(h: Column, c: int) -> Column:
    """h * c modulo 2^32 within 63 bits."""
    low = h.bitwiseAND(65535) * c
    high = F.shiftleft((F.shiftrightunsigned(h, 16) * c).bitwiseAND(65535), 16)
    return (low + high).bitwiseAND(_MASK)


def mixed(h: Column) -> Column:
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 16))
    h = _times(h, _FIRST)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 13))
    h = _times(h, _SECOND)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def string_hash(text: Column) -> Column:
    """31-polynomial of the characters modulo 2^32 (code points; the same for the basic plane)."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("bigint"), lambda a, c: (a * 31 + c).bitwiseAND(_MASK))


def hashed_features(rows: DataFrame, key: str = "id", text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, dim, weight): L2-normalised sparse hashing embeddings of unigrams and half-weight bigrams.

    Each distinct feature is hashed once. Rows without features, or whose
    features cancel out, have no rows: the zero vector.
    """
    if dimensions < 16:
        raise ValueError("at least 16 dimensions")
    tokens = rows.select(key, matching_tokens(F.col(text)).alias("tokens"))
    single = tokens.select(key, F.explode("tokens").alias("feature"), F.lit(1.0).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.concat_ws(" ", F.element_at("tokens", i), F.element_at("tokens", i + 1)))
    double = tokens.filter(F.size("tokens") > 1).select(key, F.explode(pairs).alias("feature"), F.lit(0.5).alias("w"))
    counted = single.unionByName(double).groupBy(key, "feature").agg(F.sum("w").alias("w"))
    hashed = counted.select("feature").distinct().withColumn("h", mixed(string_hash(F.col("feature")))).withColumn("sign", F.when(mixed(F.col("h")).bitwiseAND(1) == 0, 1.0).otherwise(-1.0))
    signed = F.when(F.col("h") >= 2147483648, F.col("h") - 4294967296).otherwise(F.col("h"))
    hashed = hashed.select("feature", F.pmod(signed, F.lit(dimensions)).cast("int").alias("dim"), "sign")
    summed = counted.join(hashed, "feature").groupBy(key, "dim").agg(F.sum(F.col("w") * F.col("sign")).alias("w")).filter("w <> 0")
    norm = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return summed.join(norm, key).select(key, "dim", (F.col("w") / F.col("norm")).alias("weight"))


def _mixed_array(h: np.ndarray) -> np.ndarray:
    """mixed of 32-bit numbers held in 64 bits."""
    for shift, factor in ((16, _FIRST), (13, _SECOND)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor) & np.uint64(_MASK)
    return h ^ (h >> np.uint64(16))


def feature_lists(rows: DataFrame, key: str = "id", text: str = "text", dimensions: int = DIMENSIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, key, features): what hashed_features gives as rows, as one list per row (dim, weight), by dimension; the zero vector is empty.

    A row is hashed where it lies. The hash of two words follows from theirs, so
    only the distinct words of a batch are read letter by letter.
    """
    if dimensions < 16:
        raise ValueError("at least 16 dimensions")
    names = [*keep, key]
    schema = T.StructType([*rows.select(*names).schema.fields]).add("features", FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(_MASK)
        for batch in batches:
            lists = batch.column("tokens")
            coded = lists.flatten().dictionary_encode()
            words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            own = np.zeros(len(words), np.uint64)
            for i, word in enumerate(words):
                h = 0
                for c in word:
                    h = (h * 31 + ord(c)) & _MASK
                own[i] = h
            power = np.array([pow(31, len(w), 1 << 32) for w in words], np.uint64)
            owner = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            first = np.flatnonzero(owner[1:] == owner[:-1])
            a, b = place[first], place[first + 1]
            # "a b" is a, a blank, then b: 31 to the length of b moves what stands before it.
            double = ((own[a] * np.uint64(31) + np.uint64(32) & mask) * power[b] + own[b]) & mask
            h = _mixed_array(np.concatenate([own[place], double]))
            weight = np.concatenate([np.ones(len(place)), np.full(len(first), 0.5)]) * np.where(_mixed_array(h) & np.uint64(1) == 0, 1.0, -1.0)
            signed = h.astype(np.int64) - np.where(h >= 1 << 31, 1 << 32, 0)
            cells, at = np.unique(np.concatenate([owner, owner[first]]) * dimensions + signed % dimensions, return_inverse=True)
            summed = np.bincount(at, weight, len(cells))
            cells, summed = cells[summed != 0], summed[summed != 0]
            norm = np.sqrt(np.bincount(cells // dimensions, summed * summed, batch.num_rows))
            pairs = pa.StructArray.from_arrays([pa.array(cells % dimensions, pa.int32()), pa.array(summed / norm[cells // dimensions])], ["dim", "weight"])
            ends = np.searchsorted(cells // dimensions, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], [*names, "features"])

    tokens = F.coalesce(matching_tokens(F.col(text)), F.array().cast("array<string>"))
    return rows.select(*names, tokens.alias("tokens")).mapInArrow(run, schema)


def hash_embed(text: str, dimensions: int = DIMENSIONS, tokens: Callable[[str], list[str]] | None = None) -> np.ndarray:
    """The same embedding of one text, dense, for sequential steps inside Arrow functions."""
    from scholia.operators.sentences import matching_words

    own = (tokens or matching_words)(text)
    out = np.zeros(dimensions)
    for feature, weight in [*((t, 1.0) for t in own), *((f"{a} {b}", 0.5) for a, b in zip(own, own[1:], strict=False))]:
        h = 0
        for unit in struct.unpack(f"<{len(feature.encode('utf-16-le')) // 2}H", feature.encode("utf-16-le")):
            h = (h * 31 + unit) & _MASK
        h = _mixed_int(h)
        signed = h - (1 << 32) if h >= 1 << 31 else h
        out[signed % dimensions] += weight if _mixed_int(h) & 1 == 0 else -weight
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


def _mixed_int(h: int) -> int:
    h ^= h >> 16
    h = h * _FIRST & _MASK
    h ^= h >> 13
    h = h * _SECOND & _MASK
    return h ^ h >> 16


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double; vectors of different length raise nothing and give null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def normalised(vector: Column) -> Column:
    """Unit length; the zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def mean_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): the mean per group, at unit length; sums combine before the shuffle."""
    parts = rows.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("parts"))
    return lists.select(group, normalised(F.transform("parts", lambda p: p["x"])).alias("centroid"))


def vector_topk(queries: DataFrame, rows: DataFrame, k: int, project: str = "project_id", key: str = "chunk_id") -> DataFrame:
    """(query_id, project, key, score, rank): exact top k by dot product within the query's project.

    queries: (query_id, project, qvector), a stated set, broadcast when counted
    to be few; rows: (project, key, vector). Vectors of another size are passed
    over. Each row meets the queries of its own project only.
    """
    side = F.broadcast(queries) if queries.count() <= BROADCAST_QUERIES else queries
    scored = rows.join(side, project).filter(F.size("vector") == F.size("qvector")).select("query_id", project, key, F.round(dot(F.col("qvector"), F.col("vector")), 6).alias("score"))
    order = Window.partitionBy("query_id", project).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to vectors."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(T.BinaryType())
def to_bytes(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def dense_form(dimensions: int) -> Callable[[Column], Column]:
    """A column function: lists (dim, weight) as vectors of so many floats."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(features: pa.Array) -> pa.Array:
        pairs, row = features.flatten(), pc.list_parent_indices(features).to_numpy()
        out = np.zeros((len(features), dimensions), np.float32)
        out[row, pairs.field("dim").to_numpy()] = pairs.field("weight").to_numpy()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(features) + 1) * dimensions, pa.int32()), pa.array(out.ravel()))

    return run


#: The whole vectors of an embedder, where it can give a row as one list: (rows, key, text, dimensions, keep).
LISTS: dict[Callable[..., DataFrame], Callable[..., DataFrame]] = {hashed_features: feature_lists}

#: Embedders by name: functions of (rows, key, text) that give sparse rows.
EMBEDDERS: dict[str, Callable[..., DataFrame]] = {"hashing": hashed_features}


def embedder(name: str) -> Callable[..., DataFrame]:
    """A registered embedder. Model weights are not shipped: `local` must be registered by the user."""
    if name in ("local", "minilm") and name not in EMBEDDERS:
        raise LookupError(f"embedder {name!r} needs model weights; register a function in EMBEDDERS")
    return EMBEDDERS[name]
