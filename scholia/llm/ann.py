"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is projected on HASHES Gaussian directions. Within a block of rows
each projection is one sorted array; around a query's own projection a window
grows by virtual rehashing (its width doubles each round). A vector that falls
into the windows of THRESHOLD or more projections is verified by its exact
distance. A query stops when k verified vectors lie within what the round's
radius guarantees, or when all rows of the block are verified.

Queries and rows are both dealt into blocks by length and hash, and each pair of a query
block and a row block is one task: nothing is broadcast, no row pairs are
emitted, and equal vectors are compared once per block (only their k + 1
smallest ids can be among k nearest). Block results merge by a top-k per query.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id; vectors are searched among
those of their own length; ties go to the smaller id; equal rows count once;
rows that repeat an id with other vectors are rows of their own, and such queries
have k results each; rows of a query's own id are none of its results; fewer than
k candidates give them all; empty tables give empty results. Only the id and the vector column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.session import Scratch, checkpointed, read_table

HASHES = 48
#: Share of the projections in which a candidate must collide.
THRESHOLD = 0.5
BLOCK_ROWS = 10_000
BLOCK_QUERIES = 2_000
SEED = 20_240_607
#: A query goes on until its windows are this many times as wide as its k-th distance asks for.
SUCCESS_MARGIN = 1.3


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


class ProjectionIndex:
    """Sorted arrays of one block: distinct vectors, each with its smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, hashes: int = HASHES, seed: int = SEED):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        fresh = np.ones(len(ids), dtype=bool)
        fresh[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        starts = np.flatnonzero(fresh)
        self.vectors = vectors[starts]
        ends = np.append(starts[1:], len(ids))
        self.ids = [ids[a : min(b, a + k + 1)] for a, b in zip(starts, ends, strict=True)]
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], hashes))
        projected = self.vectors @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=0)
        self.hashes, self.k = hashes, k
        self.need = int(np.ceil(THRESHOLD * hashes))
        spread = self.sorted[-1] - self.sorted[0] if len(starts) else np.zeros(hashes)
        self.first_width = float(max(np.median(spread) / 256, 1e-12))

    def search(self, query: np.ndarray, own: int) -> list[tuple[float, int]]:
        """The k nearest found, other than id own, as (distance, id)."""
        n = len(self.vectors)
        at = query @ self.directions
        counts = np.zeros(n, dtype=np.int32)
        low = high = np.array([np.searchsorted(self.sorted[:, j], at[j]) for j in range(self.hashes)])
        low, high = low.copy(), high.copy()
        distance = np.full(n, np.inf)
        verified = np.zeros(n, dtype=bool)
        width = self.first_width
        best: list[tuple[float, int]] = []
        while True:
            for j in range(self.hashes):
                column = self.sorted[:, j]
                a, b = np.searchsorted(column, at[j] - width, side="left"), np.searchsorted(column, at[j] + width, side="right")
                if a < low[j]:
                    counts[self.order[a : low[j], j]] += 1
                if b > high[j]:
                    counts[self.order[high[j] : b, j]] += 1
                low[j], high[j] = min(a, low[j]), max(b, high[j])
            new = np.flatnonzero((counts >= self.need) & ~verified)
            if len(new):
                verified[new] = True
                distance[new] = np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1))
            everything = bool(verified.all())
            if verified.sum() > 0:
                near = np.flatnonzero(verified)
                if len(near) > 4 * (self.k + 1):
                    cut = np.partition(distance[near], self.k)[self.k]
                    near = near[distance[near] <= cut]
                best = sorted((float(distance[v]), int(i)) for v in near for i in self.ids[v] if i != own)[: self.k]
            # At this width a vector at distance width / 0.6745 collides in half of the projections.
            if everything or (len(best) == self.k and best[-1][0] * 0.6745 * SUCCESS_MARGIN <= width):
                return best
            if bool((low == 0).all() and (high == n).all()):
                counts[:] = self.hashes
            width *= 1.5


def nearest(rows: DataFrame, queries: DataFrame, k: int, scratch: Scratch, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, itself excepted."""
    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).distinct()

    points = scratch.write(clean(rows), "points")
    asked = scratch.write(clean(queries).withColumn("q", F.monotonically_increasing_id()), "asked")
    row_blocks = max(1, -(-points.count() // block_rows))
    query_blocks = max(1, -(-asked.count() // block_queries))
    dealt = points.select(F.lit(False).alias("asks"), F.lit(0).cast("long").alias("q"), "id", F.size("v").alias("width"), "v", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    dealt = dealt.unionByName(asked.select(F.lit(True).alias("asks"), "q", "id", F.size("v").alias("width"), "v", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), F.pmod(F.xxhash64(F.col("id") + 1), F.lit(query_blocks)).cast("int").alias("qb")))

    def run(key_: tuple, table: pa.Table) -> pa.Table:
        ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        if asks.all() or not asks.any():
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in ("q", "query_id", "vec_id", "score")})
        vectors = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        index = ProjectionIndex(ids[~asks], vectors[~asks], k)
        out: list[tuple[int, int, int, float]] = []
        for q, own, query in zip(table.column("q").to_numpy()[asks], ids[asks], vectors[asks], strict=True):
            out += [(int(q), int(own), i, d) for d, i in index.search(query, int(own))]
        return pa.table({"q": pa.array([x[0] for x in out], pa.int64()), "query_id": pa.array([x[1] for x in out], pa.int64()), "vec_id": pa.array([x[2] for x in out], pa.int64()), "score": pa.array([x[3] for x in out], pa.float64())})

    found = dealt.groupBy("width", "rb", "qb").applyInArrow(run, "q long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "ann")
    rows = read_table(spark, sf_dir, "embeddings")
    result = checkpointed(nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), 10, scratch))
    scratch.drop()
    return result


QUERIES = {"op6_ann": op6_ann}
ORACLES: dict = {}
