"""Centroid clustering with annulus search over integer vectors.

The centroids (a parameter's number of them) are sorted by norm. A vector's
exact distance to the centroid of nearest norm bounds its distance to the
nearest one, so by the triangle inequality every centroid that can be as near,
ties included, has a norm within that bound of the vector's own: two binary
searches give the annulus, and only its centroids are compared, exactly, in
whole numbers. The bound needs no state of the round before, so a round is one
pass over the written vectors: tasks emit sums and counts per centroid, Spark
adds them up, and the driver holds k centroids and nothing else.

Defined results: vectors that are null, of another length, or hold null or
non-finite components take no part; a null vec_id is hashed as empty text and
kept; rows that repeat a vec_id or a vector each count; of equal hashes the
smaller vector starts first; with fewer than k vectors there are as many
centroids; ties go to the smaller number; an empty table gives an empty result;
further columns are not read. Components of 2**26 and more are compared with
unbounded integers; a component, distance or sum beyond a long is taken as the
largest (or least) long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.session import Scratch, read_table

WIDTH = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
#: With components below this, squared distances over 64 of them stay within 63 bits.
NARROW = 2**26
LONGEST = 2**63 - 1


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): v holds floor(scale * x) of each component, of whole vectors only."""
    own = F.col(vector).cast("array<double>")
    finite = F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.filter(F.col(vector).isNotNull() & (F.size(vector) == width)).filter(finite)
    return whole.select(F.col(key).alias("vec_id"), F.transform(own, lambda x: F.floor(x * float(scale))).alias("v"))


def is_narrow(rows: np.ndarray) -> bool:
    return bool(((rows > -NARROW) & (rows < NARROW)).all())


class Annulus:
    """Nearest of k centroids, exactly; `compared` counts the distances taken."""

    def __init__(self, centroids: list[list[int]]):
        self.wide = any(abs(x) >= NARROW for c in centroids for x in c)
        self.norms = np.array([float(sum(x * x for x in c)) ** 0.5 for c in centroids])
        self.order = np.argsort(self.norms, kind="stable")
        self.norms = self.norms[self.order]
        self.exact = np.array(centroids, dtype=object)
        self.narrow = None if self.wide else np.array(centroids, dtype=np.int64)
        self.compared = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row of vectors, whole numbers of any size."""
        small = self.narrow is not None and is_narrow(vectors)
        points, centroids = (vectors.astype(np.int64), self.narrow) if small else (vectors.astype(object), self.exact)
        n, k = len(points), len(centroids)

        def squared(rows: np.ndarray, number: int) -> np.ndarray:
            self.compared += len(rows)
            gap = points[rows] - centroids[number]
            return (gap * gap).sum(axis=1)

        norms = np.sqrt((points.astype(float) ** 2).sum(axis=1))
        right = np.clip(np.searchsorted(self.norms, norms), 0, k - 1)
        left = np.maximum(right - 1, 0)
        start = np.where(np.abs(self.norms[left] - norms) <= np.abs(self.norms[right] - norms), left, right)
        best, number = np.empty(n, dtype=points.dtype), self.order[start].copy()
        for rank in np.unique(start):
            rows = np.flatnonzero(start == rank)
            best[rows] = squared(rows, int(self.order[rank]))
        bound = np.sqrt(best.astype(float))
        # Norms are rounded, so the annulus is a little wider than the bound.
        slack = 1e-9 * (norms + bound + self.norms[-1]) + 1e-9
        low = np.searchsorted(self.norms, norms - bound - slack, side="left")
        high = np.searchsorted(self.norms, norms + bound + slack, side="right")
        for rank in range(k):
            rows = np.flatnonzero((low <= rank) & (rank < high) & (start != rank))
            if len(rows):
                c = int(self.order[rank])
                got = squared(rows, c)
                better = (got < best[rows]) | ((got == best[rows]) & (c < number[rows]))
                best[rows[better]], number[rows[better]] = got[better], c
        return number, best


def _integers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(vectors: DataFrame, centroids: list[list[int]], width: int) -> DataFrame:
    """(cluster, dim, total, n) summed over all vectors; every task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Annulus(centroids)
        totals, counts = np.zeros((len(centroids), width), dtype=object), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            rows = _integers(batch.column("v"), width)
            number, _ = index.nearest(rows)
            for c in np.unique(number):
                own = rows[number == c]
                # A batch has under 2**31 rows, so narrow components add up within 63 bits.
                totals[c] += own.sum(axis=0) if is_narrow(own) else own.astype(object).sum(axis=0)
                counts[c] += len(own)
        used = [c for c in range(len(centroids)) if counts[c]]
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array([c for c in used for _ in range(width)], pa.int32()),
                "dim": pa.array([d for _ in used for d in range(width)], pa.int32()),
                "total": pa.array([str(totals[c][d]) for c in used for d in range(width)], pa.string()),
                "n": pa.array([int(counts[c]) for c in used for _ in range(width)], pa.int64()),
            }
        )

    parts = vectors.select("v").mapInArrow(run, "cluster int, dim int, total string, n long")
    return parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def starting_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: str = "3") -> list[list[int]]:
    """The k vectors of smallest sha256 of `seed:vec_id`, in that order."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256).alias("h"), "v")
    return [[int(x) for x in r["v"]] for r in hashed.orderBy("h", "v").limit(k).collect()]


def fit_centroids(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "3", width: int = WIDTH) -> list[list[int]]:
    """Centroids after `rounds` rounds of assignment and floored means; empty ones stay."""
    centroids = starting_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        moved = [list(c) for c in centroids]
        # At most k * width rows, however many vectors there are.
        for r in _sums(vectors, centroids, width).collect():
            moved[r["cluster"]][r["dim"]] = int(r["total"]) // r["n"]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]], width: int = WIDTH) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of every vector and its squared distance."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Annulus(centroids)
        for batch in batches:
            number, distance = index.nearest(_integers(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array([min(int(d), LONGEST) for d in distance], pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def centroid_text(centroid: list[int]) -> str:
    return ",".join(map(str, centroid))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "clusters")
    vectors = scratch.write(quantised(read_table(spark, sf_dir, "embeddings")), "vectors")
    centroids = fit_centroids(vectors)
    assigned = scratch.write(assign(vectors, centroids), "assigned")
    # One row per centroid, so both tables below have at most CLUSTERS rows.
    sums = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    rows = [(c, min(n, LONGEST), min(sum(sums.values()), LONGEST), hashlib.sha256(centroid_text(centroids[c]).encode()).hexdigest()) for c, n in sums.items()]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    scratch.drop("vectors")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Rounds unrolled: c0 are the first centroids, a<i> the assignments, c<i> their means."""
    parts = [
        f"q AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT v, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM q ORDER BY h, v LIMIT {CLUSTERS}))",
    ]
    distance = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for i in range(ROUNDS + 1):
        parts.append(f"d{i} AS (SELECT id, vec_id, v, cluster, CAST({distance} AS BIGINT) AS distance FROM q, c{i})")
        parts.append(f"a{i} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, min(distance) AS distance, arg_min(cluster, distance * {CLUSTERS} + cluster) AS cluster FROM d{i} GROUP BY id)")
        if i < ROUNDS:
            parts.append(f"s{i} AS (SELECT cluster, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(0, {WIDTH})) AS dim FROM a{i}) GROUP BY cluster, dim)")
            parts.append(f"m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS c FROM s{i} GROUP BY cluster)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    last = ROUNDS
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, CAST(a.cluster AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} USING (cluster)"


QUERIES = {"op12_clusters": op12_clusters}
ORACLES = {"op12_clusters": _sql()}
