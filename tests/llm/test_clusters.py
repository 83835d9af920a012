import hashlib
import math

import numpy as np
import pytest

from scholia.llm import clusters


def brute(rows, k, rounds, width):
    """Lloyd's rounds over whole numbers, one distance after the other."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(x)) for x in v]))
    ordered = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in ordered[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    return centroids, sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr)


def cluster(spark, rows, k=8, rounds=4, width=6):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(3)
    vectors = clusters.quantised(table, width=width)
    centroids = clusters.fit_centroids(vectors, k, rounds, width=width)
    return centroids, sorted((tuple(r) for r in clusters.assign(vectors, centroids, width).collect()), key=repr)


def test_rounds_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(i % 5, 1, 6)]) for i in range(150)]
    rows += [(i, [float(x) for x in rng.integers(-1, 2, 6)]) for i in range(150, 230)]  # many ties
    rows += [(7, [0.0] * 6), (7, [0.0] * 6), (None, [1.0] * 6), (300, None), (301, [1.0] * 5), (302, [None] + [1.0] * 5), (303, [math.nan] * 6), (304, [math.inf] * 6), (305, [])]
    assert cluster(spark, rows) == brute(rows, 8, 4, 6)


def test_wide_numbers_few_rows_and_none(spark):
    wide = [(i, [float(10 ** (i % 12)) * s for s in (1, -1, 1, 2, -3, 1)]) for i in range(12)]
    centroids, got = cluster(spark, wide, k=3)
    want_centroids, want = brute(wide, 3, 4, 6)
    assert centroids == want_centroids
    assert got == sorted(((i, c, min(d, clusters.LONGEST)) for i, c, d in want), key=repr)
    few = [(1, [1.0] * 6), (2, [2.0] * 6)]
    assert cluster(spark, few) == brute(few, 8, 4, 6)
    assert cluster(spark, []) == ([], [])


def test_annulus_passes_over_far_norms_and_keeps_ties():
    rng = np.random.default_rng(5)
    centroids = [[int(x) for x in np.r_[r, 0, 0]] for r in range(0, 64_000, 1000)]
    index = clusters.Annulus(centroids)
    points = np.stack([rng.integers(0, 64_000, 500), np.zeros(500, int), np.zeros(500, int)], axis=1)
    number, distance = index.nearest(points)
    every = ((points[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
    assert index.compared < 500 * 4  # of 500 * 64
    tied = clusters.Annulus([[2, 0], [0, 2], [-2, 0], [0, 0]])
    assert [int(x) for x in tied.nearest(np.array([[1, 1], [-1, 0], [0, 0]]))[0]] == [0, 2, 3]


@pytest.mark.parametrize("value", [2**26 - 1, 2**26, 2**40])
def test_bounds_of_narrow_numbers(value):
    index = clusters.Annulus([[value] * 64, [-value] * 64])
    number, distance = index.nearest(np.array([[value] * 64, [-value] * 64, [0] * 64]))
    assert list(number) == [0, 1, 0] and [int(d) for d in distance] == [0, 0, 64 * value**2]
