"""Clustering against a brute force in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from plumeline.llm import vantage

TYPES = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, dim, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    return sorted(((i, c, d, sum(x for _, n, x in found if n == c), total, centroids[c]) for i, c, d in found), key=repr)


def f32(values):
    return [None if v is None else float(np.float32(v)) for v in values]


def cases(n, dim, seed, spread=2.0):
    rng = random.Random(seed)
    rows = [(i, f32(rng.gauss(rng.choice((-spread, 0, spread)), 0.5) for _ in range(dim))) for i in range(n)]
    return rows + [(n, None), (n + 1, []), (n + 2, f32([1.0] * (dim - 1))), (n + 3, [None] + f32([1.0] * (dim - 1))), (n + 4, [float("nan")] * dim), (n + 5, [float("inf")] + [0.0] * (dim - 1)), (None, f32([0.25] * dim)), (3, f32([0.5] * dim)), (3, f32([0.5] * dim)), (n + 6, [0.0] * dim)]


@pytest.mark.parametrize("k,rounds,dim,n", [(8, 10, 5, 90), (1, 2, 3, 20), (40, 3, 2, 60), (200, 2, 4, 50)])
def test_equals_the_brute_force(spark, k, rounds, dim, n):
    rows = cases(n, dim, k)
    df = spark.createDataFrame([(*r, 1) for r in rows], TYPES).withColumn("cluster", vantage.F.lit("mine"))
    found = vantage.clusters(df, k=k, rounds=rounds, dim=dim)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, k, rounds, dim)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2)] * 2) for i in range(10)]  # two places only
    found = vantage.clusters(spark.createDataFrame([(*r, 0) for r in rows], TYPES), k=6, rounds=4, dim=2)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, 6, 4, 2)


def test_empty_tables_and_bounds(spark):
    empty = spark.createDataFrame([], TYPES)
    assert vantage.clusters(empty).isEmpty()
    assert vantage.clusters(spark.createDataFrame([(1, None, 0)], TYPES)).isEmpty()
    huge = [(1, [3e5, 0.0], 0), (2, [1.0, 2.0], 0)]  # 3e5 * 1024 is beyond 2**27: left out
    assert [r.vec_id for r in vantage.clusters(spark.createDataFrame(huge, TYPES), dim=2).collect()] == [2]
    with pytest.raises(ValueError):
        vantage.clusters(empty, k=vantage.MOST_CENTROIDS + 1)


def test_search_is_exact_and_prunes():
    rng = np.random.default_rng(2)
    for k, dim, low in ((1, 2, 4), (7, 1, 3), (64, 2, 6), (300, 3, 40), (50, 64, 1 << 27)):
        x, c = rng.integers(-low + 1, low, (400, dim)), rng.integers(-low + 1, low, (k, dim))
        far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        number, best = vantage.nearest(vantage.build(c), x)
        assert (number == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
    seen = []
    squared = vantage.squared
    try:
        vantage.squared = lambda a, b: seen.append(len(a)) or squared(a, b)
        grid = rng.integers(0, 100_000, (512, 2))
        tree = vantage.build(grid)
        seen.clear()
        vantage.nearest(tree, rng.integers(0, 100_000, (200, 2)))
    finally:
        vantage.squared = squared
    assert sum(seen) < 200 * 512 / 4
