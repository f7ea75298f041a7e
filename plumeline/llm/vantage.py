"""Centroid clustering with integer vectors: Lloyd's rounds, each of which asks a vantage-point tree over the centroids for the nearest one.

A vector of the wanted number of components, none null or non-finite, becomes the integers floor(scale * x). The first centroids are the
vectors of least sha256 of `<seed>:<vec_id>`. In each round the driver builds the tree of the centroids (a few numbers, at most
`MOST_CENTROIDS` of them) and broadcasts it; tasks search it for every vector and hand on the sums of each cluster, so that a round moves
one row for each cluster, component and task. Means are exact: floor(sum / count) of integers. An empty cluster keeps its centroid.

The search is best-first: a vector visits its nodes by their lower bounds and stops when the least bound is beyond its best distance.
A bound equal to the best distance is still visited, as the centroid behind it may tie and be of smaller number. Distances to visited centroids are
exact integers; bounds are square roots, which get a slack of more than their error.

Null vec_ids hash as an empty number. Rows that share a vec_id are vectors of their own; equal hashes go by the components. Of fewer vectors than
centroids each is a centroid, an empty table gives no rows. Vectors with a component of 2**27 or more are left out: their squared
distances need not fit a long. Sums that do not fit a long are null. Further columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: The tree is built by the driver and broadcast: at most so many centroids.
MOST_CENTROIDS = 16_384
#: Integers below this keep 64 squared differences in a long.
MOST = 1 << 27
#: Bounds (a number for each vector and node) that a task holds.
BOUNDS = 4_000_000
#: More than the relative error of a square root of an integer and of a difference of two.
SLACK = 1e-9


@dataclass
class Tree:
    """Node i has the vantage point `point[i]` (a centroid's number) and two children, 0 for none; the centroids below a child are between
    `low` and `high` from the vantage point. The root is node 1."""

    centroids: np.ndarray
    point: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def build(centroids: np.ndarray) -> Tree:
    """The vantage point of a set is its centroid of smallest number; the others are halved by their distance from it."""
    n = len(centroids)
    tree = Tree(centroids, np.zeros(n + 1, np.int64), np.zeros((n + 1, 2), np.int64), np.zeros((n + 1, 2)), np.zeros((n + 1, 2)))
    todo, used = [(np.arange(n), 0, 0)] if n else [], 0
    while todo:
        members, parent, side = todo.pop()
        used += 1
        tree.point[used] = members[0]
        if parent:
            tree.child[parent, side] = used
        rest = members[1:]
        if not len(rest):
            continue
        far = np.sqrt(squared(centroids[rest], centroids[members[0]][None, :]).astype(float))
        order = np.argsort(far, kind="stable")
        for s, part in enumerate((order[: (len(rest) + 1) // 2], order[(len(rest) + 1) // 2 :])):
            if len(part):
                tree.low[used, s], tree.high[used, s] = far[part].min(), far[part].max()
                todo.append((np.sort(rest[part]), used, s))
    return tree


def nearest(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance from the nearest centroid of each vector; of equally near ones the smallest number. Each turn visits
    for every vector that is not done its own node of least bound."""
    n, nodes = len(x), len(tree.point)
    best, number = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    radius = np.full(n, np.inf)
    bounds = np.full((n, nodes), np.inf)
    bounds[:, 1] = 0.0
    todo = np.arange(n)
    while True:
        node = bounds[todo].argmin(axis=1)
        bound = bounds[todo, node]
        go = np.isfinite(bound) & (bound <= radius[todo])
        todo, node, bound = todo[go], node[go], bound[go]
        if not len(todo):
            return number, best
        bounds[todo, node] = np.inf
        at = tree.point[node]
        d = squared(x[todo], tree.centroids[at])
        won = (d < best[todo]) | ((d == best[todo]) & (at < number[todo]))
        best[todo[won]], number[todo[won]] = d[won], at[won]
        root = np.sqrt(d.astype(float))
        radius[todo] = np.sqrt(best[todo].astype(float)) * (1 + SLACK)
        for side in (0, 1):
            child = tree.child[node, side]
            has = child > 0
            away = np.maximum(np.maximum(root - tree.high[node, side], tree.low[node, side] - root), bound)
            bounds[todo[has], child[has]] = np.maximum(0.0, away - SLACK * (root + tree.high[node, side]))[has]


def vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 1024) -> DataFrame:
    """key and v, its integers, of the vectors that count."""
    x = F.col("v")
    given = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dim)
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < (MOST - 1) / scale))
    return given.where(F.coalesce(fit, F.lit(False))).select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def parts(batch: pa.RecordBatch, nodes: int, dim: int) -> Iterator[np.ndarray]:
    """The batch's vectors, so many together that their bounds stay below `BOUNDS`."""
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    step = max(1, min(4096, BOUNDS // nodes))
    for at in range(0, len(x), step):
        yield x[at : at + step].astype(np.int64)


def sums(known: DataFrame, tree: Tree, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Number and component sums of each cluster that has vectors."""
    k, tree_size = len(tree.centroids), len(tree.point)
    sent = known.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)  # components are below 2**27, so that 2**36 vectors fit
        for batch in batches:
            for x in parts(batch, tree_size, dim):
                number, _ = nearest(sent.value, x)
                np.add.at(total, number, np.column_stack([x, np.ones(len(x), np.int64)]))
        met = np.flatnonzero(total[:, dim])
        c, i = np.repeat(met, dim + 1), np.tile(np.arange(dim + 1), len(met))
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(c, pa.int32()), "i": pa.array(i, pa.int32()), "s": pa.array(total[c, i])})

    found = known.select("v").mapInArrow(run, "cluster int, i int, s long").groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for row in found.orderBy("cluster", F.desc("i")).collect():  # a number for each cluster and component
        if row.i == dim:
            out[row.cluster] = (int(row.s), [0] * dim)
        else:
            out[row.cluster][1][row.i] = int(row.s)
    sent.unpersist()
    return out


def assigned(known: DataFrame, tree: Tree, dim: int) -> DataFrame:
    """vec_id, cluster and distance."""
    sent = known.sparkSession.sparkContext.broadcast(tree)
    kind = known.select("vec_id").schema.fields[0].dataType

    nodes = len(tree.point)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in parts(batch, nodes, dim):
                number, best = nearest(sent.value, x)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(at, len(x)), pa.array(number, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])
                at += len(x)

    return known.mapInArrow(run, f"vec_id {kind.simpleString()}, cluster int, distance long")


def centroids(known: DataFrame, k: int, rounds: int, dim: int, seed: int) -> np.ndarray:
    """The centroids after so many rounds. A round that changes none ends them, as all later ones would do the same."""
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"1 to {MOST_CENTROIDS} centroids, not {k}")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = np.array([r.v for r in known.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64).reshape(-1, dim)
    for _ in range(rounds if len(found) else 0):
        after = found.copy()
        for c, (n, total) in sums(known, build(found), dim).items():
            after[c] = [s // n for s in total]
        if (after == found).all():
            break
        found = after
    return found


def clusters(rows: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia and inertia (summed over the cluster and over all), and centroid, the integers of its cluster's."""
    spark = rows.sparkSession
    known = written(vectors(rows, key, vector, dim, scale), "integers")
    found = centroids(known, k, rounds, dim, seed)
    out = written(assigned(known, build(found), dim), "assigned")
    by = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    inertia = {r.cluster: int(r.s) for r in by.collect()}  # a row for each cluster
    long = lambda n: n if n < 1 << 63 else None
    rows_of = [(c, long(inertia.get(c, 0)), long(sum(inertia.values())), x) for c, x in enumerate(found.tolist())]
    facts = spark.createDataFrame(rows_of, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(facts), "cluster").select(F.col("vec_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")

