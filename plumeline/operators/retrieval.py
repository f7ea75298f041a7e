"""An index for retrieval: inverted lists around centroids, searched by a calibrated number of probes and ranked exactly.

Centroids are fitted on a bounded sample; every vector is in the list of its nearest one. A query is held against the vectors of the
lists whose centroids are nearest to it, by cosine, so that what it is compared with are `probes` lists instead of all vectors. Without `probes` a
search is exact. Vectors that are null, empty, zero, not finite or of another dimension are in no list and find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import top_chunks

#: Vectors from which centroids are fitted, and queries by which probes are calibrated: those of least hash, at most so many.
SAMPLE, ASKED = 20_000, 200
#: Lists at most (their centroids are broadcast: 8 bytes for each list and dimension), and vectors and queries that one task compares.
LISTS, CHUNKS, QUERIES = 4096, 50_000, 5_000
SEED, ROUNDS = 23, 12
#: Cosines that are held at once: 16 MB, and as much for each copy that ranks them.
AT_ONCE = 1 << 21


@dataclass
class Index:
    """`lists` has the chunks' columns and list; centroids are unit vectors, a row each."""

    lists: DataFrame
    centroids: np.ndarray
    chunk: str
    vector: str


def units(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count, and these as unit vectors."""
    good = np.array([v is not None and len(v) == dim and None not in v for v in vectors], bool)
    x = np.array([v for v, g in zip(vectors, good, strict=True) if g], float).reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        norm = np.linalg.norm(x, axis=1)
        fine = np.isfinite(norm) & (norm > 0)
    good[good] = fine
    return good, x[fine] / norm[fine, None]


def parts(rows: int, columns: int) -> Iterator[slice]:
    """Slices of so many rows that their cosines with all columns are held at once."""
    size = max(1, AT_ONCE // max(1, columns))
    return (slice(at, min(at + size, rows)) for at in range(0, rows, size))


def fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids by Lloyd's rounds on cosine; an empty one takes the vector that is farthest from its own."""
    rng = np.random.default_rng(SEED)
    found = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    own, best = np.empty(len(sample), np.int64), np.empty(len(sample))
    for _ in range(ROUNDS):
        for part in parts(len(sample), len(found)):
            near = sample[part] @ found.T
            own[part], best[part] = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norm == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
        norm[empty] = 1
        found = sums / norm[:, None]
    return found


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n lists of nearest centroids of each vector, the nearest first."""
    out = np.empty((len(x), min(n, len(centroids))), np.int64)
    for part in parts(len(x), len(centroids)):
        out[part] = np.argsort(-np.round(x[part] @ centroids.T, 12), axis=1, kind="stable")[:, :n]
    return out


def build(chunks: DataFrame, chunk: str = "chunk", vector: str = "embedding", lists: int | None = None) -> Index | None:
    """None if no vector counts. By default there are as many lists as the square root of the number of chunks, up to a bound."""
    given = chunks.where(F.size(vector) > 0)
    dims = given.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return None
    dim = dims["dim"]
    lists = min(LISTS, max(1, round(dims["count"] ** 0.5)) if lists is None else lists)
    sample = given.where(F.size(vector) == dim).orderBy(F.xxhash64(F.col(chunk).cast("string"), F.lit(SEED)), chunk).limit(SAMPLE).select(vector).toPandas()[vector].tolist()
    _, x = units(sample, dim)
    if not len(x):
        return None
    centroids = fit(x, lists)
    sent = chunks.sparkSession.sparkContext.broadcast(centroids)
    names = [c for c in chunks.columns if c != "list"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = units(batch.column(vector).to_pylist(), dim)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(nearest_lists(x, sent.value, 1).ravel(), pa.int32())], [*names, "list"])

    kind = chunks.select(*names).withColumn("list", F.lit(0)).schema
    return Index(chunks.select(*names).mapInArrow(run, kind), centroids, chunk, vector)


def probed(queries: DataFrame, index: Index, n: int, query: str, vector: str) -> DataFrame:
    """query, vector, list and rank (from 1) of each of the n lists that a query asks."""
    sent, dim = queries.sparkSession.sparkContext.broadcast(index.centroids), index.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = units(batch.column("v").to_pylist(), dim)
            own, width = np.flatnonzero(good), min(n, len(sent.value))
            for part in parts(len(x), width * dim):
                near = nearest_lists(x[part], sent.value, n)
                asked = batch.take(pa.array(np.repeat(own[part], width), pa.int64()))
                yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(near.ravel(), pa.int32()), pa.array(np.tile(np.arange(1, width + 1), len(near)), pa.int32())], ["q", "v", "list", "rank"])

    given = queries.select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("q IS NOT NULL")
    return given.mapInArrow(run, f"q {given.schema['q'].dataType.simpleString()}, v array<double>, list int, rank int")


def search(queries: DataFrame, index: Index, k: int, probes: int | None = None, query: str = "query", vector: str = "embedding", where: str | None = None) -> DataFrame:
    """query, chunk, similarity (cosine, to nine decimals) and place of the k nearest chunks in the probed lists, ties by chunk. `where` is a condition on
    the chunks, such as their corpus, which reaches their scan. Large lists, and lists that many queries ask, are split over tasks."""
    lists = index.lists if where is None else index.lists.where(where)
    if probes is None:
        return top_chunks(queries, lists, k, query, vector, index.chunk) if vector == index.vector else top_chunks(queries.withColumnRenamed(vector, index.vector), lists, k, query, index.vector, index.chunk)
    asked = probed(queries, index, probes, query, vector).drop("rank")
    held = lists.select(F.col(index.chunk).alias("c"), F.col(index.vector).cast("array<double>").alias("w"), "list").where("c IS NOT NULL")
    dealt = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = dealt(held, CHUNKS, "cs").join(dealt(asked, QUERIES, "qs"), "list")  # a row for each list, of which there are `LISTS` at most
    sizes = F.broadcast(sizes)
    split = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(sizes, "list").withColumn("qp", split("q", "qs")).withColumn("cp", every("cs")).drop("cs", "qs")
    held = held.join(sizes, "list").withColumn("cp", split("c", "cs")).withColumn("qp", every("qs")).drop("cs", "qs")

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"q": q["q"].iloc[:0], "c": c["c"].iloc[:0], "similarity": pd.Series([], dtype=float)})
        a, b = (np.array(x.tolist(), float) for x in (q["v"], c["w"]))
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        found = []
        for part in parts(len(a), len(b)):
            near, most = np.round(a[part] @ b.T, 9), min(k, len(b))
            least = -np.partition(-near, most - 1, axis=1)[:, most - 1]
            i, j = np.nonzero(near >= least[:, None])  # ties at the k-th place stay until all lists are known
            found.append(pd.DataFrame({"q": q["q"].to_numpy()[i + part.start], "c": c["c"].to_numpy()[j], "similarity": near[i, j]}))
        return pd.concat(found, ignore_index=True)

    keys = ["list", "cp", "qp"]
    kind = f"q {asked.schema['q'].dataType.simpleString()}, c {held.schema['c'].dataType.simpleString()}, similarity double"
    met = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, kind)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "c"))
    return met.withColumn("place", place).where(F.col("place") <= k).select(F.col("q").alias(query), F.col("c").alias(index.chunk), "similarity", "place")


def calibrate(queries: DataFrame, index: Index, k: int, recall: float = 0.9, query: str = "query", vector: str = "embedding") -> int:
    """The least number of probes that finds this share of the k nearest chunks of a bounded sample of queries: for each true neighbour
    its list's rank among those that the query would ask."""
    some = queries.orderBy(F.xxhash64(F.col(query).cast("string"), F.lit(SEED)), query).limit(ASKED)
    true = search(some, index, k, None, query, vector).select(F.col(query).alias("q"), F.col(index.chunk).alias("c"))
    own = true.join(index.lists.select(F.col(index.chunk).alias("c"), "list").distinct(), "c")
    ranks = own.join(probed(some, index, len(index.centroids), query, vector).select("q", "list", "rank"), ["q", "list"]).groupBy("q", "c").agg(F.min("rank").alias("rank"))
    counts = {r["rank"]: r["count"] for r in ranks.groupBy("rank").count().collect()}  # a row for each list at most
    total, seen = sum(counts.values()), 0
    for rank in sorted(counts):
        seen += counts[rank]
        if seen >= recall * total:
            return rank
    return 1
