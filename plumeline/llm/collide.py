"""Near-duplicate vectors by collision counting on one-dimensional projections.

Every vector is projected on many random lines. The projections of a vector at the threshold from another differ by a normal variable
of known width, so a window of fixed width around a query's projection holds the other's with a known probability; a pair that
collides in as many windows as a pair at the threshold does but for one in 10,000 is verified by its cosine in double precision.

The first lines also deal the work out: vectors are sorted into cells of a window's width along them, and a cell meets itself and its
neighbours, in blocks of bounded size, so that neither a label, a cell nor a crowd of near copies comes together in one task. In a pair
of blocks both sides are sorted along each line; a line on which the sorted runs lie further apart than a window is missed by all their
pairs, and blocks that miss too many lines are passed over. The others count their windows' collisions, and stop as soon as no pair can
reach the count. A pair of blocks returns sums for each vector and a spanning forest of its links, never the links themselves. Equal
vectors of a label are one node with a weight.

Vectors that are null, of length zero, or hold null or non-finite components link with nothing, nor do those without a label or
with different numbers of components. Repeated rows are vectors of their own, as are rows that share a key; rows with a null key link
with nothing. A cosine equal to the threshold is a link. Further columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

LEAST, LINES, CELL_LINES, BLOCK, RUN = 0.93, 48, 2, 1024, 128
#: Half widths of the windows, in standard deviations of the difference that a pair at the threshold has; a cell loses a pair once in 16,000.
WINDOW, CELL = 1.5, 4.0
RECALL = 0.9999


def needed_collisions(lines: int = LINES, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability `recall`."""
    p, total = erf(window / sqrt(2)), 0.0
    for c in range(lines, -1, -1):
        total += comb(lines, c) * p**c * (1 - p) ** (lines - c)
        if total >= recall:
            return c
    return 0


def width(dim: int, least: float) -> float:
    """Standard deviation of the difference of the projections of two unit vectors of cosine `least`."""
    return sqrt(2 * (1 - least) / dim)


def lines_of(dim: int, lines: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, lines)) / sqrt(dim)


def projected(vectors: DataFrame, least: float) -> DataFrame:
    """id, n, label, dim, cell, vector (the unit vector) and lines (its projections)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["vector"].map(len), sort=True):
                x = np.array(part["vector"].tolist(), np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares from overflowing
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                y = x @ lines_of(dim, LINES)
                cells = np.floor(y[:, :CELL_LINES] / (CELL * width(dim, least))).astype(np.int64)
                yield pd.DataFrame({"id": part["id"], "n": part["n"], "label": part["label"], "dim": dim, "cell": list(cells), "vector": list(x), "lines": list(y)})

    return vectors.mapInPandas(run, "id long, n long, label string, dim int, cell array<long>, vector array<double>, lines array<double>")


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a bipartite graph, given as a matrix of rows and columns."""
    rows, columns, edges = linked.any(axis=1), linked.any(axis=0), []
    while rows.any():
        front = np.array([rows.argmax()])
        rows[front] = False
        while len(front):
            new = np.flatnonzero(linked[front].any(axis=0) & columns)
            columns[new] = False
            edges += zip(front[linked[np.ix_(front, new)].argmax(axis=0)].tolist(), new.tolist(), strict=True)
            if not len(new):
                break
            front = np.flatnonzero(linked[:, new].any(axis=1) & rows)
            rows[front] = False
            edges += zip(front.tolist(), new[linked[np.ix_(front, new)].argmax(axis=1)].tolist(), strict=True)
    return edges


def widest(lines: np.ndarray) -> int:
    """The line along which the vectors lie furthest apart."""
    return int(lines.std(axis=0).argmax())


def collisions(p: np.ndarray, q: np.ndarray, sorted_q: np.ndarray, half: np.float32, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """How many windows around the vectors of p hold each vector of q, for those of q that may be held by enough of them; and which these are.

    The windows of a run are merged into sorted q line by line: what is left of the least window or right of the largest is missed by all."""
    low, high = p.min(axis=0) - half, p.max(axis=0) + half
    reach = np.array([np.searchsorted(sorted_q[:, k], high[k], "right") - np.searchsorted(sorted_q[:, k], low[k], "left") for k in range(LINES)])
    allowed = LINES - wanted
    if (reach == 0).sum() > allowed:
        return np.empty((len(p), 0), np.uint8), np.empty(0, np.int64)
    left, missed = np.arange(len(q)), np.zeros(len(q), np.uint8)
    lines = np.argsort(reach, kind="stable")  # the most selective first
    for k in lines:
        missed += (q[:, k] < low[k]) | (q[:, k] > high[k])
    left = left[missed <= allowed]
    hits = np.zeros((len(p), len(left)), np.uint8)
    for at, k in enumerate(lines):
        hits += np.abs(p[:, k, None] - q[None, left, k]) <= half
        if at % 8 == 7 and len(left):
            may = (hits.max(axis=0) + (LINES - 1 - at)) >= wanted
            if not may.all():
                hits, left = hits[:, may], left[may]
    return hits, left


def compare(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Two blocks (or one with itself): sums of the weights linked to each vector (other is null) and a forest of links."""
    a, b = frame[frame["side"] == 0], frame[frame["side"] == 1]
    own = not len(b)
    b = a if own else b
    if not len(a):
        return pd.DataFrame({"id": [], "other": [], "n": []}).astype("int64")
    dim, wanted = int(a["dim"].iat[0]), needed_collisions()
    x, y = np.array(a["vector"].tolist()), np.array(b["vector"].tolist())
    p, q = np.array(a["lines"].tolist(), np.float32), np.array(b["lines"].tolist(), np.float32)
    half = np.float32(WINDOW * width(dim, least) * (1 + 1e-6))
    linked = np.zeros((len(a), len(b)), bool)
    order = np.argsort(p[:, widest(p)], kind="stable")  # runs of neighbours, which most windows of the others miss
    by = np.argsort(q, axis=0, kind="stable")
    sorted_q = np.take_along_axis(q, by, axis=0)
    for start in range(0, len(a), RUN):
        part = order[start : start + RUN]
        hits, left = collisions(p[part], q, sorted_q, half, wanted)
        if len(left):
            near = hits >= wanted
            linked[np.ix_(part, left)] = near & (x[part] @ y[left].T >= least)
    if own:
        np.fill_diagonal(linked, False)
    ids, others = a["id"].to_numpy(), b["id"].to_numpy()
    out = [pd.DataFrame({"id": ids, "other": pd.array([pd.NA] * len(ids), "Int64"), "n": linked @ b["n"].to_numpy()})]
    if not own:
        out.append(pd.DataFrame({"id": others, "other": pd.array([pd.NA] * len(others), "Int64"), "n": linked.T @ a["n"].to_numpy()}))
    pairs = forest(linked)
    out.append(pd.DataFrame({"id": ids[[i for i, _ in pairs]], "other": pd.array(others[[j for _, j in pairs]], "Int64"), "n": 0}))
    return pd.concat([x[(x["n"] > 0) | x["other"].notna()] for x in out])


def block_pairs(placed: DataFrame) -> DataFrame:
    """task, and the two blocks that meet in it: a cell with itself or with a neighbour, each pair of blocks once."""
    cells = placed.groupBy("label", "dim", "cell").agg((F.max("block") + 1).alias("blocks"))
    ahead = [o for o in product((-1, 0, 1), repeat=CELL_LINES) if o >= (0,) * CELL_LINES]
    steps = F.explode(F.array(*[F.array(*[F.lit(x).cast("long") for x in o]) for o in ahead]))
    moved = cells.select("label", "dim", "cell", "blocks", steps.alias("step")).withColumn("cell_b", F.zip_with("cell", "step", lambda c, s: c + s))
    met = moved.join(cells.withColumnsRenamed({"cell": "cell_b", "blocks": "blocks_b"}), ["label", "dim", "cell_b"])
    each = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
    each = each.where((F.col("cell") != F.col("cell_b")) | (F.col("block") <= F.col("block_b")))
    return each.select("label", "dim", "cell", "block", "cell_b", "block_b", F.concat_ws("|", "label", "dim", F.to_json("cell"), "block", F.to_json("cell_b"), "block_b").alias("task"))


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """One row for each row of vectors: key, n_links (other vectors of cosine `least` or more and equal label), component_id (the
    least key reachable by links, its own included) and kept (whether that is its own)."""
    wide = F.col(vector).cast("array<double>")
    usable = F.col(label).isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(wide, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), wide.alias("vector"), F.coalesce(usable, F.lit(False)).alias("usable"))
    rows = rows.withColumn("digest", F.when(F.col("usable") & F.col("id").isNotNull(), F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256)))
    distinct = rows.where("digest IS NOT NULL").groupBy("label", "digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.any_value("vector").alias("vector"))
    nodes = written(projected(distinct.select("id", "n", "label", "vector"), least), "vectors")
    # Blocks by a hash of the id: as many as a cell's size asks for.
    sizes = nodes.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = written(nodes.join(sizes, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks"), "blocks")
    tasks = written(block_pairs(placed.select("label", "dim", "cell", "block")), "tasks")
    cell = ["label", "dim", "cell", "block"]
    fields = ["task", "id", "n", "dim", "vector", "lines"]
    left = placed.join(tasks.select("task", *cell), cell).select(*fields, F.lit(0).alias("side"))
    other = tasks.where((F.col("cell") != F.col("cell_b")) | (F.col("block") != F.col("block_b"))).select("task", "label", "dim", F.col("cell_b").alias("cell"), F.col("block_b").alias("block"))
    right = placed.join(other, cell).select(*fields, F.lit(1).alias("side"))
    found = left.unionByName(right).groupBy("task").applyInPandas(lambda frame: compare(frame, least), "id long, other long, n long")
    found = written(found, "collisions")
    sums = found.where("other IS NULL").groupBy("id").agg(F.sum("n").alias("linked"))
    merged = components(found.where("other IS NOT NULL"), "id", "other").withColumnRenamed("node", "id")
    whole = distinct.select("label", "digest", "id", "n").join(sums, "id", "left").join(merged, "id", "left")
    whole = whole.select("label", "digest", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "label", "digest").join(whole, ["label", "digest"], "left")
    component = F.coalesce("component", "id")
    kind = vectors.schema[key].dataType
    return out.select(F.col("id").cast(kind).alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
