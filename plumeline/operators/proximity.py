"""Groups of rows that are linked by nearness in place and time, without comparing all pairs.

Places are points of the unit sphere in space, where a great-circle distance is a chord, at all latitudes and across 180 degrees. Cubes of a third
of the chord and the interval are nodes: all rows of a node are linked to each other. What two nodes hold is told by their bounding
boxes: some are linked for sure, some cannot be. Only of the others the boxes are halved on all sides, again and again, until a link is
found or excluded, or so few rows are left that their pairs cost no more than reading the table; a box with a single place and time is exact. So
a node with any number of rows takes part in as many comparisons as one with a few.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .graph import components, written

#: Boxes are halved so often at most (a box is a millionth of the distance wide then), and no more once the rows of those in question have no more
#: than so many pairs for each row of the table: these are compared.
LEVELS, PER_ROW = 20, 4
AXES = ("x", "y", "z", "s")
CELL = ("cx", "cy", "cz", "cs")


def located(rows: DataFrame, key: str, by: list[str], km: float, span_us: int) -> DataFrame:
    """by, key, lat, lon, time (s, microseconds), and the point in space; rows without a place or time are left out."""
    lat, lon = F.radians("lat"), F.radians("lon")
    out = rows.select(*by, F.col(key).alias("key"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("s"))
    return out.withColumns({"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}).dropna(subset=["lat", "lon", "s", "key"])


def chord_of(km: float) -> float:
    return 2 * math.sin(min(km / geo.EARTH_KM / 2, math.pi / 2))


def cells(km: float, span_us: int, level: int) -> dict[str, Column]:
    """The cube of a point. A power of two more per level, so that a cube of one level lies in one of the level before."""
    sides = {**dict.fromkeys("xyz", 3 * 2.0**level / chord_of(km)), "s": 3 * 2.0**level / span_us}
    return {c: F.floor(F.col(a) * F.lit(sides[a])) for a, c in zip(AXES, CELL, strict=True)}


def boxes(points: DataFrame, by: list[str]) -> DataFrame:
    """For each cube its least key, number of rows and bounds."""
    ends = [f(a).alias(f"{name}_{a}") for a in (*AXES, "lat", "lon") for f, name in ((F.min, "low"), (F.max, "high"))]
    return points.groupBy(*by, *CELL).agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("n"), *ends)


def verdict(km: float, span_us: int) -> Column:
    """Of boxes a and b: true if all their rows are linked, false if none can be, null if that is open."""
    side = lambda name: lambda c: F.col(f"{name}.{c}")
    a, b = side("a"), side("b")
    apart = lambda c: F.greatest(F.lit(0), a(f"low_{c}") - b(f"high_{c}"), b(f"low_{c}") - a(f"high_{c}"))
    across = lambda c: F.greatest(a(f"high_{c}") - b(f"low_{c}"), b(f"high_{c}") - a(f"low_{c}"))
    squares = lambda f: sum((f(c) * f(c) for c in "xyz"), F.lit(0.0))
    chord = chord_of(km)
    slack = chord * chord * 1e-9 + chord * 1e-15
    single = F.lit(True)
    for name in (a, b):
        for c in ("lat", "lon", "s"):
            single = single & (name(f"low_{c}") == name(f"high_{c}"))
    exact = (across("s") <= span_us) & (geo.distance_km(a("low_lat"), a("low_lon"), b("low_lat"), b("low_lon")) <= km)
    never = (apart("s") > span_us) | (squares(apart) > chord * chord + slack)
    sure = (across("s") <= span_us) & (squares(across) <= chord * chord - slack)
    return F.when(single, exact).when(never, False).when(sure, True)


def as_side(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))


def node_links(points: DataFrame, nodes: DataFrame, by: list[str], km: float, span_us: int, tally: list[int] | None = None) -> DataFrame:
    """node_a and node_b: nodes of which some rows are near each other. `tally` gets the number of compared boxes of each level."""
    third = {f"g{c}": F.floor(F.col(c) / 3) for c in CELL}
    grid = [*third]
    coarse = nodes.select(*by, *[v.alias(k) for k, v in third.items()]).distinct()
    steps = [s for s in product((-1, 0, 1), repeat=4) if s >= (0, 0, 0, 0)]  # one of two opposite ones
    to = coarse.withColumn("step", F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(s)]) for s in steps])))
    to = to.select(*by, *grid, *[(F.col(g) + F.col(f"step.d{i}")).alias(f"to_{g}") for i, g in enumerate(grid)])
    there = coarse.select(*by, *[F.col(g).alias(f"to_{g}") for g in grid])
    near = to.join(there, [*by, *[f"to_{g}" for g in grid]])
    placed = nodes.withColumns(third)
    met = near.join(as_side(placed, "a", [*by, *grid]), [*by, *grid])
    met = met.join(as_side(placed, "b", [*by, *grid]).withColumnsRenamed({g: f"to_{g}" for g in grid}), [*by, *[f"to_{g}" for g in grid]])
    same = F.lit(True)
    for g in grid:
        same = same & (F.col(g) == F.col(f"to_{g}"))
    met = met.where(~same | (F.col("a.node") < F.col("b.node")))

    met = met.withColumns({"node_a": F.col("a.node"), "node_b": F.col("b.node")})
    linear = PER_ROW * (nodes.agg(F.sum("n")).first()[0] or 0)
    links = None
    for level in range(LEVELS + 1):
        if tally is not None:
            tally.append(met.count())
        judged = met.withColumn("linked", verdict(km, span_us)).where("linked IS NULL OR linked")
        judged = written(judged.select(*by, "node_a", "node_b", "linked", (F.col("a.n") * F.col("b.n")).alias("pairs"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in CELL]), "boxes")
        found = judged.where("linked").select("node_a", "node_b").distinct()
        links = found if links is None else links.unionByName(found)
        left = judged.where("linked IS NULL")
        left = left.join(found, ["node_a", "node_b"], "left_anti") if level else left
        pairs = left.agg(F.sum(F.col("pairs").cast("double"))).first()[0]
        if pairs is None:
            return links
        if pairs <= linear or level == LEVELS:
            break
        # The boxes of the cubes in question, halved on all sides.
        parents = [f"p{c}" for c in CELL]
        side = lambda s: left.select(*by, *[F.col(f"{s}_{c}").alias(p) for c, p in zip(CELL, parents, strict=True)])  # noqa: B023, E731
        above = dict(zip(parents, cells(km, span_us, level).values(), strict=True))
        asked = points.withColumns(above).join(side("a").unionByName(side("b")).distinct(), [*by, *parents], "left_semi")
        kids = written(boxes(asked.withColumns(cells(km, span_us, level + 1)), by), "halves")
        kids = kids.withColumns({p: F.floor(F.col(c) / 2) for c, p in zip(CELL, parents, strict=True)})
        met = left.select(*by, "node_a", "node_b", *[f"{s}_{c}" for s in "ab" for c in CELL])
        for s in "ab":
            keys = [f"{s}_{c}" for c in CELL]
            met = met.join(as_side(kids, s, [*by, *parents]).withColumnsRenamed(dict(zip(parents, keys, strict=True))), [*by, *keys])
    if tally is not None:
        tally.append(int(pairs))
    rows = points.withColumns(cells(km, span_us, level)).select(*by, *CELL, "lat", "lon", "s").distinct()
    met = left
    for s in "ab":
        met = met.join(rows.select(*by, *[F.col(c).alias(f"{s}_{c}") for c in CELL], *[F.col(c).alias(f"{c}_{s}") for c in ("lat", "lon", "s")]), [*by, *[f"{s}_{c}" for c in CELL]])
    near = (F.abs(F.col("s_a") - F.col("s_b")) <= span_us) & (geo.distance_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= km)
    return links.unionByName(met.where(near).select("node_a", "node_b").distinct())


def grouped(rows: DataFrame, minutes: float, km: float, key: str, by: list[str], tally: list[int] | None = None) -> DataFrame:
    """rows with event: the least key that links reach, directly or over others. A row without place, time or neighbours is its own event.
    Links are within groups of equal `by` (a null links with nothing), so many minutes and so many km."""
    span_us = round(minutes * 60_000_000)
    points = located(rows, key, by, km, span_us).dropna(subset=by)
    nodes = written(boxes(points.withColumns(cells(km, span_us, 0)), by), "nodes")
    links = node_links(points, nodes, by, km, span_us, tally)
    reached = components(links, "node_a", "node_b")
    joined = nodes.join(reached, "node", "left").where("n > 1 OR component IS NOT NULL").select(*by, *CELL, F.coalesce("component", "node").alias("event"))
    at = located(rows, key, by, km, span_us).withColumns(cells(km, span_us, 0)).join(joined, [*by, *CELL]).select(F.col("key").alias(key), "event")
    return rows.drop("event").join(at, key, "left").withColumn("event", F.coalesce("event", key))
