"""Retrieval, grounding of claims, agreement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Vectors in a block of queries and of chunks, and blocks of chunks in a deal; each deal gets all queries, a stated set.
QUERY_BLOCK, CHUNK_BLOCK, BLOCKS = 512, 4096, 4


def blocks(rows: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Vectors in blocks, a row each: the keys as text, dim, and the unit vectors as one binary. Vectors that are null, empty, zero or not finite are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[[v is not None and len(v) > 0 for v in frame["v"]]]
            for dim, part in frame.groupby(frame["v"].map(len), sort=True):
                for at in range(0, len(part), size):
                    x = np.array(part["v"].iloc[at : at + size].tolist(), float)
                    norm = np.linalg.norm(x, axis=1)
                    good = np.isfinite(norm) & (norm > 0)
                    if good.any():
                        yield pd.DataFrame({"dim": [dim], f"{name}_keys": [part["k"].iloc[at : at + size][good].tolist()], f"{name}_vectors": [(x[good] / norm[good, None]).tobytes()]})

    given = rows.select(F.col(key).cast("string").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k IS NOT NULL")
    return given.mapInPandas(run, f"dim int, {name}_keys array<string>, {name}_vectors binary")


def top_chunks(queries: DataFrame, chunks: DataFrame, k: int, query: str = "query", vector: str = "embedding", chunk: str = "chunk") -> DataFrame:
    """For each query its k nearest chunks by cosine (to nine decimals, ties by id), with similarity and place. Blocks of queries meet blocks
    of chunks of the same dimension; each two give k chunks of a query at most, so little is shuffled after them. Neither side is broadcast; there
    are as many deals of chunks as their number asks for."""
    asked, known = blocks(queries, query, vector, QUERY_BLOCK, "q"), blocks(chunks, chunk, vector, CHUNK_BLOCK, "c")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                q, c = (np.frombuffer(v).reshape(-1, row.dim) for v in (row.q_vectors, row.c_vectors))
                near, most = np.round(q @ c.T, 9), min(k, len(c))
                least = -np.partition(-near, most - 1, axis=1)[:, most - 1]
                i, j = np.nonzero(near >= least[:, None])  # ties at the k-th place stay until all blocks are known
                yield pd.DataFrame({"q": np.asarray(row.q_keys)[i], "c": np.asarray(row.c_keys)[j], "similarity": near[i, j]})

    deals = max(1, -(-chunks.count() // (CHUNK_BLOCK * BLOCKS)))
    dealt = known.withColumn("deal", F.pmod(F.xxhash64("c_keys"), F.lit(deals)).cast("int"))
    met = asked.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).join(dealt, ["dim", "deal"]).mapInPandas(run, "q string, c string, similarity double")
    out = met.select(F.col("q").cast(queries.schema[query].dataType).alias(query), F.col("c").cast(chunks.schema[chunk].dataType).alias(chunk), "similarity")
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("similarity"), chunk))
    return out.withColumn("place", place).where(F.col("place") <= k)


def grounded(claims: DataFrame, evidence: DataFrame, key: list[str]) -> DataFrame:
    """claims with verified (some evidence shares the key) and text marked [unverified] otherwise."""
    known = evidence.select(*key).distinct().withColumn("_known", F.lit(True))
    out = claims.join(known, key, "left").withColumn("verified", F.coalesce("_known", F.lit(False))).drop("_known")
    return out.withColumn("marked", F.when(F.col("verified"), F.col("claim")).otherwise(F.concat(F.lit("[unverified] "), F.col("claim"))))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed and expected agreement, and Cohen's kappa (null where agreement is certain by chance)."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    side = lambda c: cells.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias(f"n_{c}"))
    chance = side(a).join(side(b), "v").agg(F.coalesce(F.sum(F.col(f"n_{a}").cast("double") * F.col(f"n_{b}")), F.lit(0.0)).alias("chance"))
    both = total.join(F.broadcast(chance), F.lit(True)).select("total", (F.col("same") / F.col("total")).alias("observed"), (F.col("chance") / F.pow("total", F.lit(2))).alias("expected"))
    return both.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


METADATA = "struct<cause: string, confidence: double, radius_km: double, risk: map<string, string>>"


def metadata(rows: DataFrame, column: str = "metadata") -> DataFrame:
    """Fields of an explanation's JSON metadata as columns; what is missing or unreadable is null."""
    return rows.withColumn("_m", F.from_json(column, METADATA)).select("*", "_m.*").drop("_m")


def likert(ratings: DataFrame, by: list[str], rating: str = "rating", low: int = 1, high: int = 5) -> DataFrame:
    """Number, mean and standard deviation of the ratings on the scale; others do not count."""
    on_scale = F.when(F.col(rating).between(low, high), F.col(rating).cast("double"))
    return ratings.groupBy(*by).agg(F.count(on_scale).alias("n"), F.avg(on_scale).alias("mean_rating"), F.stddev_samp(on_scale).alias("sd_rating"))


def ablation(scores: DataFrame, variant: str = "variant", item: str = "item", score: str = "score", full: str = "full") -> DataFrame:
    """For each variant without one of the sources: items scored under it and under the full context, both means, and what is lost."""
    whole = scores.where(F.col(variant) == full).groupBy(item).agg(F.avg(score).alias("_full"))
    part = scores.where(F.col(variant) != full).groupBy(variant, item).agg(F.avg(score).alias("_part"))
    both = part.join(whole, item).groupBy(variant).agg(F.count(F.lit(1)).alias("n"), F.avg("_part").alias("mean_score"), F.avg("_full").alias("mean_full"))
    return both.withColumn("lost", F.col("mean_full") - F.col("mean_score"))


# Claims in free text

#: Names of metrics and units in texts.
CLAIMED = {"pm2.5": "pm25", "pm25": "pm25", "pm10": "pm10", "ozone": "ozone", "no2": "no2", "so2": "so2", "co": "co", "temperature": "temperature", "humidity": "humidity", "wind speed": "wind_speed", "pressure": "pressure"}
CLAIM_UNITS = {"ug/m3": "ug/m3", "µg/m³": "ug/m3", "μg/m³": "ug/m3", "ppm": "ppm", "ppb": "ppb", "°c": "degC", "degc": "degC", "%": "percent", "percent": "percent", "m/s": "m/s", "hpa": "hPa"}
#: A metric, a number and a unit in one sentence, and maybe a day after them. It is a fixed pattern, also of the SQL that is held against it.
CLAIM = r"(?i)\b(pm2\.5|pm25|pm10|ozone|no2|so2|co|temperature|humidity|wind speed|pressure)\b[^0-9.;\n]{0,40}?(-?[0-9]+(?:\.[0-9]+)?) ?(ug/m3|µg/m³|μg/m³|ppm|ppb|°c|degc|percent|%|m/s|hpa)(?:[^0-9.;\n]{0,20}([0-9]{4}-[0-9]{2}-[0-9]{2}))?"


def claims(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, n (from 0), span, metric, value, unit and day (null if none is said) of every measured value that a text states. A null text states none."""
    groups = [F.regexp_extract_all(text, F.lit(CLAIM), F.lit(i)) for i in range(5)]
    found = texts.select(F.col(key), F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("span", "metric", "value", "unit", "day"), strict=True)])).alias("n", "c"))
    known = lambda names, c: F.element_at(F.create_map(*[F.lit(x) for item in names.items() for x in item]), F.lower(c))
    return found.select(key, "n", "c.span", known(CLAIMED, F.col("c.metric")).alias("metric"), F.col("c.value").cast("double").alias("value"), known(CLAIM_UNITS, F.col("c.unit")).alias("unit"), F.col("c.day").try_cast("date").alias("day"))


def supported(stated: DataFrame, evidence: DataFrame, by: list[str], tolerance: float = 0.1) -> DataFrame:
    """stated with verified: whether some evidence (by, metric, unit, value, timestamp) is within the tolerance (a share of the evidence), on
    the claim's day if it has one. Values meet by buckets of their logarithms, of which evidence keeps the ends only: whatever lies between
    them supports no claim that the ends do not. So a claim meets three rows at most, however much evidence there is."""
    if not 0 < tolerance < 1:
        raise ValueError("the tolerance is a share between 0 and 1")
    width = -float(np.log1p(-tolerance)) * (1 + 1e-9)
    bucket = lambda v: F.coalesce(F.floor(F.ln(F.abs(v)) / width), F.lit(0)).cast("long")
    keys = [*by, "metric", "unit", "_sign", "_day", "_bucket"]
    seen = evidence.where("value IS NOT NULL").select(*by, "metric", "unit", "value", F.signum("value").alias("_sign"), F.explode(F.array(F.coalesce(F.to_date("timestamp").cast("string"), F.lit("never")), F.lit("any"))).alias("_day"), bucket(F.col("value")).alias("_bucket"))
    ends = seen.groupBy(*keys).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    names = stated.columns
    asked = stated.drop("verified").withColumns({"_claim": F.struct(*[c for c in names if c != "verified"]), "_sign": F.signum("value"), "_day": F.coalesce(F.col("day").cast("string"), F.lit("any")), "_bucket": F.explode(F.array(*[bucket(F.col("value")) + i for i in (-1, 0, 1)]))})
    near = lambda e: F.abs(F.col("value") - F.col(e)) <= F.abs(F.col(e)) * tolerance
    met = asked.join(ends, keys, "left").withColumn("_good", F.coalesce(near("_low") | near("_high"), F.lit(False)))
    return met.groupBy("_claim").agg(F.max("_good").alias("verified")).select("_claim.*", "verified")


def annotated(texts: DataFrame, judged: DataFrame, key: str, text: str) -> DataFrame:
    """texts with n_claims, n_verified, and marked: the text with [unverified] after each claim that nothing supports. A text whose claims are stated twice is
    marked at both places; one without claims is unchanged, and its share is that of no claims."""
    facts = judged.groupBy(key).agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("verified").alias("n_verified"), F.array_sort(F.collect_set(F.when(~F.col("verified"), F.col("span")))).alias("_spans"))
    out = texts.drop("n_claims", "n_verified", "marked").join(facts, key, "left").fillna(0, ["n_claims", "n_verified"])
    mark = F.aggregate("_spans", F.col(text), lambda t, s: F.replace(t, s, F.concat(s, F.lit(" [unverified]"))))
    return out.withColumn("marked", F.coalesce(mark, F.col(text))).drop("_spans")
