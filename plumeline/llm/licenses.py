"""License scans with DataFrame functions only.

Windows of overlapping words are hashed by MinHash bands and retrieve license templates from a table of their bands; exact shingle
containment verifies what they retrieve. Templates are classed by length, and each class has windows of its own: their size and
step are so chosen that some window holds the whole of any match, and its number of bands so that such a window collides with its
template with at least the wanted probability.

A text is windowed only if it holds a word without which no template can match; that loses nothing: a template whose containment
reaches the threshold has too many shingles for all those with such a word to be missing.

Templates come as a few texts or as a table (license_id, text), such as the full texts of all licenses; their shingles and bands are
then made by Spark, and only their words come to the driver, which plans windows from them: MOST_TEMPLATES words at most.

Words are lower-cased runs of letters and digits; shingles are five words. Null and empty texts match nothing; every row is a text of its
own, so repeated rows and shared or null keys give a row for each. Whole texts are read, in windows. A containment equal to the
threshold is a match; of windows of equal containment the first is reported. Further columns are ignored; an empty table gives an empty
table. Templates shorter than five words are refused, as are more than MOST_TEMPLATES words of them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT, COLLISION = 5, 0.8, 0.999
#: Bands of all templates up to so many rows are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BANDS = 200_000
#: Words of all templates together; a plan is made from them on the driver.
MOST_TEMPLATES = 5_000_000
#: Letters of a word that is worth looking for first.
TELLING = 6

#: Notices by which licenses are granted in a line.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_shingles(text: str) -> list[str]:
    own = template_words(text)
    return list(dict.fromkeys(" ".join(own[i : i + SHINGLE]) for i in range(len(own) - SHINGLE + 1)))


@dataclass(frozen=True)
class Scale:
    """Windows for the templates of `least` to `most` shingles."""

    least: int
    most: int
    words: int
    step: int
    bands: int


def scales(templates: dict[str, str], containment: float, collision: float) -> dict[str, Scale]:
    """The scale of each template; its class is the power of two at or below its number of shingles."""
    sizes = {name: len(template_shingles(text)) for name, text in templates.items()}
    if short := [n for n, size in sizes.items() if not size]:
        raise ValueError(f"templates of less than {SHINGLE} words: {short}")
    out = {}
    for name, size in sizes.items():
        low = 1 << (size.bit_length() - 1)
        most = max(s for s in sizes.values() if s >> (size.bit_length() - 1) == 1)
        longest = max(len(template_words(t)) for n, t in templates.items() if sizes[n] >> (size.bit_length() - 1) == 1)
        step = max(1, low // 2)
        words = longest + step - 1
        shingles = words - SHINGLE + 1
        common = min(math.ceil(containment * s - 1e-9) / (shingles + s - math.ceil(containment * s - 1e-9)) for s in range(low, most + 1))
        out[name] = Scale(low, most, words, step, max(1, math.ceil(math.log(1 - collision) / math.log(1 - common))) if common < 1 else 1)
    return out


def required_words(templates: dict[str, str], containment: float) -> list[str]:
    """Words of which every match has one: for each template enough that the shingles without any are too few to match."""
    out: set[str] = set()
    for text in templates.values():
        left = template_shingles(text)
        allowed = math.ceil(containment * len(left) - 1e-9) - 1
        left = [s for s in left if not out & set(s.split())]
        while len(left) > allowed:
            words = {w for s in left for w in s.split()}
            telling = {w for w in words if len(w) >= TELLING} or words  # long words are rare in other texts
            best = max(sorted(telling), key=lambda w: (sum(w in s.split() for s in left), len(w)))
            out.add(best)
            left = [s for s in left if best not in s.split()]
    return sorted(out)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def shingles_of(words: Column) -> Column:
    at = F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))


def band_values(shingles: Column, bands: int) -> Column:
    """The least hash of all shingles under each of `bands` hash functions."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(band))))

    return F.array(*map(least, range(bands)))


def windows_of(starts: Column, scale: Scale) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.array_distinct(F.slice("shingles", i, scale.words - SHINGLE + 1)).alias("seen")))


def planned(templates: DataFrame) -> tuple[dict[str, str], DataFrame]:
    """The words of each template of a table, and license_id and own (its distinct shingles) as Spark makes them. Of templates that share an id the least text counts."""
    one = templates.where("license_id IS NOT NULL AND text IS NOT NULL").groupBy(F.col("license_id").cast("string").alias("license_id")).agg(F.min("text").alias("text"))
    words = one.select("license_id", words_of(F.col("text")).alias("words"))
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    if total > MOST_TEMPLATES:
        raise ValueError(f"{total} words of templates; at most {MOST_TEMPLATES}")
    return {r.license_id: " ".join(r.words) for r in words.collect()}, words.select("license_id", F.array_distinct(shingles_of(F.col("words"))).alias("own"))


def template_table(spark: SparkSession, templates: dict[str, str], scale: Scale, of: dict[str, Scale]) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("license_id"), F.array(*map(F.lit, template_shingles(t))).alias("own")) for n, t in templates.items() if of[n] == scale]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.license_id", "t.own")


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT, collision: float = COLLISION) -> DataFrame:
    """key, license_id, containment (the best window's share of the template's shingles) and first_word (where the first such
    window starts), one row for each license that a row's text holds."""
    templates, table_of = planned(templates) if isinstance(templates, DataFrame) else (NOTICES if templates is None else templates, None)
    if not templates:
        return docs.select(F.col(key), F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word")).limit(0)
    of = scales(templates, containment, collision)
    needed = "(?<![\\p{L}\\p{N}])(" + "|".join(required_words(templates, containment)) + ")(?![\\p{L}\\p{N}])"
    known = docs.select(F.col(key), F.col(text).alias("text")).where(F.lower("text").rlike(needed)).withColumn("row", F.monotonically_increasing_id())
    known = known.select(key, "row", words_of(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE).select(key, "row", shingles_of(F.col("words")).alias("shingles"))
    found = []
    for scale in sorted(set(of.values()), key=lambda s: s.least):
        # Cut inside one expression: a window's row holds its own shingles, not the text's.
        starts = F.sequence(F.lit(1), F.size("shingles"), F.lit(scale.step))
        windows = known.select(key, "row", F.explode(windows_of(starts, scale)).alias("w")).select(key, "row", "w.start", "w.seen")
        bands = windows.select(key, "row", "start", "seen", F.posexplode(band_values(F.col("seen"), scale.bands)).alias("band", "value"))
        names = [n for n in templates if of[n] == scale]
        table = template_table(docs.sparkSession, templates, scale, of) if table_of is None else table_of.where(F.size("own").between(scale.least, scale.most) & F.col("license_id").isin(names))
        asked = table.select("license_id", "own", F.posexplode(band_values(F.col("own"), scale.bands)).alias("band", "value"))
        asked = F.broadcast(asked) if len(templates) * scale.bands <= BROADCAST_BANDS else asked
        hits = bands.join(asked, ["band", "value"]).select(key, "row", "start", "license_id", (F.size(F.array_intersect("own", "seen")) / F.size("own")).alias("containment"))
        found.append(hits.where(F.col("containment") >= containment))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = out.groupBy(key, "row", "license_id").agg(F.max("containment").alias("containment"), F.min_by("start", F.struct(-F.col("containment"), F.col("start"))).alias("first_word"))
    return best.select(key, "license_id", "containment", (F.col("first_word") - 1).alias("first_word"))
