"""Context documents of a bounded length: sections of items in the order of their worth, filled by running sums of their tokens.

`documents` fills each document inside its row, as an anomaly may have thousands of alerts; `fitted` and `assembled` do the same for any table of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detect import micros
from .enrich import SECTIONS

#: Tokens of a document at most; tokens that are kept for what says how many items were left out, for each section; readings of a series that can matter.
MOST, LEFT_OUT, SERIES = 3000, 8, 1000
TOKEN = r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"


def tokens(text: Column) -> Column:
    """Words of letters and digits, and other signs one by one."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), F.lit(0))


def fitted(items: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """items (key, rank, section, place, item) with n_tokens and kept: those of a document, by rank and place, before the first that would take
    it over `most` tokens, less what all its sections' titles and the numbers of left-out items take. Rank 0 is always kept."""
    title = F.row_number().over(Window.partitionBy(key, "rank").orderBy("place", "item")) == 1
    counted = items.withColumns({"n_tokens": tokens(F.col("item")) + 1, "_title": F.when(title, tokens(F.col("section")) + 1 + LEFT_OUT).otherwise(0)})
    titles = F.sum("_title").over(Window.partitionBy(key))
    so_far = F.sum("n_tokens").over(Window.partitionBy(key).orderBy("rank", "place", "item").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("kept", (F.col("rank") == 0) | (titles + so_far <= most)).drop("_title")


def assembled(judged: DataFrame, key: str) -> DataFrame:
    """key, document and n_tokens: a line for each section, with the number of its items that were left out."""
    entry = F.when(F.col("kept"), F.struct("place", "item"))
    part = judged.groupBy(key, "rank", "section").agg(F.array_sort(F.collect_list(entry)).alias("own"), F.count_if(~F.col("kept")).alias("more"))
    said = F.array_join(F.transform("own", lambda x: x["item"]), "; ")
    more = F.when((F.col("more") > 0) & (F.size("own") > 0), F.concat(F.lit("; and "), F.col("more"), F.lit(" more"))).when(F.col("more") > 0, F.concat(F.col("more").cast("string"), F.lit(" known"))).otherwise("")
    lines = part.withColumn("line", F.concat("section", F.lit(": "), said, more)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    out = lines.select(key, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("document"))
    return out.withColumn("n_tokens", tokens(F.col("document")))


def series(anomalies: DataFrame, readings: DataFrame, hours: int = 72, key: str = "id") -> DataFrame:
    """key, readings: the metric's readings at the entity in the hours before each anomaly, the latest first, as (minutes before, value); so many
    of the latest as any document can say."""
    span = hours * 3_600_000_000
    a = anomalies.select(F.col(key).alias("anomaly"), "source_entity_id", "metric", micros(F.col("timestamp")).alias("at_a"))
    a = a.withColumn("bucket", F.explode(F.array(F.floor(F.col("at_a") / span), F.floor(F.col("at_a") / span) - 1)))
    r = readings.select("source_entity_id", "metric", "value", micros(F.col("timestamp")).alias("at")).withColumn("bucket", F.floor(F.col("at") / span))
    met = a.join(r, ["source_entity_id", "metric", "bucket"]).where(F.col("at").between(F.col("at_a") - span, F.col("at_a") - 1))
    latest = F.row_number().over(Window.partitionBy("anomaly").orderBy(F.desc("at"), "value"))
    met = met.withColumn("place", latest).where(F.col("place") <= SERIES)
    ago = F.floor((F.col("at_a") - F.col("at")) / 60_000_000)
    return met.groupBy("anomaly").agg(F.array_sort(F.collect_list(F.struct("place", ago.alias("minutes"), "value"))).alias("readings")).withColumnRenamed("anomaly", key)


def sections(rows: DataFrame, key: str = "id", most: int = MOST) -> DataFrame:
    """key, sections: (section, texts, size) of enriched anomalies (with `readings` of `series`, or without): what the anomaly is comes first, then the summary of its
    history, places, fires, alerts and readings of the hour, then the series. Sections without items say that nothing is known. `texts` are the first `most` items, as
    each has a token or more with its separator; `size` counts all (alerts by n_alerts, where only the first are in the row)."""
    reading = lambda x: F.format_string("%s %s %.2f", x["source"], x["metric"], x["value"])
    of = lambda metrics: F.filter("concurrent", lambda x: x["metric"].isin(*metrics))
    known = [m for metrics in SECTIONS.values() for m in metrics]
    facts = rows.schema["facilities"].dataType.elementType.names
    place = lambda x: F.concat_ws(" ", x["facility"].cast("string"), *[x[c].cast("string") for c in ("kind",) if c in facts], F.format_string("%.1f km %s", x["km"], x["wind"]), *[F.concat(F.lit("violations "), x[c].cast("string")) for c in ("violations",) if c in facts])
    score = F.when(F.col("z").isNotNull(), F.format_string(", z-score %.2f", "z")).otherwise("") if "z" in rows.columns else F.lit("")
    said = F.concat(F.format_string("%s = %.2f %s at %.4f, %.4f", "metric", "value", "unit", "lat", "lon"), score, F.lit(", "), F.col("timestamp").cast("string"), F.lit(", "), F.concat_ws("/", "source", "source_entity_id"))
    usual = [F.when(F.col("usual").isNotNull(), F.format_string("usual at this hour %.2f", "usual"))] if "usual" in rows.columns else []
    summary = F.when(F.col("history.n") > 0, F.format_string("%d readings, %.2f to %.2f, mean %.2f", "history.n", "history.low", "history.high", "history.mean_value"))
    own = lambda x: x
    parts = [
        ("Anomaly", F.array(said), own),
        ("History of 72 hours", F.array_compact(F.array(summary, *usual)), own),
        ("Alerts", F.col("alerts"), lambda x: x.cast("string")),
        ("Fires", F.col("fires"), lambda x: F.format_string("%s %.1f km %s, %.1f", x["fire"].cast("string"), x["km"], x["wind"], x["value"])),
        ("Facilities", F.col("facilities"), place),
        *[(title, of(metrics), reading) for title, metrics in SECTIONS.items()],
        ("Other readings", F.filter("concurrent", lambda x: ~x["metric"].isin(*known)), reading),
        *([("Readings before, minutes and value", F.coalesce("readings", F.array()), lambda x: F.format_string("%d %.2f", x["minutes"], x["value"]))] if "readings" in rows.columns else []),
    ]
    none = F.array(F.lit("none known"))
    some = lambda x, text: F.when(F.size(x) > 0, F.transform(F.slice(x, 1, most), text)).otherwise(none)
    all_of = {"Alerts": F.col("n_alerts").cast("int")} if "n_alerts" in rows.columns else {}
    return rows.select(key, F.array(*[F.struct(F.lit(title).alias("section"), some(x, text).alias("texts"), F.greatest(F.size(x), all_of.get(title, F.lit(1)), F.lit(1)).alias("size")) for title, x, text in parts]).alias("sections"))


def documents(rows: DataFrame, key: str = "id", most: int = MOST) -> DataFrame:
    """key, document and n_tokens of enriched anomalies; no document has more than `most` tokens, but for what the anomaly itself is. As `fitted`, a document ends
    before the first item that would take it over."""
    titles = F.aggregate("sections", F.lit(0), lambda n, s: n + tokens(s["section"]) + 1 + LEFT_OUT)
    full = lambda a: a["total"] > most

    def filled(a: Column, s: Column) -> Column:
        """After a section: the tokens up to the first item too many, that one counted, and the number of items kept in each section."""
        begin = F.struct(a["total"].alias("total"), F.lit(0).alias("n"), a["kept"].alias("kept"))
        turn = lambda x, text: F.when(full(x), x).otherwise(F.struct((x["total"] + tokens(text) + 1).alias("total"), (x["n"] + 1).alias("n"), x["kept"].alias("kept")))
        end = lambda x: F.struct(x["total"].alias("total"), F.concat(x["kept"], F.array(F.when(full(x), F.greatest(x["n"] - 1, F.lit(0))).otherwise(x["n"]))).alias("kept"))
        return F.aggregate(s["texts"], begin, turn, end)

    kept = F.aggregate("sections", F.struct(titles.alias("total"), F.array().cast("array<int>").alias("kept")), filled, lambda a: a["kept"])

    def line(s: Column, n: Column, i: Column) -> Column:
        n = F.when(i == 0, s["size"]).otherwise(n)  # the anomaly itself
        more = s["size"] - n
        said = F.array_join(F.slice(s["texts"], 1, n), "; ")
        left = F.when((more > 0) & (n > 0), F.concat(F.lit("; and "), more.cast("string"), F.lit(" more"))).when(more > 0, F.concat(more.cast("string"), F.lit(" known"))).otherwise("")
        return F.concat(s["section"], F.lit(": "), said, left)

    lines = F.transform(F.arrays_zip("sections", "kept"), lambda x, i: line(x["sections"], x["kept"], i))
    out = sections(rows, key, most).withColumn("kept", kept).select(key, F.array_join(lines, "\n").alias("document"))
    return out.withColumn("n_tokens", tokens(F.col("document")))
