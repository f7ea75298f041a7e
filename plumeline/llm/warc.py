"""A content-addressed WARC archive of two tables.

`payloads` holds the bytes of every distinct payload once, under its SHA-256; `headers` holds the exact header bytes of every record
and the digest of its payload. A join of the two gives the records back, byte for byte, and reading checks each payload against its
digest. Of records with equal payloads of at least `least` bytes the one of smallest page_id is a response, the others revisit it.

Null or empty html is an empty payload. A null url is an empty target. Repeated rows give repeated records; their payload is stored
once, as are those of equal rows that share a page_id. Rows with a null page_id become revisits of an equal payload, else responses.
Payloads of any length are stored whole; a payload that many pages share meets its records in a broadcast of the repeated digests, up to
a bound. An empty table gives an empty archive. Further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

CRLF = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Up to so many digests of repeated payloads, and rows (a page_id and a digest) that need no payload, under 100 bytes each, are broadcast, so
#: that neither records nor payloads are shuffled; beyond, both sides are.
BROADCAST_ROWS = 200_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: every 5 hexadecimal digits are 20 bits, that is 4 base32 digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def with_headers(pages: DataFrame, date: str, least: int) -> DataFrame:
    """page_id, digest (SHA-256), revisit, first (of its digest) and header, the bytes before the payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.length(payload).alias("size"), base32_sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("digest"))
    firsts = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = written(firsts, "repeated")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    revisit = F.when(F.col("size") < least, False).otherwise(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size"), F.lit(CRLF * 2))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"\s", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first")))),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {REVISIT}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.length(F.encode(http, "UTF-8")) + F.when(F.col("revisit"), 0).otherwise(F.col("size"))),
    ]
    header = F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http), "UTF-8")
    known = known.join(firsts, "digest", "left").withColumn("first", F.coalesce("first", "page_id"))
    return known.withColumn("revisit", revisit).select("page_id", "digest", "revisit", F.col("page_id").eqNullSafe(F.col("first")).alias("first"), header.alias("header"))


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least: int = 0) -> None:
    """Writes `path`/headers and `path`/payloads."""
    spark = pages.sparkSession
    with_headers(pages, date, least).write.option("compression", "zstd").parquet(f"{path}/headers")
    others = spark.read.parquet(f"{path}/headers").where("NOT first").select("page_id", "digest")
    if others.count() <= BROADCAST_ROWS:
        others = F.broadcast(others)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    brought = pages.select("page_id", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).join(others, ["page_id", "digest"], "left_anti").select("digest", "payload")
    brought.write.option("compression", "zstd").parquet(f"{path}/payloads")
    stored = spark.read.parquet(f"{path}/payloads")
    if not stored.groupBy("digest").count().where("count > 1").isEmpty():  # repeated rows, or null page_ids
        stored.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/distinct")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of every WARC record, as column record. A payload that is not of its digest fails the job."""
    headers = spark.read.parquet(f"{path}/headers")
    folders = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/distinct")
    doubled = folders.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folders)
    payloads = spark.read.parquet(f"{path}/{'distinct' if doubled else 'payloads'}")
    payloads = payloads.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("payload and digest differ"))).alias("payload"))
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    responses = headers.where("NOT revisit").join(payloads, "digest").select(F.concat("header", "payload", end).alias("record"))
    return responses.union(headers.where("revisit").select(F.concat("header", end).alias("record")))


def parse(records: DataFrame) -> DataFrame:
    """What the bytes of each record say; the payload of a response is measured and digested anew, that of a revisit is null."""
    head = F.substring_index(F.col("record").cast("string"), CRLF * 2, 2)
    known = records.select("record", head.alias("head"))
    field = lambda name, pattern: F.regexp_extract("head", f"(?m)^{name}: {pattern}", 1)
    kind = field("WARC-Type", r"(\w+)")
    start = F.octet_length("head") + 5
    payload = F.when(kind == "response", F.col("record").substr(start, F.octet_length("record") - start - 3))
    known = known.select("head", kind.alias("record_type"), payload.alias("payload"))
    revisit = F.col("record_type") == "revisit"
    return known.select(
        field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").try_cast("long").alias("page_id"),
        field("WARC-Target-URI", "([^\r\n]*)").alias("url"),
        F.when(revisit, F.regexp_extract("head", r"(?s)\r\n\r\n.*Content-Length: ([0-9]+)", 1).cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        "record_type",
        F.when(revisit, field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").try_cast("long")).alias("refers_to"),
        "payload",
    )
