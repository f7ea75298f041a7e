"""Line dedup that can be taken back: sharded cuckoo filters in front of exact reference counts.

A line's key is the line without white space at both ends, A-Z lower-cased; keys of at least `chars` code points count. `LineIndex` is a folder of
tables, to which each change adds a version; a version counts once its last table is complete, so that a change that dies halfway changes nothing:

- `holdings`: (doc_id, key, sign), a row for each document and key that came or went;
- `counts`: for the keys that a version touched how many documents hold them, and the largest doc_id of these. The last version of a key holds;
- `filters`: a cuckoo filter for each touched shard, of the keys that at least `least` documents hold. The last version of a shard holds.

`insert` and `delete` update the counts of the keys that they touch; keys that get common enough enter the filter of their shard, keys that no longer are
leave it, which a Bloom filter could not do. `dropped` asks the filters for every holding, so that only common keys (and a few false alarms)
meet the exact counts, which decide. A document keeps the lines of the keys that it is the last one to hold.

Null or empty texts are one empty line. Rows that share a doc_id are one document; rows without one hold nothing and stay as they are.
Inserting a document again with the same lines changes nothing. A key is the 128-bit BLAKE2b digest of the line, so that long lines cost what short ones do.
A key that many documents hold is summed before it is shuffled, and meets the counts in a broadcast of the `HOT` most frequent keys at most. Empty tables give
empty versions. Further columns stay in `apply`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Keys above 1 / HOT of all common holdings are broadcast, of which there are fewer than HOT.
HOT = 2_000
#: Up to so many bytes of filters, and rows of dropped keys (under 50 bytes each), are broadcast; beyond, holdings go to the shards, and documents are shuffled.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 500_000
#: Holdings of a shard that meet its filter in one task.
TOGETHER = 1_000_000
WHITE = " \t\n\x0b\x0c\r"
SLOTS, KICKS = 4, 500


def key_of(line: str, chars: int) -> bytes | None:
    line = line.strip(WHITE)
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(line) >= chars else None  # of bytes only A-Z are lowered


# A cuckoo filter is an array of buckets of four 16-bit fingerprints, 0 where free; a fingerprint is in one of two buckets, each of which follows from the other.


def hashed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and fingerprint (1 to 65535) of keys of 16 bytes, whose halves are hashes already."""
    halves = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
    return halves[:, 0], halves[:, 1] % np.uint64(65535) + np.uint64(1)


def step(fingerprint):
    """What leads from one bucket of a fingerprint to its other one."""
    return fingerprint * type(fingerprint)(0x5BD1E995) if isinstance(fingerprint, int) else fingerprint * np.uint64(0x5BD1E995)


def keys_array(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)


def has(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; never false for one that is."""
    place, mark = hashed(keys)
    buckets, mask = table.reshape(-1, SLOTS), np.uint64(len(table) // SLOTS - 1)
    one = place & mask
    two = one ^ (step(mark) & mask)
    return (buckets[one] == mark[:, None]).any(axis=1) | (buckets[two] == mark[:, None]).any(axis=1)


def put(table: memoryview, place: int, mark: int) -> bool:
    """Adds a fingerprint; False, and nothing changed, if it finds no bucket after so many kicks."""
    mask, path = len(table) // SLOTS - 1, []
    bucket = place & mask
    for kick in range(KICKS):
        other = bucket ^ (step(mark) & mask)
        for at in (*range(bucket * SLOTS, bucket * SLOTS + SLOTS), *range(other * SLOTS, other * SLOTS + SLOTS)):
            if not table[at]:
                table[at] = mark
                return True
        at = other * SLOTS + kick % SLOTS
        path.append((at, table[at]))
        table[at], mark = mark, table[at]
        bucket = at // SLOTS ^ (step(mark) & mask)
    for at, old in reversed(path):
        table[at] = old
    return False


def take(table: memoryview, place: int, mark: int) -> None:
    """Removes one such fingerprint. Keys that share fingerprint and buckets have one each, so that it does not matter whose goes."""
    mask = len(table) // SLOTS - 1
    bucket = place & mask
    other = bucket ^ (step(mark) & mask)
    for at in (*range(bucket * SLOTS, bucket * SLOTS + SLOTS), *range(other * SLOTS, other * SLOTS + SLOTS)):
        if table[at] == mark:
            table[at] = 0
            return
    raise ValueError("a key that leaves a filter was not in it")


def updated(table: np.ndarray, new: np.ndarray, gone: np.ndarray) -> np.ndarray | None:
    """The filter after keys came and went; None if they do not fit."""
    table = table.copy()
    view = memoryview(table)
    for place, mark in zip(*(x.tolist() for x in hashed(gone)), strict=True):
        take(view, place, mark)
    for place, mark in zip(*(x.tolist() for x in hashed(new)), strict=True):
        if not put(view, place, mark):
            return None
    return table


def built(keys: np.ndarray) -> np.ndarray:
    """A filter of those keys with room for as many more."""
    buckets = 1
    while buckets * SLOTS * 0.9 < max(2 * len(keys), 8):
        buckets *= 2
    while (table := updated(np.zeros(buckets * SLOTS, np.uint16), keys, keys[:0])) is None:
        buckets *= 2
    return table


def holdings_of(docs: DataFrame, key: str, text: str, chars: int) -> DataFrame:
    """doc_id and key, each pair once for a row."""
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for n, body in enumerate(batch.column("text").to_pylist()):
                keys = {k: None for line in body.split("\n") if (k := key_of(line, chars))}
                at += [n] * len(keys)
                found += keys
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], ["doc_id", "key"])

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, key binary")


class LineIndex:
    """The tables in `path`, a folder that driver and executors share. `shards` is settled when the folder is new; take as many as keep the common
    keys of each at some millions."""

    def __init__(self, spark: SparkSession, path: str, shards: int = 64, least: int = 3, chars: int = 20):
        self.spark, self.path, self.shards, self.least, self.chars = spark, path.rstrip("/"), shards, least, chars

    def version(self) -> int:
        """The last complete version, 0 if there is none."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/filters")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        known = [int(p.getPath().getName().partition("=")[2]) for p in fs.listStatus(root) if p.getPath().getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))]
        return max(known, default=0)

    def write(self, df: DataFrame, table: str, version: int) -> DataFrame:
        """Over what a change that died may have left."""
        path = f"{self.path}/{table}/version={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, table: str, version: int) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/version={n}" for n in range(1, version + 1)])

    def holdings(self, version: int) -> DataFrame:
        """doc_id and key of what is held."""
        rows = self.read("holdings", version)
        if version == 1:
            return rows.select("doc_id", "key")
        return rows.groupBy("doc_id", "key").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def counts(self, version: int) -> DataFrame:
        """key, n and holder of all keys that were ever held."""
        rows = self.read("counts", version)
        if version > 1:
            rows = rows.groupBy("key").agg(F.max_by(F.struct("n", "holder"), "version").alias("last")).select("key", "last.*")
        return rows.select("key", "n", "holder")

    def filters(self, version: int) -> DataFrame:
        """shard and filter."""
        return self.read("filters", version).groupBy("shard").agg(F.max_by("filter", "version").alias("filter"))

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        last = self.version()
        held = holdings_of(docs, key, text, self.chars)
        if not docs.groupBy(key).count().where("count > 1").isEmpty():
            held = held.distinct()
        if last:
            held = held.join(self.holdings(last), ["doc_id", "key"], "left_anti")
        held = self.write(held.withColumn("sign", F.lit(1)), "holdings", last + 1)
        now = held.groupBy("key").agg(F.count(F.lit(1)).alias("more"), F.max("doc_id").alias("largest"))
        if last:
            now = now.join(self.counts(last), "key", "left")
            now = now.select("key", F.coalesce("n", F.lit(0)).alias("was"), (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"), F.greatest("holder", "largest").alias("holder"))
        else:
            now = now.select("key", F.lit(0).cast("long").alias("was"), F.col("more").alias("n"), F.col("largest").alias("holder"))
        self.update(self.write(now, "counts", last + 1), last)

    def delete(self, ids: DataFrame, key: str = "doc_id") -> None:
        """Documents by their ids; those that hold nothing change nothing."""
        last = self.version()
        if not last:
            return
        held = self.holdings(last)
        gone = held.join(ids.select(F.col(key).alias("doc_id")).distinct(), "doc_id", "left_semi")
        gone = self.write(gone.withColumn("sign", F.lit(-1)), "holdings", last + 1)
        touched = gone.select("key").distinct()
        left = held.join(touched, "key", "left_semi").join(gone, ["doc_id", "key"], "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("left"), F.max("doc_id").alias("largest"))
        now = touched.join(self.counts(last), "key").join(left, "key", "left")
        now = now.select("key", F.col("n").alias("was"), F.coalesce("left", F.lit(0)).alias("n"), F.col("largest").alias("holder"))
        self.update(self.write(now, "counts", last + 1), last)

    def shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")

    def update(self, counts: DataFrame, last: int) -> None:
        """Keys that got common enough enter the filters, those that no longer are leave. A filter that gets too full is built anew from the counts."""
        least = self.least
        up = F.col("n") >= least
        changes = counts.where(up != (F.col("was") >= least)).select("key", self.shard(), up.alias("up"))
        before = self.filters(last) if last else self.spark.createDataFrame([], "shard int, filter binary")

        def run(change: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            if not len(change):
                return pd.DataFrame({"shard": pd.Series([], dtype="int32"), "filter": pd.Series([], dtype=object)})
            keys, up = keys_array(change["key"]), change["up"].to_numpy(bool)
            table = updated(np.frombuffer(old["filter"].iloc[0], np.uint16), keys[up], keys[~up]) if len(old) else built(keys[up])
            return pd.DataFrame({"shard": change["shard"].iloc[:1].astype("int32"), "filter": [None if table is None else table.tobytes()]})

        new = changes.groupBy("shard").cogroup(before.groupBy("shard")).applyInPandas(run, "shard int, filter binary")
        if last:
            new = written(new, "filters")
            full = new.where("filter IS NULL").select("shard")
            if not full.isEmpty():
                common = self.counts(last + 1).where(F.col("n") >= least).select("key", self.shard()).join(F.broadcast(full), "shard", "left_semi")
                again = common.groupBy("shard").applyInPandas(lambda own: pd.DataFrame({"shard": own["shard"].iloc[:1], "filter": [built(keys_array(own["key"])).tobytes()]}), "shard int, filter binary")
                new = new.where("filter IS NOT NULL").unionByName(again)
        self.write(new, "filters", last + 1)

    def hits(self, held: DataFrame, version: int) -> DataFrame:
        """The holdings whose keys the filters know. Small filters are broadcast; else holdings go to their shards, a large shard in several tasks."""
        filters = self.filters(version)
        held = held.select("doc_id", "key", self.shard())
        kind = f"doc_id {held.schema['doc_id'].dataType.simpleString()}, key binary"
        if (filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= BROADCAST_BYTES:
            sent = self.spark.sparkContext.broadcast({r.shard: bytes(r.filter) for r in filters.collect()})

            def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    shards, keys = batch.column("shard").to_numpy(), keys_array(batch.column("key").to_pylist())
                    found = np.zeros(len(shards), bool)
                    order = np.argsort(shards, kind="stable")
                    own, starts = np.unique(shards[order], return_index=True)
                    for shard, rows in zip(own.tolist(), np.split(order, starts[1:]), strict=True):
                        if shard in sent.value:
                            found[rows] = has(np.frombuffer(sent.value[shard], np.uint16), keys[rows])
                    yield batch.select(["doc_id", "key"]).filter(pa.array(found))

            return held.mapInArrow(probe, kind)
        parts = held.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))  # a row for each shard
        held = held.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        copies = filters.join(F.broadcast(parts), "shard").select("shard", "filter", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

        def probe_part(own: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(filters):
                return own.iloc[:0][["doc_id", "key"]]
            return own.loc[has(np.frombuffer(filters["filter"].iloc[0], np.uint16), keys_array(own["key"])), ["doc_id", "key"]]

        return held.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(probe_part, kind)

    def dropped(self) -> DataFrame:
        """doc_id and key of all lines that go: of the common keys, in all documents but the last that holds them."""
        version = self.version()
        hits = written(self.hits(self.holdings(version), version), "hits")
        common = self.counts(version).where(F.col("n") >= self.least)
        total = common.agg(F.sum("n")).first()[0] or 0
        hot = F.broadcast(common.where(F.col("n") * HOT > total))
        cold = hits.join(hot.select("key"), "key", "left_anti").join(common.where(F.col("n") * HOT <= total), "key")
        return hits.join(hot, "key").unionByName(cold).where("doc_id <> holder").select("doc_id", "key")

    def apply(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """key, n_lines (before dropping), n_dropped and kept (the other lines) of documents that the index holds."""
        gone = written(self.dropped(), "dropped") if self.version() else None
        given = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        kind, chars = given.schema["doc_id"].dataType.simpleString(), self.chars
        if gone is None:
            rows = given.withColumn("keys", F.lit(None).cast("array<binary>"))
        else:
            small = gone.count() <= BROADCAST_ROWS
            gone = gone.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
            rows = given.where("doc_id IS NOT NULL").join(F.broadcast(gone) if small else gone, "doc_id", "left")
            rows = rows.unionByName(given.where("doc_id IS NULL").withColumn("keys", F.lit(None).cast("array<binary>")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for body, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                    lines = body.split("\n")
                    drop = frozenset(keys or ())
                    left = [line for line in lines if key_of(line, chars) not in drop] if drop else lines
                    out.append((len(lines), len(lines) - len(left), "\n".join(left) if drop else body))
                n, d, kept = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

        return rows.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept string").withColumnRenamed("doc_id", key)
