"""Near-duplicates by order MinHash.

A document's k-mers are its runs of five words, each labelled with how often it came before. A sketch hashes all labelled k-mers and
keeps the least few of them in the order of the text, so that two documents share a sketch if they share those k-mers and their
order: its chance falls with edits, and also with moves, that a plain MinHash does not see. Documents that share a sketch are
candidates. Texts of up to SHORT k-mers, of which few sketches could be drawn, are candidates by a rule that loses nothing instead: of
texts as alike as asked for, the least few k-mers by hash (n less the common ones that n k-mers need, and one) share one. An
alignment inside the band that the threshold allows verifies candidates: the longest chain of common labelled k-mers that rises in
both texts, over all k-mers of the two (an ordered Jaccard similarity).

Texts that are equal as words are one node. The others of a bucket are first compared with its hub only. Buckets whose documents are
linked by then, directly or not, are done. All others are compared in blocks: a bucket is cut by sizes, as texts of unlike size are
never alike, and by hashes into blocks of bounded size; two blocks that meet count their common k-mers, align the pairs that reach the
needed count and are not linked yet, and return a forest of links, never the pairs. So a bucket of a thousand near copies costs a
thousand comparisons, and no link between classes is lost, however large a bucket is.

Words are lower-cased runs of letters, digits and characters beyond ASCII; a shorter text is one k-mer. Texts without words (null,
empty, only punctuation) link with nothing, rows with a null key neither. Rows that share a key are one document, alike another if
one of their texts is. Repeated rows get the same class; further columns are ignored; an empty table gives an empty table. A pair at
exactly the threshold is linked. Whole texts are read, whatever their length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, WordHash, mix, releasing, windows, written
from .graph import components
from .phrases import words as plain_words

#: With 6 k-mers each, 20 sketches find a pair of long texts of similarity 0.8 with probability 1 - (1 - 0.8 ** 6) ** 20 = 0.997, one of 0.9 with
#: 1 - 3e-7. Sketches draw without replacement, which tells in short texts; up to SHORT k-mers the exact rule holds.
KMER, SKETCHES, KEPT, LEAST, SHORT = 5, 20, 6, 0.8, 30
#: Documents and k-mers that a block holds at most (or one document), and distinct k-mers that are counted at once.
BLOCK_DOCS, BLOCK_KMERS, AT_ONCE = 256, 400_000, 8_192
#: Up to so many large cells (some 30 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_CELLS = 200_000
#: Up to so many ids (8 bytes each) whose texts are compared are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def kmers(text: str | None, table: WordHash, k: int = KMER) -> np.ndarray:
    """Fingerprints of the labelled k-mers, in the order of the text."""
    own = table.array(plain_words(text.lower())) if text else np.empty(0, np.uint64)
    runs = windows(own, min(k, len(own))) if len(own) else own
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(runs) else np.empty(0, bool)
    at = np.arange(len(runs))
    label = np.empty(len(runs), np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return mix(runs + label * BASE)


SEEDS = mix(np.arange(1, 1025, dtype=np.uint64))


def sketches(labelled: np.ndarray, count: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """For each hash function one fingerprint of the `kept` least labelled k-mers in text order."""
    odd = SEEDS[:count, None] | np.uint64(1)
    hashed = (labelled[None, :] ^ SEEDS[512 : 512 + count, None]) * odd
    hashed ^= hashed >> np.uint64(29)
    if labelled.size > kept:
        places = np.sort(np.argpartition(hashed, kept - 1, axis=1)[:, :kept], axis=1)
        chosen = labelled[places]
    else:
        chosen = np.broadcast_to(labelled, (count, labelled.size))
    out = np.zeros(count, np.uint64)
    for column in chosen.T:
        out = mix(out * BASE + column)
    return out


def buckets(labelled: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Where a text looks for candidates: its sketches, or the least k-mers of a short text, or both where short and longer texts may be alike."""
    n, found = len(labelled), []
    if n <= SHORT / least:
        needed = int(np.ceil(least * n - 1e-9))
        found.append(mix(np.sort(labelled)[: n - needed + 1] + SEEDS[0]))
    if n > SHORT:
        found.append(mix(sketches(labelled) + SEEDS[: SKETCHES]))
    return np.concatenate(found)


def rising(values: list[int]) -> int:
    """Length of the longest strictly rising subsequence."""
    tops: list[int] = []
    for v in values:
        i = bisect_left(tops, v)
        if i == len(tops):
            tops.append(v)
        else:
            tops[i] = v
    return len(tops)


def similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Ordered Jaccard similarity of two sequences of distinct labelled k-mers; 0 if it cannot reach `least`."""
    total = len(a) + len(b)
    needed = int(np.ceil(least / (1 + least) * total - 1e-9))
    if not total or min(len(a), len(b)) < needed:
        return 0.0
    order = np.argsort(b, kind="stable")
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    common = b[order][at] == a
    i, j = np.flatnonzero(common), order[at[common]]
    near = np.abs(i - j) <= max(len(a), len(b)) - needed  # a chain that reaches `needed` never leaves this band
    j = j[near]
    if len(j) < needed:
        return 0.0
    chain = len(j) if (np.diff(j) > 0).all() else rising(j.tolist())
    return chain / (total - chain)


def sketched(docs: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """id, digest (of the words), size (number of k-mers) and buckets of every text with words, as a written table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordHash()
        for frame in frames:
            rows = []
            for k, t in zip(frame["id"], frame["text"], strict=True):
                own = kmers(t, table)
                if len(own):
                    rows.append((k, xxhash.xxh3_128_hexdigest(b" ".join(plain_words(t.lower()))), len(own), buckets(own, least).view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "digest", "size", "buckets"])

    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    return written(given.mapInPandas(releasing(run), "id long, digest string, size int, buckets array<long>"), "sketches")


def texts_of(docs: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """id and text of the documents of some ids; up to a bound these are broadcast, so that no other text is shuffled."""
    ids = written(ids.select("id").distinct(), "ids")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """Of the pairs (a, b) those whose alignment reaches `least`."""
    pairs = written(pairs, "pairs")
    texts = texts_of(docs, key, text, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, last = WordHash(), (None, None)
        for frame in frames:
            good = []
            for b, x, y in zip(frame["b"], frame["text_a"], frame["text_b"], strict=True):
                if last[0] != b:
                    last = (b, kmers(y, table))
                good.append(similarity(kmers(x, table), last[1], least) >= least)
            yield frame.loc[good, ["a", "b"]]

    return written(joined.select("a", "b", "text_a", "text_b").mapInPandas(releasing(run), "a long, b long"), "verified")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many k-mers each two of the documents share; a document's k-mers are distinct."""
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc, token = doc[times[token] > 1], token[times[token] > 1]
    token = np.unique(token, return_inverse=True)[1]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(token, kind="stable")
    doc, token = doc[order], token[order]
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, AT_ONCE):
        a, b = np.searchsorted(token, (at, at + AT_ONCE))
        held = np.zeros((len(sets), AT_ONCE), np.float32)
        held[doc[a:b], token[a:b] - at] = 1
        counts += held @ held.T
    return counts


def linked(ids: list[int], groups: list[int], sides: np.ndarray, texts: list[str], table: WordHash, least: float) -> list[tuple[int, int]]:
    """A forest of the links between documents of different groups (which are linked already): of one block (side 0 only), or of one side with the other."""
    if len(set(groups)) < 2:
        return []
    sets = [kmers(t, table) for t in texts]
    sizes = np.array([len(x) for x in sets])
    total = sizes[:, None] + sizes[None, :]
    group = np.unique(np.array(groups), return_inverse=True)[1]
    wanted = (group[:, None] != group[None, :]) & (common_counts(sets) >= np.ceil(least / (1 + least) * total - 1e-9))
    wanted &= (sides[:, None] < sides[None, :]) if sides.any() else np.triu(np.ones_like(wanted), 1)
    up, out = list(range(int(group.max()) + 1)), []

    def top(g: int) -> int:
        while up[g] != g:
            up[g] = g = up[up[g]]
        return g

    for i, j in np.argwhere(wanted).tolist():
        a, b = top(int(group[i])), top(int(group[j]))
        if a != b and similarity(sets[i], sets[j], least) >= least:
            up[a] = b
            out.append((ids[i], ids[j]))
    return out


def in_blocks(rest: DataFrame, mixed: DataFrame, docs: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """Links (a, b) inside buckets. rest: bucket, id, size, component; mixed: bucket, n and total (k-mers) of those to be compared."""
    texts = texts_of(docs, key, text, rest.join(mixed.select("bucket"), "bucket", "left_semi"))
    small = (F.col("n") <= BLOCK_DOCS) & (F.col("total") <= BLOCK_KMERS)
    whole = rest.join(mixed.where(small).select("bucket"), "bucket").select(F.col("bucket").cast("string").alias("task"), F.lit(0).alias("side"), "id", "component")
    large = rest.join(mixed.where(~small).select("bucket"), "bucket").withColumn("class", F.floor(F.log(F.col("size").cast("double")) / -np.log(least)).cast("int"))
    cells = large.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    cells = written(cells.select("bucket", "class", "n", F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("total") / BLOCK_KMERS)).cast("int").alias("blocks")), "cells")
    cut = cells.where("blocks > 1").select("bucket", "class", "blocks")
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_CELLS else cut
    large = large.join(cut, ["bucket", "class"], "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    # A cell meets itself and the next class: sizes further apart are never alike.
    other = cells.select("bucket", F.col("class").alias("class_b"), F.col("blocks").alias("blocks_b"))
    met = cells.join(other, "bucket").where((F.col("class_b") - F.col("class")).isin(0, 1) & ((F.col("class_b") > F.col("class")) | (F.col("n") > 1)))
    each = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
    each = each.where((F.col("class") < F.col("class_b")) | (F.col("block") <= F.col("block_b")))
    each = written(each.select("bucket", "class", "block", "class_b", "block_b", F.concat_ws(":", "bucket", "class", "block", "class_b", "block_b").alias("task")), "tasks")
    cell = ["bucket", "class", "block"]
    left = large.join(each.select("task", *cell), cell).select("task", F.lit(0).alias("side"), "id", "component")
    across = each.where((F.col("class") < F.col("class_b")) | (F.col("block") < F.col("block_b"))).select("task", "bucket", F.col("class_b").alias("class"), F.col("block_b").alias("block"))
    right = large.join(across, cell).select("task", F.lit(1).alias("side"), "id", "component")
    sent = whole.unionByName(left).unionByName(right).join(texts, "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, task, held = WordHash(), None, []

        def links() -> pd.DataFrame:
            ids, groups, sides, own = zip(*held, strict=True)
            return pd.DataFrame(linked(ids, groups, np.array(sides), own, table, least), columns=["a", "b"])

        for frame in frames:
            for name, *row in zip(*(frame[c].tolist() for c in ("task", "id", "component", "side", "text")), strict=True):
                if name != task:
                    if len(held) > 1:
                        yield links()
                    task, held = name, []
                held.append(row)
        if len(held) > 1:
            yield links()

    return sent.repartition("task").sortWithinPartitions("task").mapInPandas(releasing(run), "a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row for each row of docs: key, component_id (the least key of its class) and kept (whether it is that one)."""
    known = sketched(docs, key, text, least)
    firsts = written(known.groupBy("digest").agg(F.min("id").alias("first"), F.max("size").alias("size"), F.min_by("buckets", "id").alias("buckets")), "firsts")
    entries = written(firsts.select(F.col("first").alias("id"), "size", F.explode("buckets").alias("bucket")), "entries")
    full = entries.groupBy("bucket").agg(F.min("id").alias("hub"), F.min_by("size", "id").alias("hub_size"), F.max("id").alias("last")).where("last > hub")
    entries = written(entries.join(full.select("bucket", "hub", "hub_size"), "bucket"), "buckets")

    alike = F.least("size", "hub_size") >= least * F.greatest("size", "hub_size")
    links = verified(entries.where((F.col("id") != F.col("hub")) & alike).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), docs, key, text, least)
    merged = components(links, "a", "b")
    placed = written(entries.select("id", "size", "bucket").join(merged.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("id")).alias("members")]
    # Two documents have met as hub and other; buckets of the same documents are compared once.
    mixed = placed.groupBy("bucket").agg(*sums).where("n > 2 AND low < high")
    mixed = written(mixed.groupBy("members", "n", "total").agg(F.min("bucket").alias("bucket")), "mixed")
    if not mixed.isEmpty():
        more = in_blocks(placed, mixed, docs, key, text, least)
        merged = components(merged.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")
    of_digest = firsts.select("digest", "first").join(merged.withColumnRenamed("node", "first"), "first", "left").select("digest", F.coalesce("component", "first").alias("component"))
    placed = known.select("id", "digest").join(of_digest, "digest").groupBy("id").agg(F.min("component").alias("component"))
    out = docs.select(F.col(key), F.col(key).cast("long").alias("id")).join(placed, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(key, component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
