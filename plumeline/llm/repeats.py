"""Repeated passages by prefix-partitioned suffix trees.

The suffixes of all texts, cut at `size` words, are the leaves of one tree. Variable-length prefixes deal its subtrees out to
groups of bounded size: a suffix goes by its first PREFIX words, and where so many suffixes share a group that it would grow too
large, by all `size` words. Edges carry fingerprints of their words in place of the words themselves, 80 bits for a path of `size`
words (two different ones of a thousand billion are equal with a probability below one half). In a group the leaves, sorted by path, have the inner nodes of depth `size` as runs of equal paths. The leaves of a run of two
or more are windows that also start elsewhere. A document's runs of such windows that follow each other are its repeats, as long as
they last; `repeats` gives them as spans.

Texts are packed into batches, each a row of a written table that is read twice: once to send its paths, and once to look up which of
them came back. A batch sends a path once, however often its own texts repeat it, so that the passage that a third of all documents
hold weighs one row for each batch; what repeats inside a batch is seen there. Only paths are shuffled, and the squeezed texts once.
A batch sends at most FAN rows; where there are more groups than that, the rows of many batches are gathered and dealt out again, so
that the number of rows grows with the input and not with its square.

Null and empty texts have no words, and texts shorter than `size` no windows. Every row is a text of its own: repeated rows are copies
of each other, rows may share a key, and keys may be null. Whole texts are read, in batches of bounded size or one text. Further
columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, pack, pack_sorted, stable_order, together, unpack, unpack_sorted, windows, written

PREFIX = 8
#: Characters that a batch holds at most (or one text), leaves that a group is to hold, and rows that a batch sends at most.
BATCH_CHARS, GROUP_LEAVES, FAN = 10_000_000, 1_500_000, 2_048
#: One in so many texts tells which groups are too large for prefixes of PREFIX words; it only steers where a leaf goes.
PLAN_EACH = 64
#: Leaves that are gathered to be dealt out again.
GATHER_LEAVES = 4_000_000
SECOND = np.uint64(0xD6E8FEB86659FD93)

#: Bytes of texts whose windows are made at once (or one text).
TOGETHER_BYTES = 2_000_000
#: Of each byte its own value, 32 for what separates words; bytes.split() separates by the same six.
TABLE = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """batch, keys (as text), sizes and squeezed texts, as a written table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for frame in frames:
            for k, t in zip(frame["k"], frame["t"], strict=True):
                held.append((k, (t or "").encode()))
                size += len(t or "")
                if size >= BATCH_CHARS:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    def batch(held: list[tuple]) -> pd.DataFrame:
        keys, texts = zip(*held, strict=True)
        squeezed = zstandard.ZstdCompressor(level=5).compress(b"".join(texts))
        return pd.DataFrame({"keys": [list(keys)], "sizes": [pack(np.array([len(t) for t in texts], np.int64))], "texts": [squeezed]})

    given = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return written(given.mapInPandas(run, "keys array<string>, sizes binary, texts binary").withColumn("batch", F.expr("uuid()")), "texts")


def texts_of(sizes: bytes, texts: bytes) -> Iterator[bytes]:
    blob, at = zstandard.ZstdDecompressor().decompress(texts), 0
    for size in unpack(sizes, "i8").tolist():
        yield blob[at : at + size]
        at += size


def leaves_of(texts: Iterable[bytes], size: int) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts, one after the other: path (64 bits), its second part (16 bits), and prefix; and how many words each text has."""
    paths, seconds, prefixes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.uint16)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for some in together(texts, TOGETHER_BYTES):
        own, n = hash_words(some, TABLE)
        counts.append(n)
        leaves = np.maximum(n - size + 1, 0)  # windows that begin in one text and end in another are none
        at = np.arange(leaves.sum()) + np.repeat(np.cumsum(n) - n - (np.cumsum(leaves) - leaves), leaves)
        if len(at):
            paths.append(windows(own, size)[at])
            seconds.append((windows(own ^ SECOND, size)[at] >> np.uint64(48)).astype(np.uint16))
            prefixes.append(windows(own, PREFIX)[at])
    return tuple(np.concatenate(x) for x in (paths, seconds, prefixes, counts))


def sorted_runs(path: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of leaves by path, and where a new path begins in it."""
    order = stable_order(path)
    ordered, also = path[order], second[order]
    same = ordered[1:] == ordered[:-1]
    if (same & (also[1:] != also[:-1])).any():  # the first parts of two paths are equal by chance
        order = np.lexsort((second, path))
        same = (path[order][1:] == path[order][:-1]) & (second[order][1:] == second[order][:-1])
    return order, np.concatenate([[True], ~same]) if len(path) else np.empty(0, bool)


def plan(batches: DataFrame, size: int, fan: int) -> np.ndarray:
    """Into how many parts each of the `fan` groups is cut, from a sample of the texts: a bounded list."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                _, _, prefix, _ = leaves_of((t for i, t in enumerate(texts_of(row.sizes, row.texts)) if i % PLAN_EACH == 0), size)
                group, n = np.unique(mix(prefix) % np.uint64(fan), return_counts=True)
                yield pd.DataFrame({"group": group.astype(np.int32), "n": n})

    parts = np.ones(fan, np.int64)
    for row in batches.select("sizes", "texts").mapInPandas(run, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect():
        parts[row["group"]] = max(1, -(-row["n"] * PLAN_EACH // GROUP_LEAVES))
    return parts


LEAVES = "names array<string>, owners binary, paths binary, seconds binary"


def part_of(path: np.ndarray, group: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (mix(path) % parts[group].astype(np.uint64)).astype(np.int64)


def leaves(batches: DataFrame, size: int, parts: np.ndarray, direct: bool) -> DataFrame:
    """For each batch and each group (and, if they go there directly, part) the distinct paths, sorted."""
    fan = len(parts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                path, second, prefix, _ = leaves_of(texts_of(row.sizes, row.texts), size)
                order, new = sorted_runs(path, second)
                first = order[new]
                path, second, group = path[first], second[first], (mix(prefix[first]) % np.uint64(fan)).astype(np.int64)
                part = part_of(path, group, parts) if direct else np.zeros(len(path), np.int64)
                yield dealt([row.batch], None, path, second, group, part)

    return batches.select("batch", "sizes", "texts").mapInPandas(run, f"group int, part long, {LEAVES}")


def dealt(names: list[str], owner: np.ndarray | None, path: np.ndarray, second: np.ndarray, group: np.ndarray, part: np.ndarray) -> pd.DataFrame:
    """Sorted leaves cut by group and part."""
    cell = group * (int(part.max(initial=0)) + 1) + part
    # Stable, so that each row stays sorted by path; numbers of 16 bits are sorted by counting.
    order = np.argsort(cell.astype(np.uint16) if cell.max(initial=0) < 1 << 16 else cell, kind="stable")
    group, part = group[order], part[order]
    cuts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (part[1:] != part[:-1])])) if len(order) else np.empty(0, np.int64)
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True) if len(cuts) else ():
        own = order[a:b]
        rows.append((int(group[a]), int(part[a]), names, None if owner is None else pack(owner[own]), pack_sorted(path[own]), second[own].tobytes()))
    return pd.DataFrame(rows, columns=["group", "part", "names", "owners", "paths", "seconds"])


def gathered(frame: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The batches of some rows, and of their leaves the batch's number, path and second part."""
    names = [n for own in frame["names"] for n in own]
    paths = [unpack_sorted(x) for x in frame["paths"]]
    owners, before = [], 0
    for own, packed_owner, path in zip(frame["names"], frame["owners"], paths, strict=True):
        owners.append(before + (np.zeros(len(path), np.uint32) if packed_owner is None else unpack(packed_owner, "u4")))
        before += len(own)
    return names, np.concatenate(owners).astype(np.uint32), np.concatenate(paths), np.concatenate([np.frombuffer(x, "u2") for x in frame["seconds"]])


def deal_again(frame: pd.DataFrame, parts: np.ndarray) -> pd.DataFrame:
    """The leaves of many batches in one group, cut into the group's parts."""
    names, owner, path, second = gathered(frame)
    order = stable_order(path)
    path, group = path[order], np.full(len(path), frame["group"].iat[0], np.int64)
    return dealt(names, owner[order], path, second[order], group, part_of(path, group, parts))


def deep_nodes(frame: pd.DataFrame) -> pd.DataFrame:
    """One subtree: its leaves, sorted by path, with the nodes of full depth as runs; gives each batch its paths that have another leaf."""
    names, owner, path, second = gathered(frame)
    order, new = sorted_runs(path, second)
    found = order[~(new & np.append(new[1:], True))]  # each batch sent a path once
    found = found[np.lexsort((path[found], owner[found]))]
    cuts = np.searchsorted(owner[found], np.arange(len(names) + 1))
    rows = [(n, pack_sorted(path[found[a:b]]), second[found[a:b]].tobytes()) for n, a, b in zip(names, cuts[:-1], cuts[1:], strict=True) if a < b]
    return pd.DataFrame(rows, columns=["batch", "paths", "seconds"])


def hits_of(path: np.ndarray, second: np.ndarray, found: pd.DataFrame) -> np.ndarray:
    """Which windows of a batch also start elsewhere: in another batch, as was found, or in this one."""
    order, new = sorted_runs(path, second)
    hit = np.zeros(len(path), bool)
    hit[order[~(new & np.append(new[1:], True))]] = True
    if len(found):
        paths, seconds = np.concatenate([unpack_sorted(x) for x in found["paths"]]), np.concatenate([np.frombuffer(x, "u2") for x in found["seconds"]])
        by = stable_order(paths)
        paths, seconds = paths[by], seconds[by]
        ordered, also = path[order], second[order]
        at = np.searchsorted(paths, ordered)  # in order, which is quicker
        for more in range(2):  # two paths of which the first part is equal are next to each other
            near = np.minimum(at + more, len(paths) - 1)
            hit[order[(paths[near] == ordered) & (seconds[near] == also)]] = True
    return hit


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in windows that begin at `starts`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def search(docs: DataFrame, key: str, text: str, size: int, report, schema: str) -> DataFrame:
    """`report` makes rows of a text's words and of which of its windows are repeated."""
    batches = packed(docs, key, text)
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    parts = plan(batches, size, int(min(FAN, max(8, chars // 6 // GROUP_LEAVES))))  # a word has about six characters
    direct = int(parts.sum()) <= 2 * FAN
    sent = leaves(batches, size, parts, direct)
    if not direct:
        spread = max(1, batches.count() * BATCH_CHARS // 6 // len(parts) // GATHER_LEAVES)
        sent = sent.withColumn("spread", F.pmod(F.xxhash64("names"), F.lit(spread)))
        sent = sent.groupBy("group", "spread").applyInPandas(lambda frame: deal_again(frame, parts), f"group int, part long, {LEAVES}")
    found = sent.groupBy("group", "part").applyInPandas(deep_nodes, "batch string, paths binary, seconds binary")

    def by_text(batch, mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = mine.iloc[0]
        path, second, _, counts = leaves_of(texts_of(row["sizes"], row["texts"]), size)
        hit, at, rows = hits_of(path, second, found), 0, []
        for k, t, n in zip(row["keys"], texts_of(row["sizes"], row["texts"]), counts.tolist(), strict=True):
            own = max(0, n - size + 1)
            rows += [(k, *x) for x in report(t, n, np.flatnonzero(hit[at : at + own]))]
            at += own
        return pd.DataFrame(rows, columns=["key", *[c.split()[0] for c in schema.split(", ")]])

    out = batches.groupBy("batch").cogroup(found.groupBy("batch")).applyInPandas(by_text, f"key string, {schema}")
    return out.withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 35, digest: bool = False) -> DataFrame:
    """key, n_words, n_removed and kept of each row: the words that no repeated window covers, joined by spaces (with `digest` its SHA-256 instead)."""

    def report(t: bytes, n: int, starts: np.ndarray) -> list[tuple]:
        own, gone = t.split(), 0
        if len(starts):
            hit = covered(n, starts, size)
            gone = int(hit.sum())
            own = [w for w, g in zip(own, hit.tolist(), strict=True) if not g]
        left = b" ".join(own)
        return [(n, gone, hashlib.sha256(left).hexdigest() if digest else left.decode())]

    return search(docs, key, text, size, report, "n_words long, n_removed long, kept string")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 35) -> DataFrame:
    """key, first and n_words of each repeat: the longest runs of words in which every window of `size` also starts elsewhere."""

    def report(t: bytes, n: int, starts: np.ndarray) -> list[tuple]:
        new = np.flatnonzero(np.diff(starts, prepend=-2) > 1)
        last = starts[np.append(new[1:], len(starts)) - 1] if len(new) else starts
        return [(int(a), int(b - a + size)) for a, b in zip(starts[new], last, strict=True)]

    return search(docs, key, text, size, report, "first long, n_words long")
