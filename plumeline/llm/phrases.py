"""Exact phrases and proximity matches by a distributed positional inverted index.

The index is dealt by document: each row of the stored table is a shard of about SHARD_WORDS words, with its sorted distinct terms,
the postings of each term (positions, delta-packed) and the documents' places. The items are packed into blocks of bounded size, also
rows of a stored table; every block meets every shard, as all items are asked of all documents, and neither comes to the driver. A
shard looks the block's terms up, passes over windows with a term that it lacks, which are nearly all, and intersects the
offset-adjusted postings of the others from their rarest term on. What a task holds is one shard and one block, whatever the number of
either, and a term or document in every second row makes no shard larger.

Words are runs of digits, letters and all characters beyond ASCII, with A-Z lower-cased; the index holds 64-bit hashes of them. Null
and empty texts have no words, a phrase without words or id matches nothing; rows of one item_id are one item. Rows that repeat or share
a key, and rows with a null key, are separate documents. Whole texts are read: a long document is a shard by itself, a long item is cut
into parts that overlap. An empty table of documents gives an empty table, one of items gives no hits. Items that hit one word are
sorted as strings. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, hash_words, pack, releasing, stable_order, unpack, written

SHARD_WORDS = 1_000_000
#: Words of items in a block, and of an item in one piece.
BLOCK_WORDS, PIECE_WORDS = 200_000, 50_000
#: Bytes of a word with what separates it, for the size of shards; postings of windows' rarest terms that are intersected at once.
WORD_BYTES, AT_ONCE = 6, 1_000_000
#: A-Z become a-z, other ASCII outside 0-9 and a-z separates words. All bytes of other characters are word bytes.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

INDEX = "keys array<string>, sizes binary, terms binary, counts binary, postings binary"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", gap: int = 64) -> DataFrame:
    """Writes the index of all words to the shared folder. Documents lie `gap` positions apart, so that no phrase up to that length spans two."""
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "postings")
    docs = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, sizes, hashes in hashed(frames, "key"):
            yield shard(keys, sizes, hashes, gap)

    index = docs.mapInPandas(releasing(run), INDEX).withColumn("shard", F.expr("uuid()"))
    index.write.option("compression", "none").parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def hashed(frames: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Keys, numbers of words, and the hashes of all these words one after the other, of about SHARD_WORDS words or one text at once."""
    keys, texts, total = [], [], 0
    for frame in frames:
        for k, t in zip(frame[key], frame["text"], strict=True):
            keys.append(k)
            texts.append(t.encode() if t else b"")
            total += len(texts[-1])
            if total >= SHARD_WORDS * WORD_BYTES:
                hashes, sizes = hash_words(texts, TABLE)
                yield keys, sizes, hashes
                keys, texts, total = [], [], 0
    if keys:
        hashes, sizes = hash_words(texts, TABLE)
        yield keys, sizes, hashes


def starts_of(sizes: np.ndarray, gap: int) -> np.ndarray:
    return np.cumsum(sizes + gap) - sizes - gap


def shard(keys: list, n: np.ndarray, hashes: np.ndarray, gap: int) -> pd.DataFrame:
    where = np.arange(len(hashes)) + np.repeat(starts_of(n, gap) - (np.cumsum(n) - n), n)
    order = stable_order(hashes)
    hashes, where = hashes[order], where[order]
    firsts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    deltas = np.diff(where, prepend=0)
    deltas[firsts] = where[firsts]
    counts = np.diff(np.append(firsts, len(hashes)))
    return pd.DataFrame({"keys": [keys], "sizes": [pack(n)], "terms": [hashes[firsts].tobytes()], "counts": [pack(counts.astype(np.uint32))], "postings": [pack(deltas.astype(np.uint32))]})


class Shard:
    def __init__(self, row, gap: int):
        self.sizes = unpack(row.sizes, "i8")
        self.starts = starts_of(self.sizes, gap)
        self.terms, self.counts = np.frombuffer(row.terms, "u8"), unpack(row.counts, "u4").astype(np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        sums = np.cumsum(unpack(row.postings, "u4"), dtype=np.int64)
        #: The postings of all terms, each term's in ascending order.
        self.where = sums - np.repeat(np.append(0, sums)[self.firsts], self.counts)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in this shard, -1 for none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def positions(self, term: int) -> np.ndarray:
        return self.where[self.firsts[term] : self.firsts[term] + self.counts[term]]

    def phrases(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which rows of `at`, each a phrase of as many terms, start where: offset-adjusted postings are intersected from the rarest term
        on, those of many phrases together."""
        order = np.argsort(self.counts[at], axis=1, kind="stable")
        rarest = np.take_along_axis(at, order[:, :1], 1)[:, 0]
        span = int(self.where.max()) + 2 * at.shape[1]  # with its term before it a posting is a number of its own, in ascending order
        postings = np.repeat(np.arange(len(self.terms)) * span, self.counts) + self.where
        batch = np.cumsum(self.counts[rarest]) // AT_ONCE
        for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(batch)) + 1):
            n = self.counts[rarest[own]]
            which = np.repeat(own, n)
            found = self.where[np.arange(n.sum()) + np.repeat(self.firsts[rarest[own]] - (np.cumsum(n) - n), n)] - order[which, 0]
            for j in range(1, at.shape[1]):
                k = order[which, j]
                kept = among(at[which, k] * span + found + k, postings)
                which, found = which[kept], found[kept]
            yield which, found

    def near(self, at: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term that have every other term within `slop` words."""
        order = np.argsort(self.counts[at], kind="stable")
        found = self.positions(at[order[0]])
        for k in order[1:]:
            own = self.positions(at[k])
            i = np.searchsorted(own, found - slop)
            found = found[(i < len(own)) & (own[np.minimum(i, len(own) - 1)] <= found + slop)]
        return found


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    return (at < len(ordered)) & (ordered[np.minimum(at, len(ordered) - 1)] == values)


def pieces(own: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """An item's words in pieces that overlap so far that each window of `size` lies in one."""
    for at in range(0, max(1, len(own) - size + 1), PIECE_WORDS):
        yield own[at : at + PIECE_WORDS + size - 1]


def pack_items(items: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """names, sizes and words (one piece of an item after the other) of each block, as a written table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, parts, total = [], [], 0
        for items, sizes, hashes in hashed(frames, "item"):
            for name, own in zip(items, np.split(hashes, np.cumsum(sizes)[:-1]), strict=True):
                for part in pieces(own, size) if len(own) else ():
                    names.append(name)
                    parts.append(part)
                    total += len(part)
                    if total >= BLOCK_WORDS:
                        yield block(names, parts)
                        names, parts, total = [], [], 0
        if names:
            yield block(names, parts)

    def block(names: list[str], parts: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"names": [names], "lengths": [pack(np.array([len(p) for p in parts], np.int64))], "words": [np.concatenate(parts).tobytes()]})

    given = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    # Few bytes for each item: some files of a test set need not make as many blocks.
    return written(given.mapInPandas(releasing(run), "names array<string>, lengths binary, words binary"), "items")


class Block:
    """Windows of a block: where each begins in its words, how many words it has, and its item."""

    def __init__(self, names, lengths: bytes, words: bytes, size: int):
        self.names, lengths = names, unpack(lengths, "i8")
        self.asked, self.inverse = np.unique(np.frombuffer(words, "u8"), return_inverse=True)
        counts = np.maximum(1, lengths - size + 1)
        self.item = np.repeat(np.arange(len(lengths)), counts)
        self.size = np.minimum(lengths, size)[self.item]
        self.start = np.arange(counts.sum()) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(counts) - counts), counts)

    def present(self, own: Shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows of which the shard has all terms, those of one size at once, with a row of the terms' places for each."""
        at = own.find(self.asked)[self.inverse]
        lacking = np.concatenate([[0], np.cumsum(at < 0)])
        found = np.flatnonzero(lacking[self.start + self.size] == lacking[self.start])
        for n in np.unique(self.size[found]):
            k = found[self.size[found] == n]
            yield k, at[self.start[k][:, None] + np.arange(n)]


def search(index: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", size: int = 13, slop: int | None = None, gap: int = 64) -> DataFrame:
    """Occurrences of the items' windows: shard, place (of the document in its shard), item, start, end (words of the document).
    With `slop`, instead the places of a window's rarest term that have all its other terms within so many words."""
    if max(size, slop or 0) > gap:
        raise ValueError("windows must not be longer than the gap between documents")
    blocks = pack_items(items, item, text, size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                own, block, hits = Shard(row, gap), Block(row.names, row.lengths, row.words, size), []
                names = np.array(block.names, dtype=object)
                for k, terms in block.present(own) if len(own.terms) else ():
                    for which, places in own.phrases(terms) if slop is None else ((np.full(len(x), i), x) for i, x in enumerate(own.near(t, slop) for t in terms)):
                        if len(places):
                            doc = np.searchsorted(own.starts, places, side="right") - 1
                            begin = places - own.starts[doc]
                            hits.append(pd.DataFrame({"shard": row.shard, "place": doc, "item": names[block.item[k[which]]], "start": begin, "end": begin + (terms.shape[1] if slop is None else 1)}))
                if hits:
                    yield merged(pd.concat(hits)) if slop is None else pd.concat(hits)

    # A stated set of queries against all documents, block by block.
    met = index.select("shard", "sizes", "terms", "counts", "postings").crossJoin(blocks)
    return met.mapInPandas(releasing(run), "shard string, place long, item string, start long, end long")


def merged(hits: pd.DataFrame) -> pd.DataFrame:
    """Overlapping occurrences of one item in one document as one."""
    hits = hits.sort_values(["place", "item", "start"], kind="stable")
    new = (hits["place"] != hits["place"].shift()) | (hits["item"] != hits["item"].shift()) | (hits["start"] > hits["end"].shift())
    return hits.groupby(new.cumsum().to_numpy()).agg({"shard": "first", "place": "first", "item": "first", "start": "min", "end": "max"})


def documents_of(index: DataFrame) -> DataFrame:
    """shard, place, key and n_words of every document."""

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield pd.DataFrame({"shard": row.shard, "place": np.arange(len(row.keys)), "key": row.keys, "n_words": unpack(row.sizes, "i8")})

    return index.select("shard", "keys", "sizes").mapInPandas(releasing(run), "shard string, place long, key string, n_words long")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", size: int = 13, per: int = 20) -> DataFrame:
    """Per document: n_words, n_hit (words inside occurrences of windows), n_items, items (sorted as strings), contaminated
    (some word is hit, and at least one in `per` of all)."""
    index = build_index(docs, key, text, gap=max(64, size))
    hits = search(index, items, item=item, size=size, gap=max(64, size))
    before = Window.partitionBy("shard", "place").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    found = hits.withColumn("new", new).groupBy("shard", "place").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    out = documents_of(index).join(found, ["shard", "place"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("key").cast(docs.schema[key].dataType).alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * per >= F.col("n_words"))).alias("contaminated"),
    )
