"""Byte-level BPE by recursive DuckDB queries inside Spark partitions.

Spark deals the documents out; a task splits its texts into the pattern's matches and encodes the distinct ones in one recursive
query: (word, pos, id) rows join the merge table, the leftmost pair of least rank of every word is contracted, until no word has
a pair left. An ordered aggregation over (doc, pos, id) rows joined with the vocabulary decodes. No row leaves its task, so nothing
is shuffled.

A long match is cut into tiles that overlap by half, which the query encodes like words. Two tiles that have one token in common,
at the same place, are joined there. The result is the match's own encoding: a sequence of tokens is that of its bytes if each two
neighbours are that of theirs (the first contraction over a border between tokens would be one in the pair of these alone, as all
before it are the same), and each two neighbours come from one tile. Tiles that share no token are made larger, up to the match.

Nulls count as empty texts; an empty text has no tokens. Repeated rows and null keys give results like others, an empty table gives
an empty one. Further columns are kept by `encode` and `decode` unless they have a result's name, and left out by `round_trip`.
Whole texts are encoded, whatever their length, in batches of bounded size or one text; of equal ranks the leftmost goes first.
"""

from __future__ import annotations

import base64
import hashlib
import marshal
import tempfile
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing

#: Characters of text that a task holds at once, and distinct words and their characters in each of two generations that it remembers, none longer than KEPT_LONGEST.
BATCH_CHARS = 1_000_000
KEPT_WORDS, KEPT_CHARS, KEPT_LONGEST = 200_000, 8_000_000, 256
#: Half of a tile's bytes, at first and where tiles of that size share no token. Multiples keep the phase of runs of characters of 1 to 4 bytes.
TILES = (192, 960, 6_720, 60_480)
#: Bytes of words that go into one recursion (or one word), and rows that it may keep over all its rounds (or two rounds).
WORD_BYTES, ROWS = 100_000, 1_000_000

#: `start` and so every round holds a word's rows together and by pos: one thread keeps the order of rows, and OVER () follows it.
#: encode_words() checks that each result covers its word without gaps, which a broken order would not.
ENCODE = """
WITH RECURSIVE step(round, word, pos, id, size) AS (
    SELECT 0, word, pos, id, size FROM start
    UNION ALL
    SELECT round + 1, word, pos, CASE WHEN chosen THEN (pick // 4294967296)::INTEGER ELSE id END, CASE WHEN chosen THEN size + added ELSE size END
    FROM (
        SELECT p.*, k.pick, pos = pick % 4294967296 AS chosen, pick % 4294967296 = before AS gone
        FROM (
            SELECT round, word, pos, id, size, lead(size) OVER () AS added, CASE WHEN lag(word) OVER () = word THEN lag(pos) OVER () END AS before FROM step
        ) AS p JOIN (
            SELECT word, min(m.rank * 4294967296 + pos) AS pick
            FROM (SELECT round, word, pos, CASE WHEN lead(pos) OVER () = pos + size AND lead(word) OVER () = word THEN id * 4294967296 + lead(id) OVER () END AS pair FROM step)
            JOIN merges AS m USING (pair) GROUP BY word HAVING min(round) < $rounds
        ) AS k USING (word)
    )
    WHERE gone IS NOT TRUE
)
SELECT word, pos, id, size, round FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round) ORDER BY word, pos
"""

DECODE = "SELECT doc, string_agg(hex, '' ORDER BY pos) AS hex FROM tokens JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc"


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@cache
def database(path: str) -> duckdb.DuckDBPyConnection:
    """An in-memory database of this process, with the vocabulary and every split of a token into two tokens."""
    known = ranks(path)
    db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.mkdtemp(prefix="plumeline-bpe-")})
    pairs = [(known[t[:i]] << 32 | known[t[i:]], r) for t, r in known.items() for i in range(1, len(t)) if t[:i] in known and t[i:] in known]
    merges = pa.table({"pair": pa.array([a for a, _ in pairs], pa.int64()), "rank": pa.array([b for _, b in pairs], pa.int64())})
    vocabulary = pa.table({"id": pa.array(list(known.values()), pa.int32()), "hex": pa.array([t.hex() for t in known])})
    for name, table in (("merges", merges), ("vocabulary", vocabulary)):
        db.register("given", table)
        db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        db.unregister("given")
    return db


def forget(path: str) -> None:
    """At a task's end: the process stays, but its database's memory is given back, and its words wait squeezed for the next task."""
    database(path).close()
    database.cache_clear()
    if path in ENCODED:
        SQUEEZED[path] = zstandard.ZstdCompressor(level=1).compress(marshal.dumps(ENCODED.pop(path)))


def remembered(path: str) -> tuple[dict[str, bytes], dict[str, bytes]]:
    if path in SQUEEZED:
        ENCODED[path] = marshal.loads(zstandard.ZstdDecompressor().decompress(SQUEEZED.pop(path)))
    return ENCODED.setdefault(path, ({}, {}))


def contracted(words: list[bytes], known: dict[bytes, int], db: duckdb.DuckDBPyConnection) -> list[bytes]:
    """The ids of each word; words that have pairs left after a recursion's rounds go into the next one."""
    single = np.array([known[bytes([b])] for b in range(256)], np.int32)
    sizes = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(sizes) - sizes
    ids = single[np.frombuffer(b"".join(words), np.uint8)]
    left = {"word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": np.arange(len(ids)) - np.repeat(begins, sizes), "id": ids, "size": np.ones(len(ids), np.int32)}
    found: list[bytes] = [b""] * len(words)
    while len(left["word"]):
        rounds = max(1, ROWS // len(left["word"]) - 1)
        db.register("start", pa.table(left))
        out = db.execute(ENCODE, {"rounds": rounds}).fetchnumpy()
        db.unregister("start")
        firsts = np.flatnonzero(np.diff(out["word"], prepend=-1))
        held = out["word"][firsts]
        ends = out["pos"] + out["size"]
        follows = np.append(out["pos"][1:], 0)
        last = np.append(firsts[1:], len(ends)) - 1
        follows[last] = sizes[held]
        if (held != np.unique(left["word"])).any() or out["pos"][firsts].any() or (ends != follows).any():
            raise AssertionError("the query lost the order of its rows")
        data = out["id"].astype("<u4").tobytes()
        done = out["round"][firsts] < rounds
        for word, a, b in zip(held[done].tolist(), firsts[done].tolist(), last[done].tolist(), strict=True):
            found[word] = data[a * 4 : b * 4 + 4]
        more = out["round"] == rounds
        left = {c: np.ascontiguousarray(out[c][more]) for c in ("word", "pos", "id", "size")}
    return found


def recursions(words: list[bytes], path: str) -> list[bytes]:
    """The ids of words by the query, so many bytes at once."""
    known, db, found = ranks(path), database(path), []
    part = np.cumsum([len(w) for w in words]) // WORD_BYTES
    for own in np.split(np.arange(len(words)), np.flatnonzero(np.diff(part)) + 1) if words else ():
        found += contracted([words[i] for i in own], known, db)
    return found


def joined_tiles(tiles: list[bytes], sizes: np.ndarray, step: int) -> bytes | None:
    """The ids of a match whose tiles begin `step` bytes after each other; None if two have no token in common. sizes: bytes of each id."""
    out, before, before_at = [], None, None
    for k, tile in enumerate(tiles):
        ids = np.frombuffer(tile, "<u4")
        ends = np.cumsum(sizes[ids]) + k * step
        at = (ends - sizes[ids]) << 32 | ends
        if before is None:
            before, before_at = ids, at
            continue
        _, i, j = np.intersect1d(before_at, at, assume_unique=True, return_indices=True)
        if not len(i):
            return None
        out.append(before[: i[0]])
        before, before_at = ids[j[0] :], at[j[0] :]
    return np.concatenate([*out, before]).astype("<u4").tobytes()


def encode_words(words: list[bytes], path: str) -> list[bytes]:
    """The ids of each distinct word, as little-endian unsigned 32-bit integers."""
    known = ranks(path)
    found: list[bytes | None] = [known[w].to_bytes(4, "little") if w in known else None for w in words]
    left = [i for i, x in enumerate(found) if x is None]
    for step in (*TILES, max(map(len, words), default=0)):
        cuts = [range(0, max(1, len(words[i]) - step), step) for i in left]
        tiles = iter(recursions([words[i][a : a + 2 * step] for i, own in zip(left, cuts, strict=True) for a in own], path))
        for i, own in zip(left, cuts, strict=True):  # nearly all words are one tile, whose ids are their own
            found[i] = next(tiles) if len(own) == 1 else joined_tiles([next(tiles) for _ in own], token_sizes(path), step)
        left = [i for i in left if found[i] is None]
    return found


@cache
def token_sizes(path: str) -> np.ndarray:
    known = ranks(path)
    sizes = np.zeros(max(known.values()) + 1, np.int64)
    for token, rank in known.items():
        sizes[rank] = len(token)
    return sizes


def decode_ids(ids: list[bytes], path: str) -> list[bytes]:
    """The bytes that each sequence of ids stands for."""
    db, flat = database(path), np.frombuffer(b"".join(ids), "<u4")
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    db.register("tokens", pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "pos": np.arange(len(flat), dtype=np.int64), "id": flat.astype(np.int32)}))
    out = db.execute(DECODE).fetchall()
    db.unregister("tokens")
    texts = [b""] * len(ids)
    for doc, text in out:
        texts[doc] = bytes.fromhex(text)
    return texts


#: Of this process, by vocabulary: the ids of words met of late, and of those met before. A word that is met again moves to the first; when that
#: is full it takes the other's place, so that frequent words stay.
ENCODED: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}
#: The same between tasks: other stages have the same processes.
SQUEEZED: dict[str, bytes] = {}


class Encoder:
    """Encodes texts; only words that this process does not remember go to the query."""

    def __init__(self, path: str, pattern: str):
        self.path, self.matches = path, regex.compile(pattern).findall
        self.words, self.before = remembered(path)
        self.chars = sum(map(len, self.words))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        split = [self.matches(t) for t in texts]
        if len(self.words) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.words, self.before, self.chars = {}, self.words, 0
            ENCODED[self.path] = self.words, self.before
        new = list({w for words in split for w in words if w not in self.words})
        found = {w: self.before[w] for w in new if w in self.before}
        unknown = [w for w in new if w not in found]
        found.update(zip(unknown, encode_words([w.encode() for w in unknown], self.path), strict=True))
        short = {w: x for w, x in found.items() if len(w) <= KEPT_LONGEST}
        self.words.update(short)
        self.chars += sum(map(len, short))
        if len(short) == len(found):
            look = self.words.__getitem__
        else:
            look = lambda w: self.words[w] if w in self.words else found[w]
        return [b"".join(map(look, words)) for words in split]


def batches(frames: Iterator[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    """The same rows in runs of at most BATCH_CHARS characters, or one row."""
    for frame in frames:
        size = frame[text].str.len().fillna(0).cumsum()
        for _, part in frame.groupby((size // BATCH_CHARS).astype("int64"), sort=True):
            yield part


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", result: str = "ids") -> DataFrame:
    """Adds `result`, array<int> of token ids; null texts count as empty."""
    kept = docs.drop(result)
    schema = kept.withColumn(result, F.array().cast("array<int>")).schema

    def run(frames):
        encoder = Encoder(path, pattern)
        for part in batches(frames, text):
            yield part.assign(**{result: [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder.ids([t or "" for t in part[text]])]})
        forget(path)

    return kept.mapInPandas(releasing(run), schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", result: str = "decoded") -> DataFrame:
    """Adds `result`, the binary that the ids stand for; null ids give null."""
    kept = encoded.drop(result)
    schema = kept.withColumn(result, F.lit(None).cast("binary")).schema

    def run(frames):
        for part in frames:
            given = part[ids].notna()
            texts = decode_ids([np.asarray(x, "<u4").tobytes() if x is not None else b"" for x in part[ids]], path)
            yield part.assign(**{result: [t if g else None for t, g in zip(texts, given, strict=True)]})

    return kept.mapInPandas(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: n_tokens, ids_sha256 (of little-endian unsigned 32-bit integers) and decoded_sha256, on request also ids."""

    def run(frames):
        encoder = Encoder(path, pattern)
        for part in batches(frames, text):
            ids = encoder.ids([t or "" for t in part[text]])
            out = {
                key: part[key].to_numpy(),
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decode_ids(ids, path)],
            }
            yield pd.DataFrame(out | ({"ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]} if with_ids else {}))
        forget(path)

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).cast("string").alias(key), text)  # as text, so that nulls do not turn integers into floats
    found = given.mapInPandas(releasing(run), f"`{key}` string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return found.withColumn(key, F.col(key).cast(kind))
