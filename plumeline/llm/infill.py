"""Fill-in-middle texts by secondary sort.

A text is cut into units (lines, with their line breaks). The hash of `<seed>:<doc_id>` says where prefix and middle end and in which order the
output has them. Tasks emit pieces of whole units (a longer unit in several), keyed by document and output position;
repartitionAndSortWithinPartitions brings a document's pieces to one task in order, where they stream through an incremental digest and a
reader of the output's markers. What the reader finds is keyed by document and place in the text and sorted again, in the same
partitions, and streams through a second digest: that of the text rebuilt from output and form alone. No task holds a text for
that; sorting spills.

A null or empty text is plain, has no pieces and is not shuffled. A text with one of the markers stays plain. A null doc_id hashes as an empty number.
Rows that share a doc_id are documents of their own; rows equal in both have equal results, and of those in a task the pieces are sent once, with a count,
so that a hot row is no hot task. A document is keyed by a digest of id and text, so that tasks which run again emit the same. A text of
any length is one task's stream. An empty table gives no rows. Further columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Markers of prefix, middle and suffix.
PREFIX, MIDDLE, SUFFIX = "<P>", "<M>", "<S>"
#: The order of the parts in each form, as ranks in the text: 0 prefix, 1 middle, 2 suffix.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
MARKERS = (PREFIX, MIDDLE, SUFFIX)
#: Code points of a piece at most, bytes of text that a partition is meant for, and different rows of a task that are counted at most.
PIECE, PARTITION, COUNTED = 16_384, 24 << 20, 100_000


class Settings(NamedTuple):
    seed: int = 7
    fim_percent: int = 100
    spm_percent: int = 50


def units(text: str) -> list[int]:
    """Where each line ends, its line break included."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return ends


def plan(doc_id: object, text: str, ends: list[int], settings: Settings) -> tuple[str, int, int]:
    """Form, and where prefix and middle end (in code points)."""
    digits = hashlib.sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in MARKERS) or h[2] % 100 >= settings.fim_percent:
        return "plain", 0, 0
    first, last = sorted(x % (len(ends) + 1) for x in h[:2])
    at = [0, *ends]
    return "spm" if h[3] % 100 < settings.spm_percent else "psm", at[first], at[last]


def chunks(text: str, begin: int, end: int, ends: list[int]) -> Iterator[str]:
    """The text between two places in pieces of whole units; a unit that is longer than a piece is cut."""
    while begin < end:
        most = min(end, begin + PIECE)
        fit = bisect_right(ends, most)
        stop = most if most == end or not fit or ends[fit - 1] <= begin else ends[fit - 1]
        yield text[begin:stop]
        begin = stop


def emitted(rows: Iterable[tuple], settings: Settings) -> Iterator[tuple]:
    """((document, position), value): facts at -1, pieces of the output from 0, further equal rows of the task at -2."""
    more: dict[bytes, int] = {}
    for doc_id, text in rows:
        document = hashlib.blake2b(f"{doc_id!r}\0{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if document in more:
            more[document] += 1
            continue
        if len(more) < COUNTED:
            more[document] = 0
        ends = units(text)
        form, first, last = plan(doc_id, text, ends, settings)
        plain = form == "plain"
        yield (document, -1), (doc_id, len(ends), form, None if plain else first, None if plain else last - first)
        if plain:
            parts = [("", 0, len(text))]
        else:
            spans = ((0, first), (first, last), (last, len(text)))
            parts = [(MARKERS[rank], *spans[rank]) for rank in ORDERS[form]]
        position = 0
        for mark, begin, end in parts:
            for piece in chunks(text, begin, end, ends) if end > begin else [""]:
                yield (document, position), (mark + piece).encode()
                mark, position = "", position + 1
    for document, n in more.items():
        if n:
            yield (document, -2), n


class Reader:
    """Takes an output apart by its markers as it streams by: (rank, bytes) of the parts of the text."""

    def __init__(self, form: str):
        self.ranks = list(ORDERS.get(form, ()))
        self.rank = 0 if form == "plain" else None
        self.held = b""

    def feed(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        self.held += piece
        while self.ranks:
            mark = MARKERS[self.ranks[0]].encode()
            at = self.held.find(mark)
            if at < 0:
                yield from self.pass_on(max(0, len(self.held) - len(mark) + 1))
                return
            yield from self.pass_on(at)
            self.held, self.rank = self.held[len(mark) :], self.ranks.pop(0)
        yield from self.pass_on(len(self.held))

    def pass_on(self, n: int) -> Iterator[tuple[int, bytes]]:
        if n:
            if self.rank is None:
                raise ValueError("an output that does not begin with a marker")
            yield self.rank, self.held[:n]
            self.held = self.held[n:]

    def end(self) -> Iterator[tuple[int, bytes]]:
        if self.ranks:
            raise ValueError(f"an output without {MARKERS[self.ranks[0]]}")
        yield from self.pass_on(len(self.held))


def restored(output: str, form: str) -> str:
    """The text that an output was made of."""
    reader, parts = Reader(form), ([], [], [])
    for rank, piece in [*reader.feed(output.encode()), *reader.end()]:
        parts[rank].append(piece)
    return b"".join(b"".join(p) for p in parts).decode()


def assembled(rows: Iterable[tuple], texts: bool) -> Iterator[tuple]:
    """Pieces in output order to ((document, (rank, number)), piece), and at rank 3 the document's facts, number of rows and digest."""
    for document, own in groupby(rows, key=lambda kv: kv[0][0]):
        digest, facts, reader, before, count, number, kept = hashlib.sha256(), None, None, None, 0, 0, []
        for (_, position), value in own:
            if position == -2:
                count += value
            elif position == -1:
                facts, count = value, count + 1
                reader = Reader(facts[2])
            elif position != before:  # equal rows of other tasks have the same piece
                before = position
                digest.update(value)
                if texts:
                    kept.append(value)
                for rank, piece in reader.feed(value):
                    yield (document, (rank, number)), piece
                    number += 1
        for rank, piece in reader.end():
            yield (document, (rank, number)), piece
            number += 1
        yield (document, (3, 0)), (facts, count, digest.hexdigest(), b"".join(kept).decode() if texts else None)


def rebuilt(rows: Iterable[tuple], texts: bool) -> Iterator[tuple]:
    """Pieces in the text's order to a row for each document."""
    digest = hashlib.sha256()
    for (_, (rank, _)), value in rows:
        if rank < 3:
            digest.update(value)
            continue
        facts, count, output, text = value
        for _ in range(count):
            yield (*facts, output, digest.hexdigest(), *([text] if texts else []))
        digest = hashlib.sha256()


def by_document(key: tuple) -> int:
    return int.from_bytes(key[0][:8], "big")


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, texts: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars (code points, null if plain), output_sha256, restored_sha256, and with `texts` output, the text itself."""
    spark, settings = docs.sparkSession, Settings(seed, fim_percent, spm_percent)
    given = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    full = given.where("t <> ''")
    size = full.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    schema = T.StructType([T.StructField(key, given.schema["k"].dataType), *T._parse_datatype_string("n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * texts).fields])
    pieces = full.rdd.mapPartitions(lambda rows: emitted(rows, settings)).repartitionAndSortWithinPartitions(partitions, by_document)
    back = pieces.mapPartitions(lambda rows: assembled(rows, texts), preservesPartitioning=True)
    done = back.repartitionAndSortWithinPartitions(pieces.getNumPartitions(), by_document).mapPartitions(lambda rows: rebuilt(rows, texts))
    nothing = F.sha2(F.lit(""), 256)
    empty = given.where("t IS NULL OR t = ''").select(
        F.col("k").alias(key), F.lit(0).cast("long").alias("n"), F.lit("plain").alias("form"), F.lit(None).cast("long").alias("prefix_chars"), F.lit(None).cast("long").alias("middle_chars"),
        nothing.alias("output_sha256"), nothing.alias("restored_sha256"), *([F.lit("").alias("output")] if texts else []),
    )
    return spark.createDataFrame(done, schema, verifySchema=False).unionByName(empty)
