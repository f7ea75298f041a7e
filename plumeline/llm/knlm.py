"""Text quality by an interpolated modified Kneser-Ney n-gram model.

The model predicts each character of a word, and the word's end, from the characters before it, up to `order` together. It is
trained on trusted text: tasks count the n-grams of their distinct words, Spark adds the counts up, derives continuation counts,
discounts and interpolation weights by grouping and joins, and keeps them as one table dealt out by n-gram. To score, documents are
packed into batches; a batch asks the shards of the table for the n-grams of its distinct words and gets their weights back, so
that neither a text nor the model passes through one place. Counts, n-grams asked for and scores all grow with the input, as new
words do. Texts of any length are taken whole; n-grams are made of a bounded number of characters at once, or of one word.

A document's perplexity is that of its characters. It is accepted if that is no more than the threshold of its language: a quantile
of trusted texts of that language that were kept from training, times a margin; languages without trusted text take that of all.

A few insults hardly move the perplexity of a text. So where texts are labelled as toxic or clean, two further models of order 1 are
trained, over whole words (lower-cased runs of letters and digits) of the toxic and of the clean texts; words of fewer than
LEAST_TEXTS labelled texts are one unknown word to both. As in Kneser-Ney's lower orders, contexts are counted instead of tokens:
the texts that have a word, so that one text's stutter is no evidence. A text's toxicity is the largest sum, over all its runs of words, of the
logs of the models' ratios less DRIFT for each word, so that neither a text's length nor what else it holds hides its insults. It is not
accepted if that is above a threshold: the quantile of clean texts kept from training, times the margin, and no less than the
log odds of clean texts against toxic ones, less what one word takes (a run has a word at least). Rows labelled both ways are toxic; without labels of both kinds nothing is judged as toxic.

Null and empty texts, and texts of white space, have no perplexity and are not accepted. Null languages are a language of their
own. Rows with a null key are judged, but never trusted. Repeated rows get equal results and count as often in training, as do rows
that share a key. A perplexity equal to its threshold is accepted. Further columns are left out. Without any trusted text all texts
with words are accepted; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, distinct_words, mix, pack, pack_sorted, release, releasing, stable_order, together, unpack, unpack_sorted, written

ORDER, QUANTILE, MARGIN = 4, 0.995, 1.1
#: One in so many trusted texts is not trained on and sets the threshold, in languages with at least LEAST_HELD such texts; else all set it.
HELD_OUT, LEAST_HELD = 10, 20
#: Characters of texts in a batch, and of words whose n-grams a task holds at once when it counts them and when it asks for them or scores.
CHUNK_CHARS, COUNT_CHARS, SCORE_CHARS = 16_000_000, 1_000_000, 200_000
#: Bytes of texts (or one text) that are split into words at once.
SPLIT_BYTES = 4_000_000
#: Rows whose texts are Python strings at once when batches are made.
PACK_ROWS = 256
#: N-grams of a shard of the model, and batches (by the number of shards) that ask it at once.
SHARD_GRAMS, SLICE_BATCHES = 2_000_000, 64
#: Up to so many ids of trusted documents (8 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Up to so many words with ratios (12 bytes each) are broadcast; beyond, batches ask for theirs as they do for n-grams.
BROADCAST_WORDS = 1_000_000
#: Labelled texts from which on a word is known to the models of toxic and clean text, and what each word takes from a run's sum.
LEAST_TEXTS, DRIFT = 5, 1.0
FIRST, LAST = 2, 3  # code points that mark a word's begin and end


def orders(words: list[str], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n from 0 to order and the words' characters with their marks: n, the n-grams that end at each character (0 is the empty one), the
    character's place in its word, and its word."""
    sizes = np.array([len(w) for w in words], np.int64) + 2
    ends = np.cumsum(sizes)
    chars = np.frombuffer((chr(FIRST) + f"{chr(LAST)}{chr(FIRST)}".join(words) + chr(LAST)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    place = (np.arange(len(chars)) - np.repeat(ends - sizes, sizes)).astype(np.int32)
    keys = np.zeros(len(chars), np.uint64)
    yield 0, keys, place, word
    for n in range(1, order + 1):
        longer = chars + np.uint64(n)
        longer[1:] += keys[:-1] * BASE
        keys = mix(longer)
        yield n, keys, place, word


def pieces(words: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Where runs of words of so many characters, or of one word, begin and end."""
    at = 0
    while at < len(words):
        size, end = 0, at
        while end < len(words) and (end == at or size + len(words[end]) <= chars):
            size += len(words[end])
            end += 1
        yield at, end
        at = end


#: What str.split() takes for white space: of one byte, as a table, and of more.
SPACES = bytes(32 if 9 <= c <= 13 or 28 <= c <= 31 else c for c in range(256))
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def plainly_spaced(text: bytes) -> bytes:
    if not text.isascii():
        for space in WIDE_SPACES:
            text = text.replace(space, b" ")
    return text


def split_words(texts: Iterable[bytes]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Of some texts at once: their distinct words, which of them each word is, and how many words each text has."""
    for some in together(map(plainly_spaced, texts), SPLIT_BYTES):
        yield distinct_words(some, SPACES)


COUNTS = "n int, key long, context long, suffix long, raw long"


def count_grams(docs: DataFrame, text: str, order: int) -> DataFrame:
    """n, key, context (the n-gram without its last character), suffix (without its first) and raw: how often it ends a longest history."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for words, which, _ in split_words(t.encode() for frame in frames for t in frame[text].dropna()):
            times = np.bincount(which, minlength=len(words))
            # Some words at a time, so that their n-grams take bounded memory; a word longer than that comes alone.
            for at, end in pieces(words, COUNT_CHARS):
                yield from table(words[at:end], times[at:end])

    def table(words: list[str], times: np.ndarray) -> Iterator[pd.DataFrame]:
        suffix = None
        for n, keys, place, word in orders(words, order):
            if n:
                at = np.flatnonzero(place >= max(1, n - 1))
                grams = keys[at]
                by = stable_order(grams)
                own = grams[by]
                firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
                own, i = own[firsts], at[by[firsts]]
                ends = np.where((n == order) | (place[at] == n - 1), times[word[at]], 0)[by]
                raw = np.add.reduceat(ends, firsts) if len(firsts) else ends
                yield pd.DataFrame({"n": n, "key": own.view(np.int64), "context": suffix[i - 1].view(np.int64), "suffix": suffix[i].view(np.int64), "raw": raw})
            suffix = keys

    counted = docs.select(text).mapInPandas(releasing(run), COUNTS)
    return counted.groupBy("n", "key", "context", "suffix").agg(F.sum("raw").alias("raw"))


def discounts(counts: DataFrame) -> dict[int, list[float]]:
    """D1, D2 and D3+ of each order, from the numbers of n-grams with counts 1 to 4: a few numbers, whatever the input."""
    rows = counts.where("c <= 4").groupBy("n", "c").count().collect()
    have = {(r["n"], r["c"]): r["count"] for r in rows}
    out = {}
    for n in {r["n"] for r in rows}:
        n1, n2, n3, n4 = (have.get((n, c), 0) for c in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ratio = [n2 / n1 if n1 and n2 else 0.5, n3 / n2 if n2 and n3 else 0.5, n4 / n3 if n3 and n4 else 0.5]
        out[n] = [min(max(k - (k + 1) * y * ratio[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
    return out


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """The model: key, n (null if it is a history only), alpha (the n-gram's own discounted share) and gamma (what its history leaves
    to shorter ones). Key 0 is the empty history."""
    counts = written(count_grams(docs, text, order), "grams")
    left = counts.where("n > 1").groupBy(F.col("suffix").alias("key")).agg(F.count(F.lit(1)).alias("left"))
    counts = written(counts.join(left, "key", "left").select("n", "key", "context", F.when(F.col("raw") > 0, F.col("raw")).otherwise(F.col("left")).alias("c")), "counts")
    by_order = discounts(counts)
    d = F.lit(0.0)
    for n, values in by_order.items():
        for k, v in enumerate(values, 1):
            d = F.when((F.col("n") == n) & (F.least("c", F.lit(3)) == k), v).otherwise(d)
    counts = counts.withColumn("d", d)
    histories = counts.groupBy("context").agg(F.sum("c").alias("total"), F.sum("d").alias("spared"))
    alphas = counts.join(histories.select("context", "total"), "context").select("key", "n", ((F.col("c") - F.col("d")) / F.col("total")).alias("alpha"))
    gammas = histories.select(F.col("context").alias("key"), (F.col("spared") / F.col("total")).alias("gamma"))
    model = alphas.join(gammas, "key", "full").select("key", "n", F.coalesce("alpha", F.lit(0.0)).cast("float").alias("alpha"), F.coalesce("gamma", F.lit(1.0)).cast("float").alias("gamma"))
    return written(model, "model")


WHOLE_WORDS = re.compile(r"[^\W_]+").findall


def whole_words(text: str) -> list[str]:
    return WHOLE_WORDS(text.lower())


def word_key(word: str) -> int:
    """Apart from the keys of n-grams."""
    return xxhash.xxh3_64_intdigest(word, seed=1)


def count_words(labelled: DataFrame, text: str) -> DataFrame:
    """key, clean and toxic (how many such texts have the word), of texts with a column `toxic`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Counter(), Counter()
        for frame in frames:
            for t, toxic in zip(frame[text], frame["toxic"], strict=True):
                found[toxic].update(set(whole_words(t)))
            if sum(map(len, found)) > 400_000:
                yield table(*found)
                found = Counter(), Counter()
        if any(found):
            yield table(*found)

    def table(clean: Counter, toxic: Counter) -> pd.DataFrame:
        words = list(clean.keys() | toxic.keys())
        keys = np.fromiter(map(word_key, words), np.uint64, len(words)).view(np.int64)
        return pd.DataFrame({"key": keys, "clean": [clean[w] for w in words], "toxic": [toxic[w] for w in words]})

    counted = labelled.select(text, "toxic").where(F.col(text).isNotNull()).mapInPandas(releasing(run), "key long, clean long, toxic long")
    return counted.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def train_ratios(labelled: DataFrame, text: str = "text") -> DataFrame | None:
    """key and ratio (log of the toxic model's probability by the clean one's) of each known word; None without words of both kinds."""
    kinds = ("clean", "toxic")
    counts = written(count_words(labelled, text), "words")
    totals = counts.agg(*(F.sum(k).alias(k) for k in kinds)).first()
    if not (totals["clean"] and totals["toxic"]):
        return None
    known = counts.where(F.col("clean") + F.col("toxic") >= LEAST_TEXTS)
    by_kind = discounts(known.select(F.lit(0).alias("n"), F.col("clean").alias("c")).unionByName(known.select(F.lit(1).alias("n"), F.col("toxic").alias("c"))).where("c > 0"))
    for n, k in enumerate(kinds):
        d = F.lit(0.0)
        for c, v in enumerate(by_kind.get(n, (0.5, 1.25, 2.0)), 1):
            d = F.when(F.least(k, F.lit(3)) == c, v).otherwise(d)
        known = known.withColumn(f"d_{k}", d)
    sums = known.agg(F.count(F.lit(1)).alias("words"), *(F.sum(f"d_{k}").alias(k) for k in kinds)).first()
    if not (sums["clean"] and sums["toxic"]):
        return None
    clean, toxic = ((F.col(k) - F.col(f"d_{k}") + sums[k] / (sums["words"] + 1)) / totals[k] for k in kinds)
    return written(known.select("key", F.log(toxic / clean).cast("float").alias("ratio")), "ratios")


def toxicity(values: np.ndarray) -> float:
    """Largest sum of a run of values, 0 for none."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return float((sums - np.minimum.accumulate(sums)).max())


class Weights:
    """alpha and gamma of n-grams, sorted by their hashes; others are unseen. A table tells by the highest bits where to look."""

    def __init__(self, keys: np.ndarray, alpha: np.ndarray, gamma: np.ndarray):
        by = np.argsort(keys, kind="stable")
        end = np.uint64(2**64 - 1)  # stands for what is beyond all keys
        self.keys, self.alpha, self.gamma = np.append(keys[by], end), np.append(alpha[by], np.float32(0)), np.append(gamma[by], np.float32(1))
        bits = len(keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys[:-1] >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32 if len(by) < 2**31 else np.int64)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = (keys >> self.shift).astype(np.int64)
        at = self.first[cell]
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):  # the others of the same cell, which are few
            own = at[left] + 1
            inside = own < self.first[cell[left] + 1]
            at[left[~inside]] = len(self.keys) - 1
            left, own = left[inside], own[inside]
            at[left] = own
            left = left[self.keys[own] != keys[left]]
        return self.alpha[at], self.gamma[at]


def word_scores(words: list[str], order: int, weights: Weights, symbols: int) -> np.ndarray:
    """Log probability of each word with its end."""
    out = np.zeros(len(words))
    for at, end in pieces(words, SCORE_CHARS):
        p, spare = None, None
        for n, keys, place, word in orders(words[at:end], order):
            if n:
                alpha, gamma = weights.of(keys)
                p = np.where(place >= n - 1, alpha + spare * p, p)
                spare = np.concatenate([[1.0], gamma[:-1]])
            else:
                p, spare = np.full(len(keys), 1.0 / (symbols + 1)), weights.of(keys[:1])[1]  # one history, the empty one
        out[at:end] = np.bincount(word, weights=np.where(place > 0, np.log(p), 0.0), minlength=end - at)
    return out


def packed(docs: DataFrame, key: str, text: str, also: tuple[str, ...]) -> DataFrame:
    """The texts in batches of CHUNK_CHARS characters or one text, a row each: batch (a digest of what it holds, so that a task that is run
    again makes the same one), the columns as arrays of strings, and the squeezed texts."""
    names = (key, *also)
    kinds = pa.schema([("batch", pa.string()), *((c, pa.list_(pa.string())) for c in names), ("sizes", pa.binary()), ("texts", pa.binary())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for frame in frames:
            for at in range(0, frame.num_rows, PACK_ROWS):
                for *own, t in zip(*(c.to_pylist() for c in frame.slice(at, PACK_ROWS).columns), strict=True):
                    held.append((*own, None if t is None else t.encode()))
                    size += len(t or "")
                    if size >= CHUNK_CHARS:
                        yield batch(held)
                        held, size = [], 0
            del frame  # before the next one is read
        if held:
            yield batch(held)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        *columns, texts = zip(*held, strict=True)
        sizes = np.array([-1 if t is None else len(t) for t in texts], np.int64)
        name = xxhash.xxh3_128(repr(columns).encode("utf-8", "surrogatepass") + sizes.tobytes())
        squeezer = zstandard.ZstdCompressor(level=5).compressobj(size=int(np.maximum(sizes, 0).sum()))
        squeezed = bytearray()
        for t in filter(None, texts):
            name.update(t)
            squeezed += squeezer.compress(t)
        squeezed += squeezer.flush()
        row = {"batch": name.hexdigest(), **dict(zip(names, map(list, columns), strict=True)), "sizes": pack(sizes), "texts": bytes(squeezed)}
        return pa.RecordBatch.from_pylist([row], schema=kinds)

    given = docs.select(*[F.col(c).cast("string").alias(c) for c in names], text)
    return given.mapInArrow(releasing(run), "batch string, " + ", ".join(f"`{c}` array<string>" for c in names) + ", sizes binary, texts binary")


def texts_of(sizes: bytes, texts: bytes) -> Iterator[bytes]:
    """Nulls count as empty."""
    blob, at = zstandard.ZstdDecompressor().decompress(texts), 0
    for size in unpack(sizes, "i8").tolist():
        yield blob[at : at + max(size, 0)]
        at += max(size, 0)


def score(docs: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, also: tuple[str, ...] = (), ratios: DataFrame | None = None) -> DataFrame:
    """key, the columns `also`, and perplexity (null without words) of each row; with `ratios` also toxicity."""
    symbols = max(1, model.where("n = 1").count())
    rated = ratios is not None
    sent = None
    if rated and ratios.count() <= BROADCAST_WORDS:
        known = ratios.toPandas()
        by = np.argsort(known["key"].to_numpy(np.int64).view(np.uint64))
        sent = docs.sparkSession.sparkContext.broadcast((known["key"].to_numpy(np.int64).view(np.uint64)[by], known["ratio"].to_numpy(np.float32)[by]))
    asking = rated and sent is None
    if asking:
        model = model.unionByName(ratios.select("key", F.lit(None).cast("int").alias("n"), F.col("ratio").alias("alpha"), F.lit(0.0).cast("float").alias("gamma")))
    chunks = (docs.agg(F.sum(F.length(text))).first()[0] or 0) / CHUNK_CHARS
    # The only exchange of texts: asking and judging share it.
    batches = packed(docs, key, text, also).repartition(max(8, math.ceil(2 * chunks)), "batch")
    # As many shards as the model needs; batches ask them in slices, so that what a shard gets at once is bounded by both sides' sizes.
    shards = max(8, math.ceil(model.count() / SHARD_GRAMS))
    slices = max(1, math.ceil(chunks / (SLICE_BATCHES * shards)))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, sizes, texts in zip(frame["batch"], frame["sizes"], frame["texts"], strict=True):
                words = list({w for own, _, _ in split_words(texts_of(sizes, texts)) for w in own})
                wanted = [np.zeros(1, np.uint64)]
                for at, end in pieces(words, SCORE_CHARS):
                    wanted += [np.unique(keys[place >= n - 1]) for n, keys, place, _ in orders(words[at:end], order) if n]
                if asking:
                    own = {w for t in words for w in whole_words(t)}
                    wanted.append(np.fromiter(map(word_key, own), np.uint64, len(own)))
                asked = np.unique(np.concatenate(wanted))
                shard = asked % np.uint64(shards)
                by = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[by], np.arange(shards + 1))
                rows = [(name, s, pack_sorted(asked[by[cuts[s] : cuts[s + 1]]])) for s in range(shards) if cuts[s] < cuts[s + 1]]
                yield pd.DataFrame(rows, columns=["batch", "shard", "wanted"])

    def answer(key, asks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        known = own["key"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(known)
        known, alpha, gamma = known[by], own["alpha"].to_numpy(np.float32)[by], own["gamma"].to_numpy(np.float32)[by]
        out = []
        for batch, wanted in zip(asks["batch"], asks["wanted"], strict=True):
            asked = unpack_sorted(wanted)
            at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
            at = at[known[at] == asked] if len(known) else at[:0]
            out.append((batch, pack_sorted(known[at]), pack(alpha[at]), pack(gamma[at])))
        return pd.DataFrame(out, columns=["batch", "keys", "alpha", "gamma"])

    def judge(batch, mine: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        """A batch's rows; two batches that hold the same have one name. Every batch has asked, if only for the empty n-gram."""
        if not len(got) or not len(mine):
            raise RuntimeError("batch and answers do not match: the rows of the input changed their order between two reads")
        parts = [np.concatenate([unpack_sorted(x) for x in got["keys"]]), *(np.concatenate([unpack(x, "f4") for x in got[c]]) for c in ("alpha", "gamma"))]
        weights = Weights(*parts)
        found = pd.concat([judged_rows(row, weights) for _, row in mine.iterrows()])
        del weights, parts
        release()
        return found

    def judged_rows(row: pd.Series, weights: Weights) -> pd.DataFrame:
        ids: dict[str, int] = defaultdict(count().__next__)  # words of the batch by first sight
        split = []
        for distinct, which, sizes in split_words(texts_of(row["sizes"], row["texts"])):
            split += np.split(np.fromiter(map(ids.__getitem__, distinct), np.int32, len(distinct))[which], np.cumsum(sizes)[:-1])
        words = list(ids)
        del ids
        scores = word_scores(words, order, weights, symbols) if words else np.empty(0)
        lengths = np.array([len(w) for w in words], np.int64) + 1
        of_words = Weights(*sent.value, np.zeros(len(sent.value[0]), np.float32)) if sent else weights
        steps, ends = steps_of(words, of_words) if rated else (None, None)
        out, toxic = [], []
        for own in split:
            out.append(math.exp(-scores[own].sum() / lengths[own].sum()) if len(own) else None)
            if rated:
                toxic.append(toxicity(run_of(own, steps, ends)) if len(own) else None)
        found = pd.DataFrame({c: pd.Series(list(row[c]), dtype=object) for c in (key, *also)})
        found["perplexity"] = pd.Series(out, dtype="float64")
        if rated:
            found["toxicity"] = pd.Series(toxic, dtype="float64")
        return found

    def steps_of(words: list[str], weights: Weights) -> tuple[np.ndarray, np.ndarray]:
        """What each whole word of a word adds to a run's sum, one after the other, and where each word's begin."""
        flat, sizes = [np.empty(0)], [np.zeros(1, np.int64)]
        for at, end in pieces(words, SCORE_CHARS):
            split = [[w] if w.isalnum() else WHOLE_WORDS(w) for w in map(str.lower, words[at:end])]
            distinct = list({w for own in split for w in own})
            keys = np.fromiter(map(word_key, distinct), np.uint64, len(distinct))
            ratio, gamma = weights.of(keys)
            known = dict(zip(distinct, np.where(gamma == 0, ratio, 0.0).tolist(), strict=True))  # unknown words have a gamma of 1
            flat.append(np.fromiter((known[x] for own in split for x in own), np.float64) - DRIFT)
            sizes.append(np.fromiter(map(len, split), np.int64, len(split)))
        return np.concatenate(flat), np.cumsum(np.concatenate(sizes))

    def run_of(own: np.ndarray, steps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends[own + 1] - ends[own]
        return steps[np.repeat(ends[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    asks = batches.mapInPandas(releasing(ask), "batch string, shard int, wanted binary").withColumn("slice", F.pmod(F.xxhash64("batch"), F.lit(slices)).cast("int"))
    dealt = model.withColumn("shard", unsigned_mod(F.col("key"), shards)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    answers = asks.groupBy("shard", "slice").cogroup(dealt.groupBy("shard", "slice")).applyInPandas(answer, "batch string, keys binary, alpha binary, gamma binary")
    measures = ["perplexity", "toxicity"][: 1 + rated]
    kind = ", ".join([f"`{c}` string" for c in (key, *also)] + [f"{m} double" for m in measures])
    judged = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(judge, kind)
    return judged.select(*[F.col(c).cast(docs.schema[c].dataType) for c in (key, *also)], *measures)


def unsigned_mod(x, m: int):
    """x % m of a long that holds an unsigned integer."""
    return F.pmod(F.pmod(x, F.lit(m)) + F.when(x < 0, (1 << 64) % m).otherwise(0), F.lit(m)).cast("int")


def trusted_only(docs: DataFrame, trusted: DataFrame, key: str) -> DataFrame:
    ids = trusted.select(key).where(F.col(key).isNotNull()).distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """The texts with a label, and toxic: 1 or 0."""
    return docs.select(key, text).join(F.broadcast(labels) if labels.count() <= BROADCAST_IDS else labels, key)


def classify(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, labels: DataFrame | None = None) -> DataFrame:
    """key, language, perplexity, threshold and accepted of each row; `trusted` has the keys of the trusted texts. With `labels` (key
    and toxic, 1 or 0; other rows say nothing) also toxicity and toxicity_threshold, null where nothing is judged as toxic."""
    held = F.pmod(F.xxhash64(key), F.lit(HELD_OUT)) == 0
    model = train(trusted_only(docs, trusted.where(~held), key), text, order)
    ratios = None
    if labels is not None:
        labels = labels.where(F.col(key).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
        ratios = train_ratios(labelled_texts(docs, labels.where(~held), key, text), text)
    scored = written(score(docs, model, key, text, order, also=(lang,), ratios=ratios), "scores")
    known = scored.join(trusted.select(key).distinct(), key, "left_semi").where("perplexity IS NOT NULL")

    def cut(of: str) -> Column:
        apart = F.when(held, F.col(of))
        at = lambda x: F.percentile_approx(x, F.lit(quantile), F.lit(10_000)) * margin
        return F.when(F.count(apart) >= LEAST_HELD, at(apart)).otherwise(at(F.col(of)))

    everywhere = known.agg(cut("perplexity").alias("overall"))
    cuts = known.groupBy(lang).agg(cut("perplexity").alias("own"))
    # One row for each language.
    out = scored.join(cuts.withColumnRenamed(lang, "_lang"), F.col(lang).eqNullSafe(F.col("_lang")), "left").crossJoin(F.broadcast(everywhere))
    threshold = F.coalesce("own", "overall", F.lit(float("inf")))
    accepted = F.col("perplexity").isNotNull() & (F.col("perplexity") <= threshold)
    if labels is None:
        return out.select(key, lang, "perplexity", threshold.alias("threshold"), accepted.alias("accepted"))
    if ratios is None:
        out, limit = out.withColumn("toxicity", F.lit(None).cast("double")), F.lit(None).cast("double")
    else:
        clean = F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0))
        of_clean = F.coalesce(cut("_clean"), F.lit(0.0))
        rated = scored.join(labels, key).where("toxicity IS NOT NULL").withColumn("_clean", F.when(F.col("toxic") == 0, F.col("toxicity")))
        out = out.crossJoin(F.broadcast(rated.agg(F.greatest(of_clean, F.log(clean / F.sum("toxic")) - DRIFT).alias("limit"))))
        limit = F.col("limit")
    accepted = accepted & ~F.coalesce(F.col("toxicity") > limit, F.lit(False))
    return out.select(key, lang, "perplexity", threshold.alias("threshold"), "toxicity", limit.alias("toxicity_threshold"), accepted.alias("accepted"))
