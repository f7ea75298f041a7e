import math
import time
import tracemalloc
import weakref
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.llm import common, knlm

TRUSTED = ["the cat sat on the mat", "a cat and a hat", "the rat ate the oat", "that bat sat", "on the flat hat sat a fat cat", "the cat sat on the mat"]


class Plain:
    """Interpolated modified Kneser-Ney over strings, straight from its definition."""

    def __init__(self, texts, order):
        self.order, raw = order, Counter()
        for word in " ".join(texts).split():
            w = "\2" + word + "\3"
            for i in range(1, len(w)):
                raw[w[max(0, i - order + 1) : i + 1]] += 1
        counts = [dict() for _ in range(order + 1)]
        seen = {g for g in raw}
        for n in range(order, 0, -1):
            level = {g: c for g, c in raw.items() if len(g) == n}
            longer = {g[1:] for g in counts[n + 1]} if n < order else set()
            for s in longer:
                level.setdefault(s, sum(g[1:] == s for g in counts[n + 1]))
            counts[n] = level
        assert seen
        self.alpha, self.gamma, self.symbols = {}, {"": 1.0}, len(counts[1])
        for n in range(1, order + 1):
            have = Counter(c for c in counts[n].values() if c <= 4)
            n1, n2, n3, n4 = (have[c] for c in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ratio = [n2 / n1 if n1 and n2 else 0.5, n3 / n2 if n2 and n3 else 0.5, n4 / n3 if n3 and n4 else 0.5]
            d = [min(max(k - (k + 1) * y * ratio[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
            total, spared = defaultdict(float), defaultdict(float)
            for g, c in counts[n].items():
                total[g[:-1]] += c
                spared[g[:-1]] += d[min(c, 3) - 1]
            for g, c in counts[n].items():
                self.alpha[g] = (c - d[min(c, 3) - 1]) / total[g[:-1]]
            self.gamma |= {h: spared[h] / total[h] for h in total}

    def p(self, history, c):
        if history is None:
            return 1 / (self.symbols + 1)
        return self.alpha.get(history + c, 0.0) + self.gamma.get(history, 1.0) * self.p(history[1:] if history else None, c)

    def perplexity(self, text):
        total = n = 0
        for word in text.split():
            w = "\2" + word + "\3"
            for i in range(1, len(w)):
                total += math.log(self.p(w[max(0, i - self.order + 1) : i], w[i]))
                n += 1
        return math.exp(-total / n) if n else None


def test_perplexity_equals_definition(spark):
    texts = [*TRUSTED, None, "", " \n", "the zebra", "XXX ### $$$", "the cat " * 3000, "hat"]
    docs = spark.createDataFrame([(i, t, "en", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, perplexity double")
    trusted = docs.where(F.col("doc_id") < len(TRUSTED))
    for order in (2, 4):
        plain = Plain(TRUSTED, order)
        found = {r.doc_id: r.perplexity for r in knlm.score(docs, knlm.train(trusted, order=order), order=order).collect()}
        for i, t in enumerate(texts):
            want = plain.perplexity(t or "")
            assert found[i] == (None if want is None else pytest.approx(want, rel=1e-4))


def test_decisions(spark):
    texts = [*TRUSTED * 4, "@@@ ### XQZ", None, ""]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = docs.where("doc_id < 24").select("doc_id")
    found = {r.doc_id: r for r in knlm.classify(docs, trusted).collect()}
    assert [found[i].accepted for i in range(len(texts))] == [True] * 24 + [False] * 3
    assert len({found[i].threshold for i in (0, 2)}) == 1
    nothing = knlm.classify(docs, trusted.limit(0)).collect()
    assert sum(r.accepted for r in nothing) == 25
    assert knlm.classify(docs.limit(0), trusted).isEmpty()


def test_held_out(spark):
    """Documents that were not trained on: nearly all good ones are accepted, most bad ones not."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    good = labels.where("quality = 1")
    found = knlm.classify(docs, good.where("doc_id % 4 > 0")).join(labels.where("doc_id % 4 = 0"), "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("share"))
    share = {r.quality: r.share for r in found.collect()}
    assert share[1] >= 0.97
    assert share[0] <= 0.25


def test_toxic_documents():
    """One run of insults decides, wherever it stands and however long the text is."""
    steps = [-1.0, 4.5, -1.0, 4.0, -1.0, -1.0]
    assert knlm.toxicity(np.array(steps)) == 7.5
    assert knlm.toxicity(np.array([-1.0] * 9_000 + steps)) == 7.5
    assert knlm.toxicity(np.array([])) == 0.0


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_toxic_held_out(spark, monkeypatch, size):
    """Labelled documents whose labels were not given: those with insults go, clean ones stay, and insults in trusted text do not hide them."""
    d = f"/root/testdata/{size}"
    monkeypatch.setattr(knlm, "BROADCAST_WORDS", 0 if size == "sf0.01" else knlm.BROADCAST_WORDS)  # both ways
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    given = labels.where("doc_id % 4 > 0")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    docs = docs.union(spark.createDataFrame([(10**7, None, "en", "s", 0), (10**7 + 1, "You IDIOT, moron-like scum! " + "of the and " * 4000, "en", "s", 0)], docs.schema))
    found = knlm.classify(docs, given.where("quality <=> 1 AND toxic <=> 0"), labels=given)
    rows = found.join(docs.select("doc_id", "text"), "doc_id").join(labels.withColumnRenamed("toxic", "label"), "doc_id", "left").collect()
    insult = lambda t: bool({"trash", "idiot", "moron", "scum", "clown", "loser"} & set(knlm.whole_words(t)))
    judged = lambda of: [r.toxicity > r.toxicity_threshold for r in of]
    test = [r for r in rows if r.doc_id % 4 == 0 and r.doc_id < 10**7]
    toxic, clean = judged(r for r in test if r.label == 1 and insult(r.text)), judged(r for r in test if r.label == 0)
    assert sum(toxic) >= 0.95 * len(toxic) > 0
    assert sum(clean) <= 0.02 * len(clean)
    own = {r.doc_id: r for r in rows if r.doc_id >= 10**7}
    assert own[10**7].toxicity is None and not own[10**7].accepted
    assert judged([own[10**7 + 1]]) == [True] and not own[10**7 + 1].accepted


def test_no_toxic_labels(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TRUSTED)], "doc_id long, text string, lang string")
    for kind in (0, 1, None):
        labels = docs.select("doc_id", F.lit(kind).cast("int").alias("toxic"))
        found = knlm.classify(docs, docs.select("doc_id"), labels=labels).collect()
        assert all(r.accepted and r.toxicity is None and r.toxicity_threshold is None for r in found)


def test_long_words_and_null_keys(spark, monkeypatch):
    """A text of 5 million characters without white space, null keys and repeated rows; small bounds change nothing."""
    texts = [*TRUSTED, "x1" * 2_500_000, "the cat sat", "the cat sat"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "the cat sat", None), (7, "the cat sat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = docs.where("doc_id < 6 OR doc_id IS NULL").select("doc_id")
    find = lambda: sorted((-1 if r.doc_id is None else r.doc_id, r.perplexity, r.accepted) for r in knlm.classify(docs, trusted).collect())
    found = find()
    assert len(found) == len(rows)
    assert len({p for i, p, _ in found if i in (-1, 7, 8)}) == 1
    assert not next(a for i, _, a in found if i == 6)
    for name, bound in (("COUNT_CHARS", 7), ("CHUNK_CHARS", 20), ("SHARD_GRAMS", 5), ("SLICE_BATCHES", 1)):
        monkeypatch.setattr(knlm, name, bound)
    small = spark.createDataFrame([r for r in rows if r[0] != 6], docs.schema)
    again = sorted((-1 if r.doc_id is None else r.doc_id, r.perplexity) for r in knlm.classify(small, trusted).collect())
    assert [i for i, _ in again] == [i for i, *_ in found if i != 6]
    assert [p for _, p in again] == pytest.approx([p for i, p, _ in found if i != 6], rel=1e-6)


def test_scores_hold_few_characters_at_once():
    words = [f"w{i:09d}" for i in range(100_000)]
    tracemalloc.start()
    scores = knlm.word_scores(words, 4, knlm.Weights(np.zeros(1, np.uint64), np.zeros(1, np.float32), np.ones(1, np.float32)), 9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and scores == pytest.approx(np.full(len(words), -11 * math.log(10)))


def test_tasks_give_memory_back_when_their_variables_are_gone(monkeypatch):
    refs, gone = [], []
    monkeypatch.setattr(common, "release", lambda: gone.append(refs[0]() is None))

    def run(frames):
        held = np.zeros(9)
        refs.append(weakref.ref(held))
        yield from frames

    assert list(common.releasing(run)(iter([1, 2]))) == [1, 2] and gone == [True]


def test_words_are_split_as_str_does(monkeypatch):
    """All white space, texts of every kind, whatever is taken at once."""
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = ["", " ", "".join(f"a{s}" for s in spaces), "".join(f"{s}é中" for s in spaces), "b\0 c\x1bd ​ ﻿ x", "é" * 100 + " é " + "z" * 65 + " a a", " 　"]
    for size in (1, 10**6):
        monkeypatch.setattr(knlm, "SPLIT_BYTES", size)
        found = []
        for words, which, sizes in knlm.split_words(t.encode() for t in texts):
            assert len(set(words)) == len(words)
            found += [[words[i] for i in own] for own in np.split(which, np.cumsum(sizes)[:-1])]
        assert found == [t.split() for t in texts]


def test_weights_equal_a_dictionary():
    rng = np.random.default_rng(4)
    for keys in (rng.integers(0, 2**64, 3000, dtype=np.uint64), np.arange(3000, dtype=np.uint64), np.array([2**64 - 1, 0], np.uint64), np.empty(0, np.uint64)):
        alpha, gamma = rng.random((2, len(keys))).astype(np.float32)
        asked = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 2**64, 100, dtype=np.uint64), np.array([0, 2**64 - 2, 2**63], np.uint64)])
        known = dict(zip(keys.tolist(), zip(alpha.tolist(), gamma.tolist(), strict=True), strict=True))
        got = knlm.Weights(keys, alpha, gamma).of(asked)
        for k, a, g in zip(asked.tolist(), *(x.tolist() for x in got), strict=True):
            assert (a, g) == known.get(k, (0, 1)) or k == 2**64 - 1


def test_cost_of_scores():
    """Looking n-grams up takes no search for each: scoring words costs little more than making their n-grams."""
    rng = np.random.default_rng(6)
    words = ["".join(map(chr, rng.integers(97, 123, 9))) for _ in range(100_000)]
    keys = np.unique(np.concatenate([k for at, end in knlm.pieces(words, knlm.SCORE_CHARS) for _, k, _, _ in knlm.orders(words[at:end], 4)]))
    weights = knlm.Weights(keys, np.full(len(keys), 0.5, np.float32), np.full(len(keys), 0.5, np.float32))
    took = []
    for run in (lambda: [len(k) for at, end in knlm.pieces(words, knlm.SCORE_CHARS) for _, k, _, _ in knlm.orders(words[at:end], 4)], lambda: knlm.word_scores(words, 4, weights, 26)):
        run()
        began = time.process_time()
        run()
        took.append(time.process_time() - began)
    assert took[1] < 6 * took[0], took
