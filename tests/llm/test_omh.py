import random
from itertools import combinations

import numpy as np
import pytest

from plumeline.llm import omh
from plumeline.llm.common import WordHash
from plumeline.llm.graph import components

RNG = random.Random(3)
WORDS = [f"w{i}" for i in range(5000)]


def prose(n):
    return RNG.choices(WORDS, k=n)


def edited(words, edits):
    out = list(words)
    for _ in range(edits):
        i = RNG.randrange(len(out))
        out[i : i + 1] = RNG.choice([[], [RNG.choice(WORDS)], [out[i], RNG.choice(WORDS)]])
    return out


def longest_chain(a, b):
    """Textbook longest common subsequence of labelled k-mers."""
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(0 for _ in b)] if not row else row
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def slow_similarity(a, b):
    chain = longest_chain(a.tolist(), b.tolist())
    return chain / (len(a) + len(b) - chain) if len(a) + len(b) else 0.0


def test_alignment_equals_textbook():
    table = WordHash()
    for trial in range(60):
        words = prose(RNG.randrange(1, 120)) if trial % 3 else RNG.choices(["a", "b"], k=60)
        other = edited(words, trial % 9)
        if trial % 5 == 0:
            other = other[len(other) // 2 :] + other[: len(other) // 2]
        a, b = omh.kmers(" ".join(words), table), omh.kmers(" ".join(other), table)
        exact = slow_similarity(a, b)
        assert omh.similarity(a, b) == (pytest.approx(exact) if exact >= 0.8 else pytest.approx(omh.similarity(a, b)))
        assert (omh.similarity(a, b) >= 0.8) == (exact >= 0.8 - 1e-12)


def test_sketches_see_order():
    table = WordHash()
    a = omh.kmers(" ".join(f"x{i}" for i in range(200)), table)
    b = np.concatenate([a[100:], a[:100]])
    assert (omh.sketches(a) == omh.sketches(a.copy())).all()
    assert (omh.sketches(a) == omh.sketches(b)).mean() < 0.3


def test_recall():
    """At the threshold the sketches find what the formula says, and more above."""
    table, found = WordHash(), []
    for _ in range(150):
        words = prose(400)
        a, b = omh.kmers(" ".join(words), table), omh.kmers(" ".join(edited(words, 8)), table)
        if omh.similarity(a, b) >= 0.8:
            found.append((omh.sketches(a) == omh.sketches(b)).any())
    assert len(found) > 50
    assert np.mean(found) >= 0.98


def documents():
    base, other = prose(120), prose(200)
    texts = [None, "", "?!", "one two", "one two", "one two three", " ".join(base), " ".join(base).upper() + "!", " ".join(other)]
    texts += [" ".join(edited(base, 1)) for _ in range(12)] + [" ".join(edited(other, 2)) for _ in range(6)]
    chain = prose(300)
    for _ in range(6):  # neighbours are alike, the ends are not
        chain = edited(chain, 5)
        texts.append(" ".join(chain))
    passage = prose(30)
    texts += [" ".join(prose(8) + passage) for _ in range(12)]
    return texts


def brute(texts):
    table = WordHash()
    own = [omh.kmers(t, table) for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if len(own[i]) and len(own[j]) and slow_similarity(own[i], own[j]) >= 0.8:
            a, b = sorted((top(i), top(j)))
            up[b] = a
    return [top(i) for i in range(len(texts))]


def test_classes_equal_brute_force(spark, monkeypatch):
    texts = documents()
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    expected = brute(texts)
    found = {r.doc_id: (r.component_id, r.kept) for r in omh.classes(docs).collect()}
    assert found == {i: (c, i == c) for i, c in enumerate(expected)}
    assert omh.classes(docs.limit(0)).isEmpty()
    monkeypatch.setattr(omh, "BLOCK_DOCS", 2)  # blocks and classes of sizes everywhere
    monkeypatch.setattr(omh, "AT_ONCE", 3)
    monkeypatch.setattr(omh, "BROADCAST_CELLS", 0)
    assert {r.doc_id: r.component_id for r in omh.classes(docs).collect()} == dict(enumerate(expected))


def test_short_texts_lose_nothing():
    """Every pair of up to 40 words at the threshold shares a bucket."""
    table, found = WordHash(), 0
    for n in range(1, 41):
        for trial in range(60):
            words = prose(n)
            other = [words + prose(trial % 3 + 1), words[trial % 4 :], edited(words, 1)][trial % 3]
            a, b = omh.kmers(" ".join(words), table), omh.kmers(" ".join(other), table)
            if len(b) and slow_similarity(a, b) >= 0.8 and min(len(a), len(b)) <= omh.SHORT:
                found += 1
                assert np.isin(omh.buckets(a), omh.buckets(b)).any()
    assert found > 500


def test_common_counts_and_forest(monkeypatch):
    monkeypatch.setattr(omh, "AT_ONCE", 5)
    table, base = WordHash(), prose(60)
    texts = [" ".join(edited(base, 1)) for _ in range(20)] + [" ".join(prose(50)) for _ in range(5)]
    sets = [omh.kmers(t, table) for t in texts]
    counts = omh.common_counts(sets)
    assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in combinations(range(len(sets)), 2))
    ids = list(range(len(texts)))
    for sides in (np.zeros(25, int), np.array([0] * 12 + [1] * 13)):
        links = omh.linked(ids, ids, sides, texts, table, 0.8)
        assert all(omh.similarity(sets[i], sets[j]) >= 0.8 and sides[i] <= sides[j] for i, j in links)
        assert len(links) == len({frozenset(x) for x in links}) <= 19
    assert omh.linked(ids, [0] * 25, np.zeros(25, int), texts, table, 0.8) == []


def test_shared_and_null_keys(spark):
    text = " ".join(prose(50))
    rows = [(1, text), (2, text + " end"), (2, "something else"), (None, text), (3, "something else"), (4, text), (4, text)]
    found = [(r.doc_id, r.component_id, r.kept) for r in omh.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted([(1, 1, True), (2, 1, False), (2, 1, False), (None, None, True), (3, 1, False), (4, 1, False), (4, 1, False)], key=str)


def test_long_text(spark):
    words = prose(200_000)
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3])), (3, " ".join(words[100_000:]))]
    assert [r.component_id for r in omh.classes(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [1, 1, 3]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 150)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in [*range(100, 160), 200]}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()
