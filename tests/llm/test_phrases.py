import re
import time

import numpy as np
import pandas as pd

from plumeline.llm import phrases
from plumeline.llm.common import hash_words, stable_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOX = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions"
DOCS = [None, "", "!!!", FOX.upper(), FOX + " " + FOX, "É " + FOX[:50], "ab " * 200 + FOX + " tail", "solo item", "x solo ITEM y", FOX, FOX]
ITEMS = [("a", FOX), ("b", "solo item"), ("c", None), ("d", ""), (None, FOX), ("e", "the quick brown fox jumps over the lazy dog while seven wizards quietly"), ("f", "absent words only")]


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    own, hit, items = tokens(text), set(), set()
    for name, item in ITEMS:
        words = tokens(item)
        size = min(13, len(words))
        for i in range(len(words) - size + 1) if words and name else ():
            for j in range(len(own) - size + 1):
                if own[j : j + size] == words[i : i + size]:
                    hit |= set(range(j, j + size))
                    items.add(name)
    return len(own), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(own)


def test_contamination_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(DOCS)], "doc_id long, text string, n_words int")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = {r.doc_id: r for r in phrases.contamination(docs, items).collect()}
    assert len(found) == len(DOCS)
    for i, t in enumerate(DOCS):
        assert (found[i].n_words, found[i].n_hit, list(found[i].items), found[i].contaminated) == brute(t)
    assert phrases.contamination(docs.limit(0), items).isEmpty()
    assert not [r for r in phrases.contamination(docs, items.limit(0)).collect() if r.n_hit]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha " + "x " * 30 + "beta"), (4, "alpha")], "doc_id long, text string")
    items = spark.createDataFrame([("p", "alpha beta")], "item_id string, text string")
    index = phrases.build_index(docs)
    near = phrases.search(index, items, slop=5).join(phrases.documents_of(index), ["shard", "place"])
    assert sorted(r.key for r in near.collect()) == ["1", "2"]


def test_blocks_and_pieces(spark, monkeypatch):
    """Items cut into pieces and blocks, long items, items of several rows, null and shared keys."""
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 20)
    monkeypatch.setattr(phrases, "PIECE_WORDS", 3)
    monkeypatch.setattr(phrases, "SHARD_WORDS", 30)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(DOCS)], "doc_id long, text string, n_words int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id string, text string").repartition(3)
    found = {r.doc_id: r for r in phrases.contamination(docs, items).collect()}
    for i, t in enumerate(DOCS):
        assert (found[i].n_words, found[i].n_hit, list(found[i].items), found[i].contaminated) == brute(t)
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, "x " + " ".join(f"w{i}" for i in range(2000, 2020)) + " y"), (1, "nothing"), (None, " ".join(f"w{i}" for i in range(40, 53)))]
    more = spark.createDataFrame([("long", long), ("long", "nothing"), ("other", None)], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, list(r.items)) for r in phrases.contamination(spark.createDataFrame(rows, "doc_id long, text string"), more).collect())
    assert got == [(0, 13, 13, ["long"]), (1, 1, 1, ["long"]), (1, 22, 20, ["long"])]


def test_long_document(spark):
    text = " ".join(f"t{i % 977}" for i in range(1_200_000)) + " " + FOX
    found = phrases.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id string, text string")).first()
    assert (found.n_words, found.n_hit, list(found.items), found.contaminated) == (1_200_015, 15, ["a", "e"], False)


def test_hashes_tell_words_apart():
    """Words of all lengths, with NUL and other bytes, at the begin and end of texts: equal hashes where words are equal, and only there."""
    texts = [b"", b"a", b"a\0", b"\0a", b" a  ab ", b"abcdefgh abcdefghi abcdefgh\0 " + b"x" * 64 + b" " + b"x" * 65, b"x" * 64 + b"y", "é ß 中文中文中文 é".encode(), b"ab", b"x" * 65 + b" ba", b"   "]
    own = bytes(range(256))
    hashes, sizes = hash_words(texts, own)
    words = [[w for w in t.split(b" ") if w] for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    pairs = set(zip((w for t in words for w in t), hashes.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert [len(x) for x in hash_words([], own)] == [0, 0]


def test_stable_order():
    rng = np.random.default_rng(3)
    few = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for values in (few[rng.integers(0, 300, 5000)], np.arange(5000, dtype=np.uint64)[::-1] % 7, few[:0], few[:1], few & np.uint64(2**63), few[rng.integers(0, 300, 5000)] % np.uint64(8191) + np.uint64(2**63)):
        assert (stable_order(values) == np.argsort(values, kind="stable")).all()


def test_cost_of_a_shard():
    """Reading, indexing and asking a shard of which every window has all its terms takes little more than splitting its words."""
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(100_000)]
    drawn = (100_000 * rng.random(600_000) ** 3).astype(int)
    text = " ".join(vocabulary[i] for i in drawn)
    texts = [text[at : at + 3000] for at in range(0, len(text), 3000)]
    items = [" ".join(vocabulary[i] for i in drawn[at : at + 40]) for at in range(0, 80_000, 400)]
    began = time.process_time()
    whole = [phrases.words(t) for t in texts]
    split = time.process_time() - began
    began = time.process_time()
    found = 0
    lengths, words = phrases.hash_words([x.encode() for x in items], phrases.TABLE)[::-1]
    for keys, sizes, hashes in phrases.hashed(iter([pd.DataFrame({"key": range(len(texts)), "text": texts})]), "key"):
        row = next(phrases.shard(keys, sizes, hashes, 64).itertuples(index=False))
        own = phrases.Shard(row, 64)
        for _, terms in phrases.Block([str(i) for i in range(len(items))], phrases.pack(lengths), words.tobytes(), 13).present(own):
            found += sum(len(places) for _, places in own.phrases(terms))
    took = time.process_time() - began
    assert sum(map(len, whole)) >= 600_000 and found > 4000
    assert took < 6 * split, (took, split)
