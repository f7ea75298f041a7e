import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from plumeline.llm import repeats

RNG = random.Random(5)
PASSAGE = " ".join(f"p{RNG.randrange(10**6)}" for _ in range(40))


def prose(n):
    return " ".join(f"w{RNG.randrange(10**6)}" for _ in range(n))


COPY = prose(60)
DOCS = [None, "", "  ", prose(100), prose(30) + "\n" + PASSAGE + "\t" + prose(20), PASSAGE, prose(10) + " " + PASSAGE, COPY, COPY, COPY, "short copy", "short copy", "la " * 80, prose(34), PASSAGE + " x " + PASSAGE, "é é " * 20]


def brute(docs, size=35):
    split = [re.findall(r"[^\x20\x09-\x0D]+", d or "") for d in docs]
    counts = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if counts[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(DOCS)], "doc_id long, text string, kept string").repartition(3)
    expected = brute(DOCS)
    for digest in (False, True):
        found = {r.doc_id: r for r in repeats.remove_repeats(docs, digest=digest).collect()}
        assert len(found) == len(DOCS)
        for i, (n, gone, kept) in enumerate(expected):
            assert (found[i].n_words, found[i].n_removed, found[i].kept) == (n, gone, hashlib.sha256(kept.encode()).hexdigest() if digest else kept)
    assert repeats.remove_repeats(docs.limit(0)).isEmpty()


@pytest.mark.parametrize("fan", [2, 2048])
def test_small_batches(spark, monkeypatch, fan):
    """Heavy prefixes, many batches and groups change nothing, whether leaves go directly or are dealt out again."""
    for name, bound in (("PLAN_EACH", 1), ("GROUP_LEAVES", 50), ("BATCH_CHARS", 500), ("FAN", fan), ("GATHER_LEAVES", 100)):
        monkeypatch.setattr(repeats, name, bound)
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").repartition(7)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(docs).collect()}
    assert [found[i] for i in range(len(DOCS))] == brute(DOCS)


def test_repeated_rows_null_and_shared_keys(spark, monkeypatch):
    """Rows are texts of their own, whatever their keys."""
    monkeypatch.setattr(repeats, "BATCH_CHARS", 700)
    long = [prose(50) for _ in range(4)]
    rows = [(5, long[0]), (7, long[1] + " " + PASSAGE), (9, long[2]), (5, long[0]), (8, prose(12) + " " + PASSAGE), (9, long[2]), (None, long[3]), (None, PASSAGE), (2**60 + 1, None), (7, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(df).collect()), key=str)
    assert found == sorted(((k, *x) for (k, _), x in zip(rows, brute([t for _, t in rows]), strict=True)), key=str)


def test_equal_parts_of_paths(monkeypatch):
    """Paths of which one part is equal by chance are told apart."""
    path, second = np.array([5, 5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1, 3], np.uint16)
    order, new = repeats.sorted_runs(path, second)
    assert sorted(order[~(new & np.append(new[1:], True))].tolist()) == [0, 2]
    found = pd.DataFrame({"paths": [repeats.pack_sorted(np.array([5, 7], np.uint64))], "seconds": [np.array([3, 9], np.uint16).tobytes()]})
    assert repeats.hits_of(path, second, found).tolist() == [True, False, True, False, True]


def test_long_text_and_spans(spark):
    body = [f"v{RNG.randrange(10**7)}" for _ in range(150_000)]
    texts = [" ".join(body), "x " + " ".join(body[1000:1500]) + " y " + " ".join(body[2000:2040]), " ".join(body[5000:5034])]
    found = sorted((r.doc_id, r.first, r.n_words) for r in repeats.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert found == [(0, 1000, 500), (0, 2000, 40), (1, 1, 500), (1, 502, 40)]


def test_windows_of_many_texts_together(monkeypatch):
    """No window spans two texts, however many are taken at once; words are split by six bytes only."""
    texts = [(t or "").encode() for t in DOCS] + ["a\x00b \x1c\x85\u00a0 c\x0bd\x0ce".encode() * 12]
    whole = repeats.leaves_of(texts, 35)
    monkeypatch.setattr(repeats, "TOGETHER_BYTES", 1)
    for a, b, c in zip(whole, repeats.leaves_of(texts, 35), zip(*(repeats.leaves_of([t], 35) for t in texts), strict=True), strict=True):
        assert a.tolist() == b.tolist() == np.concatenate(c).tolist()
    split = [re.findall(r"[^\x20\x09-\x0D]+", t.decode()) for t in texts]
    assert whole[3].tolist() == [len(w) for w in split]
    runs = [tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34)]
    assert len(set(runs)) == len(set(whole[0].tolist())) == len(set(zip(runs, whole[0].tolist(), strict=True)))
    assert [len(x) for x in repeats.leaves_of([], 35)] == [0] * 4


def test_cost_of_leaves():
    """A text's windows take little more than splitting its words."""
    texts = [prose(500).encode() for _ in range(1000)]
    began = time.process_time()
    for t in texts:
        re.findall(r"[^\x20\x09-\x0D]+", t.decode())
    split = time.process_time() - began
    began = time.process_time()
    path, *_ = repeats.leaves_of(texts, 35)
    took = time.process_time() - began
    assert len(path) == 466_000 and took < 4 * split, (took, split)
