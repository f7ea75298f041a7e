"""Line dedup against a brute force, before and after insertions and deletions."""

import hashlib
import random

import numpy as np
import pytest

from plumeline.llm import lines

LONG = "x" * 20
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TYPES = "doc_id long, text string"


def brute(docs, least=3, chars=20):
    key = lambda line: line.strip(lines.WHITE).translate(LOWER)
    holders = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= chars:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in docs:
        own = (text or "").split("\n")
        gone = [doc_id is not None and len(holders.get(key(x), ())) >= least and doc_id != max(holders[key(x)]) for x in own]
        out.append((doc_id, len(own), sum(gone), "\n".join(x for x, g in zip(own, gone) if not g)))
    return sorted(out, key=repr)


def found(index, spark, docs):
    return sorted((tuple(r) for r in index.apply(spark.createDataFrame(docs, TYPES)).collect()), key=repr)


def some_docs(n, seed):
    rng = random.Random(seed)
    pool = [f"{'Common' if i % 2 else 'common'} line number {i} of the site {'é' * (i % 3)}" for i in range(30)] + ["short", "", "  ", "\t"]
    return [(i, "\n".join(rng.choice(["", " ", "\t", "\x0b"]) + (rng.choice(pool).upper() if rng.random() < 0.2 else rng.choice(pool)) for _ in range(rng.randrange(12)))) for i in range(n)]


def test_whole_table(spark, tmp_path):
    docs = [*some_docs(120, 1), (500, None), (501, ""), (None, f"{LONG}\n{LONG}"), (None, None), (502, f"{LONG}\n a \n{LONG.upper()}\r"), (503, f"  {LONG}"), (504, LONG), (505, "\n" * 3), (506, f"{'y' * 19}\n{'é' * 20}"), (507, "É" * 20)]
    index = lines.LineIndex(spark, f"file://{tmp_path}/i", shards=4)
    index.insert(spark.createDataFrame(docs, TYPES))
    assert found(index, spark, docs) == brute(docs)
    assert any(r[2] for r in brute(docs))


def test_insertions_and_deletions_are_reversible(spark, tmp_path):
    index = lines.LineIndex(spark, f"file://{tmp_path}/i", shards=3)
    docs = some_docs(60, 2)
    states = []
    for batch in (docs[:25], docs[25:40], docs[40:]):
        index.insert(spark.createDataFrame(batch, TYPES))
        held = docs[: len(states) * 15 + 25] if len(states) < 2 else docs
        states.append(held)
        assert found(index, spark, held) == brute(held)
    index.insert(spark.createDataFrame(docs[10:30], TYPES))  # again: nothing changes
    assert found(index, spark, docs) == brute(docs)
    gone = {d for d, _ in docs[30:]} | {3, 7}
    index.delete(spark.createDataFrame([(d,) for d in sorted(gone)] + [(999,), (None,)], "doc_id long"))
    left = [d for d in docs if d[0] not in gone]
    assert found(index, spark, left) == brute(left)
    index.insert(spark.createDataFrame([d for d in docs if d[0] in gone], TYPES))
    assert found(index, spark, docs) == brute(docs)


def test_sharded_probe_equals_broadcast(spark, tmp_path, monkeypatch):
    docs = some_docs(80, 3)
    index = lines.LineIndex(spark, f"file://{tmp_path}/i", shards=5)
    index.insert(spark.createDataFrame(docs, TYPES))
    monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(lines, "TOGETHER", 7)
    assert found(index, spark, docs) == brute(docs)


def test_full_filters_are_built_anew(spark, tmp_path):
    text = lambda n: "\n".join(f"a line of the number {i:06d}" for i in range(n))
    first = [(i, text(5)) for i in range(3)]
    more = [(i, text(400)) for i in range(10, 13)]
    index = lines.LineIndex(spark, f"file://{tmp_path}/i", shards=1)
    index.insert(spark.createDataFrame(first, TYPES))
    index.insert(spark.createDataFrame(more, TYPES))
    assert found(index, spark, first + more) == brute(first + more)


def test_a_change_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    docs = some_docs(30, 4)
    index = lines.LineIndex(spark, f"file://{tmp_path}/i", shards=2)
    index.insert(spark.createDataFrame(docs[:20], TYPES))
    monkeypatch.setattr(lines.LineIndex, "update", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.insert(spark.createDataFrame(docs[20:], TYPES))
    monkeypatch.undo()
    assert index.version() == 1
    assert found(index, spark, docs[:20]) == brute(docs[:20])
    index.insert(spark.createDataFrame(docs[20:], TYPES))
    assert found(index, spark, docs) == brute(docs)


def test_rows_that_share_an_id_and_other_columns(spark, tmp_path):
    docs = [(1, f"{LONG}\n{LONG}"), (1, f"{LONG}\nz"), (2, LONG), (3, "b" * 25)]
    index = lines.LineIndex(spark, f"file://{tmp_path}/i", shards=2)
    df = spark.createDataFrame([(*d, b"k", 1, "s") for d in docs], f"{TYPES}, key binary, n int, shard string")
    index.insert(df)
    assert sorted(tuple(r) for r in index.apply(df).collect()) == brute(docs)
    assert brute(docs)[0][2] == 0  # two documents only
    index.insert(df.limit(0))
    assert index.apply(df.limit(0)).isEmpty()


def test_empty_index_and_very_long_texts(spark, tmp_path):
    index = lines.LineIndex(spark, f"file://{tmp_path}/i")
    assert found(index, spark, [(1, "a\nb")]) == [(1, 2, 0, "a\nb")]
    index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    long = [(i, "\n".join([f"line {n} " + "w" * 40 for n in range(60_000)] + ["q" * 3_000_000])) for i in range(3)]
    index.insert(spark.createDataFrame(long, TYPES))
    assert [r[:3] for r in found(index, spark, long)] == [(0, 60001, 60001), (1, 60001, 60001), (2, 60001, 0)]


def test_cuckoo_filter_has_no_false_negatives_and_takes_deletions():
    keys = lines.keys_array([hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(20_000)])
    table = lines.built(keys[:10_000])
    assert lines.has(table, keys[:10_000]).all()
    assert lines.has(table, keys[10_000:]).mean() < 0.001
    table = lines.updated(table, keys[10_000:12_000], keys[:5_000])
    assert lines.has(table, keys[5_000:12_000]).all()
    assert lines.has(table, keys[:5_000]).mean() < 0.001
    assert lines.updated(np.zeros(8, np.uint16), keys[:100], keys[:0]) is None
    with pytest.raises(ValueError):
        lines.updated(table, keys[:0], keys[19_000:])


def test_a_put_that_fails_changes_nothing():
    keys = lines.keys_array([hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(50)])
    place, mark = (x.tolist() for x in lines.hashed(keys))
    table = np.zeros(16, np.uint16)
    view = memoryview(table)
    for p, m in zip(place, mark):
        before = table.copy()
        if not lines.put(view, p, m):
            assert (table == before).all()
            return
    raise AssertionError("50 fingerprints in 16 slots")
