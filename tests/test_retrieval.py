"""The retrieval index: every vector in a list, exact without probes, recall with the calibrated number of probes."""

import numpy as np
import pytest

from plumeline.operators import evaluate, retrieval

CHUNKS = "chunk long, embedding array<float>, corpus string"
QUERIES = "query long, embedding array<float>"


def table(n=1200, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    x = centres[rng.integers(0, 25, n)] + 0.5 * rng.normal(size=(n, dim))
    rows = [(i, v.tolist(), "abcd"[i % 4]) for i, v in enumerate(x)]
    rows += [(n, None, "a"), (n + 1, [], "a"), (n + 2, [0.0] * dim, "a"), (n + 3, [1.0] * (dim - 1), "b"), (n + 4, [float("nan")] * dim, "b"), (n + 5, rows[0][1], "c"), (n + 6, [None] * dim, "c")]
    return rows


@pytest.fixture(scope="module")
def index(spark):
    return retrieval.build(spark.createDataFrame(table(), CHUNKS))


def queries(spark, n=120):
    rows = table()
    return spark.createDataFrame([(i, v) for i, v, _ in rows[:1200:10][:n]] + [(90_000, None), (90_001, [0.0] * 16)], QUERIES)


def brute(rows, asked, k):
    good = [(i, np.array(v, float)) for i, v, _ in rows if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    x = np.array(x, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q, v in asked:
        v = np.array(v, np.float32).astype(float)
        near = np.round(x @ (v / np.linalg.norm(v)), 9)
        out[q] = [int(ids[j]) for j in np.lexsort((ids, -near))[:k]]
    return out


def as_lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query, r.place)):
        out.setdefault(r.query, []).append(r.chunk)
    return out


def test_every_vector_is_in_one_list(spark, index):
    lists = {r.chunk: r.list for r in index.lists.collect()}
    assert set(lists) == {i for i, v, _ in table() if i not in (1200, 1201, 1202, 1203, 1204, 1206)}
    assert len(set(lists.values())) > 10 and lists[0] == lists[1205]
    assert set(index.lists.columns) == {"chunk", "embedding", "corpus", "list"}


def test_exact_and_full_probes_equal_brute_force(spark, index):
    rows = table()
    want = brute(rows, [(i, v) for i, v, _ in rows[:1200:10]], 5)
    assert as_lists(retrieval.search(queries(spark), index, 5)) == want
    assert as_lists(retrieval.search(queries(spark), index, 5, probes=len(index.centroids))) == want


def test_recall_of_calibrated_probes(spark, index):
    want = as_lists(retrieval.search(queries(spark), index, 5))
    probes = retrieval.calibrate(queries(spark), index, 5, 0.9)
    assert 1 <= probes < len(index.centroids) / 2
    found = as_lists(retrieval.search(queries(spark), index, 5, probes))
    assert sum(len(set(found.get(q, ())) & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_split_lists_give_the_same(spark, index, monkeypatch):
    whole = as_lists(retrieval.search(queries(spark, 30), index, 5, 4))
    monkeypatch.setattr(retrieval, "CHUNKS", 9)
    monkeypatch.setattr(retrieval, "QUERIES", 4)
    assert as_lists(retrieval.search(queries(spark, 30), index, 5, 4)) == whole


def test_corpora(spark, index):
    found = retrieval.search(queries(spark, 20), index, 3, len(index.centroids), where="corpus = 'b'")
    want = brute([r for r in table() if r[2] == "b"], [(i, v) for i, v, _ in table()[::10][:20]], 3)
    assert as_lists(found) == want


def test_empty(spark, index):
    none = spark.createDataFrame([], CHUNKS)
    assert retrieval.build(none) is None
    assert retrieval.build(spark.createDataFrame([(1, [0.0], "a"), (2, None, "b")], CHUNKS)) is None
    assert retrieval.search(spark.createDataFrame([], QUERIES), index, 3, 2).isEmpty()


def test_deals_follow_the_number_of_chunks(spark, monkeypatch):
    rows = table()
    monkeypatch.setattr(evaluate, "CHUNK_BLOCK", 16)
    found = evaluate.top_chunks(queries(spark, 20), spark.createDataFrame(rows, CHUNKS).repartition(7), 5)
    want = brute(rows, [(i, v) for i, v, _ in rows[::10][:20]], 5)
    assert {q: w for q, w in as_lists(found).items()} == want


def test_cosines_are_held_in_parts():
    """A batch of 10,000 vectors against 2,000 centroids would be 160 MB at once, and as much for each copy."""
    import tracemalloc


    rng = np.random.default_rng(5)
    x, centroids = rng.normal(size=(10_000, 16)), rng.normal(size=(2_000, 16))
    tracemalloc.start()
    near = retrieval.nearest_lists(x, centroids, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert near.shape == (10_000, 3) and peak < 120_000_000
    some = rng.choice(10_000, 50, replace=False)
    assert (near[some] == np.argsort(-np.round(x[some] @ centroids.T, 12), axis=1, kind="stable")[:, :3]).all()
