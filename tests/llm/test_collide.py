import numpy as np

from plumeline.llm import collide


def vectors():
    rng = np.random.default_rng(8)
    rows = [(None, 1), ([0.0] * 8, 1), ([1.0, None] + [0.0] * 6, 1), ([float("nan")] * 8, 1), ([float("inf")] + [1.0] * 7, 1)]
    for label in (1, 2, None):
        centre = rng.standard_normal((4, 16))
        for c in centre:
            rows += [((c + 0.17 * rng.standard_normal(16)).tolist(), label) for _ in range(30)]
        rows += [(centre[0].tolist(), label)] * 5 + [((centre[0] * 3).tolist(), label)]
    return rows + [([1e200] * 8, 1), ([1e200] * 8, 1), ([1.0] * 9, 1)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collide, "BLOCK", 16)
    rows = vectors()
    given = spark.createDataFrame([(i, v, label, 0) for i, (v, label) in enumerate(rows)], "vec_id long, embedding array<double>, label int, n_links int").repartition(3)
    good = [i for i, (v, label) in enumerate(rows) if label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {i: np.array(rows[i][0]) / np.abs(rows[i][0]).max() for i in good}
    linked = {i: {j for j in good if j != i and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] / np.sqrt((unit[i] @ unit[i]) * (unit[j] @ unit[j])) >= 0.93} for i in good}
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in good:
            least = min([label[i], *(label[j] for j in linked[i])])
            changed |= least != label[i]
            label[i] = least
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in collide.near_vectors(given).collect()}
    assert sum(map(len, linked.values())) > 500
    assert found == {i: (len(linked.get(i, ())), label[i], label[i] == i) for i in range(len(rows))}
    assert collide.near_vectors(given.limit(0)).isEmpty()


def test_forest_spans():
    rng = np.random.default_rng(1)
    for _ in range(20):
        m = rng.random((15, 12)) < 0.08
        up = list(range(27))

        def top(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for i, j in collide.forest(m):
            assert m[i, j]
            assert top(i) != top(15 + j)
            up[top(i)] = top(15 + j)
        assert all(top(i) == top(15 + j) for i, j in zip(*np.nonzero(m), strict=True))


def test_sorted_counts_equal_all_counts():
    """Merging windows into sorted lines and stopping early loses no pair that reaches the count, and leaves few to verify."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 64))
    x = np.concatenate([centres[rng.integers(40, size=500)] + 0.12 * rng.standard_normal((500, 64)), rng.standard_normal((500, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = (x @ collide.lines_of(64, collide.LINES)).astype(np.float32)
    half, wanted = np.float32(collide.WINDOW * collide.width(64, 0.93)), collide.needed_collisions()
    p, q = y[::2], y[1::2]
    want = (np.abs(p[:, None, :] - q[None, :, :]) <= half).sum(axis=2)
    ordered, verified = np.sort(q, axis=0), 0
    order = np.argsort(p[:, collide.widest(p)])
    for at in range(0, len(p), 32):
        part = order[at : at + 32]
        hits, left = collide.collisions(p[part], q, ordered, half, wanted)
        found = np.zeros((len(part), len(q)), bool)
        found[:, left] = hits >= wanted
        assert (found == (want[part] >= wanted)).all()
        assert (hits[hits >= wanted] == want[part][:, left][hits >= wanted]).all()
        verified += hits.size
    near = x[::2] @ x[1::2].T >= 0.93
    assert near.sum() > 1000
    assert (want >= wanted)[near].mean() >= 0.999
    assert verified <= 0.25 * len(p) * len(q)


def test_share_on_the_test_table(spark):
    """On real vectors nearly all pairs of two blocks fall out before a cosine is computed, and no link is lost."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("label IS NOT NULL AND size(embedding) = 64").orderBy("vec_id").limit(2000).collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = (x @ collide.lines_of(64, collide.LINES)).astype(np.float32)
    half, wanted = np.float32(collide.WINDOW * collide.width(64, 0.93)), collide.needed_collisions()
    order, ordered, verified, lost = np.argsort(y[:, collide.widest(y)]), np.sort(y, axis=0), 0, 0
    for at in range(0, len(y), collide.RUN):
        part = order[at : at + collide.RUN]
        hits, left = collide.collisions(y[part], y, ordered, half, wanted)
        verified += hits.size
        found = np.zeros((len(part), len(y)), bool)
        found[:, left] = hits >= wanted
        lost += ((x[part] @ x.T >= 0.93) & ~found).sum()
    assert lost == 0
    assert verified <= 0.1 * len(y) ** 2


def test_null_and_shared_keys(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (None, v, 1), (2, v, 1), (2, [-1.0, 5.0, 0.0], 1), (3, v, None)]
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in collide.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    assert found == sorted([(1, 1, 1, True), (2, 1, 1, False), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, True)], key=str)
