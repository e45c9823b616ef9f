"""Near-duplicate vectors: links and components against brute force, crowded components, edges."""

import numpy as np
import pytest

import vigil.llm.projection_dedup as P

SCHEMA = "vec_id long, embedding array<float>, label int"
COLS = ["vec_id", "n_links", "component_id", "kept"]


def brute(rows, threshold=0.9):
    """rows: (id, vector or None); the last columns are those of the operator."""
    use = []
    for k, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            use.append(k)
    lengths = [len(rows[k][1]) for k in use]
    width = max(set(lengths), key=lambda w: (lengths.count(w), w), default=0)
    use = [k for k in use if len(rows[k][1]) == width]
    x = np.array([rows[k][1] for k in use], np.float32).astype(float).reshape(len(use), -1)
    norm = np.sqrt((x * x).sum(1))
    linked = (x @ x.T) / np.outer(norm, norm) >= threshold
    equal = (x[:, None] == x[None]).all(-1) if len(x) < 2000 else np.eye(len(x), dtype=bool)
    linked = (linked | equal) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(linked, label[None], len(x)).min(1, initial=len(x)))
        if (new == label).all():
            break
        label = new
    out = []
    at = {k: i for i, k in enumerate(use)}
    for k, (i, _) in enumerate(rows):
        if k in at:
            ids = [rows[use[j]][0] for j in np.flatnonzero(label == label[at[k]])]
            least = min((j for j in ids if j is not None), default=None)
            out.append((i, int(linked[at[k]].sum()), least, i is not None and i == least))
        else:
            out.append((i, 0, i, i is not None))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    got = P.near_duplicate_vectors(df, **options)
    assert got.columns == COLS
    return sorted((tuple(r) for r in got.collect()), key=str)


def clustered(seed, n, d, spread=0.15, copies=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, d))
    x = np.concatenate([centres[rng.integers(0, len(centres), n // 2)] + rng.normal(size=(n // 2, d)) * spread, rng.normal(size=(n - n // 2, d))])
    x[-copies:] = x[0]
    return [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(n), x)]


@pytest.mark.parametrize("ranges, batch", [(50_000, 10_000), (300, 64)])
def test_links_and_components(spark, monkeypatch, ranges, batch):
    monkeypatch.setattr(P, "RANGE_ROWS", ranges)  # windows across ranges and batches
    monkeypatch.setattr(P, "PASSES_AT_ONCE", 3)
    rows = clustered(0, 1200, 24)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = run(spark, rows, window=24)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_crowded_components_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    tight = [centre + rng.normal(size=16) * 0.05 for _ in range(300)]  # all pairs linked
    wide = [centre + 6 * np.eye(16)[0] + rng.normal(size=16) * 0.9 for _ in range(300)]  # some pairs linked
    rows = [(i, [float(c) for c in v]) for i, v in enumerate([*tight, *wide, *rng.normal(size=(100, 16))])]
    rows += [(1000 + i, rows[400][1]) for i in range(20)]
    want = brute(rows)
    assert max(n for _, n, _, _ in want) > 250
    assert run(spark, rows, window=32, recall=0.9999) == want


def test_no_false_link_and_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 1000, 2):  # pairs just above and just below the threshold
        other = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        other /= np.linalg.norm(other)
        c = 0.905 if i % 4 else 0.895
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * other
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows)
    linked = sum(n for _, n, _, _ in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert linked == 500 and sum(g[1] for g in got) >= 0.97 * linked


def test_passes_grow_with_the_table():
    assert P.passes_for(100, 0.9, 128, 0.99) == 1
    few, many = P.passes_for(10**5, 0.9, 128, 0.99), P.passes_for(10**8, 0.9, 128, 0.99)
    assert 5 < few < many < 200


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (5, [2.0, 0.0]), (7, [1.0, 0.0]), (None, [3.0, 0.1]), (8, [0.0, 1.0]), (9, None), (10, [0.0, 0.0]), (11, [nan, 1.0]), (12, [inf, 1.0]),
            (13, [None, 1.0]), (14, []), (15, [1.0, 0.0, 0.0]), (None, [-1.0, 0.0]), (16, [1e38, 1e36]), (17, [1e-38, 0.0]), (None, None)]
    want = brute([(i, v) for i, v in rows if i != 17]) + [(17, 5, 5, False)]
    # 17 joins the copies of one direction; each of them gains a link
    want = sorted([(i, n + 1, c, k) if i != 17 and c == 5 else (i, n, c, k) for i, n, c, k in want], key=str)
    assert run(spark, rows) == want
    clash = spark.createDataFrame([(1, [1.0, 2.0], 3, 4), (2, [1.0, 2.0], 3, 4)], "vec_id long, embedding array<double>, root int, cls int")
    assert sorted(tuple(r) for r in P.near_duplicate_vectors(clash).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert P.near_duplicate_vectors(clash.where("vec_id > 5")).collect() == []


def test_stars_are_components():
    rng = np.random.default_rng(2)
    for n, m in ((50, 30), (50, 200), (400, 399), (5, 0)):
        u, v = (np.arange(m), np.arange(m) + 1) if m == 399 else (rng.integers(0, n, m) * 3, rng.integers(0, n, m) * 3)
        label = {i: i for i in {*u.tolist(), *v.tolist()}}
        for a, b in zip(u.tolist(), v.tolist()):
            low, high = sorted((label[a], label[b]))
            label = {i: low if c == high else c for i, c in label.items()}
        node, root = P.stars(u, v)
        assert dict(zip(node.tolist(), root.tolist())) == {i: c for i, c in label.items() if i != c}
