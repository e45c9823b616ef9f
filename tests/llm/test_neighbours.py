"""Nearest neighbours: recall, exact scores, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import vigil.llm.spann as S
from vigil.llm.spann import CentroidGraph, balanced_clusters, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, asks, k=10):
    ids = sorted({i for i, v in rows})
    vec = {}
    for i, v in rows:
        vec.setdefault(i, np.array(v, np.float32).astype(float))
    out = {}
    for q in ids:
        if asks(q):
            d = sorted((float(np.sqrt(((vec[q] - vec[i]) ** 2).sum())), i) for i in ids if i != q)
            out[q] = d[:k]
    return out


def results(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return {q: sorted(v) for q, v in out.items()}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres[rng.integers(0, 40, 2500)] + rng.normal(size=(2500, 16)) * 0.2, rng.normal(size=(500, 16))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = results(nearest_neighbours(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 50 == 0))
    want = brute(rows, lambda q: q % 50 == 0)
    assert got.keys() == want.keys()
    hits = [len({i for _, _, i in got[q]} & {i for _, i in want[q]}) for q in want]
    assert np.mean(hits) >= 9.5
    vec = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, i) for _, s, i in found] == sorted((s, i) for _, s, i in found)
        assert all(s == pytest.approx(np.sqrt(((vec[q] - vec[i]) ** 2).sum()), abs=1e-12) for _, s, i in found)


def test_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_ROWS", 7)  # lists in several parts
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 400)] + [(i, [float(c) for c in rng.integers(-2, 3, 3) + 0.5]) for i in range(400, 700)]
    got = results(nearest_neighbours(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 100 == 0, search_ratio=50.0))
    want = brute(rows, lambda q: q % 100 == 0)
    assert {q: [(s, i) for _, s, i in v] for q, v in got.items()} == {q: [(pytest.approx(s), i) for s, i in v] for q, v in want.items()}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]
    bad = [(100, None), (200, [0.0, 0.0]), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, [None, 1.0]), (600, []), (700, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id long, embedding array<float>, list int, cls string")
    assert {q: [(s, i) for _, s, i in v] for q, v in results(nearest_neighbours(df, F.col("vec_id") % 100 == 0)).items()} == {
        0: [(pytest.approx(1.0), 2), (pytest.approx(2**0.5), 1)]}
    for none in (df.where("vec_id < 0"), df.where("vec_id = 0")):
        assert nearest_neighbours(none, F.col("vec_id") % 100 == 0).collect() == []


def test_graph_reaches_all_within_ratio():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8))
    c = balanced_clusters(x, 100)
    assert 60 <= len(c) <= 160
    found, q = CentroidGraph(c).search(x[:300], 1.3, 4), x[:300]
    d = np.sqrt(((q[:, None] - c[None]) ** 2).sum(-1))
    want = [set(np.flatnonzero(r <= 1.3 * r.min())) for r in d]
    assert np.mean([len(w & set(ids.tolist())) / len(w) for w, (ids, _) in zip(want, found)]) > 0.97


@pytest.mark.parametrize("groups", [2, 16, 64])
def test_groups_are_bounded(spark, monkeypatch, groups):
    rng, n = np.random.default_rng(4), 3000
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(n, 3)))]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    per_group = -(-n // groups)
    monkeypatch.setattr(S, "GROUP_ROWS", per_group)
    monkeypatch.setattr(S, "PART_ROWS", max(1, per_group // 4))
    seen, group_by = [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: (seen.append(self) if isinstance(c[0], str) and c[0] == "grp" and "cell" in self.columns else None, group_by(self, *c))[1])
    # one replica: as many postings as vectors, so a power of two of groups
    out = nearest_neighbours(df, F.col("vec_id") % 100 == 0, replicas=1, search_ratio=50.0)
    got = {q: [(s, i) for _, s, i in v] for q, v in results(out).items()}
    assert got == {q: [(pytest.approx(s), i) for s, i in v] for q, v in brute(rows, lambda q: q % 100 == 0).items()}
    sizes = [r["count"] for r in group_by(seen[0], "grp").count().collect()]
    assert sum(sizes) == n and len(sizes) == groups and max(sizes) <= 2 * per_group


def test_cells_fill_groups_evenly():
    rng = np.random.default_rng(6)
    for groups in (2, 100, 1000, 1024):
        size = rng.lognormal(0, 1, 4096)
        size = (size / size.sum() * groups * S.GROUP_ROWS).astype(np.int64)
        parts, first, n = S.number_cells(size)
        cells = np.repeat(first - (np.cumsum(parts) - parts), parts) + np.arange(parts.sum())
        assert sorted(cells.tolist()) == list(range(parts.sum())) and n == groups
        assert np.bincount(cells % n, np.repeat(size / parts, parts)).max() <= S.GROUP_ROWS + S.PART_ROWS
