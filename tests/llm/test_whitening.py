"""Whitening: exact polynomial, roots and null spaces, whole result against numpy, edges."""

import math
from fractions import Fraction

import numpy as np
import pytest

import vigil.llm.whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def integer_scatter(rng, d, n, rank=None):
    y = rng.integers(-40, 40, (n, rank or d))
    if rank:
        y = y @ rng.integers(-3, 4, (rank, d))
    return (n * y.T @ y - np.outer(y.sum(0), y.sum(0))).astype(object).tolist()


def charpoly(a):
    """Faddeev-LeVerrier in rationals."""
    d = len(a)
    a = [[Fraction(int(v)) for v in r] for r in a]
    c, m = [Fraction(0)] * d + [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -sum(sum(a[i][t] * m[t][i] for t in range(d)) for i in range(d)) / k
    return [int(v) for v in c]


@pytest.mark.parametrize("d, n, rank", [(1, 5, None), (2, 9, None), (7, 30, None), (7, 4, None), (6, 40, 3)])
def test_characteristic_polynomial(spark, d, n, rank):
    a = integer_scatter(np.random.default_rng(d + n), d, n, rank)
    assert W.characteristic_polynomial(spark, a) == charpoly(a)


def test_hessenberg_needs_exchanges():
    a = np.array([[0, 0, 1, 0], [0, 0, 0, 2], [1, 0, 0, 0], [0, 2, 0, 5]], object)
    for p in (101, 2147483647):
        assert W.charpoly_mod(a, p) == [c % p for c in charpoly(a.tolist())]


def test_roots_and_null_spaces():
    # 9 is a double root, 4 and 0 are simple
    q = np.array([[2, -2, 1, 0], [1, 2, 2, 0], [2, 1, -2, 0], [0, 0, 0, 3]])
    a = (q.T @ np.diag([9, 4, 9, 0]) @ q).tolist()  # 9 * q' D q / 9: roots times 9
    c, trace = charpoly(a), sum(a[i][i] for i in range(4))
    assert [W.roots_above(c, x) for x in (-1, 0, 35, 36, 80, 81)] == [4, 3, 3, 2, 2, 0]
    for k, value, first, times in ((1, 81, 1, 2), (2, 81, 1, 2), (3, 36, 3, 1)):
        root, bits, f, t = W.isolate_root(c, k, trace)
        assert (f, t) == (first, times) and abs(Fraction(root, 1 << bits) - value) <= Fraction(1, 1 << (bits - 2))
        u = np.array(W.null_space(a, root, bits, t, trace))
        assert np.allclose(u @ u.T, np.eye(times), atol=1e-15) and np.allclose(u @ np.array(a), value * u, atol=1e-12)


def test_primes():
    want = [n for n in range(999, 400, -1) if all(n % k for k in range(2, 32))]
    assert W.primes_below(1000, len(want)) == want


def test_close_roots_are_told_apart():
    a = [[10**12, 1, 0], [1, 10**12 + 1, 0], [0, 0, 5]]
    c, trace = charpoly(a), 2 * 10**12 + 6
    e, v = np.linalg.eigh(np.array(a[:2], float)[:, :2] - 10**12 * np.eye(2))
    for k in (1, 2):
        root, bits, f, t = W.isolate_root(c, k, trace)
        assert (f, t) == (k, 1)
        assert abs(float(Fraction(root, 1 << bits) - 10**12) - e[2 - k]) < 1e-12
        u = W.null_space(a, root, bits, t, trace)[0]
        assert abs(abs(np.dot(u[:2], v[:, 2 - k])) - 1) < 1e-14 and abs(u[2]) < 1e-15


def plain(rows, components=8):
    keep = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in keep], np.float32).astype(float)) + 100000
    n, s = len(x), x.sum(0)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    z = x - s / n
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1], v[:, ::-1]
    return [(i, n, d) for (i, _), d in zip(keep, dev)], z @ v[:, :components] / np.sqrt(e[:components]), e[:components] / e.sum()


def made(n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * np.linspace(1, 0.05, d)
    return [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(n), x)]


@pytest.mark.parametrize("n, d", [(400, 12), (30, 3), (9, 1)])
def test_whole_result(spark, n, d):
    rows = made(n, d) + [(1000, None), (1001, [float("nan")] * d), (1002, [None] + [1.0] * (d - 1)), (1003, [float("inf")] * d), (None, [0.0] * d), (7, [0.5] * d)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    got = W.whiten(df).collect()
    want, white, share = plain(rows)
    key = lambda t: (str(t[0]), t[2])
    got, order = sorted(got, key=lambda r: (str(r.vec_id), int(r.deviation))), sorted(range(len(want)), key=lambda k: key(want[k]))
    assert [(r.vec_id, r.n, int(r.deviation)) for r in got] == [want[k] for k in order]
    mine, white = np.array([r.whitened for r in got]), white[order]
    assert mine.shape == white.shape
    assert np.allclose(mine * np.sign((mine * white).sum(0)), white, rtol=1e-8, atol=1e-8)
    assert np.allclose(got[0].explained, share, rtol=1e-10)
    assert all(r.identity_error == got[0].identity_error <= 1e-9 for r in got)


def test_scatter_is_exact_for_large_numbers():
    rng = np.random.default_rng(4)
    for top in (2**10, 2**30, 2**45, 2**62):
        y = np.array([[int(v) for v in rng.integers(-top, top, 5)] for _ in range(40)], object)
        total, products = W.scatter_sums(y if top > 2**52 else y.astype(float))
        assert total == [sum(c) for c in zip(*y.tolist())]
        assert products == [[sum(r[i] * r[j] for r in y.tolist()) for j in range(5)] for i in range(5)]


def test_large_values(spark):
    rows = [(0, [1e15, 1.0]), (1, [-3e14, 2.0]), (2, [1e300, 0.25]), (3, [4.0, -1e14])]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in W.whiten(df).collect()}
    x = [[min(math.floor(Fraction(c) * 1024) + 100000, 2**63 - 1) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    for (i, _), r in zip(rows, x):
        d = sum((4 * a - b) ** 2 for a, b in zip(r, s))
        assert (None if got[i].deviation is None else int(got[i].deviation)) == (d if d < 10**38 else None)
    assert got[0].identity_error < 1e-9


def test_edges(spark):
    clash = "vec_id long, embedding array<double>, n int, w string"
    same = spark.createDataFrame([(1, [1.0, 2.0], 3, "x"), (2, [1.0, 2.0], 3, "x")], clash)
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in W.whiten(same).orderBy("vec_id").collect()] == [
        (1, 2, 0, [], [], 0.0), (2, 2, 0, [], [], 0.0)]
    flat = spark.createDataFrame([(i, [float(i), 1.0], 0, "") for i in range(5)] + [(9, [1.0], 0, ""), (8, [], 0, "")], clash)
    got = W.whiten(flat).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4] and all(len(r.whitened) == 1 and r.explained == [1.0] for r in got)
    assert W.whiten(same.where("vec_id > 5")).collect() == []
