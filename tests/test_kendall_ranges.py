"""Kendall by ranges, strips and cells against enumeration of all pairs."""

import math

import numpy as np
import pytest

from vigil.operators import kendall


def brute(x, y):
    """(concordant, discordant, tau) over complete rows by all pairs."""
    keep = ~(np.isnan(x) | np.isnan(y))
    x, y = x[keep], y[keep]
    sign = lambda v: (v[:, None] > v).astype(int) - (v[:, None] < v).astype(int)
    both = sign(x) * sign(y)
    conc, disc = int((both > 0).sum()) // 2, int((both < 0).sum()) // 2
    denom = math.sqrt(int((sign(x) != 0).sum()) // 2 * (int((sign(y) != 0).sum()) // 2))
    return len(x), conc, disc, (conc - disc) / denom if denom else None


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 100])
def test_weighted_inversions(n):
    rng = np.random.default_rng(n)
    places, weight = rng.permutation(n), rng.integers(1, 2**40, n)
    want = sum(int(weight[i]) * int(weight[j]) for i in range(n) for j in range(i + 1, n) if places[i] > places[j])
    assert kendall.inversions(places, weight) == want


CASES = {
    "spread": lambda r: (r.normal(size=400), r.normal(size=400)),
    "one x holds half": lambda r: (np.where(r.random(400) < 0.5, 3.0, r.integers(0, 20, 400)), r.normal(size=400)),
    "one y holds half": lambda r: (r.normal(size=400), np.where(r.random(400) < 0.5, 0.0, r.integers(-5, 5, 400))),
    "many ties": lambda r: (r.integers(0, 6, 400).astype(float), r.integers(0, 6, 400).astype(float)),
    "falling": lambda r: (np.arange(200.0), -np.arange(200.0)),
    "infinite, missing, both zeros": lambda r: (r.choice([np.inf, -np.inf, np.nan, 0.0, -0.0, 1.5], 200), r.choice([np.nan, -np.inf, 0.0, -0.0, 2.0], 200)),
    "constant": lambda r: (np.ones(50), r.normal(size=50)),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("range_rows", [40, 10**6])
def test_equals_all_pairs(spark, name, range_rows):
    x, y = CASES[name](np.random.default_rng(5))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "`x.1` double, y double")
    got = kendall.kendall_tau(df, "x.1", "y", range_rows=range_rows).first()
    n, conc, disc, tau = brute(x, y)
    assert (got["n"], int(got["n_concordant"]), int(got["n_discordant"])) == (n, conc, disc)
    assert got["tau"] == (pytest.approx(tau) if tau is not None else None)


def test_no_complete_rows(spark):
    got = kendall.kendall_tau(spark.createDataFrame([(None, 1.0), (2.0, None)], "x double, y double"), "x", "y").first()
    assert (got["n"], got["tau"]) == (0, None)
