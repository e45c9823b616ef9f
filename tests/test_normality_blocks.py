"""Shapiro-Wilk in disjoint blocks: every value in one block, each block tested as a sample of its own."""

import numpy as np
import pytest

from vigil.operators import normality


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 13_000
    normal, skewed = rng.normal(5, 2, n), rng.lognormal(size=n)
    few = [float(v) if i < 300 else None for i, v in enumerate(rng.normal(size=n))]
    skewed[:4500] = 1.0  # a hot value
    odd = [float("inf"), float("nan"), None]
    rows = [(float(a), float(b), c, odd[i % 3]) for i, (a, b, c) in enumerate(zip(normal, skewed, few))]
    return spark.createDataFrame(rows, "normal double, `skew.ed` double, few double, none double").cache()


def test_blocks_hold_every_value_once(table):
    dealt = normality._dealt(table, None, 4000).toPandas()
    for c in table.columns:
        want = sorted(v for v in (r[0] for r in table.select(f"`{c}`").collect()) if v is not None and np.isfinite(v))
        assert sorted(dealt.x[dealt.column_name == c]) == want
    sizes = dealt.groupby(["column_name", "block"]).size()
    assert sizes.max() <= normality.MAX_N_FOR_P
    assert sizes.groupby("column_name").size().to_dict() == {"normal": 4, "skew.ed": 4, "few": 1}


def test_block_statistics_are_those_of_its_values(table):
    parts = ["column_name", "block"]
    got = normality.shapiro_blocks(table.repartition(5)).toPandas().sort_values(parts).reset_index(drop=True)
    dealt = normality._dealt(table, None, 4000)
    want = normality.shapiro(dealt.withColumnRenamed("column_name", "c"), ["x"], by=["c", "block"]).toPandas()
    want = want.sort_values(["c", "block"]).reset_index(drop=True)
    assert list(got.n) == list(want.n) and len(got) == 9
    np.testing.assert_allclose(got.w, want.w, rtol=1e-10)
    np.testing.assert_allclose(got.p_value, want.p_value, rtol=1e-6, atol=1e-15)
    assert got.p_value.notna().all()


def test_verdict(table):
    got = {r["column_name"]: r for r in normality.normality_verdict(table).collect()}
    assert set(got) == {"normal", "skew.ed", "few"}
    assert got["normal"]["normal"] and got["few"]["normal"] and not got["skew.ed"]["normal"]
    assert (got["normal"]["n"], got["normal"]["n_blocks"], got["skew.ed"]["n_rejected"]) == (13_000, 4, 4)


def test_empty_table(table):
    assert normality.normality_verdict(table.where("false")).count() == 0
