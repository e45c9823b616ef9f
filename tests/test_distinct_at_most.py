"""Bounded distinct counts: equal to full counts up to the limit, and few values leave a task."""

import pytest

from vigil.operators.profile import distinct_at_most, distinct_counts, variable_types
from vigil.operators.validate import premodel_checks, quality_flags


def _table(spark, n=500, parts=7):
    rows = [(i % 3, i % 100, i % 101, f"s{i}", None if i % 2 else "x", float("nan") if i % 5 == 0 else (0.0 if i % 2 else -0.0)) for i in range(n)]
    return spark.createDataFrame(rows, "a int, b int, `c.d` long, s string, `half` string, f double").repartition(parts)


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 99, 100, 101, 10_000])
def test_equals_full_counts_up_to_limit(spark, limit):
    df = _table(spark)
    full = {r["column_name"]: r["n_distinct"] for r in distinct_counts(df).collect()}
    assert distinct_at_most(df, limit) == {c: min(n, limit + 1) for c, n in full.items()}


def test_empty_null_and_no_columns(spark):
    df = spark.createDataFrame([(None, 1)], "a string, b int")
    assert distinct_at_most(df, 5) == {"a": 0, "b": 1}
    assert distinct_at_most(df.where("b > 1"), 5) == {"a": 0, "b": 0}
    assert distinct_at_most(df, 5, []) == {}


def test_flags_and_checks_at_the_threshold(spark):
    for n, high in ((100, 0.0), (101, 1.0)):
        df = spark.createDataFrame([(f"v{i}", i) for i in range(n)], "s string, y int")
        flags = {r["flag"]: r["value"] for r in quality_flags(df).where("column_name IS NULL").collect()}
        assert flags == {"has_missing": 0.0, "has_duplicates": 0.0, "has_high_cardinality": high}
        named = [(r["column_name"], r["value"]) for r in premodel_checks(df, "y").where("check = 'high_cardinality'").collect()]
        assert named == ([("s", n)] if high else [])


def test_variable_types_at_the_threshold(spark):
    df = spark.createDataFrame([(i % 9, i % 10) for i in range(90)], "nine int, ten int")
    assert {r["column_name"]: r["var_type"] for r in variable_types(df).collect()} == {"nine": "categorical", "ten": "numeric"}
