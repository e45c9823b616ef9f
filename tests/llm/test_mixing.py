"""Poisson replication against brute force."""

import hashlib
import math
from collections import Counter

import pytest
from llm_fixtures import docs, docs_rows, no_docs  # noqa: F401

from vigil.llm.mixing import STEP, mix_sources


def unit(seed, i, k):
    return int(hashlib.md5(f"{seed}:{'' if i is None else i}:{k}".encode()).hexdigest()[:13], 16) / 2**52


def draw(rate, u):
    p = c = math.exp(-rate)
    k = 0
    while c <= u and p > 0 or (c <= u and k < rate):
        k += 1
        p *= rate / k
        c += p
    return k


def brute(rows, weights=None, alpha=0.5, total=None, seed=17):
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1] or "")
    wish = {s: (v**alpha if weights is None else weights.get(s, 0.0)) if v else 0.0 for s, v in size.items()}
    goal = sum(size.values()) if total is None else total
    out = []
    for r in rows:
        s = r[3]
        rate = wish[s] / sum(wish.values()) * goal / size[s] if size[s] else 0.0
        m = max(1, math.ceil(rate / STEP))
        n = sum(draw(rate / m, unit(seed, r[0], k)) for k in range(1, m + 1)) if rate else 0
        out += [(r[0], r[1], k, n) for k in range(1, n + 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text, r.copy, r.copies) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"alpha": 0.0}, {"weights": {"s0": 1, "s3": 3.5}}, {"total": 300_000.0, "seed": 3}])
def test_against_brute_force(docs, docs_rows, options):
    assert got(mix_sources(docs, **options)) == brute(docs_rows, **options)


def test_volumes_meet_the_weights(spark):
    rows = [(i, "x" * (50 + i % 100), "en", "big" if i % 3 else "small", 1) for i in range(6000)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), weights={"big": 1, "small": 3})
    size = Counter()
    for r in out.collect():
        size[r.source] += len(r.text)
    assert size["small"] / size["big"] == pytest.approx(3, rel=0.1)
    assert sum(size.values()) == pytest.approx(sum(len(r[1]) for r in rows), rel=0.05)


def test_globally_shuffled(docs):
    keys = [r.shuffle_key for r in mix_sources(docs).collect()]
    assert keys == sorted(keys) and len(set(keys)) > 20


def test_edges(spark, no_docs):
    rows = [(1, "abc", None, None, "c1"), (1, "abc", None, None, "c2"), (None, "abcd", None, "s", "c"), (2, None, None, "s", "c"), (3, "", None, "void", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copy string")
    out = mix_sources(df, total=200.0)
    assert out.columns == ["doc_id", "text", "lang", "source", "rate", "copies", "copy", "shuffle_key"]
    assert got(out) == brute(rows, total=200.0)
    assert mix_sources(no_docs).collect() == []
    assert mix_sources(df, weights={"void": 1.0}).collect() == []
    assert got(mix_sources(df, weights={None: 1.0}, total=9000.0)) == brute(rows, weights={None: 1.0}, total=9000.0)
