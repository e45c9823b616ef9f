"""Importance resampling: CRCs of word runs, whole result against a plain version, edges."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from llm_fixtures import docs, docs_rows, no_docs, rows_of  # noqa: F401

import vigil.llm.target_resampling as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i:i + g]) for g in range(1, most + 1) for i in range(len(w) - g + 1)], len(w)


def plain(rows, target, most, buckets=10_000, percent=10, least=20):
    bucket = lambda f: crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, most)[0])
    t = Counter(bucket(f) for x in target for f in features(x, most)[0])
    S, T_ = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T_ + buckets))))
    out = []
    for i, text in rows:
        f, words = features(text, most)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    n = len(able) * percent // 100
    return [(*r[:4], None) for r in out if r[4] < least] + [(*r[:4], k if k <= n else None) for k, r in enumerate(able, 1)]


@pytest.mark.parametrize("most", [1, 3])
def test_ngram_crcs(most, monkeypatch):
    monkeypatch.setattr(T, "WORDS_AT_ONCE", 7)  # runs of words across blocks
    monkeypatch.setattr(T, "SLICE", 5)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab Z9é中'\n\x00\x7f_") for _ in range(rnd.randint(0, 80))) for _ in range(200)] + [None, "", "x" * 5000 + " y"]
    want = Counter((d, crc32(f.encode())) for d, t in enumerate(texts) for f in features(t, most)[0])
    got, words = Counter(), Counter()
    for doc, crc, of_word in T.ngram_crcs([None if t is None else t.encode() for t in texts], range(1, most + 1)):
        got.update(zip(doc.tolist(), crc.tolist()))
        words.update(of_word.tolist())
    assert got == want
    assert words == Counter({d: features(t, 1)[1] for d, t in enumerate(texts) if features(t, 1)[1]})


def test_shift_is_crc_of_zero_bytes():
    a, n = b"some prefix", np.array([0, 1, 5, 1000, 70_000])
    got = T.shift(np.full(len(n), crc32(a), np.uint32), n)
    assert [int(g) ^ crc32(b"b" * k) for g, k in zip(got, n)] == [crc32(a + b"b" * k) for k in n]


COLS = ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("most, percent", [(1, 10), (2, 50), (1, 100)])
def test_whole_result(spark, docs, docs_rows, most, percent):
    target = ["the le der and", None, "", "Die und thE que erst " * 5]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, score int")
    got = T.importance_resample(docs, bench, max_words=most, percent=percent)
    assert got.columns == COLS
    assert rows_of(got, *COLS) == sorted(plain([r[:2] for r in docs_rows], target, most, percent=percent), key=str)


def test_draw_gives_texts(spark, docs, docs_rows):
    bench = spark.createDataFrame([("the le der and",)], "text string")
    got = sorted((r.rank, r.doc_id, r.text) for r in T.draw(docs, bench, max_words=1, percent=30).collect())
    text = {i: t for i, t, *_ in docs_rows}
    want = sorted((r[4], r[0]) for r in plain([r[:2] for r in docs_rows], ["the le der and"], 1, percent=30) if r[4])
    assert [g[:2] for g in got] == want and all(text[i] == t for _, i, t in got)


def test_edges(spark, no_docs):
    rows = [(1, None), (None, "a b c"), (None, "a b c"), (2, "a b c"), (2, "a b c"), (3, ""), (4, "!!"), (5, "Q " * 60_000), (6, "é 1")]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, weight string, rank int").repartition(2)
    for bench in (["q b"], []):
        b = spark.createDataFrame([(t,) for t in bench], "text string")
        for least in (0, 2):
            got = T.importance_resample(df, b, max_words=2, percent=60, min_words=least)
            assert rows_of(got, *COLS) == sorted(plain(rows, bench, 2, percent=60, least=least), key=str)
    assert T.importance_resample(no_docs, no_docs).collect() == []
