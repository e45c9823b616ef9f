"""Lempel-Ziv fingerprints against the plain parse."""

import hashlib
import random

import numpy as np
from llm_fixtures import docs, docs_rows, no_docs  # noqa: F401

from vigil.llm.lz_fingerprint import decode, encode, fingerprint_documents, fingerprint_edits, likeness, likeness_of, lz_phrases, signature, signatures_of_edit


def brute_phrases(text):
    known, i, j = set(), 0, 1
    while j <= len(text):
        if text[i:j] in known:
            j += 1
        else:
            known.add(text[i:j])
            i, j = j, j + 1
    return known


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 3
        out.append((i, len(t), t[:len(t) - n] + nxt[:n], t, nxt))
    return out


def want(rows):
    return sorted(((i, n, hashlib.sha256(e.encode()).hexdigest(), encode(signature(t)), encode(signature(e)), likeness(signature(t), signature(e)),
                    likeness(signature(t), signature(x))) for i, n, e, t, x in brute_edits(rows)), key=str)


def test_parse_and_edit():
    rnd = random.Random(4)
    for _ in range(300):
        t = "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 150)))
        known = set()
        lz_phrases(t, len(t), known)
        assert known == brute_phrases(t)
        a, b, e = signatures_of_edit(t, "b" * (len(t) // 3))
        assert np.array_equal(a, signature(t)) and np.array_equal(b, signature(e)) and np.array_equal(decode(encode(a)), a)


def test_likeness_estimates_common_phrases():
    rnd, err = random.Random(1), []
    text = lambda k: "".join(rnd.choice("abcdefg hij") for _ in range(k))
    for k in (200, 2000, 8000):
        for share in (0.0, 0.5, 0.9):
            t = text(k)
            u = t[:int(k * share)] + text(k - int(k * share))
            p, q = brute_phrases(t), brute_phrases(u)
            err.append(abs(len(p & q) / len(p | q) - likeness(signature(t), signature(u))))
    assert max(err) < 0.15 and np.mean(err) < 0.05
    assert likeness(signature("abc"), signature("abc")) == 1.0 == likeness(signature(""), signature(""))
    assert likeness(signature(""), signature("abc")) == 0.0


def test_documents(spark, docs, docs_rows):
    for parts in ("1", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert sorted((tuple(r) for r in fingerprint_edits(docs).collect()), key=str) == want([r[:2] for r in docs_rows])
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edges(spark, no_docs):
    for rows in ([(5, "only one document")], [(1, None), (1, None), (None, "abcabc"), (None, None), (2, ""), (9, "xyz" * 30_000), (4, "q"), (4, "p")], [(None, "a" * 99), (None, "b" * 9)]):
        df = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, part int, fingerprint string")
        assert sorted((tuple(r) for r in fingerprint_edits(df).collect()), key=str) == want(rows)
    assert fingerprint_edits(no_docs).collect() == []


def test_general_interface(docs, docs_rows):
    out = fingerprint_documents(docs).withColumnRenamed("fingerprint", "a")
    out = out.withColumn("b", out.a).select("text", "a", likeness_of("a", "b").alias("same")).collect()
    assert len(out) == len(docs_rows) and {r.same for r in out} == {1.0}
    assert all(r.a == encode(signature(r.text or "")) for r in out)
