"""Rank-order language identification: distance by definition, held-out accuracy, edges."""

import zlib
from collections import Counter

import pytest
from llm_fixtures import docs, docs_rows, no_docs  # noqa: F401

from vigil.llm.lang_id import Profiles, identify_languages, keep_identified, ngram_codes, profile


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = Counter(c for w in words for c in w)
    line = "_".join(["", *words, ""])
    for i in range(len(line) - 1):
        grams[line[i:i + 2]] += 1
    for i in range(len(line) - 2):
        if line[i + 1] != "_":
            grams[line[i:i + 3]] += 1
    return grams


def code(gram):
    c = 0
    for x in gram:
        c = c << 21 | (1 if x == "_" else ord(x))
    return c


def test_profile_by_definition():
    for text in ("Straße, ça va? 12 été", "a", "aa bb aa!", "the the of of"):
        grams = {code(g): n for g, n in brute_grams(text).items()}
        assert Counter(ngram_codes(text).tolist()) == grams
        for k in (1, 3, 300):
            assert profile(ngram_codes(text), k).tolist() == sorted(grams, key=lambda g: (-grams[g], g))[:k]


def test_distance_by_definition():
    table = {"xx": profile(ngram_codes("the cat and the dog of the house"), 20).tolist(), "yy": profile(ngram_codes("le chat et le chien de la maison"), 20).tolist()}
    model = Profiles(table, 20)
    for text in ("the dog", "la maison du chat", "zzz qqq"):
        own = profile(ngram_codes(text), 20).tolist()
        far = {k: sum(min(20, abs(v.index(g) - i)) if g in v else 20 for i, g in enumerate(own)) for k, v in table.items()}
        lang = min(far, key=lambda k: (far[k], k))
        assert model.predict(text) == (lang, pytest.approx(1 - far[lang] / (20 * len(own))))
    assert model.predict(None) == model.predict("12 !") == model.predict("") == ("und", 0.0)


def test_held_out_accuracy(spark):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = identify_languages(src).collect()
    assert len(rows) == src.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tested = [r for r in rows if r.held_out and r.lang]
    assert len(tested) > 20 and sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_sees_text_only(spark):
    base = [(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr", "s") for i in range(40)]
    out = {}
    for wrong in ("en", "fr", None):
        held = [(i, t, wrong if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s) for i, t, lang, s in base]
        df = spark.createDataFrame(held, "doc_id long, text string, lang string, source string")
        out[wrong] = sorted((r.doc_id, r.lang_pred, r.score) for r in identify_languages(df).collect())
    assert out["en"] == out["fr"] == out[None]


def test_edges(spark, no_docs, docs):
    rows = [(None, "the cat"), (1, None), (1, None), (2, ""), (3, "123"), (4, "the cat and the dog"), (5, "the " * 50_000)]
    df = spark.createDataFrame([(i, t, "en", "score") for i, t in rows], "doc_id long, text string, lang string, score string")
    out = identify_languages(df)
    assert out.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.count() == len(rows) and got[(None, "the cat")].held_out
    assert {r.lang_pred for r in out.where("text IS NULL OR text IN ('', '123')").collect()} == {"und"}
    assert got[(4, "the cat and the dog")].lang_pred == "en"
    unlabelled = df.withColumn("lang", df.lang.substr(10, 1)).where("doc_id = 77")
    assert identify_languages(unlabelled).collect() == [] and identify_languages(no_docs).collect() == []
    kept = keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
