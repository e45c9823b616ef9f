"""Line deduplication against brute force."""

import numpy as np

from llm_fixtures import docs, docs_rows, no_docs, rows_of  # noqa: F401
from vigil.llm.line_dedup import WHITE, TwoBloom, _as_words, bit_positions, dedup_lines, digest, line_key, merge_slices


def brute(rows, least=10):
    where = {}
    key = lambda x: x.strip(WHITE).lower()
    big = 1 << 63
    for i, t in rows:
        for x in (t or "").encode().split(b"\n"):
            where.setdefault(key(x), set()).add(big if i is None else i)
    out = []
    for i, t in rows:
        me = big if i is None else i
        lines = (t or "").encode().split(b"\n")
        keep = [x for x in lines if len(key(x).decode()) < least or me == min(where[key(x)])]
        out.append((i, b"\n".join(keep).decode(), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def test_against_brute_force(docs, docs_rows):
    got = [(i, t or "", n, d) for i, t, n, d in rows_of(dedup_lines(docs), "doc_id", "text", "n_lines", "n_dropped")]
    assert sorted(got, key=str) == brute([r[:2] for r in docs_rows])
    assert sum(r[3] for r in got) > 10


def test_edges(spark, no_docs):
    rows = [(1, "same line here\nSAME LINE HERE "), (1, "same line here\nsame line here"), (2, "\x0b same line here"), (None, "same line here"),
            (None, "only without id\n\n"), (3, None), (4, ""), (5, "ééééééééé\nshort"), (6, "ééééééééé\nshort"), (7, "éééééééééé"), (8, "éééééééééé"),
            (9, "ÉÉÉÉÉÉÉÉÉÉ"), (10, "x" * 200_000 + "\nsame line here")]
    df = spark.createDataFrame([(i, t, "a", "b", 0.5) for i, t in rows], "doc_id long, text string, key string, n_lines string, line_keys double")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "key", "line_keys", "n_lines", "n_dropped"]
    got = sorted([(r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in out.collect()], key=str)
    assert got == brute(rows)
    assert [r.text for r in out.where("doc_id = 3").collect()] == [None]
    assert dedup_lines(no_docs).collect() == []


def test_null_text_beside_a_text_of_the_same_id(spark):
    rows = [(1, "same line here"), (2, "same line here\nother"), (2, None), (None, "same line here"), (None, None)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(out, "doc_id", "text", "n_lines", "n_dropped") == sorted(
        [(1, "same line here", 1, 0), (2, "other", 2, 1), (2, None, 1, 0), (None, "", 1, 1), (None, None, 1, 0)], key=str)


def test_small_filter_changes_nothing(docs, docs_rows):
    got = [(i, t or "", n, d) for i, t, n, d in rows_of(dedup_lines(docs, max_bits=1 << 13, bits_per_line=1), "doc_id", "text", "n_lines", "n_dropped")]
    assert sorted(got, key=str) == brute([r[:2] for r in docs_rows])


def test_merged_filters_hold_every_repeat():
    rng = np.random.default_rng(0)
    keys = [digest(b"%d" % i) for i in range(500)]
    filters = []
    for part in range(4):
        f = TwoBloom(1 << 14)
        f.add(_as_words(b"".join(keys[i] for i in range(500) if i % 4 == part or i % 50 == 0)))
        filters.append(f)
    import zlib

    import pandas as pd
    _, twice = merge_slices(pd.DataFrame({"once": [zlib.compress(f.once.tobytes()) for f in filters],
                                          "twice": [zlib.compress(f.twice.tobytes()) for f in filters]}))
    found = TwoBloom.has(np.frombuffer(zlib.decompress(twice), np.uint8), bit_positions(_as_words(b"".join(keys)), 1 << 14))
    assert found[::50].all() and found.sum() < 60 and rng is not None


def test_key():
    assert line_key(b"  Ab C\xc3\x89 \r", 4) == "ab cÉ".encode()
    assert line_key("ééééééééé".encode(), 10) is None


def test_texts_are_not_sorted_for_their_drops(docs):
    out = dedup_lines(docs)
    plan = out._jdf.queryExecution().sparkPlan().toString()  # the lines above the join of texts and drops come first
    joins = [x.strip(" +-:") for x in plan.split("\n") if "Join" in x]
    assert joins[0].startswith("ShuffledHashJoin") and "LeftOuter, BuildRight" in joins[0]
