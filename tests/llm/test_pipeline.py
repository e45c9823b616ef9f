"""The pipeline, stage by stage, against brute force."""

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import docs, docs_rows, no_docs  # noqa: F401
from test_lines import brute as brute_lines
from test_mixing import brute as brute_mix
from test_packing import check
from test_simhash import brute_components, brute_fingerprint
from tokenizers import Tokenizer


def test_stages(spark, docs, docs_rows):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    at, rows = docs, [r for r in docs_rows if r[1] and any(c.isalpha() for c in r[1])]
    for name, stage in P.STAGES[:-1]:
        at = P.materialize(stage(spark, at, ""), "test")
        assert at.columns == docs.columns
        if name == "line_dedup":
            rows = [(i, t, None, s, len(t)) for (i, t, *_), s in zip(brute_lines([r[:2] for r in rows]), [None] * len(rows))]
        elif name == "simhash_near_dedup":
            fps = [brute_fingerprint(r[1], 3) for r in rows]
            comp = brute_components(fps, [r[0] for r in rows], 2)
            rows = [r for r, c in zip(rows, comp) if r[0] == c]
        got = sorted(((r.doc_id, r.text) for r in at.collect()), key=str)
        if name != "source_mixing":
            assert got == sorted(((r[0], r[1]) for r in rows), key=str), name
            before = at.collect()
        else:
            assert got == sorted(((i, t) for i, t, _, _ in brute_mix([tuple(r) for r in before])), key=str)
    out = P.best_fit_packing(spark, at, "").collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = [len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in at.collect()]
    assert sum(r.length for r in out) == sum(total)
    n = check([(r.sequence_id, r.offset, r.length) for r in out], P.CAPACITY)
    assert -(-sum(total) // P.CAPACITY) <= n <= -(-sum(total) // P.CAPACITY) + 1


def test_empty(spark, no_docs):
    at = no_docs
    for _, stage in P.STAGES:
        at = P.materialize(stage(spark, at, ""), "test")
    assert at.collect() == [] and np.ndim(0) == 0


def test_whole_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and set(out.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    with pytest.raises(Exception):
        P.run(spark, "/nowhere")
