"""Tokenization against the library, packing against its rules and plain best-fit."""

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import docs, docs_rows, no_docs  # noqa: F401
from tokenizers import Tokenizer

from vigil.llm.packing import GAP, WAITS, across_ranges, pack_documents, pack_pieces, sweep
from vigil.llm.tokenize import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def best_fit(lengths, capacity):
    gaps, bins = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        left = (capacity if i == len(gaps) else gaps.pop(i)) - x
        bins += left == capacity - x and i == len(gaps)
        bisect.insort(gaps, left)
    return len(gaps)


def check(rows, capacity):
    """rows: (sequence, offset, length)"""
    by = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    return len(by)


def test_word_cache_equals_library(library):
    rnd = random.Random(3)
    letters = "abcéÉßµ² \n\t\r\x0b\x0c\x85\xa0\x1c'''sStvreldmo.,!!12½ªºÀ́éΣσİıœŒ中文😀ǅ​|<>"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += ["", "it's I'LL we've 'S", "ΑΣ ΑΣ. ας", "<|endoftext|> a", "word " * 3000]
    tok = WordTokenizer(PATH)
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(x, "<u4").tolist() for x in tok.ids(texts)] == [library(t) for t in texts]


def test_pack_documents(docs, docs_rows, library):
    capacity = 64
    out = [r.asDict() for r in pack_documents(docs, capacity, per_range=20).collect()]
    want = []
    for r in docs_rows:
        ids = [*library(r[1] or ""), 0]
        want += [(r[0], p, p * capacity, ids[p * capacity:(p + 1) * capacity]) for p in range(-(-len(ids) // capacity))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["ids"]) for r in out) == sorted(want)
    assert all(r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out)
    n = check([(r["sequence_id"], r["offset"], r["length"]) for r in out], capacity)
    assert n <= 1.03 * best_fit([r["length"] for r in out], capacity) + 1


@pytest.mark.parametrize("name", ["uniform", "short", "hot", "one", "halves"])
def test_packing_is_near_best_fit(spark, name):
    rng = np.random.default_rng(5)
    lengths = {"uniform": rng.integers(1, 2049, 3000), "short": rng.integers(1, 200, 3000), "hot": np.where(rng.random(3000) < 0.4, 700, rng.integers(1, 2049, 3000)),
               "one": np.ones(3000, int), "halves": np.full(501, 1024)}[name]
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "rid long, length long")
    got = pack_pieces(df, 2048, per_range=700).collect()
    assert sorted(r.rid for r in got) == list(range(len(lengths)))
    n = check([(r.sequence_id, r.offset, int(lengths[r.rid])) for r in got], 2048)
    assert n <= 1.01 * best_fit(lengths.tolist(), 2048) + 6


def test_edges(spark, no_docs):
    rows = [(1, None), (1, None), (None, ""), (2, "a " * 5000), (3, "word")]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, length int, rid string")
    out = pack_documents(df, 16, with_ids=False)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = out.collect()
    assert len(got) == 4 + -(-5001 // 16) and check([(r.sequence_id, r.offset, r.length) for r in got], 16) == -(-(5001 + 5) // 16)
    assert pack_documents(no_docs).collect() == []


def test_sweep_is_best_fit():
    rng = np.random.default_rng(1)
    for opens in (False, True):
        for _ in range(150):
            docs, gaps = rng.integers(1, 20, rng.integers(0, 30)).tolist(), rng.integers(1, 21, rng.integers(0, 30)).tolist()
            rows = sorted([(x, WAITS, i) for i, x in enumerate(docs)] + [(g, GAP, 100 + i) for i, g in enumerate(gaps)], key=lambda r: (-r[0], r[1], r[2]))
            placed, left, waits = sweep(iter(rows), 20, 1000, opens)
            free, want = {100 + i: g for i, g in enumerate(gaps)}, []
            for x in sorted(docs, reverse=True):
                able = [g for g in free.values() if g >= x]
                want.append((x, min(able) if able else None))
                if able or opens:
                    at = next((k for k, g in free.items() if able and g == min(able)), 1000 + len(free))
                    free[at] = free.get(at, 20) - x
            assert [n for _, n, _, _ in placed] == [x for x, g in want if g or opens] and sorted(n for _, n in waits) == sorted(x for x, g in want if not g and not opens)
            assert [g for g, _ in left] == sorted((g for g in free.values() if g), reverse=True)
            assert all(20 - o == g for (_, _, _, o), (_, g) in zip(placed, [w for w in want if w[1] or opens]) if g)


def test_across_ranges_fill_only_what_fits():
    rng = np.random.default_rng(3)
    for _ in range(200):
        edges = np.sort(rng.integers(1, 500, 6))[::-1]  # range p holds sizes up to edges[p]
        gaps, sizes, waits, lengths = [], {}, [], {}
        for p in range(5):
            low, high = int(edges[p + 1]), int(edges[p])
            mine = np.sort(rng.integers(1 if rng.random() < 0.5 else low, high + 1, rng.integers(0, 6)))[::-1]  # some were filled in part
            for c in {int(g).bit_length() for g in mine}:
                own = [int(g) for g in mine if int(g).bit_length() == c]
                gaps.append((p, c, len(own), min(own), max(own)))
                sizes.update({(p, c, i): g for i, g in enumerate(own)})
            if rng.random() < 0.7:
                lengths[p] = np.sort(rng.integers(low, high + 1, rng.integers(1, 9)))[::-1].tolist()
                waits.append((p, len(lengths[p]), lengths[p][0]))
        taken, filled = set(), {}
        for p, first, n, each, at, c, rank in across_ranges(gaps, waits):
            assert at < p and each >= 1
            for i in range(n):
                assert (p, first + i) not in taken
                taken.add((p, first + i))
                key = (at, c, rank + i // each)
                filled.setdefault((key, p, first), []).append(lengths[p][first + i])
        assert len({k for k, *_ in filled}) == len(filled) and all(sum(v) <= sizes[k] for (k, *_), v in filled.items())
        for p, n, longest in waits:  # a gap of a higher range that holds the longest is used if documents are left
            if any((p, i) not in taken for i in range(n)):
                assert all(k in {f for f, *_ in filled} or sizes[k] < longest or sizes[(k[0], k[1], 0)] != sizes[k] for k in sizes if k[0] < p)


@pytest.mark.parametrize("per_range", [150, 1000, 10_000])
def test_rounds_place_every_document(spark, per_range):
    rng = np.random.default_rng(per_range)
    lengths = np.concatenate([rng.integers(1, 60, 700), rng.integers(1, 2049, 700), np.full(200, 900), np.full(150, 2048)]).tolist()
    got = pack_pieces(spark.createDataFrame(list(enumerate(lengths)), "rid long, length long"), 2048, per_range=per_range).collect()
    assert sorted(r.rid for r in got) == list(range(len(lengths)))
    n = check([(r.sequence_id, r.offset, lengths[r.rid]) for r in got], 2048)
    assert n <= 1.01 * best_fit(lengths, 2048) + (0 if per_range == 10_000 else 4)


@pytest.mark.parametrize("openers, length", [(99, 10), (99, 32), (90, 40)])
def test_few_gaps_take_all_they_hold(spark, openers, length):
    lengths = [1025] * openers + [length] * 10_000  # under 1 % of the documents leave a gap
    df = spark.createDataFrame(list(enumerate(lengths)), "rid long, length long")
    got = pack_pieces(df, 2048, per_range=700).collect()
    assert sorted(r.rid for r in got) == list(range(len(lengths)))
    assert check([(r.sequence_id, r.offset, lengths[r.rid]) for r in got], 2048) == best_fit(lengths, 2048)
