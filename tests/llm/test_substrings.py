"""Substring deduplication and suffix arrays against brute force."""

import random

import numpy as np
import pytest

import vigil.llm.substring_dedup as S
from llm_fixtures import docs, docs_rows, no_docs, rows_of  # noqa: F401
from vigil.llm.suffix import common_prefixes, suffix_array


def brute(docs, w):
    first, out = {}, []
    for i, t in docs:
        for p in range(len(t) - w + 1):
            first[t[p:p + w]] = min(first.get(t[p:p + w], 1 << 64), S.LAST_ID if i is None else i)
    for i, t in docs:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - w + 1):
            if first[t[p:p + w]] < (S.LAST_ID if i is None else i):
                gone[p:p + w] = True
        gone = gone[:-1]
        spans = int(gone[0] if len(t) else 0) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, bytes(b for b, g in zip(t, gone) if not g), len(t), int(gone.sum()), spans))
    return out


def local(docs, w, shards, per):
    """The operator's own steps without Spark."""
    batches = [docs[i:i + per] for i in range(0, len(docs), per)]
    parts = [([i for i, _ in b], [len(t) for _, t in b], b"".join(t for _, t in b)) for b in batches]
    told, common = {}, {}
    for n, (_, lens, raw) in enumerate(parts):
        for s, *rest in S.announce(n, lens, raw, w, shards):
            told.setdefault(s, []).append(tuple(rest))
    for s, said in told.items():
        for n, k, bits in S.common_grams(said):
            common.setdefault(n, {})[s] = (k, bits)
    rows = [r for n, p in enumerate(parts) for r in S.deal_pieces(n, *p, w, shards, common.get(n, {}))]
    gone = {}
    for s in {r[0] for r in rows}:
        shard = S.Shard(w)
        for r in (r for r in rows if r[:2] == (s, S.PIECES)):
            shard.add(*r[2:])
        shard.settle()
        for r in (r for r in rows if r[:2] == (s, S.PLACES)):
            for d, lo, hi in zip(*shard.repeats(*r[2:])):
                gone.setdefault((r[2], int(d)), []).append((int(lo), int(hi)))
    out = []
    for n, b in enumerate(batches):
        for k, (i, t) in enumerate(b):
            g = np.zeros(len(t), bool)
            for lo, hi in gone.get((n, k), []):
                g[lo:hi + w - 1] = True
            out.append((i, bytes(x for x, y in zip(t, g) if not y), int(g.sum())))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_steps_against_brute_force(seed, monkeypatch):
    rnd = random.Random(seed)
    w, letters = rnd.choice([2, 3, 5, 8, 12, 50]), rnd.choice(["ab", "abcdé\x00 ", "thquick "])
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 150))) for _ in range(4)]
    docs = []
    for i in range(rnd.randint(1, 14)):
        t = "".join(rnd.choice(base)[rnd.randint(0, 50):rnd.randint(30, 150)] for _ in range(rnd.randint(0, 4)))
        docs.append((rnd.choice([i, i, None, 3]), t.encode()))
    monkeypatch.setattr(S, "SUB_BYTES", rnd.choice([100, 400, 1 << 20]))  # small: grams fill several sub-shards
    monkeypatch.setattr(S, "PIECE_WINDOWS", rnd.choice([3, 4096]))
    assert local(docs, w, rnd.choice([1, 3, 7]), rnd.choice([1, 3, 20])) == [r[:2] + r[3:4] for r in brute(docs, w)]


def test_against_brute_force(docs, docs_rows):
    got = rows_of(S.remove_repeated_substrings(docs, 50), "doc_id", "kept", "n_bytes", "n_removed", "n_spans")
    want = brute([(r[0], (r[1] or "").encode()) for r in docs_rows], 50)
    assert [(i, bytes(k), *x) for i, k, *x in got] == sorted(want, key=str) and sum(r[3] for r in want) > 1000


def test_edges(spark, no_docs):
    p = "a passage of more than fifty bytes, that is repeated é word for word"
    rows = [(4, p + "x"), (4, "y" + p), (2, "zz" + p), (9, p + p), (None, p), (None, None), (1, ""), (3, "a" * 20_000), (8, "b" + "a" * 300)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kept string, batch int")
    got = rows_of(S.remove_repeated_substrings(df), "doc_id", "kept", "n_bytes", "n_removed", "n_spans")
    assert [(i, bytes(k), *x) for i, k, *x in got] == sorted(brute([(i, (t or "").encode()) for i, t in rows], 50), key=str)
    assert S.remove_repeated_substrings(no_docs).collect() == []


@pytest.mark.parametrize("depth", [1, 4, 5, 7, 10, 50])
def test_suffix_array(depth):
    rng = np.random.default_rng(depth)
    pieces = [rng.integers(1, 3, n).astype(np.uint8) for n in rng.integers(depth, 120, 30)]
    text = np.concatenate([np.append(p, 0).astype(np.uint8) for p in pieces])
    lens = np.array([len(p) for p in pieces])
    ends = np.cumsum(lens + 1) - 1
    rem = np.repeat(ends, lens + 1) - np.arange(len(text))
    sa, raw = suffix_array(text, rem, depth), text.tobytes()
    assert sa.tolist() == sorted((p for p in range(len(text)) if rem[p] >= depth), key=lambda p: (raw[p:p + depth], p))
    lcp = common_prefixes(text, sa, ends - lens, lens - depth + 1, depth)
    for i in range(1, len(sa)):
        a, b = raw[sa[i - 1]:sa[i - 1] + depth], raw[sa[i]:sa[i] + depth]
        assert lcp[i] == next((k for k in range(depth) if a[k] != b[k]), depth)


def dealt(docs, w, shards, per, hot_bytes):
    """Rows for the shards, by the operator's own steps."""
    batches = [docs[i:i + per] for i in range(0, len(docs), per)]
    parts = [([i for i, _ in b], [len(t) for _, t in b], b"".join(t for _, t in b)) for b in batches]
    told, common = {}, {}
    for n, (_, lens, raw) in enumerate(parts):
        for s, *rest in S.announce(n, lens, raw, w, shards):
            told.setdefault(s, []).append(tuple(rest))
    for s, said in told.items():
        for n, k, bits in S.common_grams(said, *hot_bytes):
            common.setdefault(n, {})[s] = (k, bits)
    return [r for n, p in enumerate(parts) for r in S.deal_pieces(n, *p, w, shards, common.get(n, {}))]


def test_a_hot_gram_is_dealt_over_the_shards():
    rnd = random.Random(7)
    phrase = "this phrase is in every document"
    text = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60))
    docs = [(i, (text() + phrase + text()).encode()) for i in range(2000)]
    hot = (20_000,) if hasattr(S, "HOT_BYTES") else ()
    sizes = np.zeros(8, int)
    for s, kind, _, n, *_ in dealt(docs, 50, 8, 500, hot):
        sizes[s] += n if kind % 2 == 0 else 0
    assert sizes.max() < 1.5 * sizes.mean()


def test_windows_of_hot_grams_against_brute_force(spark, monkeypatch, docs, docs_rows):
    want = sorted(brute([(r[0], (r[1] or "").encode()) for r in docs_rows], 50), key=str)
    monkeypatch.setattr(S, "BATCH_BYTES", 2000)
    for hot_bytes in (0, 200, 1000):  # all grams, some, few
        monkeypatch.setattr(S, "HOT_BYTES", hot_bytes)
        got = rows_of(S.remove_repeated_substrings(docs, 50), "doc_id", "kept", "n_bytes", "n_removed", "n_spans")
        assert [(i, bytes(k), *x) for i, k, *x in got] == want


@pytest.mark.parametrize("seed", range(20))
def test_hot_steps_against_brute_force(seed):
    rnd = random.Random(seed)
    w, shards, base = rnd.choice([3, 8, 50]), rnd.choice([1, 3, 7]), ["".join(rnd.choice("ab\x00 é") for _ in range(150)) for _ in range(3)]
    docs = [(rnd.choice([i, None, 3]), "".join(rnd.choice(base)[rnd.randint(0, 50):rnd.randint(30, 150)] for _ in range(rnd.randint(0, 4))).encode())
            for i in range(12)]
    per, gone = rnd.choice([1, 3, 20]), {}
    rows = dealt(docs, w, shards, per, (rnd.choice([0, 128, 512]),))
    for s in range(shards):
        for kind, solver in ((S.PIECES, S.Shard), (S.WINDOWS, S.Windows)):
            mine = [r for r in rows if r[:2] == (s, kind)]
            shard = solver(w)
            for r in mine:
                shard.add(*r[2:])
            if mine:
                shard.settle()
            for r in (r for r in rows if r[:2] == (s, kind + 1)):
                for d, lo, hi in zip(*shard.repeats(*r[2:])):
                    gone.setdefault(r[2] * per + int(d), []).append((int(lo), int(hi)))
    out = []
    for k, (i, t) in enumerate(docs):
        g = np.zeros(len(t), bool)
        for lo, hi in gone.get(k, []):
            g[lo:hi + w - 1] = True
        out.append((i, bytes(x for x, y in zip(t, g) if not y), int(g.sum())))
    assert out == [r[:2] + r[3:4] for r in brute(docs, w)]
