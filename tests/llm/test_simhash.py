"""SimHash components and the Gray-order index against brute force."""

import numpy as np
import xxhash
from llm_fixtures import docs, docs_rows, no_docs, rows_of  # noqa: F401

from vigil.llm.components import connected_components
from vigil.llm.simhash import GrayIndex, drop_near_duplicates, gray_rank, hamming_links, local_forest, simhash, simhash_components


def brute_fingerprint(text, k):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    for c in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) > k else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, limit):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = []
    for i in range(len(fps)):
        known = [ids[j] for j in range(len(fps)) if find(j) == find(i) and ids[j] is not None]
        out.append(min(known) if known else None)
    return out


def test_against_brute_force(docs, docs_rows):
    fps = [brute_fingerprint(r[1], 3) for r in docs_rows]
    comp = brute_components(fps, [r[0] for r in docs_rows], 2)
    want = sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(docs_rows, fps, comp)), key=str)
    assert rows_of(simhash_components(docs, 3, 2), "doc_id", "fingerprint", "component_id") == want
    assert len({c for _, _, c in want}) < len(want)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))


def test_edges(spark, no_docs):
    rows = [(5, "A b\x0bC d"), (5, "a B c D"), (9, "a b c d"), (None, "a b c d"), (None, "quite another text"), (7, None), (8, " \n"), (1, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fingerprint string, component_id int")
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    comp = brute_components(fps, [i for i, _ in rows], 2)
    assert rows_of(simhash_components(df), "doc_id", "fingerprint", "component_id") == sorted(
        ((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comp)), key=str)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 5, 7, None, None], key=str)
    assert simhash_components(no_docs).collect() == [] and drop_near_duplicates(no_docs).collect() == []


def _cluster(seed=1):
    rng, x = np.random.default_rng(seed), []
    for b in rng.integers(0, 2**63, 60):
        x.append(int(b))
        for _ in range(rng.integers(0, 6)):
            y = x[-1]
            for _ in range(rng.integers(1, 5)):
                y ^= 1 << int(rng.integers(0, 64))
            x.append(y)
    return np.unique(np.array([*x, *range(8), *range(64, 120)], np.uint64))


def test_index_finds_every_link():
    x = _cluster()
    x = x[np.argsort(gray_rank(x))]
    for limit in (0, 1, 2, 4):
        got = {(int(q), int(p)) for qs, ps in GrayIndex.of(x).search(x, limit, whole=False) for q, p in zip(qs, ps)}
        near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None]) <= limit)
        assert got == {(int(a), int(b)) for a, b in near}
        u, v = local_forest(x, x, limit)
        root = {int(a): int(b) for a, b in zip(u, v)}
        fps = [int(f) for f in x]
        assert brute_components(fps, fps, limit) == [root.get(f, f) for f in fps]


def test_ranges_lose_no_link(spark):
    x = _cluster(2)
    fps = [int(f) for f in x.view(np.int64)]
    classes = spark.createDataFrame([(f,) for f in fps], "fp long")
    linked = {r.node: r.root for r in connected_components(hamming_links(classes, 2, per_range=40)).collect()}
    want = brute_components([int(f) for f in x], fps, 2)
    assert [linked.get(f, f) for f in fps] == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (102, 100)] + [(200, i) for i in range(300, 330)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, **{i: 200 for i in range(300, 330)}}


def test_fingerprint_words():
    for t in ("one", "one two three", "a b c a b c a b c", "É é É é", None, "", "a\x1cb c d e"):
        assert simhash(t, 3) % (1 << 64) == brute_fingerprint(t, 3)


def test_an_id_of_unlike_texts(spark):
    rows = [(1, "one text of its own here"), (1, "something quite different stands there"), (2, "something quite different stands there"),
            (0, "a third group of words again"), (2, "a third group of words again"), (3, "and the last one is alone"), (1, "one text of its own here"),
            (4, "a fifth text nobody else has"), (4, "a third group of words again")]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    # every group keeps one row: id 1 is the smallest of two groups, id 4 of one and second in another
    assert rows_of(kept, "doc_id", "text") == sorted([rows[0], rows[1], rows[3], rows[5], rows[7]], key=str)
