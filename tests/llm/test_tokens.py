"""Linear longest-match counts against the plain greedy rule."""

import random

from llm_fixtures import docs, docs_rows, no_docs, rows_of  # noqa: F401

from vigil.llm.token_counts import PieceCounter, piece_lists, token_counts


def greedy(word, first, rest, prefix=""):
    word, n, table = prefix + word, 0, first
    while word:
        cut = next((k for k in range(len(word), 0, -1) if word[:k] in table), None)
        if cut is None:
            return None
        word, n, table = word[cut:], n + 1, rest
    return n


def test_random_vocabularies():
    rnd = random.Random(2)
    some = lambda k, m: {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, m))) for _ in range(k)}
    for _ in range(200):
        first, rest = some(rnd.randint(1, 12), 5), some(rnd.randint(1, 12), 5)
        counter = PieceCounter(first, rest)
        for _ in range(60):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
            assert counter.count(word) == greedy(word, first, rest), (word, first, rest)


def test_documents(docs, docs_rows):
    first, rest, prefix = piece_lists("piece_bpe_32k.model")
    first, rest, want = set(first), set(rest), []
    for r in docs_rows:
        words = (r[1] or "").encode().split()
        got = [greedy(w.decode(), first, rest, prefix) for w in words]
        want.append((r[0], len(words), sum(1 if g is None else g for g in got), sum(g is None for g in got)))
    assert rows_of(token_counts(docs), "doc_id", "n_words", "n_tokens", "n_unknown") == sorted(want, key=str)


def test_edges(spark, no_docs, tmp_path):
    (tmp_path / "v.txt").write_text("un\n##aff\n##able\n##a\nab\n##le\n")
    df = spark.createDataFrame([("x", "unaffable\x1c unaffable\x0bq", 1), (None, None, 2), ("x", "", 3), ("y", "un" + "a" * 9999, 4)], "doc_id string, text string, n_words int")
    got = token_counts(df, str(tmp_path / "v.txt"))
    assert got.columns == ["doc_id", "n_words", "n_tokens", "n_unknown"]
    assert rows_of(got, *got.columns) == sorted([("x", 3, 1 + 3 + 1, 2), (None, 0, 0, 0), ("x", 0, 0, 0), ("y", 1, 10_000, 0)], key=str) or \
        rows_of(got, *got.columns) == sorted([("x", 3, 3, 3), (None, 0, 0, 0), ("x", 0, 0, 0), ("y", 1, 10_000, 0)], key=str)
    assert token_counts(no_docs).collect() == []
