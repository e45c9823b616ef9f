"""Small corpora for the tests of the corpus operators."""

import random

import pytest

WORDS = "the of and to le la der die und que los an erst tion ment heit dad ar en ou th sh ing".split()


def make_docs(n=60, seed=0):
    """Small corpus with copies, near copies, shared lines and passages, empty and null texts."""
    rnd = random.Random(seed)
    text = lambda k: " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(k))
    line, passage, rows = "This line stands in many documents, Again", text(30), []
    for i in range(n):
        kind = i % 10
        t = "\n".join(text(rnd.randint(1, 25)) for _ in range(rnd.randint(1, 5)))
        if kind == 1:
            t += "\n  " + line.upper() + "\t\n" + text(3)
        elif kind == 2:
            t = rows[rnd.randrange(len(rows))][1] or ""
        elif kind == 3 and rows[-1][1]:
            t = rows[-1][1].replace("the", "thE", 1)
        elif kind == 4:
            t = text(3) + passage + "é" * rnd.randint(0, 3) + text(4)
        elif kind == 5:
            t = [None, "", "  \n\n", "1234 !!", "x"][(i // 10) % 5]
        rows.append((i * 7 % 61, t, ["en", "fr", None][i % 3], f"s{min(i % 7, 3)}", len(t or "")))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs_rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
