"""Splittable scan of quoted line breaks against Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from vigil.sources.files import scan_delimited
from vigil.sources.quoted import _Cutter


@pytest.fixture
def split(spark):
    """Sets the bytes of a block and the lines of an Arrow batch."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"]

    def to(size, batch):
        for name, v in zip(names, (size, size, batch)):
            spark.conf.set(name, str(v))
    yield to
    for name in names:
        spark.conf.unset(name)


def expected(data: bytes, sep, closed=True):
    text = data.decode("utf-8", "ignore").removeprefix("﻿")
    csv.field_size_limit(10**9)
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    if not closed:
        rows.pop()
    width = len(rows[0])
    good = [tuple(f or None for f in r) + (None,) * (width - len(r)) for r in rows[1:] if len(r) <= width]
    return rows[0], sorted(good, key=str), len(rows) - 1 - len(good) + (not closed)


def made(seed, rows, end="\n", stray=True):
    rnd = random.Random(seed)
    out = ['"first\nname","b;""x""",c' if seed % 2 else "a,b,c"]
    for _ in range(rows):
        kind, fields = rnd.random(), []
        for _ in range(3 if kind < 0.8 else rnd.randint(1, 5)):
            k = rnd.random()
            word = "".join(rnd.choice("xyé 12") for _ in range(rnd.randint(0, 6)))
            if k < 0.35:
                body = word + rnd.choice(["\n", "\r\n", ",", '""', "\n\n,\n", "\r", 'a""\n""']) * rnd.randint(0, 3) + word
                fields.append(f'"{body}"' + (word.strip() if stray and rnd.random() < 0.1 else ""))
            elif k < 0.45 and stray:
                fields.append("q" + word + '"' + word)
            else:
                fields.append(word)
        out.append(",".join(fields))
        if rnd.random() < 0.05:
            out.append("")
    return end.join(out) + rnd.choice(["", end])


@pytest.mark.parametrize("seed, end", [(0, "\n"), (1, "\r\n"), (2, "\r\n"), (3, "\n"), (4, "\r")])
def test_equal_to_csv_for_any_split(spark, tmp_path, split, seed, end):
    data = ("﻿" if seed == 2 else "").encode() + made(seed, 50, end).encode() + (b"\xff\xfe,z\xe9\n" if seed == 3 else b"")
    (tmp_path / "f.csv").write_bytes(data)
    names, good, n_bad = expected(data, ",")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    for size, batch in ((23, 3), (150, 1), (1 << 20, 7)):
        split(size, batch)
        rows, bad = scan_delimited(spark, str(tmp_path / "f.csv"), multi_line=True, schema=schema)
        assert rows.columns == names
        assert sorted((tuple(r) for r in rows.collect()), key=str) == good, (size, batch)
        assert bad.count() == n_bad
        if size == 150 and end != "\r":
            assert rows.rdd.getNumPartitions() > 4


def test_long_field_over_many_blocks(spark, tmp_path, split):
    data = 'k,text\n1,"' + "line, with \"\"quotes\"\"\n" * 400 + '"\n2,x\n3,"open\nto the end,\n'
    (tmp_path / "f.csv").write_text(data)
    for size, batch in ((100, 5), (1 << 20, 10)):
        split(size, batch)
        rows, bad = scan_delimited(spark, str(tmp_path / "f.csv"), multi_line=True)
        got = {r["k"]: r["text"] for r in rows.collect()}
        assert got == {1: 'line, with "quotes"\n' * 400, 2: "x"}
        assert [r["line"] for r in bad.collect()] == ['3,"open\nto the end,']


def test_types_files_and_bad_lines(spark, tmp_path, split):
    split(25, 2)
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"p{i}.csv").write_text(f'i;big;x;d;t;b;"a\nb";a\n{i};{2**40};1.5;1d;2024-01-0{i + 1};true;"u\nv";\n\n7;1;;2;;FALSE;w\n1;2;3;4;5;6;7;8;"n\nine"\n')
    rows, bad = scan_delimited(spark, str(tmp_path / "in"), sep=";", multi_line=True)
    assert [(f.name, f.dataType.simpleString()) for f in rows.schema.fields] == [
        ("i", "int"), ("big", "bigint"), ("x", "double"), ("d", "string"), ("t", "timestamp"), ("b", "boolean"), ("a\nb", "string"), ("a", "string")]
    assert sorted((r["i"], r["big"], r["d"], r["a\nb"], r["a"]) for r in rows.collect()) == sorted(
        [(i, 2**40, "1d", "u\nv", None) for i in range(3)] + [(7, 1, "2", "w", None)] * 3)
    assert [r["line"] for r in bad.collect()] == ['1;2;3;4;5;6;7;8;"n\nine"'] * 3


def test_empty_and_header_only(spark, tmp_path, split):
    for text, n in (("", 0), ("\n\n", 0), ("\n\na,b\n", 2), ('"a', 0)):
        path = tmp_path / f"e{len(text)}{n}.csv"
        path.write_text(text)
        rows, bad = scan_delimited(spark, str(path), multi_line=True)
        assert rows.count() == 0 and len(rows.columns) == n
        assert bad.count() == 0
    with pytest.raises(ValueError):
        scan_delimited(spark, str(path), multi_line=True, encoding="UTF-16")


def test_latin_1(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes('é,b\n"ü\nö",2\n'.encode("latin-1"))
    rows, _ = scan_delimited(spark, str(tmp_path / "l.csv"), multi_line=True, encoding="ISO-8859-1")
    assert rows.columns == ["é", "b"] and [tuple(r) for r in rows.collect()] == [("ü\nö", 2)]


def test_cutter_states():
    cut = _Cutter(",", "utf-8", "ignore")
    assert cut.records(["a,b\n", '"x\n', "y\n"], False) == ([(["a", "b"], 0, 1), (["x\ny\n\x1f end of block"], 1, 3)], True)
    assert cut.records(["a,b\n", 'x",1\n', "y\n"], True) == ([(["a,b\nx", "1"], 0, 2), (["y"], 2, 3)], False)
