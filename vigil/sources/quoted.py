"""Delimited text with line breaks inside quotes, read by many tasks a file.

Spark cuts a file into blocks of lines; whether a block begins inside a quoted field depends on all
text before it. Each task therefore reads its block once for both cases and reports in which state
either ends: a map of two states. Composing the maps of the blocks before it (one row a block) gives the
state a block really starts in, and a second pass parses all blocks at once. Only records that reach over a block's end
are put together afterwards, from the pieces that their blocks hold.

A record, a quote and a line end are what Python's ``csv`` module (default dialect) takes them for.
"""

from __future__ import annotations

import codecs
import csv
import re
import sys
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import q
from ..session import ensure_checkpoint_dir

LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)")
END = "\x1f end of block"  # read after the last line: a record of its own, unless a quote is open
BROADCAST_BLOCKS = 500_000  # blocks that begin inside quotes; more of them are joined by a shuffle
STATES = "file string, block long, exit0 boolean, exit1 boolean, closes boolean, any0 boolean, head string"
PARSED = ("fields array<string>, raw string, file string, owner long, block long, seq int, header boolean, closed boolean")
#: types tried in this order for a column without a given type, and how their values are written
INFERRED = [(T.IntegerType(), r"^\s*[+-]?\d+\s*$"), (T.LongType(), r"^\s*[+-]?\d+\s*$"),
            (T.DoubleType(), r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NaN|nan|Infinity|inf)\s*$"),
            (T.TimestampType(), r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"), (T.BooleanType(), r"(?i)^\s*(true|false)\s*$")]


def _written(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of all files; a block is the place in its file of what one task reads in a row."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.col("value").cast("binary").alias("value"))


class _Cutter:
    """Cuts physical lines into records."""

    def __init__(self, sep: str, encoding: str, errors: str):
        csv.field_size_limit(sys.maxsize)
        self.sep, self.encoding, self.errors = sep, encoding, errors

    def lines(self, rows: list[bytes], start: bool) -> list[str]:
        """Physical lines with their ends of rows that Spark cut at ``\\n``; ``start``: they begin a file."""
        out = []
        for i, row in enumerate(rows):
            text = row.decode(self.encoding, self.errors) + "\n"
            if start and i == 0:
                text = text.removeprefix("﻿")
            out += [text] if "\r" not in text else LINE.findall(text)
        return out

    def records(self, lines: list[str], inside: bool) -> tuple[list[tuple[list[str], int, int]], bool]:
        """Records (fields, first line, line after the last) of ``lines`` and whether the last is still open.
        ``inside``: the first line goes on a quoted field."""
        feed = ['"' + lines[0], *lines[1:]] if inside else lines
        reader, out, at = csv.reader(chain(feed, [END]), delimiter=self.sep), [], 0
        for fields in reader:
            out.append((fields, at, reader.line_num))
            at = reader.line_num
        open_ = out[-1][0] != [END]
        if open_:
            fields, first, _ = out[-1]
            out[-1] = (fields, first, len(lines))
            return out, True
        return out[:-1], False

    def one(self, raw: str) -> list[str]:
        """The fields of one whole record."""
        return next(csv.reader(LINE.findall(raw), delimiter=self.sep))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[bytes], bool]]:
    """(all columns but the last, rows of the last, whether they begin the block) in order, a batch and block each."""
    last = None
    for b in batches:
        keys, at = list(zip(*(c.to_pylist() for c in b.columns[:-1]))), 0
        for key, run in groupby(keys):
            n = sum(1 for _ in run)
            yield key, b.column(b.num_columns - 1).slice(at, n).to_pylist(), key != last
            last, at = key, at + n


def _states(spark: SparkSession, path: str, cutter: dict) -> DataFrame:
    """A row a block: the state it ends in from either state (``exit0``, ``exit1``), whether an open quote ends in it
    (``closes``), whether a record that is not blank starts in it from outside (``any0``), and the first such record
    of a file's first block (``head``)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, key, s = _Cutter(**cutter), None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*key, *s], types)], names=names)

        names = ["file", "block", "exit0", "exit1", "closes", "any0", "head"]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
        for (file, block), rows, begins in _blocks(batches):
            if begins:
                if key is not None:
                    yield done()
                key, s = (file, block), [False, True, False, False, None]
            lines = cut.lines(rows, begins and block == 0)
            quoted, ends = any('"' in x for x in lines), {}
            for inside in {s[0], s[1]}:
                if quoted or (not inside and not s[3] and block == 0):
                    found, open_ = cut.records(lines, inside)
                else:
                    found, open_ = [([x.strip("\r\n")], 0, 0) for x in lines[:0 if inside else None] if x.strip("\r\n")], inside
                ends[inside] = found, open_
            found, open_ = ends[s[1]]
            s[2] = s[2] or (s[1] and (not open_ or len(found) > 1))
            s[1] = open_
            found, open_ = ends[s[0]]
            if not s[3]:
                first = next((k for k, r in enumerate(found) if r[0]), None)
                s[3] = first is not None
                if s[3] and block == 0 and not (open_ and first == len(found) - 1):
                    s[4] = "".join(lines[found[first][1]:found[first][2]])
            s[0] = open_
        if key is not None:
            yield done()

    return _lines(spark, path).mapInArrow(scan, STATES)


def _entries(states: DataFrame) -> DataFrame:
    """The state every block starts in (``inside``), whether it holds its file's header (``first``), whether it leaves a record
    of its own open (``opens``), and the block in which the record was opened that it goes on with (``owner``)."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    flips = F.sum((F.col("exit0") & ~F.col("exit1")).cast("long"))
    d = states.withColumn("flips", flips.over(upto))
    known = F.last(F.when(F.col("exit0") == F.col("exit1"), F.struct("exit0", "flips")), ignorenulls=True)
    d = d.withColumns({"known": known.over(before), "turned": F.coalesce(flips.over(before), F.lit(0))})
    odd = (F.col("turned") - F.coalesce(F.col("known.flips"), F.lit(0))) % 2 == 1
    d = d.withColumn("inside", F.coalesce(F.col("known.exit0"), F.lit(False)) != odd)
    opens = F.when(F.col("inside"), F.col("exit1") & F.col("closes")).otherwise(F.col("exit0"))
    d = d.withColumn("opens", opens)
    d = d.withColumn("owner", F.last(F.when(F.col("opens"), F.col("block")), ignorenulls=True).over(before))
    first = F.min(F.when(F.col("any0"), F.col("block"))).over(Window.partitionBy("file"))
    return d.select("file", "block", "inside", F.coalesce(F.col("block") == first, F.lit(False)).alias("first"), "owner", "opens", "head")


def _parse(lines: DataFrame, cutter: dict, width: int) -> DataFrame:
    """PARSED rows of (file, block, inside, first, owner, value) in file order: whole records without an owner (``fields``
    null: more than ``width``), and pieces of records that reach over a block's end."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, out = _Cutter(**cutter), []
        file = block = owner = None
        types = [pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
        names = ["fields", "raw", "file", "owner", "block", "seq", "header", "closed"]
        pending, inside, mine, header, seq = [], False, False, False, 0  # mine: the open record began in this block

        def flush():
            cols = list(zip(*out)) or [()] * len(types)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
            out.clear()
            return batch

        def record(fields, raw):
            nonlocal header
            if fields and header:
                header = False
            elif fields:
                wide = len(fields) > width
                out.append((None if wide else [f or None for f in fields] + [None] * (width - len(fields)),
                            raw().rstrip("\r\n") if wide else None, file, None, block, 0, False, True))

        def piece(raw, to, closed, head):
            nonlocal seq
            out.append((None, raw, file, to, block, seq, head, closed))
            seq += 1

        def leave():  # what is open at a block's end
            if mine and pending:
                piece("".join(pending), block, False, header)

        for (f, b, in_, first, own), rows, begins in _blocks(batches):
            if begins:
                leave()
                file, block, owner, inside, header, pending, mine, seq = f, b, own, bool(in_), bool(first), [], False, 0
            lines = cut.lines(rows, begins and b == 0)
            found, open_ = cut.records(lines, inside)
            if inside:  # the record that was open goes on
                _, _, end = found.pop(0)
                closed = bool(found) or not open_
                if mine:
                    pending += lines[:end]
                    if closed:
                        raw = "".join(pending)
                        record(cut.one(raw), lambda raw=raw: raw)
                        pending, mine = [], False
                else:
                    piece("".join(lines[:end]), owner, closed, False)
                if not closed:
                    yield flush()
                    continue
            if open_:
                _, at, _ = found.pop()
                pending, mine = lines[at:], True
            inside = open_
            for fields, a, z in found:
                record(fields, lambda a=a, z=z: "".join(lines[a:z]))
            yield flush()
        leave()
        yield flush()

    return lines.mapInArrow(parse, PARSED)


def _assemble(pieces: DataFrame, cutter: dict, width: int) -> DataFrame:
    """PARSED rows of the records whose pieces lie in several blocks; one whose quote never ends is a bad line."""
    whole = pieces.groupBy("file", "owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "raw"))), lambda p: p["raw"]), "").alias("raw"),
        F.max("header").alias("header"), F.max("closed").alias("closed"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _Cutter(**cutter)
        for b in batches:
            fields, raws = [], []
            for raw, closed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = cut.one(raw) if closed else None
                good = got is not None and len(got) <= width
                fields.append([f or None for f in got] + [None] * (width - len(got)) if good else None)
                raws.append(None if good else raw.rstrip("\r\n"))
            yield pa.RecordBatch.from_arrays([pa.array(fields, pa.list_(pa.string())), pa.array(raws, pa.string())], names=["fields", "raw"])

    return whole.where("not header or not closed").select("raw", "closed").mapInArrow(parse, "fields array<string>, raw string")


def _names(fields: list[str]) -> list[str]:
    out = []
    for i, f in enumerate(fields):
        name, n = f or f"Unnamed: {i}", 0
        while name in out:
            n += 1
            name = f"{f}.{n}"
        out.append(name)
    return out


def infer_types(df: DataFrame) -> T.StructType:
    """The first of ``INFERRED`` that all values of a string column have, else string: one aggregate over all columns."""
    fits = lambda c, t, form: q(c).rlike(form) & q(c).try_cast(t).isNotNull()
    no = [F.count_if(q(c).isNotNull() & ~fits(c, *kind)).alias(f"c{i}_{j}") for i, c in enumerate(df.columns) for j, kind in enumerate(INFERRED)]
    row = df.agg(*no, *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    kinds = [next((t for j, (t, _) in enumerate(INFERRED) if row[f"n{i}"] and not row[f"c{i}_{j}"]), T.StringType()) for i in range(len(df.columns))]
    return T.StructType([T.StructField(c, t) for c, t in zip(df.columns, kinds)])


def _header(spark: SparkSession, path: str, entries: DataFrame, cutter: dict) -> list[str] | None:
    """Fields of the first file's first record that is not blank."""
    at = entries.where("first").orderBy("file").first()
    if at is None:
        return None
    cut = _Cutter(**cutter)
    if at["head"] is not None:
        return cut.one(at["head"])
    # it stands in a later block or goes on there: the first lines in order, more until it is whole
    lines, n = _lines(spark, path).where(F.col("file") == at["file"]).withColumn("at", F.monotonically_increasing_id()), 1000
    while True:
        rows = [bytes(r["value"]) for r in lines.orderBy("block", "at").limit(n).collect()]
        found, open_ = cut.records(cut.lines(rows, True), False)
        first = next((k for k, r in enumerate(found) if r[0]), len(found))
        if first < len(found) - open_:
            return found[first][0]
        if len(rows) < n:
            return None
        n *= 4


def scan_quoted(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None, encoding: str = "UTF-8",
                on_bad_bytes: str = "ignore") -> tuple[DataFrame, DataFrame]:
    """``(rows, bad lines)`` of delimited files with a header each, whose quoted fields may hold separators, line ends and
    doubled quotes; a file is read by as many tasks as it has blocks.

    Blank lines are skipped, missing fields and empty ones are NULL, a byte order mark is dropped. A record with more fields
    than the header, or whose quote is not closed by the end of its file, is a bad line (``line``: its
    text). Values that do not parse as the type of ``schema`` are NULL; without a schema types are inferred from
    all rows. Bytes that ``encoding`` cannot read are removed, or replaced unless ``on_bad_bytes`` is ``ignore``; the
    encoding must write line ends as ASCII does. The state of the blocks is computed at the call.
    """
    if codecs.encode('\n\r"' + sep, encoding) != ('\n\r"' + sep).encode("ascii"):
        raise ValueError(f"files in {encoding} cannot be cut at line ends")
    cutter = {"sep": sep, "encoding": encoding, "errors": "ignore" if on_bad_bytes == "ignore" else "replace"}
    entries = _written(_entries(_states(spark, path, cutter)))
    header = _header(spark, path, entries, cutter)
    if header is None:
        fields = schema or T.StructType([])
        return spark.createDataFrame([], fields), spark.createDataFrame([], "line string")
    width, names = len(header), _names(header)
    if schema is not None:
        names, width = schema.names, len(schema)
    known = entries.where("inside or first").select(F.col("file").alias("__f"), F.col("block").alias("__b"), "inside", "first", "owner")
    counts = entries.agg(F.count_if("opens").alias("opens"), F.count_if(F.col("inside") | F.col("first")).alias("known")).first()
    lines = _lines(spark, path)
    on = (F.col("file") == F.col("__f")) & (F.col("block") == F.col("__b"))
    if counts["known"] <= BROADCAST_BLOCKS:
        lines = lines.join(F.broadcast(known), on, "left")
    else:
        lines = lines.withColumn("__at", F.monotonically_increasing_id()).join(known, on, "left")
        lines = lines.repartition("file", "block").sortWithinPartitions("file", "block", "__at")
    parsed = _parse(lines.select("file", "block", "inside", "first", "owner", "value"), cutter, width)
    whole = parsed.where("owner is null").select("fields", "raw")
    if counts["opens"]:
        pieces = _written(_assemble(parsed.where("owner is not null"), cutter, width))
        whole = whole.union(pieces)
    text = whole.where("fields is not null").select(*[F.col("fields")[i].alias(n) for i, n in enumerate(names)])
    kinds = schema or infer_types(text)
    rows = text.select(*[(q(f.name) if isinstance(f.dataType, T.StringType) else q(f.name).try_cast(f.dataType)).alias(f.name) for f in kinds.fields])
    return rows, whole.where("fields is null").select(F.col("raw").alias("line"))
