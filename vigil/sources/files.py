"""Sources and sinks (S1-S9) and the row key helper."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import q

_CORRUPT = "_corrupt_record"
REPLACEMENT_CHAR = "�"


def scan_delimited(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None,
                   bad_lines: str = "skip", on_bad_bytes: str = "ignore", encoding: str = "UTF-8",
                   multi_line: bool = False):
    """Delimited text with a header row and inferred (or given) types.

    - lines with more fields than the header are dropped (``bad_lines='skip'``) and
      returned separately; lines with fewer fields are padded with NULL;
    - bytes that are not valid UTF-8 are removed (``on_bad_bytes='ignore'``);
    - quoted fields may hold separators; with ``multi_line`` also line breaks: see ``quoted.scan_quoted``, which
      still reads a file by many tasks.

    Returns ``(df, bad_lines_df)``; ``bad_lines_df`` has one column ``line``.
    """
    if multi_line:
        from .quoted import scan_quoted
        return scan_quoted(spark, path, sep, schema, encoding, on_bad_bytes)
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding) \
        .option("escape", '"')
    if schema is None:
        # Inference pass over the text; for production pass an explicit schema.
        inferred = reader.option("inferSchema", True).option("mode", "PERMISSIVE").csv(path).schema
        schema = T.StructType([f for f in inferred.fields if f.name != _CORRUPT])
    full = T.StructType(list(schema.fields) + [T.StructField(_CORRUPT, T.StringType(), True)])
    raw = (reader.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
           .csv(path))
    # A corrupt record is kept when it lacks fields (padding) or a value does not parse; one with
    # more fields than the header is a bad line. Quoted text may hold separators: it is cut first.
    outside = F.regexp_replace(F.col(_CORRUPT), '"([^"]|"")*"', "")
    n_fields = F.length(outside) - F.length(F.replace(outside, F.lit(sep), F.lit(""))) + F.lit(len(sep))
    # an empty piece of all columns: a query that reads few columns, or the corrupt record alone (which Spark
    # refuses), would count the fields of a line differently
    other = F.substring(F.concat_ws("", *[q(f.name).cast("string") for f in schema.fields]), 1, 0)
    too_many = F.coalesce(n_fields + F.length(other) > F.lit(len(sep) * len(schema.fields)), F.lit(False))
    good = raw.where(~too_many).drop(_CORRUPT)
    bad = raw.where(too_many).select(F.col(_CORRUPT).alias("line"))
    if on_bad_bytes == "ignore":
        good = good.select(*[
            (F.translate(q(f.name), REPLACEMENT_CHAR, "") if isinstance(f.dataType, T.StringType) else q(f.name)).alias(f.name)
            for f in good.schema.fields])
    return good, bad


def load_rules(spark: SparkSession, source) -> DataFrame:
    """Data dictionary from a CSV/Parquet path or an existing DataFrame, all strings."""
    from .fixtures import RULE_COLUMNS, RULES_SCHEMA
    if isinstance(source, DataFrame):
        df = source
    elif str(source).endswith(".parquet"):
        df = spark.read.parquet(source)
    else:
        df = spark.read.option("header", True).schema(RULES_SCHEMA).csv(source)
    return df.select(*[q(c).cast("string").alias(c) for c in df.columns])


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    return spark.read.parquet(path)


def scan_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S5."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def with_row_key(df: DataFrame, order_by: str | None = None, name: str = "row_key") -> DataFrame:
    """Stable 1-based row key.

    With ``order_by`` (unique values) the key is a distributed row number (G1) over that column.
    Without it the key is the position in file order: files by path, their blocks by offset, rows as
    read. Rows are counted per scanned block (one row a block to the driver); no row is moved. A
    DataFrame that reads no file is numbered in partition order.
    """
    from ..functions.ranking import row_number
    if order_by is not None:
        return row_number(df, order_by, name=name)
    spark = df.sparkSession
    d = df.withColumns({"__mid": F.monotonically_increasing_id(), "__file": F.input_file_name(),
                        "__at": F.input_file_block_start(), "__part": F.spark_partition_id()})
    blocks = d.groupBy("__file", "__at", "__part").agg(F.count(F.lit(1)).alias("n"), F.min("__mid").alias("first")).collect()
    starts, n = [], 0
    for b in sorted(blocks, key=lambda r: (r["__file"], r["__at"], r["__part"])):
        starts.append((b["__file"], b["__at"], b["__part"], n + 1 - b["first"]))
        n += b["n"]
    shift = spark.createDataFrame(starts, "__file string, __at long, __part int, __shift long")
    d = d.join(F.broadcast(shift), ["__file", "__at", "__part"])  # one row a scanned block
    return d.select(*[q(c) for c in df.columns], (F.col("__mid") + F.col("__shift")).alias(name))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S7."""
    df.write.mode(mode).option("header", True).csv(path)


_UNSAFE = re.compile(r"[/\\ :]")


def safe_name(name: str) -> str:
    return _UNSAFE.sub("_", name)


def write_split(df: DataFrame, target: str, directory: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """train/test rows of one target, partitioned by ``split``."""
    path = f"{directory.rstrip('/')}/{safe_name(target)}"
    df.write.mode(mode).partitionBy("split").format(fmt).option("header", True).save(path)
    return path


def save_model(model, path: str) -> None:
    """S9."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """S9."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
