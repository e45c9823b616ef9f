"""Helpers shared by the corpus operators: shared-folder tables, names, file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


BATCH_BYTES = 4 << 20  # of an Arrow batch that goes to a Python worker
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, unless the user has set a bound: 10 000 long texts at once
    are held several times over, by the executor and by its Python workers."""
    if _BATCH not in spark.conf.getAll and not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder named by ``spark.checkpoint.dir``."""
    bound_batches(spark)
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, so a
    lost executor costs a re-read and never a recomputation."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns, *bases: str) -> list[str]:
    """Helper column names that clash with none of ``columns`` (case-insensitively)."""
    taken = {c.lower() for c in columns}
    out = []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_fs(uri: str):
    """(file system, path) of a URI for use inside tasks, where only the shared folder is visible."""
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
