"""Saving models that hold tables, alone or as a stage of a ``PipelineModel``.

A model gives its settings and its tables by ``side_tables``, the models it is made of by ``side_models``, and is made again
by ``from_tables``. The settings are written as the metadata that a pipeline's reader looks for, each table as
Parquet and each model in its own form beside it.
"""

from __future__ import annotations

import importlib
import os

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession


def _class(name: str):
    module, _, cls = name.rpartition(".")
    return getattr(importlib.import_module(module), cls)


class SideTables(MLWritable, MLReadable):
    def side_tables(self, spark: SparkSession) -> tuple[dict, dict[str, DataFrame]]:
        raise NotImplementedError

    def side_models(self) -> dict:
        return {}

    @classmethod
    def from_tables(cls, meta: dict, tables: dict[str, DataFrame], models: dict | None = None):
        raise NotImplementedError

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: SideTables):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        meta, tables = self.instance.side_tables(spark)
        models = self.instance.side_models()
        kinds = {name: f"{type(m).__module__}.{type(m).__name__}" for name, m in models.items()}
        DefaultParamsWriter.saveMetadata(self.instance, path, spark, extraMetadata={"settings": meta, "tables": sorted(tables), "models": kinds})
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(os.path.join(path, name))
        for name, m in models.items():
            m.write().overwrite().save(os.path.join(path, name))


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.getActiveSession()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        tables = {name: spark.read.parquet(os.path.join(path, name)) for name in meta["tables"]}
        models = {name: _class(kind).load(os.path.join(path, name)) for name, kind in meta["models"].items()}
        model = self.cls.from_tables(meta["settings"], tables, models) if models else self.cls.from_tables(meta["settings"], tables)
        model._resetUid(meta["uid"])
        return model
