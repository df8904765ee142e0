"""Fitted stages whose state is a small table: saved as ML metadata and one
Parquet table, so that they live in ``Pipeline``s like MLlib's own."""

from __future__ import annotations

import os

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import SparkSession


class TableWriter(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.stage, path, spark)
        spark.createDataFrame(self.stage.rows, self.stage.SCHEMA).coalesce(1).write.parquet(os.path.join(path, "data"))


class TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.getActiveSession()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.schema(self.cls.SCHEMA).parquet(os.path.join(path, "data")).collect()
        out = self.cls([tuple(r) for r in rows])
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out


class TableModel(Model, MLWritable, MLReadable):
    """A model of ``rows`` by the columns of ``SCHEMA`` (bounded by the model)."""

    SCHEMA = ""

    def __init__(self, rows: list[tuple] | None = None):
        super().__init__()
        self.rows = sorted(rows or [])

    def write(self):
        return TableWriter(self)

    @classmethod
    def read(cls):
        return TableReader(cls)

    def copy(self, extra=None):
        out = super().copy(extra)
        out.rows = self.rows
        return out
