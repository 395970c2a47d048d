"""Tables in versions: each write is a new folder, and a pointer file names the one that holds.

A writer states the version it read; if the pointer has moved since, the write is refused. So readers
see whole versions only, and two writers can't lose each other's rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.sets import insert_new, upsert


class Conflict(RuntimeError):
    pass


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        folder = self._path(f"{self.path}/_versions")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def version(self) -> int:
        """The number of the version that holds; 0 before the first."""
        return (self._pointers() or [0])[-1]

    def _folder(self, version: int) -> str:
        stream = self._fs.open(self._path(f"{self.path}/_versions/{version:010d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None, schema: str | None = None) -> DataFrame | None:
        """A version's rows, None before the first. schema: for a table by partitions, which says nothing of its columns while it has no rows."""
        version = self.version() if version is None else version
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/{self._folder(version)}") if version else None

    def write(self, df: DataFrame, expected: int, partition_by: list[str] | None = None) -> int:
        """Writes version expected + 1. The pointer is made by an exclusive create, which only one writer can win."""
        folder = f"data-{uuid.uuid4().hex}"
        df.write.partitionBy(*(partition_by or [])).parquet(f"{self.path}/{folder}")
        if self.version() != expected:
            raise Conflict(f"version {expected} was read, {self.version()} holds")
        try:
            out = self._fs.create(self._path(f"{self.path}/_versions/{expected + 1:010d}"), False)
        except Exception as e:
            raise Conflict(f"another writer made version {expected + 1}") from e
        out.write(bytearray(folder.encode()))
        out.close()
        return expected + 1

    def upsert(self, new: DataFrame, key: str | list[str]) -> int:
        v = self.version()
        return self.write(upsert(self.read(v), new, key) if v else new, v)

    def insert_new(self, new: DataFrame, key: str) -> int:
        v = self.version()
        return self.write(insert_new(self.read(v), new, key) if v else new.dropDuplicates([key]), v)

    def delete(self, keys: DataFrame, key: str) -> int:
        v = self.version()
        return self.write(self.read(v).join(keys.select(key), key, "left_anti"), v)
