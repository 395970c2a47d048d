"""Helpers that the operators of this folder share: scratch tables, batches of texts, hold-out rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import shared_dir

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written once in the shared folder, so that a lost executor costs a reread and no recomputation."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tracewell/{tag}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path := f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Deletes a table, those whose names fit a pattern, or all."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in files.globStatus(path) or []:
            files.delete(found.getPath(), True)


def in_fold(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def with_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, null texts as empty ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def groups(lengths: list[int] | np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of neighbours whose lengths add up to about `most`; a longer one stands alone."""
    start, total = 0, 0
    for k, n in enumerate(lengths):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_groups(batch: pa.RecordBatch, most: int, name: str = "text") -> Iterator[tuple[int, int, list[str]]]:
    """(first row, row after the last, texts) of runs of rows of about `most` bytes of text; nulls as empty texts. Only one run is held as Python strings at a time."""
    texts = column(batch, name)
    for x, y in groups(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), most):
        yield x, y, [t or "" for t in texts[x:y].to_pylist()]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
