"""Vectors by content address, put by any number of jobs at once.

Each put is a folder of its own, seen when its marker of success is there; a key that two puts hold has the same vector in both, so readers take either. Within a put, rows lie by model and by the first
two digits of the key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embedding import Embedder, embed_with_cache
from ..workspace import cut

ROWS = "cache_key string, vector array<double>, fingerprint string, shard string"


class EmbeddingCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _puts(self) -> list[str]:
        if not self._fs.exists(self._path(self.path)):
            return []
        folders = [s.getPath() for s in self._fs.listStatus(self._path(self.path)) if s.isDirectory()]
        return sorted(f.toString() for f in folders if self._fs.exists(self._path(f, "_SUCCESS")))

    def read(self, fingerprint: str) -> DataFrame:
        """cache_key and vector of a model, each key once."""
        puts = self._puts()
        if not puts:
            return self.spark.createDataFrame([], ROWS).select("cache_key", "vector")
        rows = None
        for p in puts:
            one = self.spark.read.schema(ROWS).parquet(p)
            rows = one if rows is None else rows.unionByName(one)
        return rows.where(F.col("fingerprint") == fingerprint).select("cache_key", "vector").dropDuplicates(["cache_key"])

    def put(self, vectors: DataFrame, fingerprint: str) -> None:
        """vectors: cache_key, vector. Null keys and vectors are left out; of rows of one key one is kept."""
        kept = vectors.where(F.col("cache_key").isNotNull() & F.col("vector").isNotNull()).dropDuplicates(["cache_key"])
        rows = kept.select("cache_key", F.col("vector").cast("array<double>").alias("vector"), F.lit(fingerprint).alias("fingerprint"), F.substring("cache_key", 1, 2).alias("shard"))
        rows.repartition("shard").write.partitionBy("fingerprint", "shard").parquet(f"{self.path}/put-{uuid.uuid4().hex}")

    def embed(self, chunks: DataFrame, fingerprint: str, dim: int, embedder: Embedder) -> DataFrame:
        """All chunks (blob_sha, node_path, text) with a vector, and `reused`; what was not there is embedded once, and put."""
        done = cut(embed_with_cache(chunks, self.read(fingerprint), fingerprint, dim, embedder))
        fresh = done.where(~F.col("reused"))
        if fresh.head(1):
            self.put(fresh.select("cache_key", F.col("embedding").alias("vector")), fingerprint)
        return done

    def compact(self) -> None:
        """All puts as one; the old ones go once the new one is there. No other job may compact meanwhile; puts and reads may go on, if a reader tries again when its files have gone."""
        old = self._puts()
        if len(old) < 2:
            return
        rows = None
        for p in old:
            one = self.spark.read.schema(ROWS).parquet(p)
            rows = one if rows is None else rows.unionByName(one)
        rows.dropDuplicates(["fingerprint", "cache_key"]).repartition("shard").write.partitionBy("fingerprint", "shard").parquet(f"{self.path}/put-{uuid.uuid4().hex}")
        for p in old:
            self._fs.delete(self._path(p), True)


