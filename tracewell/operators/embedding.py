"""Embeddings: the built-in bag of words, the cache, and where other embedders plug in."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key

Embedder = Callable[[Column], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bag_of_words(text: Column, dim: int = 32) -> Column:
    """Words of a-z, 0-9 and _, each in the bucket that the first byte of its SHA-256 names; counts at unit length; without words the first unit vector."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    # a word a bucket digit: counting them is one pass of string functions over the row
    marks = F.concat_ws("", F.transform(w, lambda x: F.concat(F.lit("<"), (F.conv(F.substring(F.sha2(x, 256), 1, 2), 16, 10).cast("int") % dim).cast("string"), F.lit(">"))))
    first = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(dim)])

    def counts(m: Column) -> Column:
        return F.array(*[((F.length(m) - F.length(F.replace(m, F.lit(f"<{i}>"), F.lit("")))) / len(f"<{i}>")).cast("double") for i in range(dim)])

    def scaled(c: Column) -> Column:
        return _let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.when(n == 0, first).otherwise(F.transform(c, lambda x: x / n)))

    return _let(_let(marks, counts), scaled)


def bag_of_words_query(text: str, dim: int = 32) -> list[float]:
    """The same for one text on the driver, as of a question."""
    v = [0.0] * dim
    for w in re.findall("[a-z0-9_]+", text.lower()):
        v[hashlib.sha256(w.encode()).digest()[0] % dim] += 1
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else [1.0] + v[1:]


def split_by_cache(chunks: DataFrame, cache: DataFrame, fingerprint: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with a cached vector, chunks without). A cached vector of another length counts as none."""
    keyed = chunks.withColumn("cache_key", cache_key(F.lit(fingerprint), F.col("blob_sha"), F.col("node_path")))
    known = cache.where(F.size("vector") == dim).select("cache_key", F.col("vector").alias("embedding")).dropDuplicates(["cache_key"])
    return keyed.drop("embedding").join(known, "cache_key"), keyed.join(known, "cache_key", "left_anti")


def embed_with_cache(chunks: DataFrame, cache: DataFrame, fingerprint: str, dim: int, embedder: Embedder) -> DataFrame:
    """All chunks with a vector; only those that the cache lacks are embedded. `reused` tells which."""
    keyed = chunks.drop("embedding").withColumn("cache_key", cache_key(F.lit(fingerprint), F.col("blob_sha"), F.col("node_path")))
    known = cache.where(F.size("vector") == dim).select("cache_key", "vector").dropDuplicates(["cache_key"])
    out = keyed.join(known, "cache_key", "left")
    return out.withColumn("reused", F.col("vector").isNotNull()).withColumn("embedding", F.coalesce("vector", embedder(F.col("text")))).drop("vector")
