"""A stored inverted index: postings by term, so that a question reads those of its own words and no text.

Postings are a table partitioned by a hash of the term and sorted by term, with each row's length beside its
count; lengths of all rows are a table of their own, and one more row says how many rows and words there are. Each version is a folder of its own. An update
takes postings of rows that go out and puts those of new rows in; what stays isn't tokenised again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.versioned import VersionedTable
from .retrieval import IDF_FLOOR, K1, B
from .sets import delete

BUCKETS = 256
#: Postings of a bucket in one file, about.
FILE_ROWS = 4_000_000


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """key, term, tf, dl, bucket of each row's words, counted within the row; a row without words has none."""
    w = docs.select(F.col(key).alias("key"), F.array_sort(words(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("w"))
    rows = w.select("key", F.size("w").alias("dl"), F.explode(_runs(F.col("w"))).alias("run"))
    return rows.select("key", "run.term", "run.tf", "dl").withColumn("bucket", _bucket(F.col("term")))


def _runs(w: Column) -> Column:
    """term and tf of each run of equal words in a sorted array."""
    first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    run = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf")))
    # an array of one binds what is used many times, so it is made once
    runs = F.flatten(F.transform(F.array(w), lambda s: F.flatten(F.transform(F.array(first(s)), lambda at: run(s, at)))))
    return F.when(F.size(w) > 0, runs)


def row_lengths(docs: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """key and dl, the number of words, of each row."""
    return docs.select(F.col(key).alias("key"), F.size(words(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("dl"))


class KeywordIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.rows, self.lengths, self.totals = (VersionedTable(spark, f"{path.rstrip('/')}/{n}") for n in ("postings", "lengths", "totals"))

    def _write(self, rows: DataFrame, lengths: DataFrame) -> None:
        """A bucket's postings go to as many files as `FILE_ROWS` asks for, dealt by a hash of the key, so that no word's postings meet in one task.

        They are counted by one more reading of the texts, which writes nothing, so postings are shuffled and written once.
        """
        v, w, u = self.rows.version(), self.totals.version(), self.lengths.version()
        files = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("files"))  # a row a bucket: BUCKETS at most
        dealt = rows.join(F.broadcast(files), "bucket").withColumn("file", F.pmod(F.xxhash64("key"), F.col("files"))).drop("files")
        self.rows.write(dealt.repartition("bucket", "file").sortWithinPartitions("bucket", "file", "term").drop("file"), v, partition_by=["bucket"])
        self.lengths.write(lengths, u)
        self.totals.write(self.lengths.read().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")), w)

    def _postings(self) -> DataFrame | None:
        if not self.rows.version():
            return None
        kind = self.lengths.read().schema["key"].dataType.simpleString()
        return self.rows.read(schema=f"key {kind}, term string, dl int, tf bigint, bucket int")

    def build(self, docs: DataFrame, key: str = "key", text: str = "text") -> None:
        """Anew from all rows. Keys are distinct."""
        self._write(postings(docs, key, text), row_lengths(docs, key, text))

    def update(self, new: DataFrame, gone: DataFrame, key: str = "key", text: str = "text") -> None:
        """Rows of these keys go out (also those that come anew), new rows come in."""
        old = self._postings()
        if old is None:
            return self.build(new, key, text)
        out = gone.select(F.col(key).alias("key")).unionByName(new.select(F.col(key).alias("key"))).distinct()
        return self._write(delete(old, out, "key").unionByName(postings(new, key, text)), delete(self.lengths.read(), out, "key").unionByName(row_lengths(new, key, text)))

    def search(self, query: str, k: int | None) -> DataFrame:
        """key and score of the k best rows (all, if k is None) for any of the query's words, by BM25; less is better. Reads the partitions of these words alone."""
        asked = sorted(set(re.findall(r"\w+", query.lower())))
        rows = self._postings()
        if rows is None:
            raise FileNotFoundError("no index was built")
        if not asked:
            return rows.select("key", F.lit(0.0).alias("score")).where(F.lit(False))
        # bucket numbers come from the same hash; the question's words are a few
        buckets = [r.b for r in self.spark.createDataFrame([(t,) for t in asked], "term string").select(_bucket(F.col("term")).alias("b")).distinct().collect()]
        hits = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(asked)).groupBy("key", "term", "dl").agg(F.sum("tf").alias("tf"))  # rows of one key and length count as one
        df = F.broadcast(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # a row a word of the question
        total = F.broadcast(self.totals.read().select("n", (F.col("words") / F.greatest("n", F.lit(1))).alias("avgdl")))
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        scored = hits.join(df, "term").join(total).groupBy("key").agg((-F.sum(part)).alias("score"))  # one row of totals
        return scored if k is None else scored.orderBy("score", "key").limit(k)
