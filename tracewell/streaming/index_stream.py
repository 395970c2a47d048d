"""The chunk index kept up from a stream of files, and a watch over queries that stand still."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.chunking import CHUNK_SCHEMA, INDEX_CHARS, chunk_files
from ..operators.embedding import Embedder, bag_of_words
from ..operators.sets import upsert
from ..sources.versioned import VersionedTable


class Stalled(RuntimeError):
    pass


def index_batch(table: VersionedTable, files: DataFrame, embedder: Embedder = bag_of_words, most: int = INDEX_CHARS) -> None:
    """One batch of file versions (path, blob_sha, content; null content: deleted): chunks of new blobs in, those of replaced ones out.

    A batch that is run again after a failure gives the same table, as chunks are keyed by content.
    """
    latest = files.groupBy("path").agg(F.max_by(F.struct("blob_sha", "content"), "seq").alias("f")).select("path", "f.*")
    fresh = chunk_files(latest.where(F.col("content").isNotNull()), most).dropDuplicates(["key"]).withColumn("embedding", embedder(F.col("text")))
    v = table.version()
    old = table.read(v)
    if old is None:
        old = files.sparkSession.createDataFrame([], CHUNK_SCHEMA + ", embedding array<double>")
    table.write(upsert(old.join(latest.select("path"), "path", "left_anti"), fresh, "key"), v)


def index_stream(files: DataFrame, table: VersionedTable, checkpoint: str, embedder: Embedder = bag_of_words, **trigger) -> StreamingQuery:
    """files: path, blob_sha, content, seq, as a stream."""
    write = files.writeStream.foreachBatch(lambda df, _: index_batch(table, df, embedder)).option("checkpointLocation", checkpoint)
    return write.trigger(**(trigger or {"availableNow": True})).start()


def await_progress(query: StreamingQuery, patience: float = 900.0, step: float = 1.0) -> None:
    """Waits for a query's end; one that makes no batch for so many seconds is stopped, and that is an error."""
    last, since = None, time.monotonic()
    while not query.awaitTermination(step):
        done = (query.lastProgress or {}).get("batchId")
        if done != last:
            last, since = done, time.monotonic()
        elif time.monotonic() - since > patience:
            query.stop()
            raise Stalled(f"no batch for {patience:g} s")
