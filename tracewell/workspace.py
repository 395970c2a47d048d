"""The folder that all of a cluster's machines share, and cutting lineage in it."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; a folder of our own only where it names none and all runs in one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and not now.isDefined() and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not now.isDefined():
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tracewell-"))
    return (named or spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder: later steps neither repeat what led to them nor depend on an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As `cut`, as a compressed table under `tracewell`: for rows of an iteration by the million, of which a checkpoint would write several times the bytes. `sweep` removes it."""
    path = f"{shared_dir(df.sparkSession)}/tracewell/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, hours: float) -> list[str]:
    """Removes what runs left under `tracewell` in the shared folder and did not change for so many hours: tables that lazy results read, of jobs that broke off or are long read. Returns the paths. No result that is still to be read may be as old."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tracewell")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = (time.time() - hours * 3600) * 1000
    gone = [s.getPath() for s in files.listStatus(path) if _newest(files, s) < old] if files.exists(path) else []
    for p in gone:
        files.delete(p, True)
    return [p.toString() for p in gone]


def _newest(files, status) -> int:
    """The last change of a folder or of the tables in it, in milliseconds."""
    inner = files.listStatus(status.getPath()) if status.isDirectory() else []
    return max([status.getModificationTime(), *(s.getModificationTime() for s in inner)])
