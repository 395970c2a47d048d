"""A log of outcomes, written by streams: `writeStream.format("outcomes").option("path", folder)`, one JSON line a row.

Tasks write files of their own; a batch is in the log when its list of files stands under its number. A batch that comes again finds its
list and leaves the log as it is, and files that no list names are nobody's: `sweep` removes them.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from .payloads import place


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class OutcomeWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, at = place(self.folder)
        name, n = f"part-{uuid.uuid4().hex}.jsonl", 0
        fs.create_dir(posixpath.join(at, "parts"), recursive=True)
        with fs.open_output_stream(posixpath.join(at, "parts", name)) as f:
            for row in iterator:
                f.write((json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False, separators=(",", ":")) + "\n").encode())
                n += 1
        return Written(name, n)

    def commit(self, messages: list, batchId: int) -> None:
        fs, at = place(self.folder)
        listed = posixpath.join(at, "batches", f"{batchId:010d}")
        if fs.get_file_info(listed).type == pafs.FileType.File:  # came before
            return self.abort(messages, batchId)
        fs.create_dir(posixpath.join(at, "batches"), recursive=True)
        draft = posixpath.join(at, "batches", f".{batchId:010d}")
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps([m.file for m in messages if m and m.rows]).encode())
        fs.move(draft, listed)
        return None

    def abort(self, messages: list, batchId: int) -> None:
        fs, at = place(self.folder)
        for m in messages:
            if m:
                fs.delete_file(posixpath.join(at, "parts", m.file))


class OutcomeLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outcomes"

    def streamWriter(self, schema, overwrite: bool) -> OutcomeWriter:
        return OutcomeWriter(dict(self.options))


def append(results: DataFrame, folder: str, checkpoint: str):
    """A writer of a stream's rows to the log; call start() on it."""
    results.sparkSession.dataSource.register(OutcomeLog)
    return results.writeStream.format("outcomes").option("path", folder).option("checkpointLocation", checkpoint)


def _listed(folder: str) -> tuple[pafs.FileSystem, str, list[str]]:
    fs, at = place(folder.rstrip("/"))
    names = []
    for f in sorted(fs.get_file_info(pafs.FileSelector(posixpath.join(at, "batches"), allow_not_found=True)), key=lambda f: f.base_name):
        if f.base_name.isdigit():
            with fs.open_input_stream(f.path) as s:
                names += json.loads(s.read())
    return fs, at, names


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The log's rows: those of files that lists name."""
    _, _, names = _listed(folder)
    return spark.read.schema(schema).json([f"{folder.rstrip('/')}/parts/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def sweep(folder: str) -> int:
    """Removes files that no list names, as of tasks that failed; no stream may be writing. Returns their number."""
    fs, at, names = _listed(folder)
    gone = [f.path for f in fs.get_file_info(pafs.FileSelector(posixpath.join(at, "parts"), allow_not_found=True)) if f.base_name not in set(names)]
    for path in gone:
        fs.delete_file(path)
    return len(gone)
