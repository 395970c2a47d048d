"""Files of JSON payloads as a stream: `spark.readStream.format("payloads").load(folder)`.

Hooks drop files into a folder, under any names and in any order (written under a name with a dot, then renamed). What a batch reads is written down before Spark is told of it: numbered
lists of files, each within the admission limits, in a folder beside. An offset is a list's number, so a batch that is run again reads the same files, and
a file that comes late, or under a name that sorts before others, is in the next list. Options: maxFiles and maxBytes of a list (0: no limit), filesPerTask,
plan (the folder of lists; one a query).
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, line int, payload string, problem string"


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _name(number: int) -> str:
    return f"{number:010d}"


def payload_lines(name: str, data: bytes) -> Iterator[tuple]:
    """A row a line that isn't blank: the JSON object, or what is wrong with it. An empty file gives none."""
    for k, raw in enumerate(data.split(b"\n"), 1):
        if not raw.strip():
            continue
        text = raw.decode(errors="replace").strip()
        try:
            ok = isinstance(json.loads(text), dict)
        except ValueError:
            ok = False
        yield name, k, text if ok else None, None if ok else "not a JSON object"


class PayloadReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.folder, self.plan = options["path"].rstrip("/"), (options.get("plan") or options["path"].rstrip("/") + "-plan").rstrip("/")
        self.files, self.bytes, self.per_task = int(options.get("maxfiles", 0)), int(options.get("maxbytes", 0)), int(options.get("filespertask", 64))
        self.listed: set[str] | None = None
        self.last, self.open = 0, False

    def _start(self) -> None:
        """Reads the lists of earlier runs."""
        if self.listed is not None:
            return
        fs, at = place(self.plan)
        self.listed = set()
        for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            if f.base_name.isdigit():
                self.last = max(self.last, int(f.base_name))
                self.listed.update(self._list(int(f.base_name)))

    def _list(self, number: int) -> list[str]:
        fs, at = place(self.plan)
        with fs.open_input_stream(posixpath.join(at, _name(number))) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"list": 0}

    def latestOffset(self) -> dict:
        """The number of the last list. A new one is made when the one before was handed out and files wait."""
        self._start()
        if self.open:
            return {"list": self.last}
        fs, at = place(self.folder)
        found = sorted((f.mtime_ns or 0, f.base_name, f.size or 0) for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")) and f.base_name not in self.listed)
        taken, size = [], 0
        for _, name, n in found:
            if taken and (self.files and len(taken) >= self.files or self.bytes and size + n > self.bytes):
                break
            taken.append(name)
            size += n
        if taken:
            fs, at = place(self.plan)
            fs.create_dir(at, recursive=True)
            draft = posixpath.join(at, f".{_name(self.last + 1)}")
            with fs.open_output_stream(draft) as f:
                f.write(json.dumps(taken).encode())
            fs.move(draft, posixpath.join(at, _name(self.last + 1)))
            self.last, self.open = self.last + 1, True
            self.listed.update(taken)
        return {"list": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._start()
        if end["list"] >= self.last:
            self.open = False
        names = [n for k in range(start["list"] + 1, end["list"] + 1) for n in self._list(k)]
        return [InputPartition(names[k : k + self.per_task]) for k in range(0, len(names), self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, at = place(self.folder)
        for name in partition.value:
            with fs.open_input_stream(posixpath.join(at, name)) as f:
                yield from payload_lines(name, f.read())


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PayloadReader:
        return PayloadReader(dict(self.options))


def read(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The stream of a folder's payloads, a row a line."""
    spark.dataSource.register(PayloadSource)
    return spark.readStream.format("payloads").options(**options).load(folder)


#: Where a hook's payload has what capture needs.
PAYLOAD = "session_id string, seq bigint, hook_event_name string, tool_name string, tool_input struct<command:string,plan:string>, tool_response string, head string, transcript string, subject string, parent string, human string, change_id string, scope string, at string"


def events(lines: DataFrame) -> DataFrame:
    """Rows for streaming.capture from payload lines; lines with a problem, or of no session, are left out.

    The event is a plan if the tool's input has one, else a possible commit. Without a seq the place in the file stands in.
    """
    from ..functions.shell import says_failed

    p = lines.where(F.col("payload").isNotNull()).select("line", F.from_json("payload", PAYLOAD).alias("p")).select("line", "p.*").where(F.col("session_id").isNotNull())
    event = F.when(F.col("tool_input.plan").isNotNull(), "plan").otherwise("maybe-commit")
    return p.select("session_id", F.coalesce("seq", F.col("line").cast("long")).alias("seq"), event.alias("event"), "tool_name", F.col("tool_input.command").alias("command"), says_failed(F.col("tool_response")).alias("response_failed"), F.col("tool_input.plan").alias("plan"), "head", "transcript", "subject", "parent", "human", "change_id", "scope", "at")
