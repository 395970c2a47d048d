"""Writing a tree of files to a git ref: `df.write.format("git-tree").option("path", repo).option("ref", ref)`, rows (path, content).

Tasks store the files and the trees of whole folders; the driver gets a name and a hash a top folder, makes the root and the commit, and moves the ref if it still is
where the writer found it. So of two writers one is refused, and a failed write leaves only objects that nothing refers to. `write_tree` deals rows by top folder.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .git import ZERO, GitError, git, succeeds
from .versioned import Conflict

#: Files stored by one git process.
FILES = 512
IDENTITY = ("-c", "user.name=tracewell", "-c", "user.email=tracewell@localhost")


@dataclass
class Folders(WriterCommitMessage):
    entries: dict[str, tuple[str, str, str] | None] = field(default_factory=dict)


def store_blobs(repo: str, contents: list[bytes]) -> list[str]:
    """The hashes of contents after one process has stored them."""
    with tempfile.TemporaryDirectory() as d:  # a task's own files, gone with it
        names = []
        for k, data in enumerate(contents):
            names.append(os.path.join(d, str(k)))
            with open(names[-1], "wb") as f:
                f.write(data)
        return git(repo, "hash-object", "-w", "--no-filters", "--stdin-paths", data="".join(n + "\n" for n in names).encode()).decode().split()


def list_tree(repo: str, treeish: str) -> dict[str, tuple[str, str, str]]:
    """mode, type and hash by name of a tree's own entries; empty for none."""
    out = git(repo, "ls-tree", "-z", treeish, allow=True)
    return {name.decode(errors="surrogateescape"): tuple(head.decode().split()) for head, _, name in (item.partition(b"\t") for item in out.split(b"\0")[:-1])}


def make_tree(repo: str, entries: dict[str, tuple[str, str, str]]) -> str:
    return git(repo, "mktree", "-z", data=b"".join(f"{m} {t} {h}\t".encode() + n.encode(errors="surrogateescape") + b"\0" for n, (m, t, h) in entries.items())).decode().strip()


def folder_tree(repo: str, base: str | None, files: list[tuple[list[str], str | None]]) -> str | None:
    """The tree of a folder after files (path parts, hash; None: goes) came into what `base` holds; None if nothing is left."""
    entries = list_tree(repo, base) if base else {}
    for name, own in groupby(sorted(files, key=lambda f: f[0]), key=lambda f: f[0][0]):
        deep, plain = [], None
        for parts, sha in own:
            if len(parts) == 1:
                plain = (sha,)
            else:
                deep.append((parts[1:], sha))
        if plain:
            entries.pop(name, None)
            if plain[0]:
                entries[name] = ("100644", "blob", plain[0])
        if deep:
            had = entries.pop(name, None)
            tree = folder_tree(repo, had[2] if had and had[1] == "tree" else None, deep)
            if tree:
                entries[name] = ("040000", "tree", tree)
    return make_tree(repo, entries) if entries else None


class TreeWriter(DataSourceWriter):
    """options: path, ref, message, expected (the commit the ref must be at; as found, if it isn't given). overwrite: the rows are all that the tree holds."""

    def __init__(self, options: dict, overwrite: bool):
        self.repo, self.ref, self.message, self.overwrite = options["path"], options["ref"], options.get("message", "update"), overwrite
        now = git(self.repo, "rev-parse", "--verify", "-q", self.ref, allow=True).decode().strip()
        self.old = options.get("expected", now)
        self.base = "" if overwrite else self.old

    def write(self, iterator: Iterator[Row]) -> Folders:
        said = Folders()
        for top, rows in groupby(iterator, key=lambda r: r.path.partition("/")[0]):
            if top in said.entries:
                raise GitError(f"rows of {top} come apart; sort them by path")
            files, waiting = [], []

            def flush(files=files, waiting=waiting) -> None:
                if waiting:
                    files += zip([p for p, _ in waiting], store_blobs(self.repo, [c for _, c in waiting]), strict=True)
                    waiting.clear()

            for r in rows:
                parts = r.path.split("/")
                if not all(parts) or {".", "..", ".git"} & set(parts):
                    raise GitError(f"{r.path!r} is no path of a tree")
                blob = getattr(r, "blob", None)
                if r.content is None:
                    files.append((parts, blob))
                else:
                    waiting.append((parts, r.content.encode() if isinstance(r.content, str) else bytes(r.content)))
                    if len(waiting) == FILES:
                        flush()
            flush()
            here = [f for f in files if len(f[0]) == 1]
            had = list_tree(self.repo, self.base).get(top) if self.base else None
            if here:
                said.entries[top] = ("100644", "blob", here[-1][1]) if here[-1][1] else None
            if len(files) > len(here):
                tree = folder_tree(self.repo, had[2] if had and had[1] == "tree" else None, [(f[0][1:], f[1]) for f in files if len(f[0]) > 1])
                said.entries[top] = ("040000", "tree", tree) if tree else None
        return said

    def commit(self, messages: list) -> None:
        entries = list_tree(self.repo, self.base) if self.base else {}
        seen: set[str] = set()
        for m in messages:
            for name, entry in (m.entries if m else {}).items():
                if name in seen:
                    raise GitError(f"rows of {name} came from several tasks; write with write_tree()")
                seen.add(name)
                entries.pop(name, None)
                if entry:
                    entries[name] = entry
        made = git(self.repo, *IDENTITY, "commit-tree", make_tree(self.repo, entries), *(["-p", self.old] if self.old else []), "-m", self.message).decode().strip()
        if not succeeds(self.repo, "update-ref", self.ref, made, self.old or ZERO):
            raise Conflict(f"{self.ref} has moved from {self.old[:8] or 'nothing'}")

    def abort(self, messages: list) -> None:
        """The ref stays; what tasks stored is unreferenced, and git's own collection removes it."""


class GitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git-tree"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(dict(self.options), overwrite)


def write_tree(rows: DataFrame, repo: str, ref: str, message: str = "update", overwrite: bool = False, expected: str | None = None) -> None:
    """rows: path, content (string or binary; null: the file goes, unless blob names a stored one). Of rows of one path the greatest content holds."""
    rows.sparkSession.dataSource.register(GitTree)
    kept = rows.groupBy("path").agg(F.max("content").alias("content"), *([F.max("blob").alias("blob")] if "blob" in rows.columns else []))
    dealt = kept.repartition(F.substring_index("path", "/", 1)).sortWithinPartitions(F.substring_index("path", "/", 1), "path")
    options = {"path": repo, "ref": ref, "message": message, **({"expected": expected} if expected is not None else {})}
    dealt.write.format("git-tree").options(**options).mode("overwrite" if overwrite else "append").save()


def note_path(sha: Column) -> Column:
    return F.concat(F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 38))


def append_notes(spark: SparkSession, repo: str, lines: DataFrame, ref: str = "refs/notes/intent") -> None:
    """Adds lines (sha, line) to commits' notes in one commit of the notes ref; a line that a note has already isn't added again.

    Notes that stay are taken over by their hashes, unread. All stand by the first two digits, so the driver gets 256 folders at most.
    """
    listed = [x.split() for x in git(repo, "notes", f"--ref={ref}", "list", allow=True).decode().splitlines()]
    expected = git(repo, "rev-parse", "--verify", "-q", ref, allow=True).decode().strip()
    old = spark.createDataFrame([(sha, blob) for blob, sha in listed], "sha string, blob string")
    new = lines.where(F.col("sha").rlike("^[0-9a-f]{40}$") & F.col("line").isNotNull()).groupBy("sha").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    bodies = spark.read.format("git").option("path", repo).option("table", "notes").option("ref", ref).load().select(F.col("commit_sha").alias("sha"), F.rtrim(F.col("body")).alias("body"))
    had = F.split(F.coalesce("body", F.lit("")), "\n")
    text = F.concat(F.array_join(F.concat(F.filter(F.array("body"), lambda b: b != ""), F.filter("lines", lambda x: ~F.array_contains(had, x))), "\n"), F.lit("\n"))
    changed = new.join(bodies, "sha", "left").select(note_path(F.col("sha")).alias("path"), text.alias("content"), F.lit(None).cast("string").alias("blob"))
    kept = old.join(new, "sha", "left_anti").select(note_path(F.col("sha")).alias("path"), F.lit(None).cast("string").alias("content"), "blob")
    write_tree(changed.unionByName(kept), repo, ref, "notes", overwrite=True, expected=expected)


def init(repo: str) -> None:
    """A repository at a path, if there is none."""
    if not os.path.isdir(os.path.join(repo, ".git")):
        subprocess.run(["git", "init", "-q", repo], check=True, capture_output=True)
