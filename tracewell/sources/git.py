"""Git repositories as a Spark data source: `spark.read.format("git").option("path", repo).option("table", ...)`.

Tables: commits, refs, tree, paths, notes, blobs, blame, patch, remote. Rows come from one git process a table (two
for notes, one a task for contents of files), never one an object; names are never put through a shell. Commits and contents are streamed.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TABLES = {
    "commits": "sha string, short_sha string, author_name string, author_email string, author_date string, subject string, message string, parents array<string>, walk_pos bigint",
    "refs": "ref string, sha string, subject string, date string, upstream string, track string, current boolean, target string",
    "tree": "rev string, mode string, type string, blob_sha string, path string",
    "paths": "sha string, base_sha string, path string, status string, old_blob string, new_blob string",
    "notes": "commit_sha string, body string",
    "blobs": "blob_sha string, path string, content string",
    "blame": "path string, line int, sha string",
    "patch": "sha string, base_sha string, patch string",
    "remote": "ref string, sha string",
}
ZERO = "0" * 40
#: Bytes of files that a task reads, about.
SPLIT_BYTES = 64 << 20
_UNIT, _RECORD = "\x1f", "\x1e"


class GitError(RuntimeError):
    pass


def _run(repo: str, *args: str, data: bytes | None = None) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-c", "core.quotepath=off", "-C", repo, *args], input=data, capture_output=True)


def git(repo: str, *args: str, data: bytes | None = None, allow: bool = False, output: bool = False) -> bytes:
    """A git command's output. allow: what fails gives nothing instead of an error; output: or what it said before it failed."""
    done = _run(repo, *args, data=data)
    if done.returncode and not allow:
        raise GitError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
    return b"" if done.returncode and not output else done.stdout


def succeeds(repo: str, *args: str) -> bool:
    return not _run(repo, *args).returncode


def push_status(line: str) -> tuple[str, str, str] | None:
    """(ref, action, detail) of a line of `git push --porcelain`; None for a line about no ref."""
    flag, *rest = line.split("\t")
    action = {"=": "up-to-date", "!": "rejected", " ": "pushed", "+": "pushed", "*": "pushed", "-": "pushed"}.get(flag)
    return (rest[0].partition(":")[0].removeprefix("+"), action, " ".join(rest[1:])) if action and rest else None


def many_objects(repo: str, names: Iterable[str]) -> Iterator[bytes | None]:
    """The contents of many objects by one process, one in memory at a time; None for one that isn't there."""
    p = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    try:
        for n in names:
            if "\n" in n:
                raise GitError(f"{n!r} is no name of an object")
            p.stdin.write(f"{n}\n".encode())
            p.stdin.flush()
            head = p.stdout.readline()
            if not head:
                raise GitError(f"git cat-file ended at {n}")
            if head.rstrip().endswith((b" missing", b" ambiguous")):
                yield None
                continue
            yield p.stdout.read(int(head.rpartition(b" ")[2]))
            p.stdout.read(1)
    finally:
        p.stdin.close()
        p.stdout.close()
        p.wait()


def records(repo: str, *args: str, end: str, chunk: int = 1 << 20) -> Iterator[str]:
    """A git command's output cut at a mark, a chunk in memory at a time; what follows the last mark is left out."""
    p = subprocess.Popen(["git", "-c", "core.quotepath=off", "-C", repo, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    mark, held = end.encode(), b""
    try:
        while data := p.stdout.read(chunk):
            *whole, held = (held + data).split(mark)
            yield from map(_text, whole)
    finally:
        p.stdout.close()
        said = p.stderr.read()
        p.stderr.close()
        failed = p.wait()
    if failed:
        raise GitError(_text(said).strip() or f"git {args[0]} failed")


def _text(data: bytes) -> str:
    return data.decode(errors="replace")


def _commits(repo: str, o: dict) -> Iterator[tuple]:
    rev = o.get("rev", "HEAD")
    if "rev" not in o and not git(repo, "rev-parse", "--verify", "-q", "HEAD", allow=True):
        return  # no commit yet
    args = ["log", f"--format=%H{_UNIT}%h{_UNIT}%an{_UNIT}%ae{_UNIT}%aI{_UNIT}%s{_UNIT}%B{_UNIT}%P{_RECORD}"]
    args += [f"--{k}={o[k]}" for k in ("since", "until") if k in o] + (["-n", o["limit"]] if "limit" in o else [])
    args += ["--topo-order"] if o.get("order") == "topo" else []
    args += ["--all"] if rev == "--all" else ["--end-of-options", rev]
    for k, record in enumerate(records(repo, *args, *(["--", o["file"]] if "file" in o else ["--"]), end=_RECORD)):
        f = record.lstrip("\n").split(_UNIT)
        yield (*f[:6], f[6].rstrip("\n"), f[7].split(), k)


def _refs(repo: str, o: dict) -> Iterator[tuple]:
    form = "%00".join(["%(refname)", "%(objectname)", "%(subject)", "%(committerdate:iso-strict)", "%(upstream:short)", "%(upstream:track)", "%(HEAD)", "%(if)%(*objectname)%(then)%(*objectname)%(else)%(objectname)%(end)"])
    for line in _text(git(repo, "for-each-ref", f"--format={form}", "--sort=-committerdate", *o.get("pattern", "refs/heads").split())).splitlines():
        f = line.split("\0")
        yield (*f[:6], f[6] == "*", f[7])


def _tree(repo: str, o: dict) -> Iterator[tuple]:
    rev = o.get("rev", "HEAD")
    for item in git(repo, "ls-tree", "-r", "-z", rev).split(b"\0")[:-1]:
        head, _, path = item.partition(b"\t")
        mode, kind, sha = head.decode().split()
        if o.get("files", "true") != "true" or mode in ("100644", "100755"):
            yield rev, mode, kind, sha, _text(path)


def _paths(repo: str, o: dict) -> Iterator[tuple]:
    """Changes of each commit against its first parent, renames as deletion and addition; of one pair if `base` is given."""
    if "base" in o:
        head = o.get("rev", "HEAD")
        blocks = [(head, o["base"], git(repo, "diff", "--raw", "-z", "--no-renames", "--abbrev=40", o["base"], head))]
    else:
        out = git(repo, "log", "-m", "--first-parent", "--root", "--raw", "-z", "--no-renames", "--abbrev=40", f"--format={_RECORD}%H {_UNIT}%P{_UNIT}", o.get("rev", "HEAD"))
        blocks = []
        for b in out.split(_RECORD.encode())[1:]:
            sha, parents, raw = b.split(_UNIT.encode(), 2)
            blocks.append((sha.decode().strip(), (parents.decode().split() or [None])[0], raw))
    for sha, base, raw in blocks:
        items = raw.strip(b"\n\0").split(b"\0")
        for head, path in zip(items[::2], items[1::2], strict=False):
            f = head.decode().strip().lstrip(":").split()
            yield sha, base, _text(path), f[4][0] if f[4][0] in "AMDT" else "M", f[2], f[3]


def _notes(repo: str, o: dict) -> Iterator[tuple]:
    pairs = [x.split() for x in _text(git(repo, "notes", f"--ref={o.get('ref', 'intent')}", "list", allow=True)).splitlines()]
    for (_, sha), body in zip(pairs, many_objects(repo, [p[0] for p in pairs]), strict=True):
        yield sha, _text(body or b"")


def blob_ranges(repo: str, o: dict) -> list[list[tuple[str, str]]]:
    """(hash, path) of the files of a tree, in runs of about `splitBytes` bytes of content; of those alone that another tree (`base`) has not, if it is given."""
    had = {r[3] for r in _tree(repo, {"rev": o["base"]})} if "base" in o else set()
    most, runs, size = int(o.get("splitbytes", SPLIT_BYTES)), [], 0
    for item in git(repo, "ls-tree", "-r", "-l", "-z", o.get("rev", "HEAD")).split(b"\0")[:-1]:
        head, _, path = item.partition(b"\t")
        mode, _, sha, n = head.decode().split()
        if (o.get("files", "true") != "true" or mode in ("100644", "100755")) and n != "-" and sha not in had:
            if not runs or size + int(n) > most:
                runs.append([])
                size = 0
            runs[-1].append((sha, _text(path)))
            size += int(n)
    return runs


def _blobs(repo: str, rows: list[tuple[str, str]]) -> Iterator[tuple]:
    for (sha, path), body in zip(rows, many_objects(repo, [sha for sha, _ in rows]), strict=True):
        yield sha, path, _text(body or b"")


def _blame(repo: str, o: dict) -> Iterator[tuple]:
    for line in _text(git(repo, "blame", "--porcelain", o.get("rev", "HEAD"), "--", o["file"])).splitlines():
        f = line.split(" ")
        if len(f[0]) == 40 and len(f) >= 3 and not line.startswith("\t"):
            yield o["file"], int(f[2]), None if f[0] == ZERO else f[0]


def _patch(repo: str, o: dict) -> Iterator[tuple]:
    sha = _text(git(repo, "rev-parse", "--verify", "--end-of-options", o.get("rev", "HEAD"))).strip()
    parents = _text(git(repo, "log", "-1", "--format=%P", sha)).split()
    context = f"-U{int(o.get('context', 3))}"
    args = ["diff", "-M", context, parents[0], sha] if parents else ["show", "--format=", "--root", "-M", context, sha]
    yield sha, parents[0] if parents else None, _text(git(repo, *args))


def _remote(repo: str, o: dict) -> Iterator[tuple]:
    for line in _text(git(repo, "ls-remote", o.get("remote", "origin"), o.get("pattern", "refs/*"))).splitlines():
        sha, _, ref = line.partition("\t")
        yield ref, sha


_READ = {"commits": _commits, "refs": _refs, "tree": _tree, "paths": _paths, "notes": _notes, "blame": _blame, "patch": _patch, "remote": _remote}


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.repos = self.options["path"].split(",")

    def partitions(self) -> list[InputPartition]:
        if self.options.get("table") == "blobs":
            return [InputPartition((r, run)) for r in self.repos for run in blob_ranges(r, self.options)] or [InputPartition((self.repos[0], []))]
        return [InputPartition((r, None)) for r in self.repos]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        repo, run = partition.value
        yield from _READ[self.options.get("table", "commits")](repo, self.options) if run is None else _blobs(repo, run)


class GitSource(DataSource):
    """One partition a repository (`path` may list several, with commas); contents of files in as many as their bytes ask for."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "commits")]

    def reader(self, schema) -> GitReader:
        return GitReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)


def read(spark: SparkSession, repo: str, table: str, **options: str):
    register(spark)
    r = spark.read.format("git").option("path", repo).option("table", table)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()
