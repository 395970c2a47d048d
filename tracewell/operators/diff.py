"""Unified diffs as rows: files, hunks and numbered lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE_LINES, ALL_LINES = 2000, 20_000
LINE_SCHEMA = "sha string, file int, path string, old_path string, status string, is_binary boolean, similarity int, hunk int, old_start int, new_start int, pos int, kind string, text string, no_newline boolean"
_HUNK = re.compile(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")
_ESCAPES = {"n": 10, "t": 9, "r": 13, '"': 34, "\\": 92, "a": 7, "b": 8, "f": 12, "v": 11}


def unquoted(path: str) -> str:
    """A path out of C-style quotes, whose octal numbers are bytes of UTF-8."""
    if len(path) < 2 or path[0] != '"' or path[-1] != '"':
        return path
    out = bytearray()
    for m in re.finditer(r"\\([0-7]{1,3})|\\(.)|([^\\]+)", path[1:-1]):
        if m[1]:
            out.append(int(m[1], 8) & 255)
        elif m[2]:
            out += bytes([_ESCAPES[m[2]]]) if m[2] in _ESCAPES else m[2].encode()
        else:
            out += m[3].encode()
    return out.decode(errors="replace")


def side_path(text: str) -> str | None:
    """The path of a `---` or `+++` line without its side's prefix; None for /dev/null."""
    p = unquoted(text.split("\t")[0])
    return None if p == "/dev/null" else p[2:] if p[:2] in ("a/", "b/") else p


def patch_rows(sha: str, patch: str) -> list[tuple]:
    """LINE_SCHEMA rows of a patch: one for each changed or context line, and one without a line for a file that has none."""
    rows: list[tuple] = []
    for number, part in enumerate(re.split(r"(?m)^diff --git ", patch)[1:]):
        head, *body = re.split(r"(?m)^(?=@@ )", part)
        lines = head.split("\n")
        tag = {k: next((x[len(k) :] for x in lines[1:] if x.startswith(k)), None) for k in ("rename from ", "rename to ", "copy from ", "copy to ", "--- ", "+++ ", "similarity index ", "new file mode", "deleted file mode")}
        status = "added" if tag["new file mode"] is not None else "deleted" if tag["deleted file mode"] is not None else "renamed" if tag["rename from "] is not None else "copied" if tag["copy from "] is not None else "modified"
        origin = tag["rename from "] or tag["copy from "]
        target = tag["rename to "] or tag["copy to "]
        old = unquoted(origin) if origin else side_path(tag["--- "]) if tag["--- "] else None
        new = unquoted(target) if target else side_path(tag["+++ "]) if tag["+++ "] else None
        quoted = re.search(r'"b/(?:\\.|[^"\\])*"$', lines[0])
        guess = unquoted(quoted[0])[2:] if quoted else lines[0].rpartition(" b/")[2]
        path = new or (old if status == "deleted" else None) or guess
        is_binary = any(x.startswith(("Binary files ", "GIT binary patch")) for x in lines)
        digits = re.match(r"\d+", tag["similarity index "] or "")
        file = (sha, number, path, old if status in ("renamed", "copied") else None, status, is_binary, int(digits[0]) if digits else None)
        pos, found = 0, False
        for h, block in enumerate(b for b in body if _HUNK.match(b)):
            m = _HUNK.match(block)
            for line in block.split("\n")[1:]:
                if line[:1] == "\\" and rows and found:
                    rows[-1] = (*rows[-1][:-1], True)
                elif line[:1] in (" ", "+", "-"):
                    rows.append((*file, h, int(m[1]), int(m[2]), pos, {" ": "context", "+": "add", "-": "del"}[line[0]], line[1:], False))
                    pos, found = pos + 1, True
        if not found:
            rows.append((*file, None, None, None, None, None, None, None))
    return rows


def parse_patches(patches: DataFrame) -> DataFrame:
    """LINE_SCHEMA rows of (sha, patch)."""
    names = [c.split()[0] for c in LINE_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for sha, p in zip(b["sha"], b["patch"], strict=True) for r in patch_rows(sha, p or "")], columns=names)

    return patches.select("sha", "patch").mapInPandas(run, LINE_SCHEMA)


def numbered_lines(lines: DataFrame, by: list[str], order: str, kind: str, old_start: Column, new_start: Column) -> DataFrame:
    """Old and new line numbers from running counts inside each hunk: an added line has no old one, a deleted one no new one."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def at(start: Column, other: str) -> Column:
        n = start + F.coalesce(F.sum((F.col(kind) != other).cast("int")).over(before), F.lit(0))
        return F.when(F.col(kind) != other, n)

    return lines.select("*", at(old_start, "add").alias("old_line"), at(new_start, "del").alias("new_line"))


def stored_lines(lines: DataFrame, file_lines: int = FILE_LINES, all_lines: int = ALL_LINES) -> DataFrame:
    """Lines with `stored`: whether both caps of a commit's display keep it. Counts are of all lines. Within a file the first are kept, and of those the first overall."""
    own = F.row_number().over(Window.partitionBy("sha", "file").orderBy("pos"))
    fits = lines.withColumn("_fits", (own <= file_lines).cast("int"))
    run = F.sum("_fits").over(Window.partitionBy("sha").orderBy("file", "pos"))
    return fits.withColumn("stored", (F.col("_fits") == 1) & (run <= all_lines)).drop("_fits")


def file_totals(lines: DataFrame, *by: str) -> DataFrame:
    return lines.groupBy(*by).agg(F.count_if(F.col("kind") == "add").alias("additions"), F.count_if(F.col("kind") == "del").alias("deletions"))


def starts_open(is_binary: Column, n_files: Column, changes: Column) -> Column:
    return F.when(is_binary, False).when(n_files <= 3, True).otherwise(changes <= 60)


def gutter_width(lines: DataFrame) -> DataFrame:
    return lines.agg(F.greatest(F.lit(2), F.length(F.max(F.greatest(F.coalesce("old_line", F.lit(0)), F.coalesce("new_line", F.lit(0)))).cast("string"))).alias("width"))
