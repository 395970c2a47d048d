"""Source files as chunks: functions, classes, what lies between, or windows of plain text.

Python files are cut by the syntax tree; TypeScript and JavaScript by a scanner that knows strings,
comments, template texts and brackets, and takes declarations at the outer level. Every line that isn't blank is in exactly one chunk.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CHARS, INDEX_CHARS = 8000, 2000


class Chunk(NamedTuple):
    kind: str
    node_path: str
    start_line: int
    end_line: int
    text: str


class Declared(NamedTuple):
    kind: str
    name: str
    start: int  # lines, from 1
    end: int
    methods: list[tuple[str, int, int]]


def language_of(path: str) -> str:
    ext = path.lower().rpartition(".")[2] if "." in path else ""
    kinds = {"typescript": ("ts", "mts", "cts"), "tsx": ("tsx",), "javascript": ("js", "mjs", "cjs", "jsx"), "python": ("py", "pyi")}
    return next((k for k, exts in kinds.items() if ext in exts), "text")


def windows(kind: str, node: str, lines: list[str], first: int, most: int) -> list[Chunk]:
    """One chunk, or as many as it takes of whole lines up to `most` characters; a longer line stands alone."""
    if sum(map(len, lines)) + len(lines) - 1 <= most:
        return [Chunk(kind, node, first, first + len(lines) - 1, "\n".join(lines))]
    out, held, size = [], [], 0
    for k, line in enumerate([*lines, None]):
        if held and (line is None or size + len(line) + 1 > most):
            out.append(Chunk(kind, f"{node}#{len(out)}", first + k - len(held), first + k - 1, "\n".join(held)))
            held, size = [], 0
        if line is not None:
            held.append(line)
            size += len(line) + 1
    return out


def python_declarations(source: str) -> list[Declared]:
    def start(n) -> int:
        return min([n.lineno, *(d.lineno for d in n.decorator_list)])

    out = []
    for n in ast.parse(source).body:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(Declared("function", n.name, start(n), n.end_lineno, []))
        elif isinstance(n, ast.ClassDef):
            out.append(Declared("class", n.name, start(n), n.end_lineno, [(m.name, start(m), m.end_lineno) for m in n.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]))
    return out


_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|$)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|[{}()\[\];]|\n", re.S)
_FUNCTION = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)?")
_CLASS = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\b\s*([A-Za-z_$][\w$]*)?")
_ARROW = re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^=]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)", re.S)
_METHOD = re.compile(r"^\s*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*\(")


def _statements(source: str) -> Iterator[tuple[int, int]]:
    """Character spans of the statements at the outer level: up to a semicolon, a closing brace or a blank line outside brackets."""
    depth, start, at = 0, None, 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        text = m[0] if m else source[at]
        end = at + len(text)
        comment = text.startswith(("//", "/*"))
        if start is None and not text.isspace() and not comment and text != ";":
            start = at
        if text in "{([" and len(text) == 1:
            depth += 1
        elif text in "})]" and len(text) == 1:
            depth = max(0, depth - 1)
            if not depth and text == "}" and start is not None:
                follow = re.match(r"[ \t]*[;,)=.]?", source[end:])[0].strip()
                if follow in ("", ";"):
                    yield start, end + (source[end:].index(";") + 1 if follow else 0)
                    end = end + (source[end:].index(";") + 1 if follow else 0)
                    start = None
        elif text == ";" and not depth and start is not None:
            yield start, end
            start = None
        elif text == "\n" and not depth and start is not None and source[end : end + 1] in ("\n", ""):
            yield start, at
            start = None
        at = end
    if start is not None:
        yield start, len(source.rstrip())


def script_declarations(source: str) -> list[Declared]:
    def line(at: int) -> int:
        return source.count("\n", 0, at) + 1

    out = []
    for a, b in _statements(source):
        text = source[a:b]
        if m := _CLASS.match(text):
            methods = []
            if (brace := text.find("{")) >= 0:
                inner = text[brace + 1 : text.rfind("}")]
                methods = [(f[1], line(a + brace + 1 + x), line(a + brace + y)) for x, y in _statements(inner) if (f := _METHOD.match(inner[x:y])) and "{" in inner[x:y]]
            out.append(Declared("class", m[1] or f"@L{line(a)}", line(a), line(b - 1), methods))
        elif m := _FUNCTION.match(text) or _ARROW.match(text):
            out.append(Declared("function", m[1] or f"@L{line(a)}", line(a), line(b - 1), []))
    return out


def chunk_file(path: str, content: str, most: int = MOST_CHARS) -> list[Chunk]:
    language, lines = language_of(path), content.split("\n")
    if not content.strip():
        return []
    if language == "text":
        return windows("file", "file", lines, 1, most)
    try:
        found = python_declarations(content) if language == "python" else script_declarations(content)
    except (SyntaxError, ValueError):
        found = []
    out: list[Chunk] = []
    taken = [False] * len(lines)
    for d in found:
        if any(taken[d.start - 1 : d.end]):  # two on one line: the first has it
            continue
        own = lines[d.start - 1 : d.end]
        parts = [(f"class:{d.name}/method:{n}", "method", x, y) for n, x, y in d.methods] if d.kind == "class" and sum(map(len, own)) + len(own) - 1 > most else []
        for node, kind, x, y in parts or [(f"{d.kind}:{d.name}", d.kind, d.start, d.end)]:
            if not any(taken[x - 1 : y]):
                out += windows(kind, node, lines[x - 1 : y], x, most)
                taken[x - 1 : y] = [True] * (y - x + 1)
    start = None
    for k in range(len(lines) + 1):
        if k < len(lines) and not taken[k]:
            start = k if start is None else start
            continue
        if start is not None:
            x, y = start, k
            while x < y and not lines[x].strip():
                x += 1
            while y > x and not lines[y - 1].strip():
                y -= 1
            if x < y:
                out.append(Chunk("segment", f"segment:@L{x + 1}", x + 1, y, "\n".join(lines[x:y])))
            start = None
    return sorted(out, key=lambda c: (c.start_line, c.node_path))


CHUNK_SCHEMA = "key string, kind string, text string, path string, blob_sha string, node_path string, start_line int, end_line int"


def chunk_files(files: DataFrame, most: int = INDEX_CHARS) -> DataFrame:
    """Chunks of path, blob_sha and content; files that are too long or binary have none. The key is `<blob>:<node>`."""
    from ..functions.text import skipped_content

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{blob}:{c.node_path}", "code", c.text, path, blob, c.node_path, c.start_line, c.end_line) for path, blob, content in zip(b["path"], b["blob_sha"], b["content"], strict=True) for c in chunk_file(path, content, most)]
            yield pd.DataFrame(rows, columns=["key", "kind", "text", "path", "blob_sha", "node_path", "start_line", "end_line"])

    kept = files.where(~F.coalesce(skipped_content(F.col("content")), F.lit(True)))
    return kept.select("path", "blob_sha", "content").mapInPandas(run, CHUNK_SCHEMA)


def filled_runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, start_line, end_line, n_chars of each run of lines that aren't blank, by gaps and islands over a text's lines."""
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    full = lines.where(F.trim(F.regexp_replace("line", r"\s", " ")) != "")
    w = Window.partitionBy("key").orderBy("pos")
    run = full.withColumn("run", F.col("pos") - F.row_number().over(w))
    return run.groupBy("key", "run").agg((F.min("pos") + 1).alias("start_line"), (F.max("pos") + 1).alias("end_line"), F.sum(F.length("line")).alias("n_chars")).drop("run")


def greedy_windows(text: Column, most: int) -> Column:
    """Ends (lines, from 1) of the windows that greedy packing of whole lines gives, as a fold over the lines inside one row."""
    sizes = F.transform(F.split(text, "\n"), F.length)
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends"))

    def step(s: Column, n: Column) -> Column:
        full = (s["size"] > 0) & (s["size"] + n + 1 > most)
        return F.struct(F.when(full, n + 1).otherwise(s["size"] + n + 1).alias("size"), (s["n"] + 1).alias("n"), F.when(full, F.array_append(s["ends"], s["n"])).otherwise(s["ends"]).alias("ends"))

    return F.aggregate(sizes, start, step, lambda s: F.array_append(s["ends"], s["n"]))
