"""Whether a shell command runs `git commit`, and whether a tool's response says it failed."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Global options of git that take the next word.
VALUE_OPTIONS = {"-c", "-C", "--git-dir", "--work-tree", "--namespace", "--exec-path"}
_PIECE = re.compile(r"'(?:[^'\\]|\\.)*'?|\"(?:[^\"\\]|\\.)*\"?|&&|\|\||[;|\n]|[^'\"&|;\n]+|&", re.S)


def segments(command: str) -> list[str]:
    """The commands of a line, split where it isn't quoted."""
    out = [""]
    for piece in _PIECE.findall(command):
        if piece in ("&&", "||", ";", "|", "\n"):
            out.append("")
        else:
            out[-1] += piece
    return out


def runs_git_commit(command: str | None) -> bool:
    for segment in segments(command or ""):
        words = segment.split()
        while words and re.match(r"[A-Za-z_]\w*=", words[0], re.A):
            words.pop(0)
        if not words:
            continue
        name = re.sub(r"(?i)\.exe$", "", re.split(r"[/\\]", re.sub(r"^[\"']|[\"']$", "", words.pop(0)))[-1]).lower()
        if name != "git":
            continue
        while words and words[0].startswith("-"):
            words = words[2 if words[0] in VALUE_OPTIONS else 1 :]
        if words[:1] == ["commit"]:
            return True
    return False


def git_commit(command: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(commands: pd.Series) -> pd.Series:
        return commands.map(runs_git_commit)

    return run(command)


def says_failed(response: Column) -> Column:
    """Only plain evidence in a response (JSON text) counts: interrupted, an error flag, success false, or an exit code other than 0."""
    v = F.try_parse_json(response)

    def flag(name: str, value: bool) -> Column:
        is_flag = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "BOOLEAN"
        return F.coalesce(is_flag & (F.try_variant_get(v, f"$.{name}", "boolean") == value), F.lit(False))

    def code(name: str) -> Column:
        is_number = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).rlike("^(BIGINT|INT|DOUBLE|DECIMAL)")
        return F.coalesce(is_number & (F.try_variant_get(v, f"$.{name}", "double") != 0), F.lit(False))

    return flag("interrupted", True) | flag("is_error", True) | flag("isError", True) | flag("success", False) | code("exit_code") | code("exitCode") | code("code")
