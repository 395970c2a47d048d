"""Secrets taken out of texts and spans, in order of rules, failing closed."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUNCATED = "«truncated»"
SPAN_BYTES = 16_384
NEVER_CAPTURE = [".env*", "*.pem", "*secrets*", "id_rsa*", "*.key"]


def marker(rule: str) -> str:
    return f"«redacted:{rule}»"


# The patterns of the built-in rules, in their order. A word border is between an ASCII word character and anything else, in Python as in Java.
_W = "[A-Za-z0-9_]"
_B = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
# Before, or after, a word character a border is where no other one is.
_FRONT, _END = f"(?<!{_W})", f"(?!{_W})"
PATTERNS = [
    ("aws-key", _FRONT + r"(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}" + _END),
    ("github-token", _FRONT + r"(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})" + _B),
    ("gitlab-token", _FRONT + r"glpat-[A-Za-z0-9_-]{20,}" + _B),
    ("private-key-block", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"),
    ("jwt", _FRONT + r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}" + _B),
    ("connection-string", _FRONT + r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@"'`]+:[^\s@"'`]+@[^\s"'`]+"""),
]
ASSIGNED = r"""([A-Za-z0-9_.-]*(?:key|token|secret|password|passwd|pwd|credential|bearer|auth)[A-Za-z0-9_.-]*\s*[=:]\s*["']?)([A-Za-z0-9+/=_.-]{16,})(["']?)"""


#: What a text must hold, one of them, for a rule to match; looked for before the rule is tried.
LITERALS = {
    "aws-key": ["AKIA", "ASIA", "ABIA", "ACCA"], "github-token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"], "gitlab-token": ["glpat-"],
    "private-key-block": ["PRIVATE KEY"], "jwt": ["eyJ"], "connection-string": ["://"],
}


#: A match can only begin where a run of its first characters does; said so, a search takes linear time in long runs.
_RUN = r"(?<![A-Za-z0-9_.-])"
#: What every text holds that the gated rule can touch: each is found in linear time.
TRIGGERS = ["(?i)key|token|secret|password|passwd|pwd|credential|bearer|auth", r"""[=:]\s*["']?[A-Za-z0-9+/=_.-]{16}"""]
#: Fixed value: the body of a span on a file that is never captured.
NEVER_BODY = {"omitted": "content excluded by never_capture glob"}


class Rule(NamedTuple):
    """An id and a function from a text to (text, replacements)."""

    id: str
    apply: Callable[[str], tuple[str, int]]


def pattern_rule(rule: str, pattern: str) -> Rule:
    compiled = re.compile(pattern)
    return Rule(rule, lambda text: compiled.subn(marker(rule), text))


def secret_shaped(value: str) -> bool:
    """Long, of letters and digits, and not made of a few characters."""
    return len(value) >= 16 and bool(re.search("[0-9]", value)) and bool(re.search("[A-Za-z]", value)) and len(set(value)) >= 8


def _assigned(text: str) -> tuple[str, int]:
    hits = 0

    def put(m: re.Match) -> str:
        nonlocal hits
        if not secret_shaped(m[2]):
            return m[0]
        hits += 1
        return m[1] + marker("generic-token") + m[3]

    return re.sub(_RUN + ASSIGNED, put, text, flags=re.I | re.A), hits


def built_in(extra: list[str] = ()) -> list[Rule]:
    return [pattern_rule(i, p) for i, p in PATTERNS] + [Rule("generic-token", _assigned)] + [pattern_rule(f"extra-{k + 1}", p) for k, p in enumerate(extra)]


def redact_text(text: str, rules: list[Rule]) -> tuple[str, dict[str, int]]:
    fired = {}
    for r in rules:
        text, n = r.apply(text)
        if n:
            fired[r.id] = fired.get(r.id, 0) + n
    return text, fired


def cap_bytes(text: str, most: int = SPAN_BYTES) -> tuple[str, bool]:
    """The longest beginning of whole characters that fits, and a marker, if the text has more bytes."""
    data = text.encode()
    return (text, False) if len(data) <= most else (data[:most].decode(errors="ignore") + TRUNCATED, True)


def redact_value(value, rules: list[Rule], most: int | None, tally: dict) -> object:
    """Every string within a JSON value; tally: counts by rule, and `truncated`."""
    if isinstance(value, str):
        out, fired = redact_text(value, rules)
        for k, n in fired.items():
            tally[k] = tally.get(k, 0) + n
        if most is not None:
            out, cut = cap_bytes(out, most)
            tally["truncated"] = tally.get("truncated", 0) + cut
        return out
    if isinstance(value, list):
        return [redact_value(v, rules, most, tally) for v in value]
    if isinstance(value, dict):
        return {k: redact_value(v, rules, most, tally) for k, v in value.items()}
    return value


def redact_spans(spans: list[dict], rules: list[Rule], never: list[str] = NEVER_CAPTURE, most: int = SPAN_BYTES) -> tuple[list[dict], dict]:
    """Spans with attributes and bodies redacted, and {rules, redacted_count, truncated_count}. The body of a span on a file that is never captured is left out. A rule that raises lets nothing through: the error goes on."""
    from .text import glob_regex

    globs, tally, out = [re.compile(glob_regex(g)) for g in never], {}, []
    for s in spans:
        attributes = s.get("attributes") or {}
        file = attributes.get("file")
        if isinstance(file, str) and any(g.search(x) for g in globs for x in (file, re.split(r"[/\\]", file)[-1])):
            out.append({**s, "attributes": {"file": file}, "body": dict(NEVER_BODY)})
            continue
        new = dict(s)
        for part, limit in (("attributes", None), ("body", most)):
            if s.get(part) is not None:
                new[part] = redact_value(s[part], rules, limit, tally)
        out.append(new)
    cut = tally.pop("truncated", 0)
    return out, {"rules": sorted(tally), "redacted_count": sum(tally.values()), "truncated_count": cut}


def redact_rows(rows: DataFrame, text: str = "text", name: str = "redacted", extra: list[str] = ()) -> DataFrame:
    """The rows with a struct more: text, rules (id and count of those that fired, as JSON) and redacted_count, their sum. A null text stays null.

    The whole-match rules are Spark expressions, each counted on what the one before left. Only texts that hold a trigger of the
    gated rule go to Python, in Arrow batches; extra patterns come last.
    """

    @F.pandas_udf("struct<text:string,n:int>")
    def gated(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if t is None else _assigned(t) for t in texts], columns=["text", "n"])

    counts: list[tuple[str, str]] = []
    out = rows.withColumn("_t", F.col(text))

    def whole(out: DataFrame, rule: str, pattern: str) -> DataFrame:
        counts.append((rule, f"_n{len(counts)}"))
        t = F.col("_t")
        n = F.when(_may_hold(t, rule), F.regexp_count(t, F.lit(pattern))).otherwise(0)
        return out.withColumn(counts[-1][1], n).withColumn("_t", F.when(F.col(counts[-1][1]) > 0, F.regexp_replace(t, pattern, marker(rule))).otherwise(t))

    for rule, pattern in PATTERNS:
        out = whole(out, rule, pattern)
    out = out.withColumn("_hit", gated(F.when(F.col("_t").rlike(TRIGGERS[0]) & F.col("_t").rlike(TRIGGERS[1]), F.col("_t")))).withColumns({"_t": F.coalesce("_hit.text", "_t"), "_gated": F.coalesce("_hit.n", F.lit(0))})
    counts.append(("generic-token", "_gated"))
    for k, pattern in enumerate(extra):
        out = whole(out, f"extra-{k + 1}", pattern)
    fired = F.concat_ws(",", *[F.when(F.col(n) > 0, F.concat(F.lit(f'"{rule}":'), F.col(n).cast("string"))) for rule, n in sorted(counts)])
    total = sum((F.coalesce(n, F.lit(0)) for _, n in counts), F.lit(0))
    found = F.struct(F.col("_t").alias("text"), F.concat(F.lit("{"), fired, F.lit("}")).alias("rules"), total.cast("int").alias("redacted_count"))
    return out.select(*rows.columns, found.alias(name))


def _may_hold(text: Column, rule: str) -> Column:
    return reduce(Column.__or__, [text.contains(x) for x in LITERALS[rule]]) if rule in LITERALS else F.lit(True)


def redact_native(text: Column) -> Column:
    """The whole-match rules as Spark expressions alone, for columns where the gated rule isn't wanted."""
    for rule, pattern in PATTERNS:
        text = F.element_at(F.transform(F.array(text), lambda t: F.when(_may_hold(t, rule), F.regexp_replace(t, pattern, marker(rule))).otherwise(t)), 1)  # noqa: B023
    return text


def secret_count(text: Column) -> Column:
    """Values that the gated rule takes, counted by Spark expressions alone."""
    values = F.regexp_extract_all(text, F.lit("(?i)" + _RUN + ASSIGNED), F.lit(2))
    shaped = F.filter(values, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.filter(F.split(v, ""), lambda c: c != ""))) >= 8))
    return F.size(shaped)


def cap_column(text: Column, most: int) -> Column:
    """cap_bytes() as a column: the longest beginning of whole characters."""
    data = F.encode(text, "UTF-8")

    def goes_on(at: int) -> Column:
        """Whether the byte at a place continues a character."""
        return F.hex(F.substring(data, at, 1)).between("80", "BF")

    cut = F.lit(max(0, most - 3))
    for back in (2, 1, 0):
        cut = F.when(~goes_on(most - back + 1), most - back).otherwise(cut) if most >= back else cut
    whole = F.substring(data, F.lit(1), cut).cast("string")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(whole, F.lit(TRUNCATED)))
