"""Labels that readers see: branches, files of a diff, spans, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clamp, first_line


def ordered_branches(branches: DataFrame) -> DataFrame:
    """The checked-out branch first, then by date, newest first. branches: name, current, date."""
    return branches.orderBy(F.desc("current"), F.desc("date"), "name")


def track_label(upstream: Column, ahead: Column, behind: Column) -> Column:
    parts = F.concat_ws(", ", F.when(ahead > 0, F.concat(F.lit("ahead "), ahead.cast("string"))), F.when(behind > 0, F.concat(F.lit("behind "), behind.cast("string"))))
    return F.when(F.coalesce(upstream, F.lit("")) == "", "no upstream").when(parts == "", "up to date").otherwise(parts)


def file_title(status: Column, path: Column, old_path: Column) -> Column:
    return F.when(status.isin("renamed", "copied") & old_path.isNotNull(), F.concat(old_path, F.lit(" → "), path)).otherwise(path)


def counts_label(is_binary: Column, additions: Column, deletions: Column) -> Column:
    return F.when(is_binary, "binary").otherwise(F.concat(F.lit("+"), additions.cast("string"), F.lit(" −"), deletions.cast("string")))


def line_marker(kind: Column) -> Column:
    return F.when(kind == "add", "+").when(kind == "del", "−").otherwise(" ")


# The attributes that say best what a span did, in order.
HEADLINE = ["command", "file", "file_path", "path", "query", "target", "url"]


def span_headline(attributes: Column, body: Column, longest: int = 120) -> Column:
    """The first attribute that says what a span did, else the first line of its plan, text or summary. Both columns are JSON texts."""
    named = [F.get_json_object(attributes, f"$.{k}") for k in HEADLINE]
    told = [first_line(F.get_json_object(body, f"$.{k}")) for k in ("plan", "text", "diff_summary")]
    return clamp(F.coalesce(*named, *told), longest, longest - 3)


def source_tag(kind: Column, rank: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), kind)


def split_citations(answer: Column, sources: Column) -> Column:
    """An answer's segments in order: texts, and citations `[n]` of the sources from 1 to `sources`. A number beyond them stays text."""
    pieces = F.split(answer, r"\[[0-9]+\]", -1)
    marks = F.concat(F.regexp_extract_all(answer, F.lit(r"(\[[0-9]+\])"), F.lit(1)), F.array(F.lit("")))
    digits = lambda m: F.regexp_replace(m, r"^\[0*|\]$", "")
    number = lambda m: F.when(F.length(digits(m)) < 10, digits(m).try_cast("int"))
    cited = F.transform(marks, lambda m: F.when(number(m).between(1, sources), number(m)))
    segment = "struct<kind:string,text:string,n:int>"
    said = lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"), F.lit(None).cast("int").alias("n"))
    cite = lambda n: F.struct(F.lit("citation").alias("kind"), F.lit(None).cast("string").alias("text"), n.alias("n"))
    none = F.array().cast(f"array<{segment}>")

    def step(acc: Column, x: Column) -> Column:
        text = F.concat(acc["open"], x["piece"])
        closed = F.when(text != "", F.array(said(text))).otherwise(none)
        goes_on = F.struct(acc["done"].alias("done"), F.concat(text, x["mark"]).alias("open"))
        ends = F.struct(F.concat(acc["done"], closed, F.array(cite(x["n"]))).alias("done"), F.lit("").alias("open"))
        return F.when(x["n"].isNull(), goes_on).otherwise(ends)

    start = F.struct(none.alias("done"), F.lit("").alias("open"))
    rest = lambda acc: F.concat(acc["done"], F.when(acc["open"] != "", F.array(said(acc["open"]))).otherwise(none))
    parts = F.arrays_zip(pieces.alias("piece"), marks.alias("mark"), cited.alias("n"))
    return F.aggregate(parts, start, step, rest)


def wrap_text(text: Column, first: str = "", indent: str = "", width: int = 98) -> Column:
    """Lines of at most `width` UTF-16 units, broken between words; a longer word has a line of its own. One line, `first`, if there is no word."""
    words = F.filter(F.split(text, "[\\s\\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", -1), lambda w: w != "")
    units = lambda c: F.octet_length(F.encode(c, "UTF-16BE")) / 2

    def step(acc: Column, w: Column) -> Column:
        full = ~acc["bare"] & (units(acc["line"]) + 1 + units(w) > width)
        on = F.struct(acc["lines"].alias("lines"), F.concat(acc["line"], F.when(acc["bare"], "").otherwise(" "), w).alias("line"), F.lit(False).alias("bare"))
        new = F.struct(F.concat(acc["lines"], F.array(acc["line"])).alias("lines"), F.concat(F.lit(indent), w).alias("line"), F.lit(False).alias("bare"))
        return F.when(full, new).otherwise(on)

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(first).alias("line"), F.lit(True).alias("bare"))
    return F.aggregate(words, start, step, lambda acc: F.concat(acc["lines"], F.array(acc["line"])))
