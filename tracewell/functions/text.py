"""Scalar functions on columns: identifiers, references, labels, times, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SPACE = r"^[\s   ﻿]+|[\s   ﻿]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def keyword_query(c: Column) -> Column:
    """The words in quotes, any of which may match; empty if there is none."""
    return F.array_join(F.transform(words(c), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def change_id(c: Column) -> Column:
    """32 lower-case hex digits from an id as people write it: `I` in front and 40 digits are allowed; else null."""
    bare = F.regexp_replace(F.lower(strip(c)), "^i", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare).when(bare.rlike("^[0-9a-f]{40}$"), F.substring(bare, 1, 32))


def trailer_change_id(message: Column) -> Column:
    """The change id of a message's last `Change-Id:` line; null if there is none or it is malformed."""
    found = F.regexp_extract_all(message, F.lit(r"(?im)^Change-Id:[ \t]*(\S+)[ \t]*$"), F.lit(1))
    return change_id(F.try_element_at(found, F.lit(-1)))


def change_trailer(c: Column) -> Column:
    return F.concat(F.lit("Change-Id: I"), c)


def new_change_id() -> Column:
    """32 random hex digits (122 random bits)."""
    return F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))


def uuid_form(c: Column) -> Column:
    return F.concat_ws("-", *[F.substring(c, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def shard_path(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 2), F.lit("/"), F.substring(c, 3, 1 << 20), F.lit(".json"))


def model_id(c: Column) -> Column:
    return F.when(c.startswith("claude"), F.concat(F.lit("anthropic/"), c)).otherwise(c)


def language_of(path: Column) -> Column:
    ext = F.regexp_extract(F.lower(path), r"\.([a-z]+)$", 1)
    return F.when(ext.isin("ts", "mts", "cts"), "typescript").when(ext == "tsx", "tsx").when(ext.isin("js", "mjs", "cjs", "jsx"), "javascript").when(ext.isin("py", "pyi"), "python").otherwise("text")


def skipped_content(text: Column, most: int = 1_048_576) -> Column:
    """Too long, or binary."""
    return (F.length(text) > most) | (F.instr(text, "\0") > 0)


def clamp(c: Column, longest: int, cut: int) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, cut), F.lit("…"))).otherwise(c)


def first_line(c: Column) -> Column:
    """The first line that isn't blank, without white space at its edges."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    return F.try_element_at(lines, F.lit(1))


def citations(answer: Column, n: Column | int) -> Column:
    """Distinct numbers in square brackets within 1..n, as they first come."""
    n = n if isinstance(n, Column) else F.lit(n)
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda x: x.between(1, n)))


def file_line(c: Column) -> Column:
    """path and line of `path:line`, split at the last colon; null if it isn't one."""
    path, line = F.regexp_extract(c, r"^(.+):([0-9]+)$", 1), F.regexp_extract(c, r"^(.+):([0-9]+)$", 2).try_cast("int")
    return F.when((path != "") & (line >= 1), F.struct(path.alias("path"), line.alias("line")))


def ahead_behind(track: Column) -> Column:
    def number(word: str) -> Column:
        return F.coalesce(F.regexp_extract(track, rf"{word} (\d+)", 1).try_cast("int"), F.lit(0))

    return F.struct(number("ahead").alias("ahead"), number("behind").alias("behind"))


def rejected_option(c: Column) -> Column:
    """option and why of `option::why`; null unless both have text."""
    at = F.instr(c, "::")
    a, b = strip(F.substring(c, F.lit(1), at - 1)), strip(F.substring(c, at + 2, F.lit(1 << 20)))
    return F.when((at > 0) & (a != "") & (b != ""), F.struct(a.alias("option"), b.alias("why")))


def without_comments(message: Column, mark: str = "#") -> Column:
    """A commit message without what follows the scissors line and without comment lines."""
    cut = F.regexp_replace(message, rf"(?s)(^|\n){mark} -+ >8 -+.*$", "")
    return F.array_join(F.filter(F.split(cut, "\n"), lambda x: ~x.startswith(mark)), "\n")


def instant_ms(c: Column) -> Column:
    """Milliseconds of a time text; 0 if it is none."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(c)), F.lit(0))


def utc_time(c: Column) -> Column:
    return F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_of(c: Column) -> Column:
    """The day that a time text begins with; empty if it doesn't."""
    return F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1)


def day_heading(day: Column, today: Column) -> Column:
    return F.when(day == "", "date unavailable").when(day == F.date_format(today, "yyyy-MM-dd"), "Today").when(day == F.date_format(F.date_sub(today, 1), "yyyy-MM-dd"), "Yesterday").otherwise(day)


def canonical_json(raw: Column) -> Column:
    """JSON with keys in order at every level, nulls kept, without white space; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(raw))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def cache_key(fingerprint: Column, blob: Column, node: Column) -> Column:
    return F.sha2(F.concat_ws("\0", fingerprint, blob, node), 256)


def model_fingerprint(provider: Column, dim: Column, precision: Column) -> Column:
    base = F.concat_ws(":", provider, dim.cast("string"))
    return F.when(F.coalesce(precision, F.lit("")).isin("", "q8"), base).otherwise(F.concat_ws(":", base, precision))


def glob_regex(glob: str) -> str:
    """A case-insensitive regular expression for the whole of a path, of `*` and `?`."""
    import re

    return "(?is)^" + "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in glob) + "$"


def never_captured(path: Column, globs: list[str]) -> Column:
    """Whether a glob matches the whole path or its last part."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g)) | name.rlike(glob_regex(g))
    return F.coalesce(hit, F.lit(False))


def pattern_match(ref: Column, pattern: str) -> Column:
    """A name, or a beginning and an end around one `*`."""
    a, star, b = pattern.partition("*")
    return (ref == pattern) if not star else ref.startswith(a) & ref.endswith(b) & (F.length(ref) >= len(a) + len(b))


def badge(kind: Column, tool: Column, model: Column, human: Column, unreadable: Column) -> Column:
    """kind and label of who recorded a row's reasoning; kind null: nobody."""
    label = F.concat_ws(" · ", kind, tool, model, F.when(kind == "human", human))
    nobody = F.when(unreadable, "note unreadable").otherwise("no reasoning recorded")
    return F.struct(F.coalesce(kind, F.lit("none")).alias("kind"), F.when(kind.isNull(), nobody).otherwise(label).alias("label"))


def ledger_text(summary: Column, reasoning: Column) -> Column:
    """An entry as text to embed."""
    def line(title: str, c: Column) -> Column:
        return F.when(c.isNotNull(), F.concat(F.lit(f"{title}: "), c))

    def joined(a: Column, sep: str) -> Column:
        return F.when(F.size(a) > 0, F.array_join(a, sep))

    rejected = F.transform(reasoning["rejected"], lambda r: F.concat(F.lit("Rejected: "), r["option"], F.lit(" — "), r["why"]))
    return F.concat_ws("\n", summary, line("Intent", reasoning["intent"]), line("Constraints", joined(reasoning["constraints"], "; ")), joined(rejected, "\n"), line("Directive", reasoning["directive"]), line("Tested", joined(reasoning["tested"], "; ")))


def session_text(tool: Column, model: Column, session_id: Column, spans: Column) -> Column:
    """What stands for a session without a summary."""
    names = F.slice(F.array_distinct(F.transform(spans, lambda s: F.coalesce(s["name"], s["kind"]))), 1, 20)
    who = F.concat_ws(", ", tool, model)
    return F.concat(F.lit("Agent session ("), who, F.lit(") "), session_id, F.lit(": "), F.size(spans).cast("string"), F.lit(" spans — "), F.array_join(names, ", "))
