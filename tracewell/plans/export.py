"""Ledger entries as trace records, and as a comment for a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import model_id, uuid_form

TRACE_VERSION = "0.1.0"


def trace_files(entries: DataFrame) -> DataFrame:
    """change_id, path, n_ranges, first_pos of each file of each change, in first-seen order: scope items grouped by path."""
    items = entries.select("change_id", F.posexplode("scope").alias("pos", "s"))
    return items.groupBy("change_id", F.col("s.path").alias("path")).agg(F.count("s.range").alias("n_ranges"), F.min("pos").alias("first_pos"))


def trace_records(effective: DataFrame) -> DataFrame:
    """change_id and record: a trace record (JSON) for each change's effective entry."""
    contributor = F.struct(F.when(F.col("author.type") == "agent", "ai").otherwise(F.coalesce("author.type", F.lit("unknown"))).alias("type"), model_id(F.col("author.model")).alias("model_id"))
    ref = F.col("session_ref")
    related = F.when(ref.isNotNull(), F.array(F.struct(F.lit("session").alias("type"), F.concat(F.lit("session/"), ref).alias("url"))))
    paths = F.array_distinct(F.transform("scope", lambda s: s["path"]))

    def file(p):
        ranges = F.transform(F.filter("scope", lambda s: (s["path"] == p) & s["range"].isNotNull()), lambda s: F.struct(s["range"]["start_line"].alias("start_line"), s["range"]["end_line"].alias("end_line"), F.concat(F.lit("git-blob:"), s["blob"]).alias("content_hash")))
        return F.struct(p.alias("path"), F.array(F.struct(contributor.alias("contributor"), ranges.alias("ranges"), related.alias("related"))).alias("conversations"))

    record = F.struct(
        F.lit(TRACE_VERSION).alias("version"), uuid_form(F.col("change_id")).alias("id"), F.col("created_at").alias("timestamp"), F.struct(F.lit("git").alias("type"), F.col("revision").alias("revision")).alias("vcs"),
        F.struct(F.coalesce("author.tool", F.lit("tracewell")).alias("name")).alias("tool"), F.transform(paths, file).alias("files"), F.struct(F.struct("change_id", "summary", "provenance", "reasoning", "session_ref").alias("ledger")).alias("metadata"),
    )
    return effective.select("change_id", F.to_json(record).alias("record"))


def pr_comment(entry: dict | None) -> tuple[str, int]:
    """(Markdown, exit code) for one change; 2 when nothing was recorded."""
    if not entry:
        return "No reasoning is recorded for this change.\n", 2
    r = entry.get("reasoning") or {}
    lines = [f"### {entry['summary']}", ""]
    lines += [f"**{t}** {r[k]}" for t, k in (("Intent:", "intent"), ("Directive:", "directive")) if r.get(k)]
    lines += [f"- {c}" for c in r.get("constraints") or []] + [f"- rejected {x['option']}: {x['why']}" for x in r.get("rejected") or []]
    return "\n".join(lines) + "\n", 0
