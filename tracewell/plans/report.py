"""The history report: timeline, changes, totals, what needs attention, and its renderings."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import badge, clamp, day_of
from ..operators.identity import island

LOW_CONFIDENCE = 0.5
SEVERITY = ["note-unreadable", "low-confidence", "inferred-provenance", "no-intent"]


def timeline(commits: DataFrame, entry_of_note: DataFrame, change_of: DataFrame | None, unreadable: DataFrame | None = None) -> DataFrame:
    """A row a commit with what its own note says.

    commits: sha, author_date, subject, walk_pos; entry_of_note: sha, entry_change_id, kind, tool, model, human, entry_summary,
    entry_confidence, entry_provenance (the entry that holds of that note); change_of: sha, mapped_change_id, or None where
    commits have mapped_change_id themselves; unreadable: sha.
    """
    bad = unreadable.select("sha", F.lit(True).alias("unreadable")).distinct() if unreadable is not None else None
    t = commits.join(entry_of_note, "sha", "left")
    t = t.join(change_of, "sha", "left") if change_of is not None else t
    t = t.join(bad, "sha", "left").fillna(False, ["unreadable"]) if bad is not None else t.withColumn("unreadable", F.lit(False))
    b = badge(F.col("kind"), F.col("tool"), F.col("model"), F.col("human"), F.col("unreadable"))
    source = F.when(F.col("entry_summary").isNotNull(), "ledger").when(F.col("unreadable"), "git-subject-note-unreadable").otherwise("git-subject")
    return t.select("sha", "walk_pos", "author_date", "subject", F.coalesce("entry_summary", "subject").alias("summary"), source.alias("summary_source"), F.coalesce("mapped_change_id", "entry_change_id").alias("change_id"), F.col("kind").isNotNull().alias("has_intent"), b["kind"].alias("badge_kind"), b["label"].alias("badge_label"), "model", F.col("entry_confidence").alias("confidence"), F.col("entry_provenance").alias("provenance"))


def filtered(rows: DataFrame, kind: str | None = None, model: str | None = None, since: str | None = None, until: str | None = None, date: str = "author_date") -> DataFrame:
    """Rows of a kind, a model and an inclusive span of days; a row without a day is in no span."""
    day = day_of(F.col(date).cast("string"))
    ok = F.lit(True)
    for c, v in ((F.col("badge_kind"), kind), (F.col("model"), model)):
        ok = ok & (c == v) if v is not None else ok
    ok = ok & (day != "") & (day >= since) if since else ok
    ok = ok & (day != "") & (day <= until) if until else ok
    return rows.where(ok)


def day_runs(rows: DataFrame, order: str = "walk_pos", date: str = "author_date", by: list[str] | None = None) -> DataFrame:
    """Neighbouring rows of one day as groups: run, day, n, first and last place. by: columns whose values have timelines of their own."""
    by = by or []
    day = day_of(F.col(date).cast("string"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(order)
    d = rows.select(*by, order, day.alias("day")).withColumn("new", ~F.col("day").eqNullSafe(F.lag("day").over(w)))
    d = d.withColumn("run", island(order, F.col("new"), by))
    return d.groupBy(*by, "run", "day").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def change_sections(rows: DataFrame, effective_of_change: DataFrame, session_of: DataFrame | None = None) -> DataFrame:
    """A row a change in the order of its newest commit: its commits and the entry that holds of all its revisions."""
    g = rows.where(F.col("change_id").isNotNull()).groupBy("change_id").agg(F.count(F.lit(1)).alias("n_commits"), F.min("walk_pos").alias("newest"), F.array_sort(F.collect_list("walk_pos")).alias("members"))
    out = g.join(effective_of_change, "change_id", "left")
    return out if session_of is None else out.join(session_of, "session_ref", "left")


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("commits"), F.count_distinct("change_id").alias("changes"), *[F.count_if(F.col("badge_kind") == k).alias(k) for k in ("agent", "human", "mixed", "none")],
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
    )


def flagged(df: DataFrame, id: Column, detail: Column, kinds: dict[str, Column]) -> DataFrame:
    """kind, id and detail for each kind whose condition a row meets; the rows are read once."""
    met = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
    return df.select(F.explode(met).alias("kind"), id.cast("string").alias("id"), detail.alias("detail"))


def attention(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """kind, id and detail of what a reader should look at. changes: change_id, summary, provenance, confidence of the entry that holds."""
    unread = F.col("summary_source") == "git-subject-note-unreadable"
    of_commits = flagged(rows, F.col("sha"), F.col("subject"), {"note-unreadable": unread, "no-intent": ~unread & ~F.col("has_intent")})
    of_changes = flagged(changes, F.col("change_id"), F.col("summary"), {"inferred-provenance": F.col("provenance") == "inferred", "low-confidence": F.col("confidence") < LOW_CONFIDENCE})
    return of_commits.unionByName(of_changes)


def attention_groups(items: DataFrame) -> DataFrame:
    """kind, severity (1 is worst) and n of the groups that have items."""
    severity = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("kind"))
    return items.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("severity", severity)


def log_annotation(kind: Column, confidence: Column, unreadable: Column, missing: str = "no intent: pre-ledger") -> Column:
    known = F.concat_ws(", ", kind, F.when(confidence.isNotNull(), F.concat(F.lit("conf "), F.format_number(confidence, 2))))
    return F.when(kind.isNotNull(), known).when(unreadable, "no intent: ledger note unreadable").otherwise(missing)


def log_rows(rows: DataFrame, width: int = 72) -> DataFrame:
    """sha, line and annotation, newest first."""
    unread = F.col("summary_source") == "git-subject-note-unreadable"
    return rows.select("walk_pos", "sha", clamp(F.col("summary"), width, width - 1).alias("line"), log_annotation(F.when(F.col("has_intent"), F.col("badge_kind")), F.col("confidence"), unread).alias("annotation"))


def render_markdown(rows: list, sums: dict) -> str:
    """A page of a report: `rows` is what the reader asked to see."""
    head = ["# Intent report", "", *(f"- {k}: {v}" for k, v in sums.items()), "", "| commit | day | summary | recorded by |", "|-|-|-|-|"]
    return "\n".join(head + [f"| {r['sha']} | {str(r['author_date'])[:10]} | {str(r['summary']).replace('|', chr(92) + '|')} | {r['badge_label']} |" for r in rows]) + "\n"


def render_html(rows: list, sums: dict) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[c]), quote=True)}</td>" for c in ("sha", "author_date", "summary", "badge_label")) + "</tr>" for r in rows)
    facts = "".join(f"<li>{html.escape(str(k))}: {html.escape(str(v))}</li>" for k, v in sums.items())
    return f'<!doctype html><meta charset="utf-8"><title>Intent report</title><ul>{facts}</ul><table>{cells}</table>\n'
