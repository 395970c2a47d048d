"""What records say beside their text: the scope of a commit, the session of an entry, flags of a reasoning, costs of an answer."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# git's name of no blob, and the reason for a session that isn't there.
NO_BLOB = "0" * 40
NO_SESSION = "no session object for this ref"


def _slashes(path: str) -> Column:
    return F.regexp_replace(path, r"\\", "/").alias("path")


def captured_scope(paths: DataFrame, merges: DataFrame) -> DataFrame:
    """sha, path, blob: what a captured commit left in each file it changed. Deleted files aren't in it, nor is anything of a merge.

    paths: sha, path, new_blob; merges: sha of the commits with several parents. A null blob counts as none.
    """
    kept = paths.where((F.col("new_blob") != NO_BLOB) & (F.col("path") != ""))
    return kept.join(merges.select("sha"), "sha", "left_anti").select("sha", _slashes("path"), F.col("new_blob").alias("blob"))


def derived_scope(paths: DataFrame) -> DataFrame:
    """sha, path, blob: the same for an entry that a person writes: a deleted file with what it held before, a merge by its first parent.

    paths: sha, path, old_blob, new_blob. A path without content on either side isn't in it.
    """
    blob = F.coalesce(F.nullif("new_blob", F.lit(NO_BLOB)), F.nullif("old_blob", F.lit(NO_BLOB)))
    return paths.select("sha", _slashes("path"), blob.alias("blob")).where(F.col("blob").isNotNull())


def session_info(rows: DataFrame, sessions: DataFrame, ref: str = "session_ref") -> DataFrame:
    """The rows with a struct `session` more: ref, status (none, available or unavailable), the reason against it, and what its record says.

    A session is stored under its digest, so of repeated records any is the right one.
    """
    facts = {"agent_tool": "agent.tool", "agent_model": "agent.model", "agent_version": "agent.version", "span_count": F.size("spans"), "captured_at": "captured_at", "summary": "summary"}
    known = sessions.dropDuplicates(["session_ref"]).select(F.col("session_ref").alias("__ref"), F.struct(*[(c if isinstance(c, Column) else F.col(c)).alias(k) for k, c in facts.items()]).alias("__facts"))
    joined = rows.join(known, F.col(ref) == F.col("__ref"), "left")
    status = F.when(F.col(ref).isNull(), "none").when(F.col("__ref").isNull(), "unavailable").otherwise("available")
    reason = F.when(F.col(ref).isNotNull() & F.col("__ref").isNull(), NO_SESSION)
    return joined.withColumn("session", F.struct(F.col(ref).alias("ref"), status.alias("status"), reason.alias("reason"), *[F.col(f"__facts.{k}").alias(k) for k in facts])).drop("__ref", "__facts")


def flags(reasoning: str = "reasoning") -> Column:
    """confidence, scopeRisk and reversibility as JSON, each only if the reasoning says it."""
    fields = {"confidence": "confidence", "scopeRisk": "scope_risk", "reversibility": "reversibility"}
    return F.coalesce(F.to_json(F.struct(*[F.col(f"{reasoning}.{c}").alias(k) for k, c in fields.items()])), F.lit("{}"))


def token_usage(rounds: DataFrame, *keys: str) -> DataFrame:
    """Tokens in and out of all rounds of an answer; null where no round tells its usage. rounds: the keys, input_tokens, output_tokens."""
    told = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    return rounds.groupBy(*keys).agg(*[F.sum(F.when(told, F.coalesce(c, F.lit(0)))).alias(c) for c in ("input_tokens", "output_tokens")])


def _counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def notes_label(entries: Column, commits: Column, unreadable: Column) -> Column:
    """What the ref of notes would send: entries on commits, and unreadable notes if there are any."""
    told = F.concat(_counted(entries, "entry", "entries"), F.lit(" on "), _counted(commits, "commit", "commits"))
    return F.concat_ws(", ", told, F.when(unreadable > 0, _counted(unreadable, "unreadable note", "unreadable notes")))


def sessions_label(traces: Column) -> Column:
    return F.concat(_counted(traces, "trace", "traces"), F.lit(", redacted"))


def changes_label(changes: Column) -> Column:
    return _counted(changes, "change", "changes")


def rewrite_pairs(lines: DataFrame, line: str = "value") -> DataFrame:
    """old_sha and new_sha of git's lines on rewritten commits (`old new [more]`). Blank lines and nulls say nothing; a line with one word is an error."""
    words = F.split(F.trim(F.regexp_replace(line, r"[\s\x0b]+", " ")), " ")
    bad = F.raise_error(F.concat(F.lit("no pair of commits in line: "), F.col(line)))
    new = F.when(F.size(words) < 2, bad.cast("string")).otherwise(F.get(words, F.lit(1)))
    return lines.where(F.col(line).rlike(r"[^\s\x0b]")).select(words[0].alias("old_sha"), new.alias("new_sha"))


def log_lines(spark: SparkSession, path: str) -> int:
    """Lines of a log that aren't blank; 0 if it can't be read."""
    try:
        return spark.read.text(path).where(F.col("value").rlike(r"\S")).count()
    except (AnalysisException, Py4JJavaError):
        return 0
