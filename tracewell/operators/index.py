"""The chunk index: rows of three kinds, kept up by what changed since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ledger_text, session_text
from .chunking import INDEX_CHARS, chunk_files
from .sets import delete, upsert


class FingerprintError(RuntimeError):
    pass


class StateError(RuntimeError):
    pass


def ledger_chunks(effective: DataFrame, change_map: DataFrame) -> DataFrame:
    """A chunk for each unfolded change with an entry."""
    live = change_map.where(F.col("folded_into").isNull()).select("change_id")
    e = effective.join(live, "change_id", "left_semi")
    return e.select(F.concat(F.lit("ledger:"), F.col("change_id")).alias("key"), F.lit("ledger").alias("kind"), ledger_text(F.col("summary"), F.col("reasoning")).alias("text"), F.col("digest").alias("blob_sha"), "change_id")


def session_chunks(sessions: DataFrame, owners: DataFrame) -> DataFrame:
    """A chunk for each session, with the change whose entries name it last. owners: session_ref, change_id, change_pos, entry_pos."""
    own = owners.where(F.col("session_ref").isNotNull()).groupBy("session_ref").agg(F.max_by("change_id", F.struct("change_pos", "entry_pos")).alias("change_id"))
    text = F.coalesce("summary", session_text(F.col("agent.tool"), F.col("agent.model"), F.col("session_id"), F.col("spans")))
    return sessions.join(own, "session_ref", "left").select(F.concat(F.lit("session:"), F.col("session_ref")).alias("key"), F.lit("session").alias("kind"), text.alias("text"), F.col("session_ref").alias("blob_sha"), "change_id", "session_ref")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status, old_blob, new_blob of what differs between two trees (path, blob_sha)."""
    a, b = old.select("path", F.col("blob_sha").alias("old_blob")), new.select("path", F.col("blob_sha").alias("new_blob"))
    status = F.when(F.col("old_blob").isNull(), "A").when(F.col("new_blob").isNull(), "D").otherwise("M")
    return a.join(b, "path", "full_outer").where(~F.col("old_blob").eqNullSafe(F.col("new_blob"))).select("path", status.alias("status"), "old_blob", "new_blob")


def refresh_code(index: DataFrame, old: DataFrame, new: DataFrame, contents: DataFrame, most: int = INDEX_CHARS) -> DataFrame:
    """The index after a change of trees: chunks of new blobs in, those of blobs that no path holds any more out; other kinds stay. contents: blob_sha, content."""
    diff = changed_files(old, new)
    gone = diff.where(F.col("old_blob").isNotNull()).select(F.col("old_blob").alias("blob_sha")).distinct().join(new.select("blob_sha"), "blob_sha", "left_anti")
    files = diff.where(F.col("new_blob").isNotNull()).select("path", F.col("new_blob").alias("blob_sha")).join(contents, "blob_sha")
    fresh = chunk_files(files, most).dropDuplicates(["key"])
    return upsert(delete(index, index.where(F.col("kind") == "code").join(gone, "blob_sha", "left_semi").select("key"), "key"), fresh, "key")


def check_fingerprint(state: dict | None, fingerprint: str) -> None:
    """An index made by another model can't be added to."""
    if state and state.get("model_fingerprint") != fingerprint:
        raise FingerprintError(f"the index was built with {state.get('model_fingerprint')}, not {fingerprint}")


def run_counts(chunks: DataFrame) -> DataFrame:
    """kind, indexed, reused, embedded of a run. chunks: kind, reused."""
    return chunks.groupBy("kind").agg(F.count(F.lit(1)).alias("indexed"), F.count_if(F.col("reused")).alias("reused"), F.count_if(~F.col("reused")).alias("embedded"))
