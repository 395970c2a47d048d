"""Table schemas, and checks that split rows into valid ones and ones with reasons against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The record types' enumerations and versions.
ORIGINS = ["post-commit", "post-rewrite", "trailer-recovery", "inferred", "orphan-recovery", "rebuild-map"]
AUTHOR_TYPES = ["agent", "human", "mixed"]
SCOPE_RISKS = ["low", "medium", "high"]
REVERSIBILITY = ["easy", "moderate", "hard"]
PROVENANCE = ["agent-captured", "human-authored", "inferred"]
SPAN_KINDS = ["gen_ai.completion", "gen_ai.tool.execution", "agent.plan", "agent.step"]
CHUNK_KINDS = ["code", "ledger", "session"]

COMMITS = "sha string, short_sha string, author_name string, author_email string, author_date string, author_ts timestamp, subject string, message string, parents array<string>, walk_pos bigint"
COMMIT_PATHS = "sha string, base_sha string, path string, status string, old_blob string, new_blob string"
TREE_BLOBS = "rev string, mode string, path string, blob_sha string"
CHANGE_MAP = "change_id string, head string, history array<string>, trailer_seen boolean, origin string, folded_into string, absorbed array<string>, divergent_heads array<string>, updated_at string, tree_pos bigint"
AUTHOR = "struct<type:string,tool:string,model:string,human:string>"
SCOPE = "array<struct<path:string,range:struct<start_line:int,end_line:int>,blob:string>>"
REASONING = "struct<intent:string,constraints:array<string>,rejected:array<struct<option:string,why:string>>,confidence:double,scope_risk:string,reversibility:string,directive:string,tested:array<string>,related:array<string>>"
LEDGER_ENTRIES = f"note_commit string, change_id string, revision string, created_at string, author {AUTHOR}, scope {SCOPE}, summary string, reasoning {REASONING}, session_ref string, session_refs array<string>, provenance string, folded_into string, redaction_note string, canonical string, digest string"
SPANS = "array<struct<span_id:string,parent_id:string,kind:string,name:string,start:string,end:string,attributes:string,body:string>>"
SESSIONS = f"session_ref string, session_id string, agent struct<tool:string,version:string,model:string>, captured_at string, commit_range struct<since:string,until:string>, redaction struct<applied:boolean,rules:array<string>,redacted_count:int,truncated_count:int>, source_fingerprint string, spans {SPANS}, summary string"
CHUNKS = "key string, kind string, text string, path string, blob_sha string, node_path string, start_line int, end_line int, change_id string, session_ref string, embedding array<float>"

HEX32, HEX40, SESSION_REF = "^[0-9a-f]{32}$", "^[0-9a-f]{40}$", "^sha256:[0-9a-f]{64}$"
RELATED_REF = "^(c/[0-9a-f]{32}|[0-9a-f]{4,40})$"
UTC_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def reasons(*checks: tuple[Column, str]) -> Column:
    """The names of the checks that a row fails; a check that is null fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks]))


def split_valid(df: DataFrame, why: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    judged = df.withColumn("reasons", why)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def change_map_reasons() -> Column:
    return reasons((F.col("change_id").rlike(HEX32), "change_id"), (F.col("head").rlike(HEX40), "head"), (F.forall("history", lambda h: h.rlike(HEX40)), "history"), (F.col("origin").isin(ORIGINS), "origin"), (F.col("folded_into").isNull() | F.col("folded_into").rlike(HEX32), "folded_into"), (F.col("updated_at").rlike(UTC_TIME), "updated_at"))


def entry_reasons() -> Column:
    r, c = F.col("reasoning"), F.col("reasoning.confidence")
    lines = F.forall("scope", lambda s: s["range"].isNull() | ((s["range"]["start_line"] >= 1) & (s["range"]["start_line"] <= s["range"]["end_line"])))
    return reasons(
        (F.col("change_id").rlike(HEX32), "change_id"), (F.col("revision").rlike(HEX40), "revision"), (F.col("created_at").rlike(UTC_TIME), "created_at"), (F.col("author.type").isin(AUTHOR_TYPES), "author.type"), (F.col("summary").isNotNull(), "summary"),
        (F.col("scope").isNotNull() & lines, "scope"), (F.col("provenance").isin(PROVENANCE), "provenance"), (r.isNull() | c.isNull() | c.between(0, 1), "reasoning.confidence"), (r.isNull() | r["scope_risk"].isNull() | r["scope_risk"].isin(SCOPE_RISKS), "reasoning.scope_risk"),
        (r.isNull() | r["reversibility"].isNull() | r["reversibility"].isin(REVERSIBILITY), "reasoning.reversibility"), (r.isNull() | r["related"].isNull() | F.forall(r["related"], lambda x: x.rlike(RELATED_REF)), "reasoning.related"), (F.col("session_ref").isNull() | F.col("session_ref").rlike(SESSION_REF), "session_ref"),
    )


def session_reasons() -> Column:
    return reasons((F.col("session_ref").rlike(SESSION_REF), "session_ref"), (F.col("captured_at").rlike(UTC_TIME), "captured_at"), (F.forall("spans", lambda s: s["kind"].isin(SPAN_KINDS)), "spans.kind"), (F.col("agent.tool").isNotNull(), "agent.tool"))
