"""Capture of agent sessions as a stream of hook events, keyed by session.

State of a session: a buffered plan, the last captured commit, and how many transcript lines were taken. A
`plan` event buffers its plan. A `maybe-commit` event is skipped unless its command ran `git commit` and
succeeded on a commit not captured before; else the lines since the last capture become spans, with the buffered plan
in front if they have none, secrets are taken out, and a session record and a ledger entry come out, as JSON. A
redaction that fails lets no trace through; the entry is kept with a note. What the commit says (`COMMIT`) may come with an
event: without a change id the entry has none, and `Workspace.adopt` finds it later.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..functions.redaction import Rule, built_in, redact_spans
from ..functions.shell import runs_git_commit
from ..operators.ledger import LINE_SCHEMA

EVENTS = "session_id string, seq bigint, event string, tool_name string, command string, response_failed boolean, plan string, head string, transcript string"
#: What an event may say of its commit beside: scope is a JSON array of {path, blob}.
COMMIT = "subject string, parent string, human string, change_id string, scope string, at string"
STATE = "plan string, last_commit string, last_line bigint, seen bigint"
OUTPUT = "session_id string, seq bigint, status string, reason string, head string, session_ref string, n_spans int, rules string, redacted_count int, note string, record string, entry string"
RECORD_SCHEMA, ENTRY_SCHEMA = "session@1", "ledger-entry@1"
TRANSCRIPT, PLAN_ONLY, TOOL = "transcript@1", "plan-only@1", "agent"


def transcript_spans(lines: list[str]) -> tuple[list[dict], bool]:
    """Spans of transcript lines, and whether any line (if there are any) was understood."""
    spans, known, full = [], 0, 0
    for raw in lines:
        if not raw.strip():
            continue
        full += 1
        try:
            line = json.loads(raw)
        except ValueError:
            continue
        if not isinstance(line, dict) or not isinstance(line.get("type"), str):
            continue
        known += 1
        message = line.get("message") if isinstance(line.get("message"), dict) else {}
        for block in (message.get("content") if isinstance(message.get("content"), list) else []) if line["type"] == "assistant" else []:
            if not isinstance(block, dict):
                continue
            given = block.get("input") if isinstance(block.get("input"), dict) else {}
            span = None
            if block.get("type") == "text" and isinstance(block.get("text"), str) and block["text"].strip():
                span = {"kind": "gen_ai.completion", "body": {"text": block["text"]}}
            elif block.get("type") == "tool_use" and block.get("name") == "ExitPlanMode":
                span = {"kind": "agent.plan", "body": {"plan": given["plan"]}} if isinstance(given.get("plan"), str) and given["plan"] else None
            elif block.get("type") == "tool_use" and isinstance(block.get("name"), str) and block["name"]:
                kept = {b: given[a] for a, b in (("file_path", "file"), ("command", "command")) if isinstance(given.get(a), str) and given[a]}
                span = {"kind": "gen_ai.tool.execution", "name": block["name"], **({"attributes": kept} if kept else {})}
            if span:
                spans.append({"span_id": f"s{len(spans) + 1}", **span})
    return spans, known > 0 or full == 0


def newest_meta(lines: list[str]) -> dict[str, str]:
    """model and version as the last line that says them has them."""
    out: dict[str, str] = {}
    for raw in lines:
        try:
            line = json.loads(raw)
        except ValueError:
            continue
        if isinstance(line, dict):
            message = line.get("message") if isinstance(line.get("message"), dict) else {}
            out |= {k: v for k, v in (("model", message.get("model")), ("version", line.get("version"))) if isinstance(v, str) and v}
    return out


def summary_of(spans: list[dict], subject: str) -> str:
    kinds = [s["kind"] for s in spans]
    parts = (["plan"] if "agent.plan" in kinds else []) + [f"{kinds.count('gen_ai.tool.execution')} tool execution(s)", f"{kinds.count('gen_ai.completion')} model turn(s)"]
    return f"agent session: {', '.join(parts)}" + (f' for commit "{subject}"' if subject else "") + "."


def _canonical(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def step(state: dict, e: dict, rules: list[Rule] | None = None) -> tuple[dict, dict]:
    """One event on a session's state: (state, result). Never raises."""
    out = {"session_id": e["session_id"], "seq": e["seq"], "status": "skipped", "reason": None, "head": e.get("head"), "session_ref": None, "n_spans": 0, "rules": "", "redacted_count": 0, "note": None, "record": None, "entry": None}
    state = {**state, "seen": e["seq"]}
    if e["event"] == "plan":
        if not e.get("plan"):
            return state, out | {"reason": "no plan"}
        return state | {"plan": e["plan"]}, out | {"status": "buffered-plan"}
    if e["event"] != "maybe-commit":
        return state, out | {"reason": "another event"}
    for wrong, reason in (
        (e.get("tool_name") not in (None, "Bash"), "not a shell event"), (not isinstance(e.get("command"), str), "no command"), (not runs_git_commit(e.get("command")), "not a commit"),
        (bool(e.get("response_failed")), "the commit failed"), (not e.get("head"), "no head"), (e.get("head") == state.get("last_commit"), "captured before"),
    ):
        if wrong:
            return state, out | {"reason": reason}
    lines = (e.get("transcript") or "").split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    first = state.get("last_line") or 0
    spans, ok = transcript_spans(lines[first if first <= len(lines) else 0 :])
    note = None if ok and e.get("transcript") is not None else "plan only"
    if not ok:
        spans = []
    meta = newest_meta(lines) if ok else {}
    if state.get("plan") and not any(s["kind"] == "agent.plan" for s in spans):
        spans = [{"span_id": "s0", "kind": "agent.plan", "body": {"plan": state["plan"]}}, *spans]
    plan = None
    try:
        spans, info = redact_spans(spans, rules or built_in())
        # the entry's intent is the plan's first line as it is after redaction
        text = next((s["body"].get("plan") for s in spans if s["kind"] == "agent.plan" and isinstance(s.get("body"), dict)), None)
        plan = next((x.strip() for x in str(text or "").split("\n") if x.strip()), None)
        record = _canonical(
            {
                "schema": RECORD_SCHEMA, "session_id": e["session_id"], "agent": {"tool": TOOL, "version": meta.get("version", "unknown"), "model": meta.get("model", "unknown")}, "captured_at": e.get("at"),
                "commit_range": {"since": state.get("last_commit") or e.get("parent") or e["head"], "until": e["head"]}, "redaction": {"applied": True, **info}, "source_fingerprint": PLAN_ONLY if note else TRANSCRIPT, "spans": spans, "summary": summary_of(spans, e.get("subject") or ""),
            }
        )
        out |= {"record": record, "session_ref": "sha256:" + hashlib.sha256(record.encode()).hexdigest(), "n_spans": len(spans), "rules": ",".join(info["rules"]), "redacted_count": info["redacted_count"]}
    except Exception as failed:  # whatever a rule raises, the trace stays out
        note = f"trace dropped: redaction failed ({type(failed).__name__})"
    entry = {
        "schema": ENTRY_SCHEMA, "change_id": e.get("change_id"), "revision": e["head"], "created_at": e.get("at"), "author": {"type": "agent", "tool": TOOL, **({"model": meta["model"]} if "model" in meta else {}), **({"human": e["human"]} if e.get("human") else {})},
        "scope": json.loads(e.get("scope") or "[]"), "summary": e.get("subject") or "(no commit subject)", **({"reasoning": {"intent": plan}} if plan else {}), "session_ref": out["session_ref"], "provenance": "agent-captured", **({"redaction_note": note} if note and not out["record"] else {}),
    }
    return state | {"plan": None, "last_commit": e["head"], "last_line": len(lines)}, out | {"status": "captured", "note": note, "entry": _canonical(entry)}


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    now = dict(zip(("plan", "last_commit", "last_line", "seen"), state.get, strict=True)) if state.exists else {"plan": None, "last_commit": None, "last_line": 0, "seen": -1}
    events = pd.concat(list(batches)).sort_values("seq")
    rows = []
    for e in events.to_dict("records"):
        now, out = step(now, {k: None if not isinstance(v, str | bool | int) and pd.isna(v) else v for k, v in e.items()})
        rows.append(out)
    state.update((now["plan"], now["last_commit"], now["last_line"], now["seen"]))
    state.setTimeoutDuration(TIMEOUT_MS)
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


#: A session without events for so long is forgotten.
TIMEOUT_MS = 7 * 24 * 3600 * 1000


def capture(events: DataFrame) -> DataFrame:
    """Results of a stream (or a batch) of EVENTS rows: a row an event, in the order of `seq` within a session."""
    names = [c.split()[0] for c in EVENTS.split(", ")]
    rows = events.select(*names, *[F.col(n).cast("string").alias(n) if n in events.columns else F.lit(None).cast("string").alias(n) for n in (c.split()[0] for c in COMMIT.split(", "))])
    if events.isStreaming:
        return rows.groupBy("session_id").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        now, out = {"plan": None, "last_commit": None, "last_line": 0, "seen": -1}, []
        for e in pdf.sort_values("seq").to_dict("records"):
            now, one = step(now, {k: None if not isinstance(v, str | bool | int) and pd.isna(v) else v for k, v in e.items()})
            out.append(one)
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return rows.groupBy("session_id").applyInPandas(whole, OUTPUT)


def session_records(results: DataFrame) -> DataFrame:
    """Rows of schemas.SESSIONS of what was captured, each content address once; to be written by VersionedTable.insert_new."""
    shape = schemas.SESSIONS.replace("session_ref string, ", "", 1)
    r = results.where(F.col("record").isNotNull()).select("session_ref", F.from_json("record", shape).alias("r"))
    return r.select("session_ref", "r.*").dropDuplicates(["session_ref"])


def ledger_lines(results: DataFrame) -> DataFrame:
    """sha and line: what is appended to each commit's note."""
    return results.where(F.col("entry").isNotNull()).select(F.col("head").alias("sha"), F.concat(F.lit('{"entry":'), "entry", F.lit(f',"schema":"{LINE_SCHEMA}"}}')).alias("line"))


def newest_sessions(states: DataFrame, n: int = 20) -> DataFrame:
    """The n sessions with the latest update, the rest being forgotten."""
    return states.orderBy(F.desc("updated_at"), "session_id").limit(n)


def first_records(stream: DataFrame, watermark: str, time: str = "captured_at") -> DataFrame:
    """Each session record once, by its content address; late copies within the watermark are dropped."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["session_ref"])
