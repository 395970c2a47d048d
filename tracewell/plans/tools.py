"""What an answering model may read of a workspace: the code of a commit, what is recorded of a change, recent commits with their intent, and why a line is as it is.

Nothing here writes. Each tool takes a dict and gives a text; wrong input raises, which `ask.run_tool` hands to the model as a result. Rows are fetched up to the number asked for.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from ..operators import diff
from ..sources import git
from .ask import Tool

if TYPE_CHECKING:
    from .workspace import Workspace

LOG, MOST_LOG, MOST_CONTEXT, LATER = 10, 50, 20, 5


def text_of(given: dict, name: str) -> str:
    value = given.get(name)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a text that isn't empty")
    return value.strip()


def number_of(given: dict, name: str, least: int, most: int, default: int | None = None) -> int:
    value = given.get(name, default)
    value = int(value) if isinstance(value, str) and re.fullmatch(r"-?\d+", value) else value
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise ValueError(f"{name} must be a whole number from {least} to {most}")
    return value


def commit_diff(w: Workspace, given: dict) -> str:
    sha, context = text_of(given, "sha"), number_of(given, "context", 0, MOST_CONTEXT, 3)
    patch = w.git("patch", rev=sha, context=str(context))
    commit = patch.select("sha", "base_sha").first()
    lines = diff.parse_patches(patch.select("sha", "patch"))
    totals = {r.path: r for r in diff.file_totals(lines, "sha", "path").collect()}  # a row a file of one commit
    subject = w.commits(rev=commit.sha, limit="1").select("subject").first().subject
    out = [f"commit {commit.sha}", f"subject: {subject}", f"against {commit.base_sha}" if commit.base_sha else "against nothing: a first commit"]
    out += [f"{len(totals)} file(s), +{sum(t.additions for t in totals.values())} -{sum(t.deletions for t in totals.values())}"]
    return "\n".join(out) + "\n\n" + patch.select("patch").first().patch


def show_change(w: Workspace, given: dict) -> str:
    rows = w.show(text_of(given, "target")).orderBy("n").collect()  # one change's entries
    if not given.get("history"):
        rows = [r for r in rows if r.is_effective]
    return "\n\n".join(describe(r) for r in rows) or "nothing is recorded"


def describe(r) -> str:
    """One entry and its session, as text."""
    head = f"change {r.change_id}, entry {r.n}" + (" (holds)" if r.is_effective else " (superseded)")
    who = " ".join(x for x in (r.author.type, r.author.tool, r.author.model, r.author.human) if x) if r.author else "unknown"
    out = [head, f"summary: {r.summary}", f"by: {who} at {r.created_at}, {r.provenance}", f"revision: {r.revision}"]
    if r.reasoning:
        why = r.reasoning
        out += [f"{k}: {v}" for k, v in (("intent", why.intent), ("directive", why.directive), ("confidence", why.confidence), ("scope risk", why.scope_risk), ("reversibility", why.reversibility)) if v is not None]
        out += [f"constraint: {c}" for c in why.constraints or []] + [f"rejected: {x.option}: {x.why}" for x in why.rejected or []] + [f"tested: {c}" for c in why.tested or []]
    out += [f"file: {s.path}" for s in r.scope or []]
    out.append(f"session: {r.session.status}" + (f" ({r.session.agent_tool}, {r.session.span_count} spans: {r.session.summary})" if r.session.status == "available" else f" ({r.session.reason})" if r.session.reason else ""))
    return "\n".join(out)


def log_intent(w: Workspace, given: dict) -> str:
    options = {"limit": str(number_of(given, "n", 1, MOST_LOG, LOG))}
    for name, option in (("rev", "rev"), ("path", "file")):
        if given.get(name) is not None:
            options[option] = text_of(given, name)
    rows = w.log(**options).select("sha", "line", "annotation").collect()  # at most MOST_LOG
    return "\n".join(f"{r.sha[:8]} {r.line} [{r.annotation}]" for r in rows) or "(no commits matched)"


def blame_why(w: Workspace, given: dict) -> str:
    path, line = text_of(given, "file"), number_of(given, "line", 1, 2**31 - 1)
    found = w.blame(path, line).limit(1).collect()
    if not found:
        raise ValueError(f"{path} has no line {line}")
    r = found[0]
    if r.sha is None:
        return f"{path}:{line} isn't committed"
    out = [f"{path}:{line} comes from commit {r.sha[:8]}"]
    if r.change_id is None:
        return out[0] + "; no change is known for it"
    out.append(f"change {r.change_id}" + (f": {r.summary}" if r.summary else "; nothing is recorded"))
    if r.reasoning and r.reasoning.intent:
        out.append(f"intent: {r.reasoning.intent}")
    if r.created_at:
        later = w.later_touches(path, r.created_at, r.change_id)
        n, shown = later.count(), later.limit(LATER).collect()
        out += [f"later: {x.created_at} {x.change_id[:8]} {x.summary}" for x in shown] + ([f"later: {n - LATER} more"] if n > LATER else [])
    return "\n".join(out)


def ask_tools(w: Workspace) -> list[Tool]:
    return [Tool(f.__name__, lambda given, f=f: f(w, given)) for f in (commit_diff, show_change, log_intent, blame_why)]


def resolve(w: Workspace, commit: str) -> str:
    return git.git(w.repo, "rev-parse", "--verify", "--end-of-options", f"{commit}^{{commit}}").decode().strip()


def target_changes(w: Workspace, targets: list[str]):
    """change_id of targets: `c/...`, a commit, or a range `a..b` of commits."""
    out = []
    for t in targets:
        if ".." in t and not t.startswith("c/"):
            own = w.commits(rev=t).select("sha").join(w.owners(), "sha").select("change_id").distinct()
        else:
            own = w.spark.createDataFrame([(w.resolve_target(t if t.startswith("c/") else resolve(w, t)),)], "change_id string")
        out.append(own)
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found.where(F.col("change_id").isNotNull()).distinct()
