"""Questions over an index: retrieval, enrichment and the deterministic part of an answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import citations
from ..operators import retrieval as r
from ..operators.embedding import bag_of_words_query
from ..operators.keyword import KeywordIndex

TOOL_ROUNDS, TOOL_CHARS = 6, 20_000


def retrieve(chunks: DataFrame, question: str, k: int = r.TOP_K, kinds: list[str] | None = None, embed: Callable[[str], list[float]] = bag_of_words_query, factor: int = r.CANDIDATE_FACTOR, boosts: DataFrame | None = None, keywords: KeywordIndex | None = None) -> DataFrame:
    """key, score, matched_by, rank: both halves take k times factor candidates; the kinds filter comes after that, so fewer than k may be left. keywords: a stored index of the chunks, so that no text is read."""
    if k < 1:
        raise ValueError("k is at least 1")
    pool = None if kinds is None else chunks.where(F.col("kind").isin(kinds)).select("key")
    v = r.ranked(r.nearest(chunks, embed(question), k * factor), "distance", pool)
    w = r.ranked(keywords.search(question, k * factor) if keywords else r.bm25(chunks, question, k * factor), "score", pool)
    return r.fuse(v, w, k, boosts=boosts)


@dataclass
class Tool:
    """Something an answering model may call."""

    name: str
    run: Callable[[dict], str]


@dataclass
class Answer:
    status: str
    text: str = ""
    cited: list[int] = field(default_factory=list)
    calls: list[tuple[str, bool, str]] = field(default_factory=list)
    usage: dict = field(default_factory=lambda: {"input": 0, "output": 0})


def run_tool(tools: dict[str, Tool], name: str, given: dict) -> tuple[bool, str]:
    """(ok, output): an unknown tool or one that raises is a result, not an error."""
    if name not in tools:
        return False, f"no tool {name}"
    try:
        out = tools[name].run(given)
    except Exception as e:
        return False, f"{name} failed: {e}"
    return True, (out or "(nothing)")[:TOOL_CHARS]


def answer(prompt: str, n_sources: int, client: Callable[[list], dict] | None, tools: list[Tool] = (), rounds: int = TOOL_ROUNDS) -> Answer:
    """A model's answer by an injected client, with tools for some rounds. Without a client, or where one fails, the status says why. client: messages to {text, calls: [(name, input)], usage}."""
    if client is None:
        return Answer("no-client")
    if not n_sources:
        return Answer("no-sources")
    out, messages, by_name = Answer("answered"), [("user", prompt)], {t.name: t for t in tools}
    for _ in range(rounds):
        try:
            reply = client(messages)
        except Exception as e:
            return Answer("client-failed", str(e), calls=out.calls, usage=out.usage)
        for k in out.usage:
            out.usage[k] += reply.get("usage", {}).get(k, 0)
        if not reply.get("calls"):
            out.text = reply.get("text", "")
            if not out.text.strip():
                return Answer("empty-answer", calls=out.calls, usage=out.usage)
            out.cited = cited_numbers(out.text, n_sources)
            return out
        results = [(name, *run_tool(by_name, name, given)) for name, given in reply["calls"]]
        out.calls += results
        messages = [*messages, ("assistant", reply), ("tools", results)]
    return Answer("too-many-rounds", calls=out.calls, usage=out.usage)


def cited_numbers(text: str, n: int) -> list[int]:
    import re

    return list(dict.fromkeys(k for k in map(int, re.findall(r"\[(\d{1,9})\]", text)) if 1 <= k <= n))


def cited_sources(answers: DataFrame, text: str, n: str) -> DataFrame:
    return answers.withColumn("cited", citations(F.col(text), F.col(n)))


def prompt_of(sources: list[dict], question: str, most_paths: int = 40) -> str:
    parts = [f"[{s['rank']}] {s['kind']} {s.get('path') or s.get('change_id') or ''}\n{s['text']}" + ("\nFiles changed ({}): {}".format(len(s["paths"]), ", ".join(s["paths"][:most_paths])) if s.get("paths") else "") for s in sources]
    return f"Question: {question}\n\n" + "\n\n".join(parts)


def ask(chunks: DataFrame, effective: DataFrame, question: str, k: int = r.TOP_K, kinds: list[str] | None = None, since: str | None = None, until: str | None = None, recent: DataFrame | None = None, **how) -> DataFrame:
    """The sources of an answer, enriched. With dates: four times as many, those in the span, cut to k, without the recency floor; else recent changes are added, unless the kinds leave ledger entries out."""
    dated = since is not None or until is not None
    found = retrieve(chunks, question, k * 4 if dated else k, kinds, **how)
    if not dated and recent is not None and (kinds is None or "ledger" in kinds):
        found = r.with_recent(found, recent)
    rich = r.enrich(found, chunks.drop("embedding"), effective)
    return r.within_dates(rich, "at", since, until, k) if dated else rich


def later_touches(entries: DataFrame, path: str, after: str, change_id: str) -> DataFrame:
    """Effective entries of other changes on a path after a time, oldest first. Times are compared as texts, as the records hold them."""
    hit = F.exists("scope", lambda s: s["path"] == path)
    return entries.where(F.col("folded_into").isNull() & (F.col("change_id") != change_id) & (F.col("created_at") > after) & hit).orderBy("created_at", "change_id")


def blame(lines: DataFrame, path: str, line: int, owners: DataFrame, effective: DataFrame) -> DataFrame:
    """One row for a line: its commit (null if not committed), change and the entry that holds. owners: sha, change_id."""
    at = lines.where((F.col("path") == path) & (F.col("line") == line)).select("path", "line", "sha")
    return at.join(owners, "sha", "left").join(effective, "change_id", "left")
