"""Taking in what another workspace knows, and giving it what this one knows, with an answer for each kind of record.

Sessions are united by content address, notes by lines (git's own merge of notes), and change maps row by row (`sets.merge_whole_maps`), with
ancestry from both histories. They go in this order, so that nothing refers to what has not come yet. Each step gives the same
when it is done again, so a run that broke off is mended by the next; tables are written against the version that was read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ancestry, details, sets
from ..sources import git
from ..sources.versioned import Conflict, VersionedTable
from ..workspace import cut

if TYPE_CHECKING:
    from .workspace import Workspace

RESULT = "phase string, kind string, action string, detail string"
NOTES, STAGED = "refs/notes/intent", "refs/notes/staged/intent"
KINDS = ["sessions", "notes", "change-map"]


class Unconfirmed(RuntimeError):
    pass


def descends(mine: Workspace, theirs: Workspace, pairs: DataFrame) -> DataFrame:
    """head and ancestor: those of the pairs (descendant, ancestor) of which either history says so."""
    found = None
    for w in (mine, theirs):
        graph = w.commits(rev="--all", order="topo").select("sha", "parents", F.col("walk_pos").alias("at"))
        hit = ancestry.leads_to(pairs, *ancestry.lines(graph)).where("leads").select(F.col("descendant").alias("head"), "ancestor")
        found = hit if found is None else found.unionByName(hit)
    return found.distinct()


def merged_map(mine: Workspace, theirs: Workspace) -> tuple[DataFrame, str, str]:
    """(the map of both, what that is to this side, how many heads diverge)."""
    a, b = cut(mine.change_map()), cut(theirs.change_map())
    if not b.head(1):
        return a, "up-to-date" if not a.head(1) else "local-ahead", ""
    apart = a.select("change_id", F.col("head").alias("x")).join(b.select("change_id", F.col("head").alias("y")), "change_id").where(F.col("x") != F.col("y"))
    pairs = cut(apart.select(F.col("x").alias("descendant"), F.col("y").alias("ancestor")).unionByName(apart.select(F.col("y").alias("descendant"), F.col("x").alias("ancestor"))))
    m = cut(sets.merge_whole_maps(a, b, descends(mine, theirs, pairs) if pairs.head(1) else None))
    named = [c for c in m.columns if c != "tree_pos"]

    def changed(side: DataFrame) -> bool:
        return bool(m.select(*named).exceptAll(side.select(*named)).head(1))

    known, ahead = not changed(a), not changed(b)
    n = sets.new_divergence(m, a).count()
    action = "adopted" if not a.head(1) else "up-to-date" if known and ahead else "local-ahead" if known else "fast-forwarded" if ahead else "merged"
    return m, action, f"{n} with divergent heads" if n else ""


def _ref(repo: str, ref: str) -> str:
    return git.git(repo, "rev-parse", "--verify", "-q", ref, allow=True).decode().strip()


def _leads(repo: str, old: str, new: str) -> bool:
    return git.succeeds(repo, "merge-base", "--is-ancestor", old, new)


def fetch_notes(repo: str, other: str, dry: bool) -> tuple[str, str]:
    """(action, detail) of taking in the other repository's notes: staged under a ref of its own, then united line by line."""
    theirs, mine = _ref(other, NOTES), _ref(repo, NOTES)
    if not theirs or theirs == mine:
        return ("up-to-date", "") if theirs or not mine else ("local-ahead", "")
    if dry:
        return "would-fetch", f"there at {theirs[:8]}"
    try:
        git.git(repo, "fetch", "-q", "--no-tags", other, f"+{NOTES}:{STAGED}")
        if not mine:
            git.git(repo, "update-ref", NOTES, theirs, git.ZERO)
            return "adopted", ""
        if _leads(repo, theirs, mine):
            return "local-ahead", ""
        forward = _leads(repo, mine, theirs)
        git.git(repo, "notes", f"--ref={NOTES}", "merge", "-q", "-s", "cat_sort_uniq", STAGED)
        return ("fast-forwarded", "") if forward else ("merged", "union of lines")
    finally:
        git.git(repo, "update-ref", "-d", STAGED, allow=True)


def push_notes(repo: str, other: str, dry: bool) -> tuple[str, str]:
    if not _ref(repo, NOTES):
        return "skipped", "no notes"
    out = git.git(repo, "push", "--porcelain", *(["--dry-run"] if dry else []), other, f"{NOTES}:{NOTES}", allow=True, output=True).decode()
    said = [git.push_status(line) for line in out.splitlines()]
    ref, action, detail = next((s for s in said if s), (NOTES, "rejected", "no answer"))
    return "would-push" if dry and action == "pushed" else action, detail


def _write(table: VersionedTable, rows: DataFrame, version: int) -> tuple[str, str]:
    try:
        table.write(rows, version)
    except Conflict as e:
        return "rejected", str(e)
    return "pushed", ""


def payload(w: Workspace) -> dict[str, str]:
    """What each kind of record would send, in words."""
    entries, bad = w.notes()
    n = entries.agg(F.count(F.lit(1)).alias("e"), F.count_distinct("sha").alias("c")).withColumn("b", bad.agg(F.count(F.lit(1))).scalar())
    one = n.select(details.notes_label(F.col("e"), F.col("c") + F.col("b"), F.col("b"))).first()[0]
    count = lambda df, label: df.agg(F.count(F.lit(1)).alias("n")).select(label(F.col("n"))).first()[0]
    return {"sessions": count(w.sessions(), details.sessions_label), "notes": one, "change-map": count(w.change_map(), details.changes_label)}


def reminder(told: dict[str, str]) -> str:
    return "Sessions may hold code and context of your work. This is sent:\n" + "\n".join(f"  {k:<12}({told[k]})" for k in KINDS)


def sync(mine: Workspace, theirs: Workspace, fetch: bool = True, push: bool = False, dry: bool = False, yes: bool = False, confirm: Callable[[str], bool] | None = None) -> DataFrame:
    """RESULT rows, one for each phase and kind of record: adopted, up-to-date, fast-forwarded, local-ahead, merged; pushed, rejected, skipped; would-fetch and would-push of a dry run, which moves nothing.

    Pushing needs yes=True or a `confirm` that says so, given what would be sent in words; without either it is refused before anything is pushed.
    """
    rows: list[tuple] = []
    if fetch:
        v = mine.session_table.version()
        united, said = sets.merge_addressed(mine.sessions(), theirs.sessions(), "session_ref")
        one = said.first()
        action = {"fast-forward": "fast-forwarded"}.get(one.outcome, one.outcome)
        moves = one.only_r > 0
        if moves and not dry:
            mine.session_table.write(united, v)
        rows.append(("fetch", "sessions", "would-fetch" if moves and dry else action, f"{one.only_r} new" if moves else ""))
        rows.append(("fetch", "notes", *fetch_notes(mine.repo, theirs.repo, dry)))
        v = mine.map_table.version()
        m, action, detail = merged_map(mine, theirs)
        moves = action not in ("up-to-date", "local-ahead")
        if moves and not dry:
            mine.map_table.write(m, v)
        rows.append(("fetch", "change-map", "would-fetch" if moves and dry else action, detail))
    if push:
        told = payload(mine)
        if not (dry or yes):
            if confirm is None:
                raise Unconfirmed("nothing is pushed without a confirmation.\n" + reminder(told))
            if not confirm(reminder(told)):
                return mine.spark.createDataFrame(rows + [("push", k, "skipped", "declined") for k in KINDS], RESULT)
        rows += [("push", k, *_pushed(mine, theirs, k, dry)) for k in KINDS]
    return mine.spark.createDataFrame(rows, RESULT)


def _pushed(mine: Workspace, theirs: Workspace, kind: str, dry: bool) -> tuple[str, str]:
    if kind == "notes":
        return push_notes(mine.repo, theirs.repo, dry)
    if kind == "sessions":
        table, v = theirs.session_table, theirs.session_table.version()
        united, said = sets.merge_addressed(theirs.sessions(), mine.sessions(), "session_ref")
        new = said.first().only_r
        return ("up-to-date", "") if not new else ("would-push", f"{new} new") if dry else _write(table, united, v)
    table, v = theirs.map_table, theirs.map_table.version()
    m, action, detail = merged_map(theirs, mine)
    if action in ("up-to-date", "local-ahead"):
        return "up-to-date", detail
    if detail:  # heads that only the other side can judge
        return "rejected", detail
    return ("would-push", "") if dry else _write(table, m, v)


def clean(result: DataFrame) -> bool:
    """Whether nothing was rejected and no heads diverge."""
    return not result.where((F.col("action") == "rejected") | F.col("detail").contains("divergent")).head(1)
