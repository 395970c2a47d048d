"""Changes and commits: which change a commit belongs to, folds, and the upkeep of the change map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import new_change_id, trailer_change_id
from ..workspace import cut

INFER_OVERLAP = 0.6


def members(change_map: DataFrame) -> DataFrame:
    """(sha, change_id, tree_pos): all commits that a change has or had."""
    return change_map.select(F.explode(F.array_distinct(F.concat(F.array("head"), F.coalesce("history", F.array().cast("array<string>"))))).alias("sha"), "change_id", "tree_pos", "folded_into")


def commit_to_change(change_map: DataFrame, last: bool = False) -> DataFrame:
    """sha and change_id: of several changes that know a commit the first in the tree's order, or the last (as after a rewrite)."""
    pick = F.max_by if last else F.min_by
    return members(change_map).groupBy("sha").agg(pick("change_id", "tree_pos").alias("change_id"))


def _followed(step: DataFrame, rounds: int) -> DataFrame:
    """k and at: where `rounds` doublings of a step (k, at) lead; what ends stays at its end, which is a row (k, k)."""
    at = step
    for _ in range(rounds):
        far = at.select(F.col("k").alias("at"), F.col("at").alias("far"))
        new = cut(at.join(far, "at").select("k", F.col("far").alias("at"), (F.col("far") != F.col("at")).alias("moved")))
        at = new.select("k", "at")
        if not new.where("moved").head(1):
            break
    return at


def fold_closure(edges: DataFrame, key: str = "change_id", parent: str = "folded_into") -> DataFrame:
    """change_id and survivor: where following `folded_into` ends. It stops before a change that is missing or was met before, so cycles end too.

    A pointer doubles its reach in each round, so chains and cycles of n folds take about log2(n) joins. What can still
    go on after n steps is on a cycle. Whoever enters a cycle walks once around it, so the end is the change before the entry.
    """
    e = edges.select(F.col(key).alias("k"), F.col(parent).alias("p"))
    known = cut(e.join(e.select(F.col("k").alias("p")).distinct(), "p", "left_semi").where(F.col("p") != F.col("k")).select("k", "p"))
    rounds = max(1, known.count()).bit_length() + 1
    step = cut(e.select("k").distinct().join(known, "k", "left").select("k", F.coalesce("p", "k").alias("at")))
    at = _followed(step, rounds)
    open_ = at.join(known.select(F.col("k").alias("at")), "at", "left_semi")
    done = at.join(open_.select("k"), "k", "left_anti")
    if open_.head(1):
        cycle = cut(open_.select(F.col("at").alias("k")).distinct())  # the places that n steps lead to
        # steps that stop at the first place on a cycle
        enter = step.join(open_.select("k"), "k", "left_semi").join(cycle.select("k", F.lit(True).alias("on")), "k", "left").select("k", F.when(F.col("on"), F.col("k")).otherwise(F.col("at")).alias("at"))
        before = known.join(cycle, "k", "left_semi").select(F.col("p").alias("at"), F.col("k").alias("end"))
        done = done.unionByName(_followed(cut(enter), rounds).join(before, "at").select("k", F.col("end").alias("at")))
    return done.select(F.col("k").alias(key), F.col("at").alias("survivor"))


def path_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of paths; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def best_siblings(commits: DataFrame, heads: DataFrame, least: float = INFER_OVERLAP) -> DataFrame:
    """sha, change_id, overlap: for a commit the unfolded change whose head has the same only parent and most of the same paths; the first in tree order of equal ones.

    commits: sha, parent, paths; heads: change_id, head, parent, paths, tree_pos.
    """
    c = commits.select("sha", "parent", F.array_distinct(F.coalesce("paths", F.array().cast(heads.schema["paths"].dataType))).alias("paths"))
    h = heads.select("change_id", "head", "parent", F.array_distinct(F.coalesce("paths", F.array().cast(heads.schema["paths"].dataType))).alias("paths"), "tree_pos")
    # siblings meet on a path that they share, so those of one parent are not all paired
    ours = c.select("sha", "parent", F.size("paths").alias("n"), F.explode("paths").alias("path"))
    theirs = h.select("change_id", "head", "parent", "tree_pos", F.size("paths").alias("m"), F.explode("paths").alias("path"))
    both = ours.join(theirs, ["parent", "path"]).where(F.col("sha") != F.col("head")).groupBy("sha", "change_id", "tree_pos", "n", "m").agg(F.count(F.lit(1)).alias("shared"))
    pairs = both.select("sha", "change_id", "tree_pos", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("overlap"))
    # two sets without paths are alike; of each parent the first two such heads are enough, as one may be the commit itself
    first = Window.partitionBy("parent").orderBy("tree_pos")
    empty = h.where(F.size("paths") == 0).withColumn("r", F.row_number().over(first)).where(F.col("r") <= 2).select("parent", "change_id", "head", "tree_pos")
    alike = c.where(F.size("paths") == 0).join(empty, "parent").where(F.col("sha") != F.col("head")).select("sha", "change_id", "tree_pos", F.lit(1.0).alias("overlap"))
    pairs = pairs.unionByName(alike).where(F.col("overlap") >= least)
    return pairs.groupBy("sha").agg(F.max_by(F.struct("change_id", "overlap"), F.struct("overlap", -F.col("tree_pos"))).alias("b")).select("sha", "b.*")


def append_member(history: Column, sha: Column) -> Column:
    return F.when(F.array_contains(history, sha), history).otherwise(F.array_append(history, sha))


def resolve(commits: DataFrame, change_map: DataFrame, siblings: DataFrame | None = None) -> DataFrame:
    """sha, change_id, rule, origin: known to the map (R1), a trailer of a known change (R2) or of a new one (R3), a sibling's (R4), or an id made here (R5). Reads only; `adopt` writes.

    commits: sha, message. siblings: of best_siblings().
    """
    folded = fold_closure(change_map)
    known = commit_to_change(change_map).join(folded, "change_id").select("sha", F.col("survivor").alias("mapped"))
    c = commits.select("sha", trailer_change_id(F.col("message")).alias("trailer")).join(known, "sha", "left")
    if siblings is None:
        c = c.withColumn("sibling", F.lit(None).cast("string"))
    else:
        c = c.join(siblings.select("sha", F.col("change_id").alias("sibling")), "sha", "left")
    # commits without a trailer find nothing, and by keys of their own they don't meet in one task
    c = c.withColumn("_by", F.coalesce("trailer", F.concat(F.lit("no trailer "), "sha"))).join(folded.select(F.col("change_id").alias("_by"), F.col("survivor").alias("by_trailer")), "_by", "left")
    rule = F.when(F.col("mapped").isNotNull(), "R1").when(F.col("by_trailer").isNotNull(), "R2").when(F.col("trailer").isNotNull(), "R3").when(F.col("sibling").isNotNull(), "R4").otherwise("R5")
    origin = F.when(rule.isin("R2", "R3"), "trailer-recovery").when(rule == "R4", "inferred").when(rule == "R5", "orphan-recovery")
    return c.select("sha", F.coalesce("mapped", "by_trailer", "trailer", "sibling", F.concat(F.substring(F.sha2(F.concat(F.lit("orphan"), F.col("sha")), 256), 1, 32))).alias("change_id"), rule.alias("rule"), origin.alias("origin"))


def adopt(change_map: DataFrame, resolved: DataFrame, now: str, order: str | None = None) -> DataFrame:
    """The change map with resolved commits: appended to their change's history; new changes get a row; all other columns stay.

    order: a column of resolved that says when each commit was read, as from the newest on. A new change's head is the first
    that was read; a sibling's commit moves the head, so the last one read holds. Without an order, ties fall by text.
    """
    at = F.col(order) if order else F.lit(0)
    fresh = resolved.where(F.col("rule") != "R1").withColumn("_at", at)
    sibling = F.col("rule") == "R4"
    add = fresh.groupBy("change_id").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("_at", "sha"))), lambda x: x["sha"]).alias("shas"), F.max_by(F.when(sibling, F.col("sha")), F.when(sibling, F.struct("_at", "sha"))).alias("new_head"),
        F.min_by("origin", F.struct("_at", "sha")).alias("new_origin"), F.bool_or(F.col("rule").isin("R2", "R3")).alias("by_trailer"),
    )
    m = change_map.join(add, "change_id", "full_outer")
    empty = F.array().cast("array<string>")
    new = {
        "head": F.coalesce("new_head", "head", F.element_at("shas", 1)), "history": F.array_union(F.coalesce("history", empty), F.coalesce("shas", empty)), "trailer_seen": F.coalesce("trailer_seen", F.lit(False)) | F.coalesce("by_trailer", F.lit(False)),
        "origin": F.when(F.col("new_head").isNotNull(), "inferred").otherwise(F.coalesce("origin", "new_origin")), "updated_at": F.when(F.col("shas").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")),
        **{c: F.coalesce(c, empty) for c in ("absorbed", "divergent_heads") if c in change_map.columns},
    }
    return m.select(*[new[c].alias(c) if c in new else F.col(c) for c in change_map.columns])


def rewrite_groups(pairs: DataFrame) -> DataFrame:
    """new_sha and old_shas in the order in which they were emitted. pairs: pos, old_sha, new_sha."""
    return pairs.groupBy("new_sha").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "old_sha"))), lambda x: x["old_sha"]).alias("old_shas"), F.min("pos").alias("pos"))


def post_rewrite(change_map: DataFrame, pairs: DataFrame) -> DataFrame:
    """new_sha, survivor, absorbed, unknown, outcome: what each rewritten commit does to the map. The first known change of a group survives and absorbs the others.

    Groups of one hook call that share no change; `rewrite_in_order` follows chains within a call.
    """
    owner = commit_to_change(change_map, last=True)
    g = pairs.join(owner.select(F.col("sha").alias("old_sha"), "change_id"), "old_sha", "left").groupBy("new_sha").agg(F.array_sort(F.collect_list(F.struct("pos", "change_id", "old_sha"))).alias("olds"))
    known = F.array_distinct(F.transform(F.filter("olds", lambda x: x["change_id"].isNotNull()), lambda x: x["change_id"]))
    unknown = F.transform(F.filter("olds", lambda x: x["change_id"].isNull()), lambda x: x["old_sha"])
    outcome = F.when(F.size("known") == 0, "unknown").when(F.size("known") == 1, "rekeyed").otherwise("folded")
    return g.select("new_sha", known.alias("known"), unknown.alias("unknown")).select("new_sha", F.try_element_at("known", F.lit(1)).alias("survivor"), F.slice("known", 2, 1 << 20).alias("absorbed"), "unknown", outcome.alias("outcome"))


def rewrite_in_order(change_map: list[dict], pairs: list[tuple[str, str]], now: str) -> tuple[list[dict], dict]:
    """One hook call on the driver, in order, as later groups see what earlier ones did: (changed rows, {rekeyed, folded, unknown}). A call has a few pairs."""
    rows = {r["change_id"]: dict(r) for r in change_map}
    owner = {sha: r["change_id"] for r in change_map for sha in [r["head"], *(r["history"] or [])]}
    groups: dict[str, list[str]] = {}
    for old, new in pairs:
        groups.setdefault(new, []).append(old)
    changed, report = {}, {"rekeyed": [], "folded": [], "unknown": []}
    for new, olds in groups.items():
        report["unknown"] += [o for o in olds if o not in owner]
        known = list(dict.fromkeys(owner[o] for o in olds if o in owner))
        if not known:
            continue
        first, rest = rows[known[0]], known[1:]
        history = list(first["history"] or [])
        first.update(head=new, history=history if new in history else [*history, new], origin="post-rewrite", updated_at=now)
        if rest:
            first["absorbed"] = list(dict.fromkeys([*(first.get("absorbed") or []), *rest]))
        for k in rest:
            rows[k].update(folded_into=known[0], updated_at=now)
        for k in known:
            changed[k] = rows[k]
            owner.update({sha: k for sha in [rows[k]["head"], *(rows[k]["history"] or [])]})
        report["folded" if rest else "rekeyed"].append((known[0], rest, new))
    return list(changed.values()), report


def relink(change_map: DataFrame, change_id: str, sha: str, now: str) -> DataFrame:
    """The change map with a change's head at another commit."""
    hit = F.col("change_id") == change_id
    return change_map.withColumns({"history": F.when(hit, append_member(F.col("history"), F.lit(sha))).otherwise(F.col("history")), "head": F.when(hit, F.lit(sha)).otherwise(F.col("head")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))})


def detach(change_map: DataFrame, sha: str, now: str) -> DataFrame:
    """The change map without a commit; a head that goes falls back to the last that remains. A change may not be emptied."""
    hit = F.array_contains("history", sha)
    left = F.array_remove("history", sha)
    safe = F.when(F.size(left) == 0, F.raise_error(F.lit("a change would have no commit left"))).otherwise(left)
    return change_map.withColumns({"head": F.when(hit & (F.col("head") == sha), F.element_at(safe, -1)).otherwise(F.col("head")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")), "history": F.when(hit, safe).otherwise(F.col("history"))})


def reconcile(commits: DataFrame, change_map: DataFrame) -> DataFrame:
    """scanned, healed, unlinked: what trailers alone can mend (R2, R3)."""
    r = resolve(commits, change_map)
    return r.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("rule").isin("R2", "R3")).alias("healed"), F.count_if(F.col("rule") == "R5").alias("unlinked"))


def squash_survivor(squashed: DataFrame, change_map: DataFrame) -> DataFrame:
    """pos, sha, change_id of the first squashed commit, oldest first, with a known change that isn't folded. squashed: pos, sha."""
    owner = commit_to_change(change_map).join(change_map.where(F.col("folded_into").isNull()).select("change_id"), "change_id", "left_semi")
    return squashed.join(owner, "sha").orderBy("pos").limit(1)


def squashed_commits(message: Column) -> Column:
    """The commits that a squash message lists, oldest first."""
    return F.reverse(F.regexp_extract_all(message, F.lit(r"(?m)^commit ([0-9a-f]{40})"), F.lit(1)))


def island(order: Column | str, changed: Column, by: list[str] | None = None) -> Column:
    """A number that grows by one wherever `changed` holds: neighbours of one number are one run."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(order)
    return F.sum(changed.cast("int")).over(w)


def minted() -> Column:
    return new_change_id()
