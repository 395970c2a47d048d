"""A change map made from history alone, for one that was lost.

What history says: trailers and notes claim commits for changes, and rewrites (old commit, new commit, in the order in which
hooks told of them) hand claims on. A new commit belongs to the change of the first of its old commits that any change has; the changes of
its other old commits fold into that one. Read one after another this is a replay; here each new commit points to that old one, and
pointers that double their reach find the claim where each chain of rewrites begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import trailer_change_id
from ..workspace import cut
from .audit import reachable
from .identity import _followed

REWRITES = "pos bigint, old_sha string, new_sha string"


def claims(commits: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """sha, change_id, by_trailer, walk_pos: what commits (sha, message, walk_pos) and notes (sha, change_id) say. A trailer goes before a note; of several notes' changes the least holds."""
    c = commits.select("sha", trailer_change_id(F.col("message")).alias("trailer"), "walk_pos").dropDuplicates(["sha"])
    if notes is None:
        n = c.select("sha").where(F.lit(False)).withColumn("noted", F.lit(None).cast("string"))
    else:
        n = notes.where(F.col("sha").isNotNull()).groupBy("sha").agg(F.min("change_id").alias("noted"))
    both = c.join(n, "sha", "full_outer").withColumn("change_id", F.coalesce("trailer", "noted"))
    return both.where(F.col("change_id").isNotNull()).select("sha", "change_id", F.col("trailer").isNotNull().alias("by_trailer"), "walk_pos")


def owned(claimed: DataFrame, rewrites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sha, change_id, at of each commit that some change has; change_id, folded_into, at, pos of each fold). at: where a rewrite that made the commit, or the fold, begins in the order; null for a claimed commit that no known one was rewritten to.

    A commit that was made from known ones belongs to their change, whatever it claims. Rewrites go forward: what is old in one was made by an earlier one or not at all.
    """
    r = cut(rewrites.where(F.col("old_sha") != F.col("new_sha")).select("pos", "old_sha", "new_sha"))
    edges = r.groupBy(F.col("old_sha").alias("sha")).agg(F.collect_set("new_sha").alias("parents"))
    known = cut(reachable(edges, claimed.select("sha")).select("sha"))
    begins = r.groupBy("new_sha").agg(F.min("pos").alias("at"))
    first = r.join(known.select(F.col("sha").alias("old_sha")), "old_sha").groupBy("new_sha").agg(F.min_by("old_sha", "pos").alias("old")).join(begins, "new_sha")
    step = cut(known.join(first.withColumnRenamed("new_sha", "sha"), "sha", "left").select(F.col("sha").alias("k"), F.coalesce("old", "sha").alias("at"), F.col("at").alias("begins")))
    rounds = max(1, step.where(F.col("begins").isNotNull()).count()).bit_length() + 1
    root = _followed(step.select("k", "at"), rounds)
    own = cut(root.join(claimed.select(F.col("sha").alias("at"), "change_id"), "at").select(F.col("k").alias("sha"), "change_id").join(step.select(F.col("k").alias("sha"), F.col("begins").alias("at")), "sha"))
    olds = r.join(own.select(F.col("sha").alias("old_sha"), F.col("change_id").alias("was")), "old_sha")
    folds = olds.join(own.select(F.col("sha").alias("new_sha"), F.col("change_id").alias("into"), "at"), "new_sha").where(F.col("was") != F.col("into"))
    return own, folds.select(F.col("was").alias("change_id"), F.col("into").alias("folded_into"), "at", "pos")


def rebuilt(commits: DataFrame, now: str, notes: DataFrame | None = None, rewrites: DataFrame | None = None, folds: DataFrame | None = None) -> DataFrame:
    """A change map (schemas.CHANGE_MAP) from commits (sha, message, walk_pos: the newest first), notes (sha, change_id), rewrites, and folds that entries tell of (change_id, folded_into).

    A change's history: claimed commits from the oldest on, those outside the walk first, then rewritten ones in their order; its head is the last. The last fold of
    a change holds, and those of rewrites go before those of entries. Changes that neither a commit nor a rewrite knows aren't in the map. Nulls in any column count as nothing said; repeated rows count once.
    """
    spark = commits.sparkSession
    claimed = cut(claims(commits, notes))
    r = rewrites if rewrites is not None else spark.createDataFrame([], REWRITES)
    own, by_rewrite = owned(claimed, r)
    walk = claimed.select("sha", "walk_pos", "by_trailer")
    rows = own.join(walk, "sha", "left")
    place = F.struct(F.col("at").isNotNull().alias("made"), F.when(F.col("at").isNull(), F.coalesce(-F.col("walk_pos"), F.lit(-(1 << 62)))).otherwise(F.col("at")).alias("place"), "sha")
    base = rows.groupBy("change_id").agg(F.transform(F.array_sort(F.collect_set(place)), lambda p: p["sha"]).alias("history"), F.max(F.coalesce("by_trailer", F.lit(False))).alias("trailer_seen"), F.max(F.col("at").isNotNull()).alias("made"))
    told = by_rewrite.select("change_id", "folded_into", F.lit(True).alias("seen"), "at", "pos")
    if folds is not None:
        none = F.lit(None).cast("long")
        told = told.unionByName(folds.where(F.col("folded_into").isNotNull() & (F.col("folded_into") != F.col("change_id"))).select("change_id", "folded_into", F.lit(False).alias("seen"), none.alias("at"), none.alias("pos")))
    last = told.groupBy("change_id").agg(F.max_by("folded_into", F.struct("seen", "at", "pos", "folded_into")).alias("folded_into"))
    taken = told.groupBy(F.col("folded_into").alias("change_id"), F.col("change_id").alias("other")).agg(F.min(F.struct("seen", "at", "pos")).alias("when"))
    taken = taken.groupBy("change_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("when", "other"))), lambda t: t["other"]).alias("absorbed"))
    empty = F.array().cast("array<string>")
    m = base.join(last, "change_id", "left").join(taken, "change_id", "left").withColumns({
        "head": F.element_at("history", -1), "origin": F.when(F.col("made"), "post-rewrite").when(F.col("trailer_seen"), "trailer-recovery").otherwise("rebuild-map"), "absorbed": F.coalesce("absorbed", empty),
        "divergent_heads": empty, "updated_at": F.lit(now), "tree_pos": F.xxhash64("change_id"),
    })
    return m.select(*[c.split()[0] for c in schemas.CHANGE_MAP.split(", ")])
