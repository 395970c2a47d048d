"""Checks over a ledger: what refers to nothing, what can't be reached, what was guessed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import cut


def dangling(references: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return references.where(F.col(key).isNotNull()).select(key).distinct().join(stored.select(key), key, "left_anti")


def reachable(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """sha of all commits that tips (sha) lead to over parents.

    Along first parents a table of jumps, each twice as far as the one before, marks whole lines of history: n commits
    in a row take log2(n) joins. Other parents of what was marked then start the next round, so there are as many rounds as merges
    stand behind one another on the way to a commit. Each step is cut from its lineage. Tips that are no known commits are returned too.
    """
    parents = cut(commits.select("sha", F.posexplode("parents").alias("pos", "parent")))
    jump = parents.where(F.col("pos") == 0).select("sha", F.col("parent").alias("to"))
    jumps = []
    while jump.head(1):  # the longest line has under 2 ** len(jumps) steps, or it is a cycle that jumps over itself
        jumps.append(jump)
        if len(jumps) > 62:
            break
        far = jump.select(F.col("sha").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(far, "to").select("sha", F.col("far").alias("to")))
    others = parents.where(F.col("pos") > 0).select("sha", "parent")
    seen, front = None, cut(tips.select("sha").distinct())
    while front.head(1):
        for j in reversed(jumps):
            front = cut(front.unionByName(front.join(j, "sha").select(F.col("to").alias("sha"))).distinct())
        new = front if seen is None else front.join(seen, "sha", "left_anti")
        seen = front if seen is None else cut(seen.unionByName(new))
        front = cut(new.join(others, "sha").select(F.col("parent").alias("sha")).distinct().join(seen, "sha", "left_anti"))
    return seen if seen is not None else tips.select("sha").distinct()


def unreachable_heads(change_map: DataFrame, reached: DataFrame) -> DataFrame:
    """Heads of unfolded changes that no ref leads to; nothing if no commit is known to be reached."""
    some = reached.select("sha").limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    heads = change_map.where(F.col("folded_into").isNull()).select("change_id", F.col("head").alias("sha"))
    return heads.join(reached.select("sha"), "sha", "left_anti").where(some).select("change_id", "sha")


def stale_blobs(changed: DataFrame, current: DataFrame, key: str = "blob_sha") -> DataFrame:
    """Old blobs of changed paths that no current path holds: their chunks can go."""
    return changed.where(F.col(key).isNotNull()).select(key).distinct().join(current.select(key), key, "left_anti")


def identity_findings(change_map: DataFrame, unreachable: DataFrame) -> DataFrame:
    """finding and change_id: five kinds of anomaly in a change map."""
    def kind(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("finding"), "change_id")

    m = change_map
    return reduce(DataFrame.unionByName, [
        kind("inferred", m.where((F.col("origin") == "inferred") & F.col("folded_into").isNull())), kind("orphan", m.where(F.col("origin") == "orphan-recovery")), kind("trailer-recovery", m.where(F.col("origin") == "trailer-recovery")),
        kind("divergent", m.where(F.coalesce(F.size("divergent_heads"), F.lit(0)) > 0)), kind("unreachable", unreachable),
    ])


def check_rows(findings: DataFrame) -> DataFrame:
    """name, status, message, ids (three at most, in order) and repairs for each finding, as a doctor's report has them."""
    g = findings.groupBy("finding").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("change_id")), 1, 3).alias("ids"))
    status = F.when(F.col("finding").isin("divergent", "unreachable"), "warn").otherwise("info")
    return g.select(F.col("finding").alias("name"), status.alias("status"), F.concat(F.col("n").cast("string"), F.lit(" change(s): "), F.array_join("ids", ", "), F.when(F.col("n") > 3, F.concat(F.lit(" and "), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")).alias("message"), "ids", F.transform("ids", lambda x: F.concat(F.lit("relink "), x)).alias("repairs"))


def index_findings(state: DataFrame, chunks: DataFrame, fingerprint: str, head: str) -> DataFrame:
    """problem rows of an index against its checkpoint: another model, another count, or behind the head."""
    s = state.withColumn("stored", chunks.agg(F.count(F.lit(1))).scalar())
    checks = [(F.col("model_fingerprint") != fingerprint, "model", F.concat(F.lit("built with "), F.col("model_fingerprint"))), (F.col("chunk_count") != F.col("stored"), "count", F.concat(F.col("stored").cast("string"), F.lit(" stored, "), F.col("chunk_count").cast("string"), F.lit(" recorded"))), (F.col("last_indexed_commit") != head, "stale", F.concat(F.lit("indexed at "), F.col("last_indexed_commit")))]
    return s.select(F.explode(F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(name).alias("problem"), text.alias("detail"))) for bad, name, text in checks]))).alias("p")).select("p.*")
