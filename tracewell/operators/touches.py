"""What touched a path after an entry, for all entries at once.

For each path and time the later touches are those of greater times on the path. Times on a path are kept as one row each, range-sorted and numbered in runs, so a path of
any length fills several tasks: counts within a run come from a window over it, and what later runs hold from a row a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import cut

SALTS = 64


def _least(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key, by parts first, so that no key's rows meet in one task."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    for by in ([*keys, "_s"], keys):
        salted = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n)
    return salted.drop("_s", "_r")


def later_touches(entries: DataFrame, depth: int = 5) -> DataFrame:
    """change_id, path, created_at, n_later, later (the first `depth` as structs of created_at, change_id, summary), more: the count of the others.

    entries: one row a change, the entry that holds, with created_at (text; compared as text), summary, folded_into, and paths (array). Touches are
    those of changes that are not folded, strictly later on the path; of one time they stand by change_id. A row for each entry and
    distinct path; entries without a time or paths have none. A path that an entry names twice counts once; repeated rows of a change count once.
    """
    one = entries.where(F.col("created_at").isNotNull()).groupBy("change_id").agg(F.min(F.struct("created_at", "summary", "folded_into", "paths")).alias("e")).select("change_id", "e.*")
    rows = cut(one.select("change_id", "created_at", "summary", F.col("folded_into").isNull().alias("live"), F.explode(F.array_distinct(F.array_compact("paths"))).alias("path")))
    first = _least(rows.where("live").select("path", "created_at", "change_id", "summary"), ["path", "created_at"], ["change_id"], depth)
    first = first.groupBy("path", "created_at").agg(F.array_sort(F.collect_list(F.struct("created_at", "change_id", "summary"))).alias("first"))  # at most `depth`
    times = rows.groupBy("path", "created_at").agg(F.count_if("live").alias("n")).join(first, ["path", "created_at"], "left")
    none = F.array().cast(first.schema["first"].dataType)
    runs = cut(times.withColumn("first", F.coalesce("first", none)).repartitionByRange("path", "created_at").withColumn("run", F.spark_partition_id()))
    within = Window.partitionBy("path", "run").orderBy("created_at")
    onward = within.rowsBetween(1, Window.unboundedFollowing)

    def heads(lists, n: int = depth):
        return F.slice(F.flatten(lists), 1, n)

    # of each run with live touches the first ones, and the first ones from it on
    some = runs.where(F.col("n") > 0).withColumn("r", F.row_number().over(within)).where(F.col("r") <= depth)
    head = some.groupBy("path", "run").agg(heads(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "first"))), lambda x: x["first"])).alias("head"))
    along = Window.partitionBy("path").orderBy("run")  # a row a run: at most one a task of the range sort
    onwards = head.select("path", "run", heads(F.collect_list("head").over(along.rowsBetween(0, depth))).alias("head"))
    sums = runs.groupBy("path", "run").agg(F.sum("n").alias("n")).join(onwards, ["path", "run"], "left")
    beyond = along.rowsBetween(1, Window.unboundedFollowing)
    sums = sums.select("path", "run", F.coalesce(F.sum("n").over(beyond), F.lit(0)).alias("n_after"), F.coalesce(F.first("head", ignorenulls=True).over(beyond), none).alias("head_after"))
    live = runs.withColumn("k", F.when(F.col("n") > 0, 1).otherwise(0)).withColumn("k", F.sum("k").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    # of each time the first `depth` touching times after it, numbered by how many live times came before
    lists = live.where(F.col("n") > 0).withColumn("next", heads(F.collect_list("first").over(Window.partitionBy("path", "run").orderBy("k").rowsBetween(0, depth)))).select("path", "run", F.col("k").alias("at"), "next")
    at = live.withColumns({"n_in": F.coalesce(F.sum("n").over(onward), F.lit(0)), "at": F.col("k") + 1}).join(lists, ["path", "run", "at"], "left").join(sums, ["path", "run"])
    at = at.select("path", "created_at", (F.col("n_in") + F.col("n_after")).alias("n_later"), F.slice(F.concat(F.coalesce("next", none), "head_after"), 1, depth).alias("later"))
    return rows.select("change_id", "path", "created_at").join(at, ["path", "created_at"]).select("change_id", "path", "created_at", "n_later", "later", (F.col("n_later") - F.size("later")).alias("more"))
