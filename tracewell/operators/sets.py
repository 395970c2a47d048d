"""Merging, upserts and deletes of keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """New rows, and the old ones of other keys."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, and the first new row of each key that isn't there yet; what a content address names never changes."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def union_lines(*sides: DataFrame) -> DataFrame:
    """Each distinct row of any side, as a note's lines merge."""
    return reduce(DataFrame.unionByName, sides).distinct()


def merge_addressed(local: DataFrame, remote: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(all rows of both by key, one row with the outcome: adopted, up-to-date, fast-forward, local-ahead or merged)."""
    sides = local.select(key).distinct().withColumn("l", F.lit(1)).join(remote.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    counts = sides.agg(F.count("l").alias("l"), F.count("r").alias("r"), F.count_if(F.col("r").isNull()).alias("only_l"), F.count_if(F.col("l").isNull()).alias("only_r"))
    outcome = F.when((F.col("l") == 0) & (F.col("r") > 0), "adopted").when((F.col("only_l") == 0) & (F.col("only_r") == 0), "up-to-date").when(F.col("only_l") == 0, "fast-forward").when(F.col("only_r") == 0, "local-ahead").otherwise("merged")
    return insert_new(local, remote, key), counts.select(outcome.alias("outcome"), "l", "r", "only_l", "only_r")


def ref_outcome(local: Column, remote: Column, local_in_remote: Column, remote_in_local: Column) -> Column:
    """What fetching a ref comes to: nothing remote, adopted, the same, forward, ahead, or diverged (and the local one stays)."""
    return F.when(remote.isNull(), "absent").when(local.isNull(), "adopted").when(local == remote, "up-to-date").when(local_in_remote, "fast-forward").when(remote_in_local, "local-ahead").otherwise("diverged-kept-local")


def changes_between(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key, status (A, M, D), old and new content of what differs between two versions of a table."""
    a, b = old.select(key, F.col(content).alias("old")), new.select(key, F.col(content).alias("new"))
    both = a.join(b, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(key, F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").otherwise("M").alias("status"), "old", "new")


def merge_change_maps(local: DataFrame, remote: DataFrame, descends: DataFrame | None = None) -> DataFrame:
    """Two change maps as one, row by row: histories united; the head that descends from the other (descends: head, ancestor), else the lesser, with both kept as divergent; trailer_seen if either has it."""
    def one(df: DataFrame, tag: str) -> DataFrame:
        return df.select("change_id", *[F.col(c).alias(f"{c}_{tag}") for c in ("head", "history", "trailer_seen")])

    m = one(local, "l").join(one(remote, "r"), "change_id", "full_outer")
    if descends is None:
        m = m.withColumns({"l_new": F.lit(False), "r_new": F.lit(False)})
    else:
        d = descends.select(F.col("head").alias("h"), F.col("ancestor").alias("a"), F.lit(True).alias("y")).distinct()
        m = m.join(d.select(F.col("h").alias("head_l"), F.col("a").alias("head_r"), F.col("y").alias("l_new")), ["head_l", "head_r"], "left")
        m = m.join(d.select(F.col("h").alias("head_r"), F.col("a").alias("head_l"), F.col("y").alias("r_new")), ["head_r", "head_l"], "left").fillna(False, ["l_new", "r_new"])
    same = F.col("head_l").isNull() | F.col("head_r").isNull() | (F.col("head_l") == F.col("head_r"))
    head = F.when(same, F.coalesce("head_l", "head_r")).when(F.col("l_new"), F.col("head_l")).when(F.col("r_new"), F.col("head_r")).otherwise(F.least("head_l", "head_r"))
    empty = F.array().cast("array<string>")
    apart = F.when(~same & ~F.col("l_new") & ~F.col("r_new"), F.array_sort(F.array("head_l", "head_r")))
    return m.select("change_id", head.alias("head"), F.array_union(F.coalesce("history_l", empty), F.coalesce("history_r", empty)).alias("history"), (F.coalesce("trailer_seen_l", F.lit(False)) | F.coalesce("trailer_seen_r", F.lit(False))).alias("trailer_seen"), apart.alias("divergent_heads"))


def merge_whole_maps(local: DataFrame, remote: DataFrame, descends: DataFrame | None = None) -> DataFrame:
    """Two change maps as one, all columns by rule. descends: (head, ancestor) pairs that history knows.

    A side is ahead if its head descends from the other's head or its history holds that head (an amended commit descends from nothing) and not the other way round;
    if each knows the other's head, the side with the later update. Head and origin are those of the side that is ahead; of neither, the local ones, and both heads are
    divergent. A fold that one side knows holds; of two, the one of the later update, then the lesser. Histories, absorbed changes and divergent heads are united, trailer_seen holds if
    either side saw one, and the later update stays. A change that one side has comes as it is.
    """
    columns = [c for c in local.columns if c != "change_id"]
    empty = F.array().cast("array<string>")

    def one(df: DataFrame, tag: str) -> DataFrame:
        have = {c: F.col(c) if c in df.columns else F.lit(None).cast(local.schema[c].dataType) for c in columns}
        return df.select("change_id", F.lit(True).alias(f"in_{tag}"), *[v.alias(f"{c}_{tag}") for c, v in have.items()])

    m = one(local, "l").join(one(remote, "r"), "change_id", "full_outer")
    for name, head, other in (("l_down", "head_l", "head_r"), ("r_down", "head_r", "head_l")):
        if descends is None:
            m = m.withColumn(name, F.lit(False))
        else:
            m = m.join(descends.select(F.col("head").alias(head), F.col("ancestor").alias(other), F.lit(True).alias(name)).distinct(), [head, other], "left").fillna(False, [name])

    def holds(history: str, head: str) -> Column:
        return F.coalesce(F.array_contains(F.coalesce(history, empty), F.col(head)), F.lit(False))

    both = F.col("in_l").isNotNull() & F.col("in_r").isNotNull()
    l_knows, r_knows = F.col("l_down") | holds("history_l", "head_r"), F.col("r_down") | holds("history_r", "head_l")
    later = F.coalesce(F.col("updated_at_r") > F.col("updated_at_l"), F.lit(False))
    same = F.col("head_l").eqNullSafe(F.col("head_r"))
    remote_wins = F.col("in_l").isNull() | (both & ~same & r_knows & (~l_knows | later))
    apart = both & ~same & ~l_knows & ~r_knows

    def united(c: str) -> Column:
        return F.array_union(F.coalesce(f"{c}_l", empty), F.coalesce(f"{c}_r", empty))

    def taken(c: str) -> Column:
        return F.when(remote_wins, F.col(f"{c}_r")).otherwise(F.col(f"{c}_l"))

    two = F.col("folded_into_l").isNotNull() & F.col("folded_into_r").isNotNull()
    level = F.col("updated_at_l").eqNullSafe(F.col("updated_at_r"))
    rules = {
        "head": taken("head"), "origin": taken("origin"), "history": F.when(remote_wins, F.array_union(F.coalesce("history_r", empty), F.coalesce("history_l", empty))).otherwise(united("history")),
        "trailer_seen": F.coalesce("trailer_seen_l", F.lit(False)) | F.coalesce("trailer_seen_r", F.lit(False)), "absorbed": united("absorbed"), "updated_at": F.greatest("updated_at_l", "updated_at_r"), "tree_pos": F.coalesce("tree_pos_l", "tree_pos_r"),
        "folded_into": F.when(two, F.when(level, F.least("folded_into_l", "folded_into_r")).when(later, F.col("folded_into_r")).otherwise(F.col("folded_into_l"))).otherwise(F.coalesce("folded_into_l", "folded_into_r")),
        "divergent_heads": F.when(apart, F.array_sort(F.array_union(united("divergent_heads"), F.array("head_l", "head_r")))).otherwise(united("divergent_heads")),
    }
    # the head stands last in a history
    rules["history"] = F.when(rules["head"].isNull(), rules["history"]).otherwise(F.array_append(F.array_remove(rules["history"], rules["head"]), rules["head"]))
    return m.select("change_id", *[(rules[c] if c in rules else taken(c)).alias(c) for c in columns])


def new_divergence(merged: DataFrame, before: DataFrame) -> DataFrame:
    """change_id of changes with divergent heads that they had not before."""
    had = before.select("change_id", F.col("divergent_heads").alias("had"))
    return merged.join(had, "change_id", "left").where(F.size(F.array_except("divergent_heads", F.coalesce("had", F.array().cast("array<string>")))) > 0).select("change_id")
