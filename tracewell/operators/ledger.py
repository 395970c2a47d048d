"""The intent ledger: notes parsed into entries, duplicates removed, and the entry that holds for a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_json, instant_ms

# a key is hot if a thousandth of all rows holds so many of its rows, some 64,000 in all
HOT_SAMPLE, HOT_ROWS = 0.001, 64
LINE_SCHEMA, ENVELOPE_SCHEMA = "ledger-note@2", "ledger-note@1"


def strength(created_at: Column, human: Column, revision: Column, digest: Column) -> Column:
    """What orders a change's entries: the instant, then the human's name (none is least), the revision, and the digest."""
    return F.struct(instant_ms(created_at).alias("at"), F.coalesce(human, F.lit("")).alias("human"), revision.alias("revision"), digest.alias("digest"))


def effective(entries: DataFrame, by: str | list[str], strength_of: Column, *values: str) -> DataFrame:
    """For each key the values of its strongest entry, or without values the fields of its strength, which are then sorted and shuffled once; one partial aggregate, in whatever order the rows come."""
    by = [by] if isinstance(by, str) else by
    strongest = F.max_by(F.struct(*values), strength_of) if values else F.max(strength_of)
    return entries.groupBy(*by).agg(strongest.alias("e")).select(*by, "e.*")


def dealt(entries: DataFrame, by: str, strength_of: Column) -> DataFrame:
    """The fields of the strength of entries, brought together by key as they are.

    A split of a large table holds few entries of a key, so to sort each split for a partial aggregate saves little and spills.
    Only keys with many rows, as a sample tells, are aggregated where they lie, so none fills a task; nothing is left out.
    """
    fields = entries.select(by, strength_of.alias("e")).select(by, "e.*")
    hot = F.broadcast(entries.select(by).sample(HOT_SAMPLE, seed=1).groupBy(by).count().where(F.col("count") >= HOT_ROWS).select(F.col(by).alias("hot")))
    is_hot = F.col(by).eqNullSafe(F.col("hot"))
    strongest = effective(entries.join(hot, is_hot, "left_semi"), by, strength_of)
    return fields.join(hot, is_hot, "left_anti").unionByName(strongest).repartition(by)


def distinct_entries(entries: DataFrame, by: list[str], digest: str, position: Column) -> DataFrame:
    """One row for each key and digest: the one at the first position."""
    w = entries.withColumn("_p", position)
    rest = [c for c in entries.columns if c not in (*by, digest)]
    return w.groupBy(*by, digest).agg(F.min_by(F.struct(*rest), "_p").alias("e")).select(*by, digest, "e.*")


def numbered(entries: DataFrame, by: str, order: list[Column], strength_of: Column) -> DataFrame:
    """Entries of each key numbered in order, with the one that holds marked and the number of those it supersedes. A key's entries are its revisions, a handful."""
    w = Window.partitionBy(by)
    s = entries.withColumn("_s", strength_of)
    return s.select("*", F.row_number().over(w.orderBy(*order)).alias("n"), (F.col("_s") == F.max("_s").over(w)).alias("is_effective"), (F.count(F.lit(1)).over(w) - 1).alias("superseded")).drop("_s")


def parse_notes(notes: DataFrame, sha: str = "commit_sha", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Note bodies as (entries, notes that can't be read).

    A body is one JSON line or an older envelope with an `entries` array, or else a line for each entry (blank
    and repeated lines are allowed). Entries: sha, format, change_id, entry (canonical JSON), digest, position,
    oldest first. A body that is no JSON, is empty, has a line of another shape or mixes changes is unreadable,
    with a reason, and gives no entries.
    """
    full = F.filter(F.split(F.col(body), "\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")
    # the parser stops after one value, so a body of several lines is one document only if its first line is none
    single = (F.size(full) <= 1) | F.try_parse_json(F.element_at(full, 1)).isNull()
    whole = F.when(single, F.try_parse_json(F.col(body)))
    is_line = F.try_variant_get(whole, "$.entry.change_id", "string").isNotNull()
    envelope = F.try_variant_get(whole, "$.entries", "array<variant>")
    lines = F.array_sort(F.array_distinct(full))
    n = notes.select(
        F.col(sha).alias("sha"), whole.isNotNull().alias("whole"),
        F.when(whole.isNotNull() & ~is_line & envelope.isNotNull(), "legacy-envelope").otherwise("jsonl").alias("format"),
        F.when(whole.isNotNull() & is_line, F.array(F.to_json(F.try_variant_get(whole, "$.entry", "variant")))).when(whole.isNotNull(), F.transform(envelope, lambda v: F.to_json(v))).otherwise(F.transform(lines, lambda x: F.to_json(F.try_variant_get(F.try_parse_json(x), "$.entry", "variant")))).alias("entries"),
    )
    ids = F.array_distinct(F.transform("entries", lambda e: F.get_json_object(e, "$.change_id")))
    bad = F.coalesce(F.exists("entries", lambda e: e.isNull() | F.get_json_object(e, "$.change_id").isNull()), F.lit(True))
    why = F.when(F.coalesce(F.size("entries"), F.lit(0)) <= 0, F.when(F.col("whole"), "JSON of another shape").otherwise("empty")).when(bad, "a line isn't an entry").when(F.size(ids) > 1, "entries of several changes")
    judged = n.withColumn("reason", why)
    rows = judged.where(F.col("reason").isNull()).select("sha", "format", F.posexplode("entries").alias("line", "entry"))
    at = instant_ms(F.get_json_object("entry", "$.created_at"))
    rows = rows.select("sha", "format", F.get_json_object("entry", "$.change_id").alias("change_id"), "entry", F.sha2(F.col("entry"), 256).alias("digest"), F.row_number().over(Window.partitionBy("sha").orderBy(at, "line")).alias("position"))
    return rows, judged.where(F.col("reason").isNotNull()).select("sha", "reason")


def note_lines(entries: DataFrame, sha: str = "commit_sha", raw: str = "raw") -> DataFrame:
    """Note bodies again: the distinct canonical lines of each commit, in order."""
    line = F.concat(F.lit('{"entry":'), canonical_json(F.col(raw)), F.lit(f',"schema":"{LINE_SCHEMA}"}}'))
    return entries.groupBy(sha).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("body"))
