"""An index of a commit graph that answers whether one commit leads to another, for many pairs at once.

A commit goes on the line of its first parent if it is the first of that parent's children in the walk; else it begins a line of its own. On a line
a place is enough: who stands at a place leads to all lower ones. Lines are joined by the other parents, one row each. So a question is a
path over lines, and the index a row a commit and a row a parent that lies on another line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import stored

#: Places of a line that are looked up together, so that the joints of a long line are dealt over many tasks.
SEGMENT = 1024


def lines(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places: sha, line (its lowest commit), place (from 0), at, door (the highest place of a joint at or below, null if none); joints: line, segment, place, at, to_line, to_place, to_at).

    commits: sha, parents, at. `at` is a place in a walk that has each commit before its parents. Parents that are no known
    commits count as none; a commit that appears twice counts once. Pointers along lines double their reach, so a line of n commits takes log2(n) joins.
    """
    c = commits.dropDuplicates(["sha"])
    known = c.select(F.col("sha").alias("parent"), F.col("at").alias("parent_at"))
    edges = stored(c.select("sha", "at", F.posexplode("parents").alias("pos", "parent")).join(known, "parent").select("sha", "at", "pos", "parent"))
    first = edges.where(F.col("pos") == 0).groupBy("parent").agg(F.min_by("sha", F.struct("at", "sha")).alias("sha"))
    below = stored(first.select("sha", F.col("parent").alias("to"), F.lit(1).cast("long").alias("steps")))
    # what has come to its line's end is written once and only looked up from then on
    ends = below.select(F.col("sha").alias("to"), F.lit(False).alias("done"))
    parts = [stored(below.join(ends, "to", "left").select("sha", "to", "steps", F.coalesce("done", F.lit(True)).alias("done")))]
    while parts[-1].where(~F.col("done")).head(1):
        parts[-1:] = [parts[-1].where("done"), parts[-1].where(~F.col("done"))]
        far = _all(parts).select(F.col("sha").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"), "done")
        parts[-1] = stored(parts[-1].drop("done").join(far, "to").select("sha", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), "done"))
    on = _all(parts).select("sha", "to", "steps")
    places = stored(c.select("sha", "at").join(on, "sha", "left").select("sha", F.coalesce("to", "sha").alias("line"), F.coalesce("steps", F.lit(0)).cast("long").alias("place"), "at"))
    to = places.select(F.col("sha").alias("parent"), F.col("line").alias("to_line"), F.col("place").alias("to_place"), F.col("at").alias("to_at"))
    joints = edges.select("sha", "parent").join(to, "parent").join(places, "sha").where(F.col("line") != F.col("to_line"))
    joints = stored(joints.select("line", _segment(F.col("place")).alias("segment"), "place", "at", "to_line", "to_place", "to_at").distinct())
    return stored(_with_doors(places, joints)), joints


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _segment(place):
    return F.floor(place / SEGMENT)


def _with_doors(places: DataFrame, joints: DataFrame) -> DataFrame:
    """Windows hold a segment's places, or a line's segments that have joints."""
    kind = places.schema["sha"].dataType
    marks = joints.select("line", "segment", "place").distinct().select(F.lit(None).cast(kind).alias("sha"), "line", "segment", "place", F.lit(None).cast("long").alias("at"), F.col("place").alias("joint"))
    rows = places.select("sha", "line", _segment(F.col("place")).alias("segment"), "place", F.col("at").cast("long").alias("at"), F.lit(None).cast("long").alias("joint")).unionByName(marks)
    own = F.max("joint").over(Window.partitionBy("line", "segment").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    lower = Window.partitionBy("line").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    held = places.where(F.col("place") >= SEGMENT).select("line", _segment(F.col("place")).alias("segment")).distinct().select("line", "segment", F.lit(None).cast("long").alias("last"))
    held = held.unionByName(joints.groupBy("line", "segment").agg(F.max("place").alias("last"))).groupBy("line", "segment").agg(F.max("last").alias("last"))
    before = held.select("line", "segment", F.max("last").over(lower).alias("before")).where(F.col("before").isNotNull())
    rows = rows.withColumn("own", own).where(F.col("sha").isNotNull()).join(before, ["line", "segment"], "left")
    return rows.select("sha", "line", "place", "at", F.coalesce("own", "before").alias("door"))


def leads_to(pairs: DataFrame, places: DataFrame, joints: DataFrame) -> DataFrame:
    """descendant, ancestor and leads (boolean) for each distinct pair; a commit leads to itself, an unknown one to nothing else.

    All commits between two joints of a line leave it by the same door, so what is walked is a row a door that was asked for, whatever the number of pairs: over
    joints whose far ends still come before the last of its ancestors in the walk, with the highest place that it comes to of each line.
    There are as many rounds as joints on the longest of these paths.
    """
    p = pairs.select("descendant", "ancestor").distinct()
    return placed_lead(p.join(side(places, "descendant"), "descendant", "left").join(side(places, "ancestor"), "ancestor", "left"), joints)


def side(places: DataFrame, name: str) -> DataFrame:
    """Places as the `descendant` or `ancestor` of pairs."""
    return places.select(F.col("sha").alias(name), *[F.col(c).alias(f"{c}_{name[0]}") for c in ("line", "place", "at", "door")])


def placed_lead(pairs: DataFrame, joints: DataFrame) -> DataFrame:
    """As leads_to, a row a pair, of pairs whose commits were joined with their `side` before they were paired, so that pairs aren't shuffled for it."""
    one_line = F.col("line_d") == F.col("line_a")
    own = F.coalesce(one_line & (F.col("place_d") >= F.col("place_a")), F.lit(False)) | F.col("descendant").eqNullSafe(F.col("ancestor"))
    far = F.coalesce((F.col("line_d") != F.col("line_a")) & (F.col("at_d") <= F.col("at_a")) & F.col("door_d").isNotNull(), F.lit(False))
    asked = pairs.select("descendant", "ancestor", own.alias("leads"), far.alias("far"), *[F.when(far, F.col(c)).alias(n) for c, n in (("line_d", "from_line"), ("door_d", "door"), ("line_a", "line"), ("place_a", "goal"), ("at_a", "at_a"))])
    asked = stored(asked)
    key = ["from_line", "door"]
    front = asked.where("far").groupBy(*key).agg(F.max("at_a").alias("last_at")).select(*key, F.col("from_line").alias("line"), F.col("door").alias("place"), "last_at")
    front = stored(front)
    fronts = [front]
    # what a segment can lead to at all
    spans = stored(joints.groupBy("line", "segment").agg(F.min("to_at").alias("least_at")))
    while front.head(1):
        where = front.join(spans, "line").where((F.col("segment") <= _segment(F.col("place"))) & (F.col("least_at") <= F.col("last_at"))).drop("least_at")
        j = joints.select("line", "segment", F.col("place").alias("from_place"), "to_line", "to_place", "to_at")
        there = where.join(j, ["line", "segment"]).where((F.col("from_place") <= F.col("place")) & (F.col("to_at") <= F.col("last_at")))
        there = there.groupBy(*key, F.col("to_line").alias("line")).agg(F.max("to_place").alias("place"), F.max("last_at").alias("last_at"))
        been = _all(fronts).groupBy(*key, "line").agg(F.max("place").alias("been"))
        front = there.join(been, [*key, "line"], "left").where(F.col("been").isNull() | (F.col("place") > F.col("been"))).drop("been")
        front = stored(front)
        fronts.append(front)
    come = _all(fronts).groupBy(*key, "line").agg(F.max("place").alias("come"))
    over = asked.where("far").join(come, [*key, "line"], "left").select("descendant", "ancestor", F.coalesce(F.col("come") >= F.col("goal"), F.lit(False)).alias("leads"))
    return asked.where(~F.col("far")).select("descendant", "ancestor", "leads").unionByName(over)
