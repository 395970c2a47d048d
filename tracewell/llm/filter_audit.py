"""Which documents five filters fail, alone and in every order, counted by part of the corpus.

1. Documents are range-sorted by a fingerprint of the text, the whole text and doc_id. In each sorted run a row is compared with its
   predecessor: one of an equal text fails the filter for copies if the text was met under a lesser id. The same pass judges the
   other filters, once a run of equal texts, so texts are shuffled once and leave the pass as a mask of a few bits.
   Ranges are cut by (fingerprint, doc_id), so a text of a third of all rows fills many partitions.
2. What a partition's first text is known for in earlier partitions comes from a row a border: the last texts of each
   partition, by digest, with their least ids.
3. Masks are counted by part, mask and labels. Everything else is sums over at most 2^filters masks a part, as what an order keeps
   depends only on the set of filters applied so far.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, column, with_text

LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 100, 80, 10
FILTERS = "ABCDE"
COPY = 16  # the bit of E
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CAPITALS, _SIGNS, _FOLLOWING = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
#: Bytes of a text from which its words are not held as a list.
LONG = 4_000_000


def text_mask(text: bytes) -> int:
    """Bits of the filters that a text (UTF-8) fails: 1 few words, 2 few distinct words, 4 many capitals, 8 signs."""
    if len(text) < LONG:
        words = text.split()
        n, distinct = len(words), len(set(words))
    else:
        n, seen = 0, set()
        for m in _WORD.finditer(text):
            n += 1
            seen.add(m[0])
        distinct = len(seen)
    capitals, points = len(text) - len(text.translate(None, _CAPITALS)), len(text.translate(None, _FOLLOWING))
    return (n < LEAST_WORDS) | (100 * distinct < DISTINCT_PERCENT * n) << 1 | (100 * capitals > CAPITALS_PERCENT * points) << 2 | (len(text.translate(None, _SIGNS)) < len(text)) << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (fp, text, doc_id, part): pid, doc_id, part, mask, and the text's digest while the fingerprint is the partition's first. At the end a row (mask -1) with digest and least id of each text of the last fingerprint."""
    pid = TaskContext.get().partitionId()
    names = ["pid", "doc_id", "part", "mask", "border"]

    def rows(ids: pa.Array, parts: pa.Array, masks: list, borders: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(masks), pid, np.int32)), ids, parts, pa.array(masks, pa.int32()), pa.array(borders, pa.binary())], names)

    first = last = text = least = digest = None
    mask, group = 0, []
    for batch in batches:
        masks, borders = [], []
        for fp, own, doc_id in zip(column(batch, "fp").to_pylist(), column(batch, "text"), column(batch, "doc_id").to_pylist(), strict=True):
            own = own.as_py()
            if fp != last or own != text:
                if fp != last:
                    first, last, group = fp if last is None else first, fp, []
                text, least, mask = own, doc_id, text_mask(own)
                group.append((own, doc_id))
                digest = hashlib.sha256(own).digest() if fp == first else None
            masks.append(mask | (COPY if least is not None and doc_id is not None and least < doc_id else 0))
            borders.append(digest)
        yield rows(column(batch, "doc_id"), column(batch, "part"), masks, borders)
    if group:
        yield rows(pa.array([k for _, k in group], pa.int64()), pa.nulls(len(group), pa.string()), [-1] * len(group), [hashlib.sha256(t).digest() for t, _ in group])


def failure_masks(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """doc_id, part (lang; null as empty) and mask of each row of documents: bits 1 to 16 for the filters A to E."""
    keyed = with_text(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    keyed = keyed.select(F.xxhash64("text").alias("fp"), F.col("text").cast("binary").alias("text"), "doc_id", "part")
    by_id = F.col("doc_id").asc_nulls_last()
    ordered = keyed.repartitionByRange("fp", by_id).sortWithinPartitions("fp", "text", by_id)
    out = scratch.put(ordered.mapInArrow(_judged, "pid int, doc_id long, part string, mask int, border binary"), "judged")
    rows, ends = out.where(F.col("mask") >= 0), out.where(F.col("mask") < 0)
    # a row or two a partition, unless fingerprints collide
    heads = rows.where(F.col("border").isNotNull()).select("pid", "border").distinct().select("pid", "border", F.lit(None).cast("long").alias("least"), F.lit(True).alias("head"))
    earlier = Window.partitionBy("border").orderBy("pid").rangeBetween(Window.unboundedPreceding, -1)
    known = heads.unionByName(ends.select("pid", "border", F.col("doc_id").alias("least"), F.lit(False).alias("head"))).withColumn("least", F.min("least").over(earlier))
    known = known.where(F.col("head") & F.col("least").isNotNull()).select("pid", "border", "least")
    copy = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    return rows.join(F.broadcast(known), ["pid", "border"], "left").select("doc_id", "part", F.when(copy, F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")).alias("mask"))


def counted(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents by part, mask and labels. A document with several label rows has a label if any says so."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    both = masks.join(marks.where(F.col("good") | F.col("toxic")), "doc_id", "left").fillna(False, ["good", "toxic"])
    return both.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """From counted(), a row a part, order of the filters and step. What is left after a step is what fails none of the filters so far, so
    each part needs one sum a set of filters; Shapley's share of a document goes to each of its k filters in 1/k of all orders."""
    sets, orders = 1 << len(filters), ["".join(p) for p in permutations(filters)]
    n, mask = F.col("n"), F.col("mask")

    def passing(s: int, rows=F.lit(True)):
        return F.coalesce(F.sum(F.when((mask.bitwiseAND(s) == 0) & rows, n)), F.lit(0))

    fails = [F.coalesce(F.sum(F.when(mask.bitwiseAND(1 << k) != 0, n)), F.lit(0)) for k in range(len(filters))]
    alone = [F.coalesce(F.sum(F.when(mask == 1 << k, n)), F.lit(0)) for k in range(len(filters))]
    share = F.lit(factorial(len(filters))) * n / F.bit_count(mask)  # whole, as k divides n! for k up to n
    shapley = [F.coalesce(F.sum(F.when(mask.bitwiseAND(1 << k) != 0, share.cast("long"))), F.lit(0)) for k in range(len(filters))]
    part = counts.groupBy("part").agg(
        F.array(*[passing(s) for s in range(sets)]).alias("left"), F.array(*[passing(s, F.col("good")) for s in range(sets)]).alias("left_good"), F.array(*[passing(s, F.col("toxic")) for s in range(sets)]).alias("left_toxic"),
        F.array(*fails).alias("fails"), F.array(*alone).alias("alone"), F.array(*shapley).alias("shapley"),
    )
    plan = [{"filter_order": o, "step": k + 1, "k": filters.index(f), "before": (before := sum(1 << filters.index(x) for x in o[:k])), "after": before + (1 << filters.index(f))} for o in orders for k, f in enumerate(o)]
    steps = part.select("*", F.explode(F.from_json(F.lit(json.dumps(plan)), "array<struct<filter_order:string,step:int,k:int,before:int,after:int>>")).alias("s")).select(*part.columns, "s.*")

    def lost(c: str):
        return F.get(c, "before") - F.get(c, "after")

    return steps.select("part", "filter_order", "step", F.get("left", "after").alias("kept"), lost("left").alias("removed"), (F.get("fails", "k") - lost("left")).alias("redundant"), F.get("alone", "k").alias("unique_fails"), lost("left_good").alias("good_lost"), lost("left_toxic").alias("toxic_lost"), F.get("shapley", "k").alias("shapley"))


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text counts as empty and a null lang as the part ''. A row is a copy if its text stands under a lesser
    doc_id anywhere; rows of one id are no copies of each other, and a null id is neither less nor greater than another. Labels of
    ids that no document has, and other columns, are ignored. Empty documents give no rows. Counts are a table of at most
    128 rows a part in the shared folder.
    """
    scratch = Scratch(spark, "filter-audit")
    counts = scratch.put(counted(failure_masks(scratch, docs), labels), "counts")
    scratch.drop("judged")
    return interactions(counts)


def audit_sql() -> str:
    """The same for DuckDB."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT part, doc_id,
    (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit, coalesce(list_sum(list_transform(string_split(filter_order[:step - 1], ''), lambda q: CASE WHEN q = '' THEN 0 ELSE 1 << (ascii(q) - 65) END)), 0)::INT AS before FROM o, range(1, 6) r(step))
SELECT part, filter_order, step::INT AS step, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost,
    sum(CASE WHEN mask & bit <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
FROM x, s GROUP BY part, filter_order, step"""
