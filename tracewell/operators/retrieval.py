"""Hybrid retrieval: nearest vectors, BM25, rank fusion, boosts, enrichment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the ranking.
RRF_K, TOP_K, CANDIDATE_FACTOR, PATH_BOOST, LINE_BOOST, RECENT = 60, 8, 4, 1 / 30, 1 / 15, 5
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of one length, in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "key", embedding: str = "embedding") -> DataFrame:
    """key and distance of the k nearest rows, nearest first; equal distances by key. A row without a vector is left out; one of another length is an error."""
    q = F.array(*[F.lit(float(x)) for x in query])
    checked = F.when(F.size(embedding) == len(query), F.col(embedding)).otherwise(F.raise_error(F.concat(F.lit(f"a vector's length isn't {len(query)}: "), F.size(embedding).cast("string"))))
    return vectors.where(F.col(embedding).isNotNull()).select(F.col(key).alias("key"), distance(checked, q).alias("distance")).orderBy("distance", "key").limit(k)


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): the postings of an inverted index."""
    from ..functions.text import words

    w = docs.select(F.col(key).alias("key"), words(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("w"))
    return w.select("key", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("key", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: str, k: int | None, key: str = "key", text: str = "text") -> DataFrame:
    """key and score of the k best rows (all, if k is None) for any of the query's words; less is better. A query without words gives nothing.

    Two scans and no shuffle of rows: one aggregate for the corpus and the documents of each word, then each row
    scores itself by its counts of the query's words and keeps a place in the top k.
    """
    import re

    from ..functions.text import words

    asked = sorted(set(re.findall(r"\w+", query.lower())))
    if not asked:
        return docs.select(F.col(key).alias("key"), F.lit(0.0).alias("score")).where(F.lit(False))
    every = F.array(*map(F.lit, asked))
    w = docs.select(F.col(key).alias("key"), words(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("w"))
    own = F.element_at(F.transform(F.array(F.filter("w", lambda x: x.isin(asked))), lambda hits: F.transform(every, lambda t: F.size(F.filter(hits, lambda x: x == t)))), 1)
    counted = w.select("key", F.size("w").alias("dl"), own.alias("tf"))
    df = F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(asked))])
    corpus = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), df.alias("df"))
    idf = corpus.select("avgdl", F.transform("df", lambda d: F.greatest(F.log((F.col("n") - d + 0.5) / (d + 0.5)), F.lit(IDF_FLOOR))).alias("idf"))
    part = F.zip_with("tf", "s.idf", lambda n, i: i * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("dl") / F.col("s.avgdl"))))
    known = counted.where(F.exists("tf", lambda n: n > 0)).withColumn("s", idf.select(F.struct("avgdl", "idf")).scalar())
    scored = known.select("key", (-F.aggregate(part, F.lit(0.0), lambda s, x: s + x)).alias("score"))
    return scored if k is None else scored.orderBy("score", "key").limit(k)


def ranked(hits: DataFrame, by: str, kinds: DataFrame | None = None) -> DataFrame:
    """key and rank, from 1. kinds: rows (key) that may count; what is filtered takes no rank."""
    if kinds is not None:
        hits = hits.join(kinds, "key", "left_semi")
    # hits are a top-k list: a few rows
    return hits.select("key", F.row_number().over(Window.orderBy(by, "key")).alias("rank"))


def fuse(vector: DataFrame, keyword: DataFrame, k: int = TOP_K, rrf_k: int = RRF_K, boosts: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (key, rank): key, score, matched_by, rank. boosts: (key, boost) added to rows that are in a list."""
    v = vector.select("key", F.col("rank").alias("rv"))
    w = keyword.select("key", F.col("rank").alias("rk"))
    score = F.coalesce(1 / (rrf_k + F.col("rv")), F.lit(0.0)) + F.coalesce(1 / (rrf_k + F.col("rk")), F.lit(0.0))
    both = v.join(w, "key", "full_outer").select("key", score.alias("score"), F.array_compact(F.array(F.when(F.col("rv").isNotNull(), F.lit("vector")), F.when(F.col("rk").isNotNull(), F.lit("keyword")))).alias("matched_by"))
    if boosts is not None:
        both = both.join(boosts, "key", "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)


def position_boost(path: str, line: int | None, path_col: Column, start: Column, end: Column) -> Column:
    """What a chunk gains by standing at a place: its file, and the line within it."""
    at_line = F.lit(False) if line is None else F.coalesce(F.lit(line).between(start, end), F.lit(False))
    return F.when(path_col == path, F.lit(PATH_BOOST) + F.when(at_line, LINE_BOOST).otherwise(0.0)).otherwise(0.0)


def enrich(ranked_sources: DataFrame, chunks: DataFrame, effective: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Sources with their chunk, the effective entry of its change, and the session of the chunk or else of the entry. Left joins throughout: a source without intent stays."""
    out = ranked_sources.join(chunks, "key", "left").join(effective, "change_id", "left")
    if "entry_session_ref" in effective.columns:
        out = out.withColumn("session_ref", F.coalesce("session_ref", "entry_session_ref")).drop("entry_session_ref")
    return out if sessions is None else out.join(sessions, "session_ref", "left")


def with_recent(sources: DataFrame, recent: DataFrame) -> DataFrame:
    """Recent sources (key, order) flagged where they were found, and else appended after the others with score 0."""
    found = sources.join(recent.select("key", F.lit(True).alias("recent")), "key", "left")
    found = found.withColumn("matched_by", F.when(F.col("recent"), F.array_append("matched_by", F.lit("recency"))).otherwise(F.col("matched_by"))).drop("recent")
    last = sources.agg(F.coalesce(F.max("rank"), F.lit(0))).scalar()
    new = recent.join(sources.select("key"), "key", "left_anti").withColumn("last", last)
    new = new.select("key", F.lit(0.0).alias("score"), F.array(F.lit("recency")).alias("matched_by"), (F.col("last") + F.row_number().over(Window.orderBy("order"))).alias("rank"))
    return found.select("key", "score", "matched_by", "rank").unionByName(new)


def within_dates(sources: DataFrame, when: str, since: str | None, until: str | None, k: int) -> DataFrame:
    """Of ranked sources those in an inclusive span of time, cut to k and ranked anew. Without a time none is kept."""
    t = F.col(when)
    ok = t.isNotNull()
    ok = ok & (t >= F.lit(since).cast("timestamp")) if since else ok
    ok = ok & (t <= F.lit(until).cast("timestamp")) if until else ok
    return sources.where(ok).withColumn("rank", F.row_number().over(Window.orderBy("rank"))).where(F.col("rank") <= k)


def confidence(sources: DataFrame, cited: list[int] | None = None, tool_ok: bool = False) -> DataFrame:
    """One row (level, reason) on how an answer's sources were found. sources: kind, matched_by, rank."""
    if cited:
        sources = sources.where(F.col("rank").isin(cited))
    both = (F.col("kind") == "ledger") & F.array_contains("matched_by", "vector") & F.array_contains("matched_by", "keyword")
    a = sources.agg(F.coalesce(F.bool_or(both), F.lit(False)).alias("both"), F.coalesce(F.bool_or(F.col("kind") != "code"), F.lit(False)).alias("captured"))
    # The levels' reasons.
    level = F.when(F.lit(tool_ok), F.struct(F.lit("high").alias("level"), F.lit("read directly from the repository, not from similarity alone").alias("reason")))
    level = level.when(F.col("both"), F.struct(F.lit("high").alias("level"), F.lit("recorded intent matched by both keyword and vector retrieval").alias("reason")))
    level = level.when(F.col("captured"), F.struct(F.lit("medium").alias("level"), F.lit("drawn from captured intent/session records").alias("reason")))
    level = level.otherwise(F.struct(F.lit("low").alias("level"), F.lit("code context only — no captured intent among the sources").alias("reason")))
    return a.select(level.alias("c")).select("c.*")


def kind_counts(sources: DataFrame) -> DataFrame:
    """kind and count, in the order ledger, session, code; kinds without sources are left out."""
    order = F.array_position(F.array(F.lit("ledger"), F.lit("session"), F.lit("code")), F.col("kind"))
    return sources.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(order)


def unit(vector: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in vector)) or 1.0
    return [x / n for x in vector]
