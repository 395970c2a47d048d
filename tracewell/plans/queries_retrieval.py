"""Queries on retrieval, embeddings and answers. Chunks are `documents` (kind by language, path by source), vectors are `embeddings`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import retrieval as r
from ..operators.batches import by_cost
from ..operators.embedding import bag_of_words, split_by_cache
from ..operators.index import run_counts
from ..operators.keyword import KeywordIndex
from ..operators.vectors import VectorStore
from ..workspace import shared_dir
from .catalogue import Tables, query

QUESTION = "the license of nicht under que"
K = r.TOP_K * r.CANDIDATE_FACTOR
_KIND = "CASE lang WHEN 'en' THEN 'code' WHEN 'de' THEN 'ledger' ELSE 'session' END"


def chunks(x: Tables) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "code").when(F.col("lang") == "de", "ledger").otherwise("session")
    n_lines = F.size(F.split("text", "\n"))
    return x.documents.select(F.col("doc_id").alias("key"), "text", kind.alias("kind"), F.col("source").alias("path"), F.lit(1).alias("start_line"), n_lines.alias("end_line"), (F.col("doc_id") % 150).alias("change_id"))


def _vectors(x: Tables, k: int) -> DataFrame:
    e = x.embeddings.select(F.col("vec_id").alias("key"), "embedding")
    q = e.where(F.col("key") == 0).first()
    return r.nearest(e, list(q.embedding) if q else [], k) if q else e.select("key", F.lit(0.0).alias("distance"))


def _latest_event(x: Tables) -> DataFrame:
    e = x.events
    return e.groupBy(F.col("user_id").alias("change_id")).agg(F.max_by(F.struct("event_type", "ts", "event_id"), F.struct("ts", "event_id")).alias("e")).select("change_id", F.col("e.event_type").alias("summary"), F.col("e.ts").alias("at"), F.col("e.event_id").alias("entry"))


_KNN = """knn AS (
  SELECT e.vec_id AS key, sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)))) AS distance
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round(distance, 12), key LIMIT {k})"""
_BM25 = f"""toks AS (SELECT doc_id AS key, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+') AS w FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
post AS (SELECT key, term, dl, count(*) AS tf FROM (SELECT key, len(w) AS dl, unnest(w) AS term FROM toks) WHERE term IN ({", ".join(f"'{w}'" for w in sorted(set(QUESTION.split())))}) GROUP BY ALL),
idf AS (SELECT term, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM post GROUP BY term), corpus),
bm AS (SELECT key, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN idf USING (term) GROUP BY key ORDER BY round(score, 9), key LIMIT {{k}})"""


def _fused(boost: str = "0", where: str = "TRUE", k: int = r.TOP_K) -> str:
    return f"""{_KNN.format(k=K)}, {_BM25.format(k=K)},
meta AS (SELECT doc_id AS key, source AS path, {_KIND} AS kind, len(string_split(text, chr(10))) AS n_lines FROM documents),
v AS (SELECT key, row_number() OVER (ORDER BY round(distance, 12), key) AS rv FROM knn WHERE key IN (SELECT key FROM meta WHERE {where})),
w AS (SELECT key, row_number() OVER (ORDER BY round(score, 9), key) AS rk FROM bm WHERE key IN (SELECT key FROM meta WHERE {where})),
f AS (SELECT coalesce(v.key, w.key) AS key, coalesce(1.0::DOUBLE / (60 + rv), 0) + coalesce(1.0::DOUBLE / (60 + rk), 0) AS score, CASE WHEN rv IS NULL THEN 'keyword' WHEN rk IS NULL THEN 'vector' ELSE 'vector,keyword' END AS matched_by FROM v FULL JOIN w ON v.key = w.key),
b AS (SELECT f.key, f.score + {boost} AS score, matched_by FROM f LEFT JOIN meta USING (key)),
fused AS (SELECT key, score, matched_by, row_number() OVER (ORDER BY round(score, 12) DESC, key) AS rank FROM b QUALIFY rank <= {k})"""


def _fuse(x: Tables, k: int = r.TOP_K, kinds: list[str] | None = None, boosts: DataFrame | None = None) -> DataFrame:
    c = chunks(x)
    pool = c.select("key") if kinds is None else c.where(F.col("kind").isin(kinds)).select("key")
    v = r.ranked(_vectors(x, K).withColumn("distance", F.round("distance", 12)), "distance", pool)
    w = r.ranked(r.bm25(c, QUESTION, K).withColumn("score", F.round("score", 9)), "score", pool)
    return r.fuse(v, w, k, boosts=boosts)


@query(f"WITH {_BM25.format(k=20)} SELECT key, round(score, 6) AS score FROM bm")
def keyword_index_topk(x: Tables) -> DataFrame:
    """The same as bm25_topk from a stored index, which only its building reads texts for."""
    index = KeywordIndex(x.spark, f"{shared_dir(x.spark)}/tracewell/keywords-{uuid.uuid4().hex}")
    index.build(chunks(x))
    return index.search(QUESTION, 20).withColumn("score", F.round("score", 6))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("key", F.round("score", 9).alias("score"), F.array_join("matched_by", ",").alias("matched_by"), F.col("rank").cast("long").alias("rank"))


_SHOW = "SELECT key, round(score, 9) AS score, matched_by, rank FROM fused"


@query(f"WITH {_KNN.format(k=10)} SELECT key, round(distance, 9) AS distance FROM knn")
def knn_topk(x: Tables) -> DataFrame:
    return _vectors(x, 10).withColumn("distance", F.round("distance", 9))


@query(f"WITH {_BM25.format(k=20)} SELECT key, round(score, 6) AS score FROM bm")
def bm25_topk(x: Tables) -> DataFrame:
    return r.bm25(chunks(x), QUESTION, 20).withColumn("score", F.round("score", 6))


@query("SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_statistics(x: Tables) -> DataFrame:
    p = r.terms(x.documents, "doc_id", "text")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_fused()} {_SHOW}")
def rrf_fuse(x: Tables) -> DataFrame:
    return _shown(_fuse(x))


@query(f"WITH {_fused(where="kind IN ('ledger', 'session')")} {_SHOW}")
def rrf_kinds(x: Tables) -> DataFrame:
    return _shown(_fuse(x, kinds=["ledger", "session"]))


@query(f"WITH {_fused(boost="CASE WHEN path = 'src3' THEN 1.0::DOUBLE / 30 ELSE 0 END")} {_SHOW}")
def rrf_path_boost(x: Tables) -> DataFrame:
    c = chunks(x)
    return _shown(_fuse(x, boosts=c.select("key", r.position_boost("src3", None, F.col("path"), F.col("start_line"), F.col("end_line")).alias("boost"))))


@query(f"WITH {_fused(boost="CASE WHEN path = 'src3' THEN 1.0::DOUBLE / 30 + CASE WHEN 4 BETWEEN 1 AND n_lines THEN 1.0::DOUBLE / 15 ELSE 0 END ELSE 0 END")} {_SHOW}")
def rrf_line_boost(x: Tables) -> DataFrame:
    c = chunks(x)
    return _shown(_fuse(x, boosts=c.select("key", r.position_boost("src3", 4, F.col("path"), F.col("start_line"), F.col("end_line")).alias("boost"))))


_LATEST = "latest AS (SELECT user_id AS change_id, event_type AS summary, ts AS happened, event_id AS entry FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"


def _enriched(x: Tables, k: int = r.TOP_K) -> DataFrame:
    labels = x.labels.groupBy(F.col("doc_id").alias("key")).agg(F.max("quality").alias("quality"))
    return r.enrich(_fuse(x, k), chunks(x), _latest_event(x)).join(labels, "key", "left")


@query(f"WITH {_fused()}, {_LATEST} SELECT f.key, f.rank, {_KIND} AS kind, (f.key % 150) AS change_id, l.summary, l.entry::VARCHAR AS entry, coalesce(q.quality, -1) AS quality FROM fused f JOIN documents d ON d.doc_id = f.key LEFT JOIN latest l ON l.change_id = f.key % 150 LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q ON q.doc_id = f.key")
def ask_enriched(x: Tables) -> DataFrame:
    return _enriched(x).select("key", F.col("rank").cast("long").alias("rank"), "kind", "change_id", "summary", F.col("entry").cast("string").alias("entry"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@query(f"""WITH {_fused()}, {_LATEST}, recent AS (SELECT change_id AS key, row_number() OVER (ORDER BY happened DESC, change_id) AS o FROM latest QUALIFY o <= 5)
SELECT f.key, round(score, 9) AS score, matched_by || CASE WHEN r.key IS NULL THEN '' ELSE ',recency' END AS matched_by, rank FROM fused f LEFT JOIN recent r USING (key)
UNION ALL SELECT key, 0.0, 'recency', (SELECT coalesce(max(rank), 0) FROM fused) + row_number() OVER (ORDER BY o) FROM recent WHERE key NOT IN (SELECT key FROM fused)""")
def ask_recency_floor(x: Tables) -> DataFrame:
    recent = _latest_event(x).orderBy(F.desc("at"), "change_id").limit(r.RECENT)
    recent = recent.select(F.col("change_id").alias("key"), F.struct((-F.unix_micros(F.col("at").cast("timestamp"))).alias("a"), F.col("change_id").alias("b")).alias("order"))
    return _shown(r.with_recent(_fuse(x), recent))


@query(f"WITH {_fused(k=K)}, {_LATEST}, e AS (SELECT f.key, f.rank AS r0, l.happened FROM fused f LEFT JOIN latest l ON l.change_id = f.key % 150) SELECT key, row_number() OVER (ORDER BY r0) AS rank FROM e WHERE happened >= TIMESTAMP '2024-01-01' AND happened <= TIMESTAMP '2031-01-01' QUALIFY rank <= 8")
def ask_date_filtered(x: Tables) -> DataFrame:
    e = r.enrich(_fuse(x, K), chunks(x), _latest_event(x))
    return r.within_dates(e, "at", "2024-01-01", "2031-01-01", r.TOP_K).select("key", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_fused()}, s AS (SELECT {_KIND} AS kind, matched_by FROM fused f JOIN documents d ON d.doc_id = f.key)
SELECT CASE WHEN coalesce(bool_or(kind = 'ledger' AND matched_by = 'vector,keyword'), FALSE) THEN 'high' WHEN coalesce(bool_or(kind <> 'code'), FALSE) THEN 'medium' ELSE 'low' END AS level FROM s""")
def ask_confidence(x: Tables) -> DataFrame:
    return r.confidence(_fuse(x).join(chunks(x), "key")).select("level")


@query(f"WITH {_fused()} SELECT {_KIND} AS kind, count(*) AS n FROM fused f JOIN documents d ON d.doc_id = f.key GROUP BY 1")
def ask_kind_counts(x: Tables) -> DataFrame:
    return r.kind_counts(_fuse(x).join(chunks(x), "key"))


@query("""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), lambda t: ('0x' || sha256(t)[1:2])::INT % 8) AS b FROM documents),
c AS (SELECT doc_id, list_transform(range(0, 8), lambda i: len(list_filter(b, lambda y: y = i))::DOUBLE) AS c FROM w),
n AS (SELECT doc_id, c, sqrt(list_sum(list_transform(c, lambda z: z * z))) AS norm FROM c)
SELECT doc_id, array_to_string(list_transform(CASE WHEN norm = 0 THEN [1.0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[] ELSE list_transform(c, lambda z: z / norm) END, lambda z: round(z * 100000)::BIGINT::VARCHAR), ',') AS v FROM n""")
def bow_embed(x: Tables) -> DataFrame:
    v = bag_of_words(F.col("text"), 8)
    return x.documents.select("doc_id", F.array_join(F.transform(v, lambda z: F.round(z * 100000).cast("long").cast("string")), ",").alias("v"))


_CACHE = "cache AS (SELECT DISTINCT sha256('bow:8' || chr(0) || sha256(text) || chr(0) || source) AS k FROM documents WHERE lang <> 'en')"


@query(f"WITH {_CACHE} SELECT d.doc_id, sha256('bow:8' || chr(0) || sha256(text) || chr(0) || source) AS cache_key, k IS NOT NULL AS hit FROM documents d LEFT JOIN cache ON k = sha256('bow:8' || chr(0) || sha256(text) || chr(0) || source)")
def embed_cache_split(x: Tables) -> DataFrame:
    c = x.documents.select("doc_id", "lang", t.digest(F.col("text")).alias("blob_sha"), F.col("source").alias("node_path"))
    cache = c.where(F.col("lang") != "en").select(t.cache_key(F.lit("bow:8"), F.col("blob_sha"), F.col("node_path")).alias("cache_key"), F.array_repeat(F.lit(0.5), 8).alias("vector")).dropDuplicates(["cache_key"])
    hits, misses = split_by_cache(c, cache, "bow:8", 8)
    return hits.select("doc_id", "cache_key", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", "cache_key", F.lit(False).alias("hit")))


@query(f"SELECT {_KIND} AS kind, count(*) AS indexed, count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) AS reused, count(*) FILTER (doc_id NOT IN (SELECT vec_id FROM embeddings)) AS embedded FROM documents GROUP BY 1")
def index_run_counts(x: Tables) -> DataFrame:
    have = x.embeddings.select(F.col("vec_id").alias("key"), F.lit(True).alias("reused"))
    return run_counts(chunks(x).join(have, "key", "left").fillna(False, ["reused"]))


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: '\"' || w || '\"'), ' OR ') AS query FROM documents")
def keyword_query_text(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", t.keyword_query(F.col("text")).alias("query"))


@query(f"WITH {_KNN.format(k=20)} SELECT key, round(distance, 9) AS distance FROM knn")
def vector_store_topk(x: Tables) -> DataFrame:
    """The nearest vectors from a stored index by cells."""
    e = x.embeddings.where(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("key"), "embedding")
    q = e.where(F.col("key") == 0).first()
    if q is None:
        return e.select("key", F.lit(0.0).alias("distance"))
    store = VectorStore(x.spark, f"{shared_dir(x.spark)}/tracewell/vectors-{uuid.uuid4().hex}", len(q.embedding))
    store.build(e)
    return store.query(list(q.embedding), 20)[0].select("key", F.round("distance", 9).alias("distance"))


_CLASS = "ceil(n / greatest(1, 2 ** (len(bin(n)) - 4)))::BIGINT * greatest(1, 2 ** (len(bin(n)) - 4))::BIGINT"


@query(f"""WITH l AS (SELECT doc_id, greatest(len(text), 1) AS n FROM documents), c AS (SELECT doc_id, n, {_CLASS} AS batch_class FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY batch_class ORDER BY n, doc_id) - 1 AS rank, greatest(least(40000000 // (batch_class * batch_class), 16), 1) AS most FROM c)
SELECT doc_id, batch_class, (rank // most)::BIGINT AS batch, (rank % most)::BIGINT AS place FROM k""")
def embed_batches(x: Tables) -> DataFrame:
    d = x.documents.select("doc_id", F.length("text").alias("n"))
    return by_cost(d, "n", "doc_id").select("doc_id", "batch_class", "batch", F.col("place").cast("long").alias("place"))
