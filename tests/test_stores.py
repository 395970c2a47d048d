"""Stores of vectors, caches of embeddings and batches for a model."""

import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import batches, retrieval, vectors
from tracewell.operators.embedding import bag_of_words, split_by_cache
from tracewell.sources.embedding_cache import EmbeddingCache


@pytest.fixture
def clusters(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 12)) * 20
    x = centres[rng.integers(0, 30, 900)] + rng.normal(size=(900, 12))
    x[5] = x[4]  # a tie
    return x, spark.createDataFrame([(k, [float(v) for v in e], f"t{k}") for k, e in enumerate(x)], "key long, embedding array<double>, text string")


def test_a_store_answers_as_measuring_all_does(spark, clusters, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "PIVOTS", 40)
    x, rows = clusters
    store = vectors.VectorStore(spark, f"file://{tmp_path}/s", 12)
    with pytest.raises(FileNotFoundError):
        store.query([0.0] * 12, 1)
    store.build(rows)
    for q, k in ((list(x[4]), 7), ([0.0] * 12, 3), (list(x[100] + 0.3), 60), (list(x[0]), 900), (list(x[0]), 2000), (list(x[1]), 0)):
        q = [float(v) for v in q]
        got, cells = store.query(q, k)
        want = retrieval.nearest(rows, q, k)
        a, b = [(r.key, round(r.distance, 9)) for r in got.orderBy("distance", "key").collect()], [(r.key, round(r.distance, 9)) for r in want.collect()]
        assert a == b and got.columns == ["key", "text", "distance"]
        if k == 7:
            assert len(cells) <= 12  # of some 40
    store.upsert(spark.createDataFrame([(4, [float(v) for v in x[4] + 100], "moved"), (5000, [float(v) for v in x[4]], "new")], "key long, embedding array<double>, text string"))
    store.delete(spark.createDataFrame([(5,)], "key long"))
    assert [(r.key, r.text) for r in store.query([float(v) for v in x[4]], 1)[0].collect()] == [(5000, "new")] and store.query([float(v) for v in x[4] + 100], 1)[0].first().text == "moved"
    for bad in ([1.0], None, [float("nan")] * 12):
        with pytest.raises(Exception, match="no vector of the store"):
            store.upsert(spark.createDataFrame([(1, bad, "x")], "key long, embedding array<double>, text string"))


def test_a_cache_takes_puts_of_two_jobs_and_embeds_once(spark, tmp_path):
    cache = EmbeddingCache(spark, f"file://{tmp_path}/c")
    chunks = spark.createDataFrame([(f"b{k}", "n", f"word{k} more") for k in range(20)] + [("b0", "n", "word0 more")], "blob_sha string, node_path string, text string")
    assert cache.read("m/8").count() == 0
    embedder = lambda t: bag_of_words(t, 8)
    seen = []
    jobs = [threading.Thread(target=lambda part=part: seen.append(cache.embed(part, "m/8", 8, embedder).where("reused").count())) for part in (chunks.where("blob_sha < 'b5'"), chunks.where("blob_sha < 'b7'"))]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    first = cache.embed(chunks, "m/8", 8, embedder)
    assert len(seen) == 2 and 0 < first.where("reused").count() < 21
    calls = []
    second = cache.embed(chunks, "m/8", 8, lambda t: calls.append(1) or F.raise_error(F.lit("embedded again")).cast("array<double>"))
    assert second.where("reused").count() == 21 and cache.read("m/8").count() == 20 and cache.read("other/8").count() == 0
    assert {r.text: r.embedding for r in second.collect()} == {r.text: r.embedding for r in chunks.select("text", embedder(F.col("text")).alias("embedding")).collect()}
    before = cache.read("m/8").count()
    cache.put(spark.createDataFrame([(None, [1.0]), ("k", None)], "cache_key string, vector array<double>"), "m/8")
    cache.compact()
    cache.compact()
    assert cache.read("m/8").count() == before and len(cache._puts()) == 1
    twice = cache.read("m/8").unionByName(cache.read("m/8"))
    assert split_by_cache(chunks.where("blob_sha = 'b1'"), twice, "m/8", 8)[0].count() == 1


def test_no_batch_is_over_budget(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([0, 1, 15, 16, 17, 500, 501, 8192, None, rng.randint(1, 3000)])) for k in range(600)] + [(1000 + k, 700) for k in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = batches.by_cost(spark.createDataFrame(rows, "key long, n int"), "n", "key", budget=5_000_000, most_rows=16).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_batch, classes = {}, {}
    for r in got:
        assert (r.n or 0) <= r.batch_class <= max(1, (r.n or 0) * 9 / 8 + 1)
        by_batch.setdefault((r.batch_class, r.batch), []).append((r.place, r.n or 0, r.key))
        classes.setdefault(r.batch_class, []).append(((r.n or 0), r.key, r.batch, r.place))
    assert len(got) == len(rows) == sum(map(len, by_batch.values()))
    for b in by_batch.values():
        assert [p for p, *_ in sorted(b)] == list(range(len(b))) and (len(b) == 1 or (len(b) <= 16 and len(b) * max(n for _, n, _ in b) ** 2 <= 5_000_000))
    for c, own in classes.items():
        most = max(1, min(16, 5_000_000 // (c * c)))
        assert [(b, p) for *_, b, p in sorted(own)] == [divmod(k, most) for k in range(len(own))]


def test_a_word_of_all_rows_has_several_files(spark, tmp_path, monkeypatch):
    from tracewell.operators import keyword

    monkeypatch.setattr(keyword, "FILE_ROWS", 50)
    docs = spark.createDataFrame([(k, "the " * (k % 3 + 1) + f"word{k}") for k in range(300)] + [(1000, None), (1001, "!?")], "key long, text string")
    index = keyword.KeywordIndex(spark, f"file://{tmp_path}/k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would go to one task
    try:
        index.build(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {f for (f,) in index._postings().where("term = 'the'").select(F.input_file_name()).distinct().collect()}
    assert len(files) >= 3 and index.totals.read().first().n == 302

    def same(now):
        got = {r.key: round(r.score, 9) for r in index.search("the word7 word299", None).collect()}
        want = {r.key: round(r.score, 9) for r in retrieval.bm25(now, "the word7 word299", None).collect()}
        assert got == want

    same(docs)
    index.update(spark.createDataFrame([(7, "no more"), (2000, "the word7")], "key long, text string"), spark.createDataFrame([(299,)], "key long"))
    same(docs.where("key not in (7, 299)").unionByName(spark.createDataFrame([(7, "no more"), (2000, "the word7")], "key long, text string")))
    bare = keyword.KeywordIndex(spark, f"file://{tmp_path}/bare")
    bare.build(docs.where("key >= 1000"))
    assert bare.search("the", 3).count() == 0 and bare.totals.read().first().n == 2
    bare.update(docs.where("key = 7"), docs.where("key = 1000"))
    assert [r.key for r in bare.search("word7", 3).collect()] == [7]


def test_postings_are_counted_within_their_row(spark, tmp_path):
    """Building writes no second copy of the postings; words are counted before a shuffle, and rows of one key and length still count as one."""
    from collections import Counter

    from tracewell.operators import keyword

    texts = {1: "b a B a_1 b", 2: None, 3: "!?", 4: "x", 5: "ä Ä z9 z9 z9", 6: " ".join(f"w{k % 7}" for k in range(500))}
    docs = spark.createDataFrame(list(texts.items()), "key long, text string")
    rows = keyword.postings(docs)
    want = {(k, w, n, len(x.split())) for k, x in texts.items() if x and x != "!?" for w, n in Counter(x.lower().split()).items()}
    assert {(r.key, r.term, r.tf, r.dl) for r in rows.collect()} == want and rows.count() == len(want)
    assert dict(rows.dtypes)["tf"] == "bigint" and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    index = keyword.KeywordIndex(spark, f"file://{tmp_path}/k")
    checkpoints = []
    old, type(docs).checkpoint = type(docs).checkpoint, lambda self, *a, **b: checkpoints.append(1) or old(self, *a, **b)
    try:
        index.build(docs.unionByName(docs.where("key = 1")))
    finally:
        type(docs).checkpoint = old
    assert not checkpoints
    n, avgdl, df = 7, (5 * 2 + 1 + 5 + 500) / 7, 1
    idf = math.log((n - df + 0.5) / (df + 0.5))
    got = index.search("b", None).collect()
    assert [r.key for r in got] == [1] and math.isclose(got[0].score, -idf * 6 * 2.2 / (6 + 1.2 * (0.25 + 0.75 * 5 / avgdl)))


def test_what_runs_left_is_swept(spark):
    import os
    import time

    from tracewell.workspace import shared_dir, sweep

    root = shared_dir(spark).removeprefix("file:")
    root = "/" + root.lstrip("/")
    for name in ("old", "new"):
        os.makedirs(f"{root}/tracewell/test-{name}/part", exist_ok=True)
    past = time.time() - 7200
    for p in ("test-old/part", "test-old"):
        os.utime(f"{root}/tracewell/{p}", (past, past))
    gone = sweep(spark, 1)
    assert any(p.endswith("test-old") for p in gone) and not os.path.exists(f"{root}/tracewell/test-old") and os.path.exists(f"{root}/tracewell/test-new") and not any(p.endswith("test-new") for p in gone)
