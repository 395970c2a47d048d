"""The audit of filters, the join of vectors and the trie of conversations, against brute force."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest

from tracewell.llm import filter_audit, prefix_trie, vector_join
from tracewell.llm.common import Scratch

DOCS, LABELS = "doc_id long, text string, lang string, note string", "doc_id long, quality int, toxic int"


def fails(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text)]


def brute_audit(docs, labels):
    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}
    judged = []
    for doc_id, text, lang in ((r[0], r[1] or "", r[2] or "") for r in docs):
        copy = doc_id is not None and any(k is not None and k < doc_id and (t or "") == text for k, t, *_ in docs)
        judged.append((lang, doc_id, {f for f, x in zip("ABCDE", [*fails(text), copy], strict=True) if x}))
    out = {}
    for part in {p for p, _, _ in judged}:
        own = [(k, f) for p, k, f in judged if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audited(spark, docs, labels):
    rows = filter_audit.audit(spark, docs, labels).collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["ab", "Cd", "EF", "x#", "\x0b", "é", " q", "lorem" + str(rng.random())]) for _ in range(rng.choice([1, 50, 99, 100, 101, 140]))) for _ in range(30)] + ["", None, "A", " ".join(map(str, range(100)))]
    docs = [(rng.choice([None, *range(400)]), rng.choice(texts), rng.choice(["en", "de", "", None]), "x") for _ in range(150)]
    docs += [(1000 + k, "the same text", "en", "x") for k in range(300)] + [(7, "the same text", "de", "x"), (7, "the same text", "de", "x"), (None, "the same text", "fr", "x")]
    rng.shuffle(docs)
    labels = [(rng.choice([None, *range(500)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")  # the copies fill several ranges
    try:
        got = audited(spark, spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = brute_audit(docs, labels)
    assert got == want and len(got) == 4 * 600


def test_copies_are_found_past_the_borders_of_partitions():
    import hashlib

    import pyarrow as pa

    def rows(*r):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in r]), pa.array([x[1] for x in r], pa.binary()), pa.array([x[2] for x in r], pa.int64()), pa.array(["en"] * len(r))], ["fp", "text", "doc_id", "part"])

    class Context:
        partitionId = staticmethod(lambda: 3)

    keep, filter_audit.TaskContext = filter_audit.TaskContext, type("T", (), {"get": staticmethod(lambda: Context)})
    try:
        # two texts of one fingerprint, over two batches
        out = [r for b in filter_audit._judged([rows((1, b"a", 4), (1, b"a", 5)), rows((1, b"a", None), (1, b"b", 2), (2, b"a", 9))]) for r in b.to_pylist()]
    finally:
        filter_audit.TaskContext = keep
    d = {t: hashlib.sha256(t).digest() for t in (b"a", b"b")}
    assert [(r["doc_id"], r["mask"] >= 16, r["border"]) for r in out[:5]] == [(4, False, d[b"a"]), (5, True, d[b"a"]), (None, False, d[b"a"]), (2, False, d[b"b"]), (9, False, None)]
    assert [(r["doc_id"], r["mask"], r["border"]) for r in out[5:]] == [(9, -1, d[b"a"])]


def test_audit_of_odd_tables(spark):
    empty = spark.createDataFrame([], LABELS)
    assert audited(spark, spark.createDataFrame([], DOCS), empty) == {}
    got = audited(spark, spark.createDataFrame([(None, None, None, None)], DOCS), empty.withColumn("part", empty.quality))
    assert got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120] and len(got) == 600


@pytest.mark.parametrize("size", [10, filter_audit.LONG + 10])
def test_a_long_text_is_judged_as_a_short_one(size):
    text = (b"ab cd " * (size // 6 + 1))[:size]
    assert filter_audit.text_mask(text) == (1 | 2 if size < 100 else 2)


# -- prefix trie

TURNS = "conv_id long, turn long, role string, text string, depth int"


def rebuilt(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        out[min(who), len(p)] = (min(members[p[:-1]]) if p else None, len(who), sum(len(q) == len(p) + 1 for q in below), len(leaf), sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest())
    return out


def tried(spark, rows, shard_rows):
    got = prefix_trie.prefix_trie(spark, spark.createDataFrame(rows, TURNS), shard_rows).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("shard_rows", [1, 12, 1000])
def test_trie_equals_brute_force(spark, shard_rows):
    rng = random.Random(13)
    rows = []
    for c in range(-6, 60):
        if rng.random() < 0.8:
            rows += [(c * (1 if c < 50 else 10**15), rng.choice([k, k, k, None, 3]), rng.choice(["user", "user", None, "é"]), rng.choice(["a", "", None, "bé", "c" * 70 + rng.choice("xy")]), 0) for k in range(rng.randint(1, 12))]
    # one conversation that many share, a long one, one at the end of the range
    for c in range(1000, 1100):
        rows += [(c, k, "user", f"same {k}", 0) for k in range(6)]
    rows += [(2005, k, "user", "more", 0) for k in range(40)] + [(None, 1, "user", "x", 0), (2**63 - 3, 0, "user", "end", 0)]
    rows += rows[:3]
    rng.shuffle(rows)
    got, want = tried(spark, rows, shard_rows), brute_trie(rows)
    assert got == want


def test_trie_of_odd_tables(spark):
    assert tried(spark, [], 10) == {}
    assert tried(spark, [(None, 1, "a", "b", 1)], 10) == {}
    one = [(7, None, None, None, 1)]  # the first five turns are those of conversation 5, which isn't there
    assert zlib.crc32(b"7") % 9 > 0 and tried(spark, one, 10) == brute_trie(one) and len(brute_trie(one)) == 1


def test_louds_knows_its_parents():
    rng = random.Random(5)
    sums = {}
    rows = []
    for c in range(200):
        path = ()
        for level in range(rng.randint(1, 7)):
            parent, path = path, (*path, rng.randint(0, 2))
            key = sums.setdefault(path, rng.getrandbits(60) | 1)
            rows.append((level, key, key ^ 5, sums.get(parent, 0), sums.get(parent, 0) ^ 5, path))
    t, of = prefix_trie.build(*(np.array([r[k] for r in rows], np.int64) for k in range(5)))
    node = {r[5]: int(n) for r, n in zip(rows, of, strict=True)}
    assert len(node) == t.levels[-1] == len(set(node.values())) and t.bits.sum() == len(node)
    parents, degrees = t.parents, t.degrees
    for path, n in node.items():
        assert parents[n] == node.get(path[:-1], -1) and degrees[n] == sum(q[:-1] == path for q in node)
    assert [t.up(np.ones(len(node), np.int64))[n] for n in node.values()] == [sum(q[: len(p)] == p for q in node) for p in node]


def test_running_sums_go_over_borders(spark):
    rows = [(k % 3 * 10 if k % 2 else 10, k, (1 << 61) + k) for k in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = prefix_trie.running(Scratch(spark, "test"), "sums", spark.createDataFrame(rows, "k long, at long, v long"), "k", ["at"], ["v"])
        got = {(r.k, r.at): r.run_v for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(k, at): sum(v for x, y, v in rows if x == k and y <= at) % (1 << 62) for k, at, _ in rows}


# -- vectors


def brute_links(rows):
    def unit(e):
        if not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            return None
        x = np.array(e, np.float64) / max(abs(v) for v in e)
        return x / np.sqrt((x * x).sum())

    x = [unit(e) for _, e, *_ in rows]
    linked = [[j for j in range(len(rows)) if j != i and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.9] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in linked[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(linked[i]), least, least is not None and least == rows[i][0]))
    return sorted(out, key=repr)


def linked(spark, rows, kind="float", **more):
    got = vector_join.vector_links(spark, spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int"), **more).collect()
    return sorted((tuple(r) for r in got), key=repr)


def clustered(rng, n, width, spread):
    centres = rng.normal(size=(5, width))
    x = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, width)) * spread
    return x.astype(np.float32)


@pytest.mark.parametrize("width,spread,interval_rows", [(3, 0.3, 16), (8, 0.25, 64), (20, 0.001, 16), (12, 0.32, 4096)])
def test_links_equal_brute_force(spark, width, spread, interval_rows):
    rng = np.random.default_rng(width)
    rows = [(int(k), [float(v) for v in x], 0) for k, x in zip(rng.permutation(700), clustered(rng, 700, width, spread), strict=True)]
    one = [float(v) for v in np.float32(rng.normal(size=width))]
    rows += [(1000 + k, one, 1) for k in range(60)] + [(3, [2 * v for v in one], 1), (3, [2 * v for v in one], 1), (None, one, 0), (None, [float("nan")] * width, 0)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * width, 0), (2003, [1.0, None], 0), (2004, [float("inf")] + one[1:], 0), (2005, [*one, 1e-30], 0), (2006, one[:-1], 0), (2000, None, 0)]
    assert linked(spark, rows, interval_rows=interval_rows) == brute_links(rows)


def test_whole_clusters_are_linked_without_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "FANOUT", 2)
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in x], 0) for k, x in enumerate(clustered(rng, 400, 16, 0.005))]
    assert linked(spark, rows, interval_rows=16) == brute_links(rows)


def test_cosines_on_the_border_and_large_components(spark):
    # the cosine of (1, 0) and (9, sqrt(19)) is 0.9
    rows = [(1, [1.0, 0.0], 0), (2, [9.0, -(19.0**0.5) + 1e-10], 0), (3, [9.0, 19.0**0.5 + 1e-10], 0), (4, [1e300, 1e299], 0), (5, [-1e-300, 0.0], 0)]
    got = linked(spark, rows, "double")
    assert got == brute_links(rows) and got[0][1:3] == (2, 1) and got[1][1] == 1


def test_links_of_odd_tables(spark):
    assert linked(spark, []) == []
    assert linked(spark, [(5, None, 0), (None, [0.0], 0)]) == sorted([(5, 0, 5, True), (None, 0, None, False)], key=repr)
    assert linked(spark, [(5, [1.0], 0)]) == [(5, 0, 5, True)]


def test_halves_of_two_intervals_meet():
    rng = np.random.default_rng(9)
    x, y = (vector_join.unit_rows(clustered(rng, n, 6, 0.3).astype(float)) for n in (150, 90))
    counts = [rng.integers(1, 4, len(v)) for v in (x, y)]
    sides = [(v, np.full(len(v), 6, np.int32), c) for v, c in zip((x, y), counts, strict=True)]
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :4]
    a, b, kept = vector_join.compare(*sides, axes, 0.2**0.5, 0.9, block=16)
    hit = x @ y.T >= 0.9
    assert (a == hit @ counts[1]).all() and (b == counts[0] @ hit).all()
    whole, own = vector_join.Unions(240), vector_join.Unions(240)
    for i, j in np.argwhere(hit):
        whole.join(int(i), int(j) + 150)
    for i, j in kept:
        own.join(i, j)
    assert [whole.top(k) for k in range(240)] == [own.top(k) for k in range(240)] and len(kept) < 240
