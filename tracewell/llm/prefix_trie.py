"""The trie of all prefixes of conversations: who shares a prefix, and what sharing would save.

1. Turns become digests and byte lengths at the scan; no later step carries texts. `running()` numbers the turns of each conversation and
   sums them up: rows are range-sorted, summed in each range, and what earlier ranges hold of a range's first conversation is added from a
   row a border. So a conversation of any length fills several tasks.
2. A prefix is known by its depth and two sums over hashes of (place, role, text) of its turns, 124 bits.
3. Prefixes above `SHARD_ROWS` rows are the upper levels. Below them the trie falls into shards, each under one
   prefix, of at most that many rows. A task packs shards and builds a succinct trie from them in level order (LOUDS): a bit vector in which node
   after node writes a one for each child and a zero, and arrays of labels; numbers and sums go up it level by level from the deepest.
4. The upper levels, a few rows for each `SHARD_ROWS`, take what shards give to their parents and are summed by pointers that double their reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, column

BITS = (1 << 62) - 1
#: Rows below a prefix from which it belongs to the upper levels, and rows that a task builds one trie of.
SHARD_ROWS, PACK_ROWS = 32_768, 131_072
#: Upper prefixes up to this number are broadcast (some 10 MB).
MOST_BROADCAST = 200_000
CHUNK_BYTES = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def lane(*columns) -> Column:
    return F.xxhash64(*columns).bitwiseAND(BITS)


def running(scratch: Scratch, name: str, rows: DataFrame, key: str, order: list[str], sums: list[str]) -> DataFrame:
    """rows with run_<c> for each c of sums: the sum (modulo 2^62) up to a row, among those of its key (a long) in this order. The result is a table."""
    kept = rows.columns
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + [f"run_{c} long" for c in sums] + ["pid int", "kind int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, first, last, held = TaskContext.get().partitionId(), None, None, np.zeros(len(sums), np.uint64)
        types = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = column(batch, key).to_numpy()
            new = np.r_[True, keys[1:] != keys[:-1]]
            starts, of = np.flatnonzero(new), np.cumsum(new) - 1
            first = keys[0] if first is None else first
            totals = []
            for k, c in enumerate(sums):
                v = column(batch, c).to_numpy().astype(np.uint64)
                total = np.cumsum(v)
                before = (total - v)[starts]
                if last is not None and keys[0] == last:
                    before[0] -= held[k]
                totals.append((total - before[of]) & np.uint64(BITS))
                held[k] = totals[-1][-1]
            last, types = keys[-1], [column(batch, c).type for c in kept]
            more = [pa.array(t.view(np.int64)) for t in totals] + [pa.array(np.full(len(keys), pid, np.int32)), pa.array(np.where(keys == first, 1, 0).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in kept] + more, names=[*kept, *(f"run_{c}" for c in sums), "pid", "kind"])
        if last is not None:  # kind 2: the partition's first key; 3: its last one, with its sums
            ends = [pa.array([first, last], t) if c == key else pa.nulls(2, t) for c, t in zip(kept, types, strict=True)]
            yield pa.RecordBatch.from_arrays(ends + [pa.array([0, int(h)], pa.int64()) for h in held] + [pa.array([pid, pid], pa.int32()), pa.array([2, 3], pa.int32())], names=[*kept, *(f"run_{c}" for c in sums), "pid", "kind"])

    out = scratch.put(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(run, schema), name)
    earlier = Window.partitionBy(key).orderBy("pid").rangeBetween(Window.unboundedPreceding, -1)
    known = out.where(F.col("kind") > 1).select(key, "pid", "kind", *[(F.sum(F.col(f"run_{c}").cast("decimal(38,0)")).over(earlier) % (BITS + 1)).cast("long").alias(f"had_{c}") for c in sums])
    known = known.where((F.col("kind") == 2) & F.col(f"had_{sums[0]}").isNotNull()).withColumn("kind", F.lit(1))  # at most a row a partition
    both = out.where(F.col("kind") < 2).join(F.broadcast(known), [key, "pid", "kind"], "left")
    return both.select(*kept, *[(F.col(f"run_{c}") + F.coalesce(f"had_{c}", F.lit(0))).bitwiseAND(BITS).alias(f"run_{c}") for c in sums])


def numbered(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), d1, d2, n_bytes of each turn, by turn (null first). Turns of one number stand by role and text."""
    c = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.select("conv_id", "turn", "role", "text", lane("role", "text").alias("d1"), lane(F.lit(1), "role", "text").alias("d2"))
    slim = c.select("conv_id", "turn", "d1", "d2", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("one"))
    ties = slim.groupBy("conv_id", "turn").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where(F.col("a") != F.col("b")).select("conv_id", "turn")
    ties = scratch.put(ties, "ties")
    if ties.head(1):  # only their texts are read again
        same = (F.col("c.conv_id") == F.col("t.conv_id")) & F.col("c.turn").eqNullSafe(F.col("t.turn"))
        tied = c.alias("c").join(ties.alias("t"), same, "left_semi").select("conv_id", "turn", "role", "text", "d1", "d2").distinct()
        ranks = tied.select("conv_id", "turn", "d1", "d2", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("rank"))
        on = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ("conv_id", "turn", "d1", "d2")]
        slim = slim.alias("s").join(ranks.alias("r"), on, "left").select("s.*", F.coalesce("rank", F.lit(0)).alias("rank"))
    else:
        slim = slim.withColumn("rank", F.lit(0))
    return running(scratch, "numbered", slim, "conv_id", ["turn", "rank"], ["one"]).select("conv_id", F.col("run_one").alias("pos"), "d1", "d2", "n_bytes")


def spliced(turns: DataFrame, conv: Column, family: int = 5, starts: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, i, len, d1, d2, n_bytes of each turn; conv_id and len of each conversation) after giving conversation c the first h turns of
    c - c % family in place of its own first h; h: crc32 of the id as text % starts. Remainders have the sign of c. turns: of numbered()."""
    lens = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    h = F.crc32(conv.cast("string").cast("binary")) % starts
    of = lens.select("conv_id", "own", h.alias("h"), (conv - conv % family).alias("base"))
    of = of.join(lens.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    of = of.withColumn("given", F.least("h", F.coalesce("there", F.lit(0)))).select("conv_id", "h", "given", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))
    heirs = F.when(conv > 0, F.sequence(F.lit(0), F.lit(family - 1))).when(conv < 0, F.sequence(F.lit(1 - family), F.lit(0))).otherwise(F.sequence(F.lit(1 - family), F.lit(family - 1)))
    first = turns.where((conv % family == 0) & (F.col("pos") < starts)).withColumn("add", F.explode(heirs)).withColumn("conv_id", F.try_add("conv_id", F.col("add").cast("long"))).drop("add")
    both = turns.withColumn("own", F.lit(True)).unionByName(first.withColumn("own", F.lit(False))).join(of, "conv_id")
    both = both.where(F.when(F.col("own"), F.col("pos") > F.col("h")).otherwise(F.col("pos") <= F.col("given")))
    i = F.when(F.col("own"), F.col("pos") - F.col("h") + F.col("given")).otherwise(F.col("pos"))
    return both.select("conv_id", i.alias("i"), "len", "d1", "d2", "n_bytes"), of.select("conv_id", "len")


@dataclass
class Louds:
    """A forest in level order. bits: a root's row first, then for each node a one a child and a zero. labels: what leads from its parent to a node."""

    bits: np.ndarray
    labels: np.ndarray
    #: Where each level begins, and the end.
    levels: list[int]

    @property
    def parents(self) -> np.ndarray:
        """Of each node, from the bits alone: the zeros before its one, less the root row's; -1 for roots."""
        return np.cumsum(~self.bits)[self.bits] - 1

    @property
    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, from the deepest level on."""
        out, parents = values.copy(), self.parents
        for lo, hi in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            np.add.at(out, parents[lo:hi], out[lo:hi])
        return out


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair, in ascending order of pairs."""
    by = np.lexsort((b, a))
    new = np.r_[False, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])]
    out = np.empty(len(a), np.int64)
    out[by] = np.cumsum(new)
    return out


def build(level: np.ndarray, k1: np.ndarray, k2: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> tuple[Louds, np.ndarray]:
    """The trie of rows (level, key of the prefix, key of its parent), and each row's node."""
    of, parents, labels, levels = np.empty(len(level), np.int64), [], [], [0]
    order = np.argsort(level, kind="stable")
    cuts = np.flatnonzero(np.diff(level[order])) + 1
    above: tuple[np.ndarray, np.ndarray] | None = None
    for rows in np.split(order, cuts):
        number = _pairs(k1[rows], k2[rows])
        n = int(number.max()) + 1
        one = np.empty(n, np.int64)
        one[number] = rows  # a row of each node
        if above is None:
            parent = np.full(n, -1)
        else:
            met = _pairs(np.r_[above[0], p1[one]], np.r_[above[1], p2[one]])
            at = np.empty(int(met.max()) + 1, np.int64)
            at[met[: len(above[0])]] = np.arange(len(above[0])) + levels[-2]
            parent = at[met[len(above[0]) :]]
        label = (k1[one] - p1[one]) & BITS
        by = np.lexsort((k2[one], k1[one], label, parent))
        place = np.empty(n, np.int64)
        place[by] = np.arange(n)
        of[rows] = place[number] + levels[-1]
        one = one[by]
        parents.append(parent[by])
        labels.append(label[by])
        above = k1[one], k2[one]
        levels.append(levels[-1] + n)
    parent = np.concatenate(parents)
    degrees = np.bincount(parent + 1, minlength=levels[-1] + 1)  # the root's row first
    bits = np.ones(int(degrees.sum()) + len(degrees), bool)
    bits[np.cumsum(degrees + 1) - 1] = False
    return Louds(bits, np.concatenate(labels), levels), of


def ends_digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole shards; rows come sorted by shard (e, e1, e2). A shard's top has its parent's key."""
    names = ["e", "e1", "e2", "i", "k1", "k2", "p1", "p2", "conv_id", "len", "n_bytes"]

    def trie(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        e, _, _, i, k1, k2, p1, p2, conv, length, n_bytes = (np.concatenate(c) for c in zip(*parts, strict=True))
        t, of = build(i - e, k1, k2, p1, p2)
        n, parents = t.levels[-1], t.parents
        convs, least = np.bincount(of, minlength=n), np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, of, conv)
        one = np.empty(n, np.int64)
        one[of] = np.arange(len(of))
        leaves, saved = t.up((t.degrees == 0).astype(np.int64)), t.up((convs - 1) * n_bytes[one])
        digest = [NOTHING] * n
        last = np.flatnonzero(i == length)
        last = last[np.lexsort((conv[last], of[last]))]
        for own in np.split(last, np.flatnonzero(np.diff(of[last])) + 1):
            if len(own):
                digest[of[own[0]]] = ends_digest(conv[own])
        top = parents < 0
        given = [pa.array(least), pa.array(i[one]), pa.array(least[parents], mask=top), pa.array(convs.astype(np.int64)), pa.array(t.degrees.astype(np.int64)), pa.array(leaves), pa.array(saved), pa.array(digest)]
        keys = [pa.array(x[one], mask=~top) for x in (p1, p2)]
        return pa.RecordBatch.from_arrays([*given, *keys], names=[*(f.split()[0] for f in _NODE.split(", ")), "p1", "p2"])

    held, n = [], 0
    for batch in batches:
        rows = [column(batch, c).to_numpy() for c in names]
        if not len(rows[0]):
            continue
        held.append(rows)
        n += len(rows[0])
        if n >= PACK_ROWS:  # all but the last shard, which may go on
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])) + 1
            if len(new):
                yield trie([[r[: new[-1]] for r in rows]])
                rows = [r[new[-1] :] for r in rows]
            held, n = [rows], len(rows[0])
    if held:
        yield trie(held)


def _key(i, k1, k2) -> Column:
    return F.concat_ws(":", i, k1, k2)


def long_digests(ends: DataFrame) -> DataFrame:
    """id and ends_sha256 of rows (id, conv_id). Ids of a node are sorted and written out range by range; as SHA-256 can't be split, one task then reads a node's chunks of text in order, one at a time."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = column(batch, "id").to_pylist(), column(batch, "conv_id").to_pylist()
            out, start = [], 0
            for k in range(1, len(ids) + 1):
                if k == len(ids) or keys[k] != keys[start] or k - start == CHUNK_BYTES // 8:
                    out.append((keys[start], ids[start], ",".join(map(str, ids[start:k])).encode()))
                    start = k
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.binary())], names=["id", "first", "chunk"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for batch in batches:
            for k, chunk in zip(column(batch, "id").to_pylist(), column(batch, "chunk"), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(chunk.as_py())
        if key is not None:
            out.append((key, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], names=["id", "ends_sha256"])

    written = ends.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(chunks, "id string, first long, chunk binary")
    return written.repartition("id").sortWithinPartitions("id", "first").mapInArrow(digest, "id string, ends_sha256 string")


def rolled_up(scratch: Scratch, nodes: DataFrame, sums: list[str]) -> DataFrame:
    """id and the sums over each node's subtree. nodes: id, parent (null at the top), sums. Pointers double their reach, so a path of n nodes takes log2(n) rounds."""
    at, step = nodes.select("id", F.col("parent").alias("far"), *sums), 0
    while True:
        at = scratch.put(at, f"up{step}")
        if not at.where(F.col("far").isNotNull()).head(1):
            return at.select("id", *sums)
        got = at.where(F.col("far").isNotNull()).groupBy(F.col("far").alias("id")).agg(*[F.sum(c).alias(f"got_{c}") for c in sums])
        on = at.select(F.col("id").alias("far"), F.col("far").alias("farther"))
        at, step = at.join(got, "id", "left").join(on, "far", "left").select("id", F.col("farther").alias("far"), *[(F.col(c) + F.coalesce(f"got_{c}", F.lit(0))).alias(c) for c in sums]), step + 1


def trie(scratch: Scratch, turns: DataFrame, conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each prefix, as in prefix_trie(). turns: conv_id, i (from 1), len, d1, d2, n_bytes; conversations: conv_id, len of each, those without turns too."""
    terms = turns.select("conv_id", "i", "len", "n_bytes", lane("i", "d1", "d2").alias("t1"), lane(F.lit(2), "d2", "i", "d1").alias("t2"))
    sums = running(scratch, "sums", terms, "conv_id", ["i"], ["t1", "t2"])
    k1, k2 = F.col("run_t1"), F.col("run_t2")
    rows = scratch.put(sums.select("conv_id", "i", "len", "n_bytes", k1.alias("k1"), k2.alias("k2"), (k1 - F.col("t1")).bitwiseAND(BITS).alias("p1"), (k2 - F.col("t2")).bitwiseAND(BITS).alias("p2")), "prefixes")
    key = ["i", "k1", "k2"]
    of = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("len") - F.col("i") + 1).alias("below"), F.min("n_bytes").alias("n_bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    upper = scratch.put(of.where(F.col("below") > shard_rows), "upper")
    small = (lambda df: F.broadcast(df)) if upper.count() <= MOST_BROADCAST else (lambda df: df)
    high = upper.select(*key, F.lit(True).alias("high"))
    # a shard's top: the first prefix of a conversation that isn't one of the upper ones
    tops = rows.join(small(high), key, "left").where(F.col("high").isNull()).drop("high").join(small(high.select((F.col("i") + 1).alias("i"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "high")), ["i", "p1", "p2"], "left")
    tops = tops.where(F.col("high") | (F.col("i") == 1)).select("conv_id", F.col("i").alias("e"), F.col("k1").alias("e1"), F.col("k2").alias("e2"))
    shards = rows.join(tops, "conv_id").where(F.col("i") >= F.col("e")).repartition("e", "e1", "e2").sortWithinPartitions("e", "e1", "e2")
    low = scratch.put(shards.mapInArrow(_nodes, f"{_NODE}, p1 long, p2 long"), "low")
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where(F.col("n_convs") > 0).select(zero.alias("i"), zero.alias("k1"), zero.alias("k2"), "n_convs", "conv_id", zero.alias("n_bytes"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    every = upper.drop("below").unionByName(root).select(_key(*key).alias("id"), F.when(F.col("i") > 0, _key(F.col("i") - 1, "p1", "p2")).alias("parent"), "i", "conv_id", "n_convs", "n_bytes")
    from_low = low.where(F.col("p1").isNotNull()).groupBy(_key(F.col("depth") - 1, "p1", "p2").alias("id")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("kids"))
    among = every.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("more"))
    joined = every.join(from_low, "id", "left").join(among, "id", "left").fillna(0, ["leaves", "saved", "kids", "more"])
    n_children = F.col("kids") + F.col("more")
    nodes = scratch.put(joined.select("id", "parent", "i", "conv_id", "n_convs", n_children.alias("n_children"), (F.col("leaves") + (n_children == 0).cast("long")).alias("leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), "nodes")
    ends = rows.where(F.col("i") == F.col("len")).join(small(high), key).select(_key(*key).alias("id"), "conv_id")
    ends = ends.unionByName(conversations.where(F.col("len") == 0).select(F.lit("0:0:0").alias("id"), "conv_id"))
    summed = rolled_up(scratch, nodes.select("id", "parent", "leaves", "saved"), ["leaves", "saved"])
    heads = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    high_rows = nodes.drop("leaves", "saved").join(summed, "id").join(long_digests(ends), "id", "left").join(heads, "parent", "left").select(
        "conv_id", F.col("i").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    below_high = low.where(F.col("p1").isNotNull()).withColumn("parent", _key(F.col("depth") - 1, "p1", "p2")).drop("parent_conv_id").join(small(heads), "parent", "left")
    return low.where(F.col("p1").isNull()).drop("p1", "p2").unionByName(below_high.select(high_rows.columns)).unionByName(high_rows)


def prefix_trie(spark: SparkSession, conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each prefix of the rebuilt conversations.

    A null role or text is empty, a null turn comes first, and turns of one number stand by role, then text; repeated rows are
    repeated turns. Rows without conv_id belong to no conversation. An empty table gives no rows, not even the root. Other columns are ignored.
    """
    scratch = Scratch(spark, "prefix-trie")
    turns = scratch.put(numbered(scratch, conversations), "turns")
    rebuilt, every = spliced(turns, F.col("conv_id"))
    out = scratch.put(trie(scratch, rebuilt, scratch.put(every, "conversations"), shard_rows), "trie")
    for name in ("ties", "numbered", "turns", "conversations", "sums", "prefixes", "upper", "low", "nodes", "up*"):
        scratch.drop(name)
    return out


def trie_sql() -> str:
    """The same for DuckDB, which has no crc32: it is worked out bit by bit over the digits."""
    return """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'r': role, 't': text} ORDER BY pos) AS turns FROM t GROUP BY c),
h AS (SELECT c, turns, (xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 9)::INT AS h FROM own),
b AS (SELECT h.c, list_concat(coalesce(o.turns[:h.h], []), coalesce(h.turns[h.h + 1:], [])) AS turns FROM h LEFT JOIN own o ON o.c = h.c - h.c % 5),
p AS (SELECT c, turns[:d] AS prefix, d, len(turns) AS n, CASE WHEN d > 0 THEN strlen(turns[d].t) ELSE 0 END AS bytes FROM b, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
n AS (SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM p GROUP BY prefix, d),
k AS (SELECT a.prefix, a.d, a.conv_id, q.conv_id AS parent_conv_id, a.n_convs, a.saved, a.ends, (SELECT count(*) FROM n x WHERE x.d = a.d + 1 AND x.prefix[:a.d] = a.prefix) AS n_children FROM n a LEFT JOIN n q ON q.d = a.d - 1 AND q.prefix = a.prefix[:a.d - 1])
SELECT k.conv_id, k.d::BIGINT AS depth, k.parent_conv_id, k.n_convs, k.n_children, count(*) FILTER (WHERE s.n_children = 0) AS n_leaves, sum(s.saved)::BIGINT AS saved_tokens, sha256(any_value(k.ends)) AS ends_sha256
FROM k JOIN k s ON s.d >= k.d AND s.prefix[:k.d] = k.prefix GROUP BY k.prefix, k.d, k.conv_id, k.parent_conv_id, k.n_convs, k.n_children"""
