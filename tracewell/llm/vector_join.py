"""All pairs of vectors with a cosine of at least 0.9, by an epsilon grid order join.

For unit vectors a cosine of s is a distance of sqrt(2 - 2 s) = epsilon, and projections bring no two vectors further apart.

1. Equal vectors become one with a count, known by a digest of 124 bits. Mean and covariance of all of them, added up task by task, give
   the leading principal directions.
2. Vectors are range-sorted by their cells in a grid of side epsilon on these directions. Runs of the sorted sequence are
   intervals of a bounded size, packed into a row each, with a box of projections, a centre and a radius.
3. Intervals are grouped by `FANOUT`, these again, up to a root. Starting with the root against itself, each level joins the children of both
   sides and drops pairs that are provably further apart than epsilon. A pair that is provably all within epsilon is done as a whole
   and goes no deeper, so a dense cluster costs its intervals and not its pairs.
4. For each pair of intervals that is left, a task goes on in the same way over halves, down to blocks whose cosines come from a matrix product.
   Products in single precision decide all but a band about the threshold that covers their error; there double precision decides.
5. Tasks give each vector's links as a number, and of links only as many as keep blocks connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, column
from .neardup import components

COSINE = 0.9
#: Leading directions, rows and bytes of an interval, rows of a block, children of a node of the tree.
DIRECTIONS, INTERVAL_ROWS, INTERVAL_BYTES, BLOCK, FANOUT = 16, 4096, 1 << 21, 256, 16
#: What rounding may add to a distance of projections or centres.
SLACK = 1e-9
BITS = (1 << 62) - 1


def units(embeddings: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, filled up with zeros; their lengths in components)."""
    sizes = embeddings.value_lengths().to_numpy()
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = embeddings.flatten().to_numpy(zero_copy_only=False)
    return unit_rows(out), sizes


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares are in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(vectors: DataFrame, width: int, directions: int = DIRECTIONS) -> np.ndarray:
    """Columns are the leading principal directions of all vectors. Tasks and then groups of tasks add up sums and products: a matrix of width x width for each of at most 64 groups, one for the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            x = np.column_stack([units(column(batch, "embedding"), width)[0], np.ones(batch.num_rows)])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1) ** 2)
        for batch in rows:
            for x in column(batch, "sums"):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = vectors.select("embedding").mapInArrow(add, "sums binary").repartition(64).mapInArrow(merge, "sums binary").coalesce(1).mapInArrow(merge, "sums binary").first()
    s = np.frombuffer(parts.sums).reshape(width + 1, width + 1)
    mean = s[-1, :-1] / max(1, s[-1, -1])
    _, directions_ = np.linalg.eigh(s[:-1, :-1] / max(1, s[-1, -1]) - np.outer(mean, mean))
    return directions_[:, ::-1][:, :directions].copy()


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """h1, h2, embedding, copies, least: the distinct ones of vectors that can be compared. rows: vec_id, embedding."""
    x = F.col("embedding")
    fit = F.coalesce(F.size(x) > 0, F.lit(False)) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    return rows.where(fit).groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (floats, or else doubles) and its digest."""
    kept = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kept else "array<double>").alias("embedding"))
    return df.select("*", F.xxhash64("embedding").bitwiseAND(BITS).alias("h1"), F.xxhash64(F.lit(1), "embedding").bitwiseAND(BITS).alias("h2"))


_INTERVAL = {"pid": "int", "k": "int", "copies": "long", "low": "array<double>", "high": "array<double>", "centre": "array<double>", "radius": "double", "members": "binary", "counts": "binary", "sizes": "binary", "vectors": "binary"}
_DOUBLES = pa.list_(pa.float64())
_TYPES = {"int": pa.int32(), "long": pa.int64(), "array<double>": _DOUBLES, "double": pa.float64(), "binary": pa.binary()}


def schema_of(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


def one_row(fields: dict[str, str], *values) -> dict[str, pa.Array]:
    return {name: pa.array([v], _TYPES[kind]) for (name, kind), v in zip(fields.items(), values, strict=True)}


def bounds(x: np.ndarray, projected: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Box of projections, centre and radius of some vectors."""
    centre = x.mean(0)
    return projected.min(0), projected.max(0), centre, float(np.sqrt(((x - centre) ** 2).sum(1).max()))


def intervals(scratch: Scratch, vectors: DataFrame, axes, width: int, epsilon: float, most: int) -> DataFrame:
    """Runs of at most `most` vectors in grid order, a row each: id (their number in the sequence), box, centre, radius, and packed members (h1, h2), counts, sizes and components in single precision where they came so. axes: broadcast directions."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    exact = np.float32 if kind == "array<float>" else np.float64

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(column(batch, "embedding"), width)[0] @ axes.value
            cell = np.floor(x / epsilon).astype(np.int64) + (1 << 20)  # positive, so bytes sort as numbers
            yield batch.append_column("cell", pa.array([c.astype(">u4").tobytes() for c in cell], pa.binary()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def row(parts: list[tuple]) -> pa.RecordBatch:
            h, counts, sizes, raw, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            return pa.RecordBatch.from_pydict(one_row(_INTERVAL, pid, k, int(counts.sum()), *bounds(x, x @ axes.value), h.tobytes(), counts.tobytes(), sizes.tobytes(), raw.tobytes()))

        for batch in batches:
            x, sizes = units(column(batch, "embedding"), width)
            raw = np.zeros(x.shape, exact)
            raw[np.arange(width) < sizes[:, None]] = column(batch, "embedding").flatten().to_numpy(zero_copy_only=False)
            h, counts = np.column_stack([column(batch, c).to_numpy() for c in ("h1", "h2")]), column(batch, "copies").to_numpy()
            at = 0
            while at < len(x):
                to = min(len(x), at + most - n)
                held.append((h[at:to], counts[at:to], sizes[at:to], raw[at:to], x[at:to]))
                n, at = n + to - at, to
                if n == most:
                    yield row(held)
                    held, n, k = [], 0, k + 1
        if held:
            yield row(held)

    placed = vectors.select("h1", "h2", "copies", "embedding").mapInArrow(cells, f"h1 long, h2 long, copies long, embedding {kind}, cell binary")
    out = scratch.put(placed.repartitionByRange("cell", "h1", "h2").sortWithinPartitions("cell", "h1", "h2").mapInArrow(pack, schema_of(_INTERVAL)), "packed")
    # a row a partition
    before = out.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return scratch.put(out.join(F.broadcast(before), "pid").select((F.col("first") + F.col("k")).alias("id"), *[c for c in _INTERVAL if c not in ("pid", "k")]), "intervals")


#: What is known of an interval or of a node above.
_SUMMARY = {"id": "long", "parent": "long", "copies": "long", "low": "array<double>", "high": "array<double>", "centre": "array<double>", "radius": "double"}


def around(low: np.ndarray, high: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A box and a ball about others."""
    middle = centre.mean(0)
    return low.min(0), high.max(0), middle, float((np.sqrt(((centre - middle) ** 2).sum(1)) + radius).max())


def parents_of(level: DataFrame) -> DataFrame:
    """The level above: nodes of `FANOUT` neighbours, with boxes and balls about theirs."""

    def merge(rows: pa.Table) -> pa.Table:
        parent, own = rows.column("parent")[0].as_py(), [np.array(rows.column(c).to_pylist()) for c in ("low", "high", "centre", "radius")]
        return pa.table(one_row(_SUMMARY, parent, parent // FANOUT, sum(rows.column("copies").to_pylist()), *around(*own)))

    return level.groupBy("parent").applyInArrow(merge, schema_of(_SUMMARY))


def apart(low_a, high_a, centre_a, radius_a, low_b, high_b, centre_b, radius_b, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(provably all further apart than epsilon, provably all within it) for rows of boxes and balls."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    between = np.sqrt(((centre_a - centre_b) ** 2).sum(-1))
    far = (np.sqrt((gap**2).sum(-1)) > epsilon + SLACK) | (between - radius_a - radius_b > epsilon + SLACK)
    return far, between + radius_a + radius_b < epsilon - SLACK


def tested_pairs(pairs: DataFrame, epsilon: float, alike: bool = True) -> DataFrame:
    """(a, b, near) of pairs that are not provably apart. pairs: a_ and b_ columns of two nodes' summaries. alike: all vectors have as many components, so that near ones link."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sides = [[np.array(column(batch, f"{s}_{c}").to_pylist()) for c in ("low", "high", "centre", "radius")] for s in "ab"]
                far, near = apart(*sides[0], *sides[1], epsilon)
                yield pa.RecordBatch.from_arrays([column(batch, "a_id").filter(pa.array(~far)), column(batch, "b_id").filter(pa.array(~far)), pa.array(near[~far] & alike)], names=["a", "b", "near"])

    return pairs.mapInArrow(test, "a long, b long, near boolean")


def expanded(scratch: Scratch, levels: list[DataFrame], epsilon: float, alike: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pairs of intervals (a, b), a <= b, whose vectors must be compared; (level, a, b) of pairs of nodes that are all within epsilon). levels: summaries from the intervals up to the root."""

    def side(level: DataFrame, s: str) -> DataFrame:
        return level.select(*[F.col(c).alias(f"{s}_{c}") for c in _SUMMARY])

    top = len(levels) - 1
    root = side(levels[top], "a").join(side(levels[top], "b"), F.col("a_id") == F.col("b_id"))  # one row
    near, open_ = None, root
    for at in range(top, -1, -1):
        found = scratch.put(tested_pairs(open_, epsilon, alike), f"pairs{at}")
        done = found.where("near").select(F.lit(at).alias("level"), "a", "b")
        near, left = done if near is None else near.unionByName(done), found.where(~F.col("near")).select("a", "b")
        if at:
            a, b = side(levels[at - 1], "a"), side(levels[at - 1], "b")
            open_ = left.join(a, left.a == a.a_parent).drop("a_parent").join(b, left.b == b.b_parent).where(F.col("a_id") <= F.col("b_id"))
    return left, near


def _links(x: np.ndarray, y: np.ndarray, sizes_x: np.ndarray, sizes_y: np.ndarray, cosine: float) -> np.ndarray:
    """Which of two blocks' unit vectors have this cosine."""
    rough = x.astype(np.float32) @ y.astype(np.float32).T
    band = (x.shape[1] + 8) * 1.2e-7  # covers rounding of components, products and their sum
    out = rough >= cosine
    i, j = np.nonzero(np.abs(rough - cosine) <= band)
    if len(i):
        exact = np.einsum("ij,ij->i", x[i], y[j])
        for k in np.flatnonzero(np.abs(exact - cosine) < 1e-13 * x.shape[1]):
            exact[k] = fsum(x[i[k]] * y[j[k]]) / (sqrt(fsum(x[i[k]] ** 2)) * sqrt(fsum(y[j[k]] ** 2)))
        out[i, j] = exact >= cosine
    return out & (sizes_x[:, None] == sizes_y[None])


class Unions:
    """Which of n things are connected."""

    def __init__(self, n: int):
        self.at = list(range(n))

    def top(self, k: int) -> int:
        while self.at[k] != k:
            self.at[k] = self.at[self.at[k]]
            k = self.at[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.at[max(a, b)] = min(a, b)
        return a != b


def compare(x: tuple, y: tuple | None, axes: np.ndarray, epsilon: float, cosine: float, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links in copies of each vector of two intervals (of one, if y is None), and links enough to connect what is connected; the second interval's places follow the first's. x, y: vectors, sizes, counts."""
    parts = [x] if y is None else [x, y]
    n = [len(p[0]) for p in parts]
    shift = 0 if y is None else n[0]
    a, b = parts[0], parts[-1]
    tallies = [np.zeros(k, np.int64) for k in n]
    unions, kept = Unions(sum(n)), []

    def summary(p: tuple) -> list[np.ndarray]:
        return [np.array(c) for c in zip(*(bounds(p[0][k : k + block], p[0][k : k + block] @ axes) for k in range(0, len(p[0]), block)), strict=True)]

    own = [summary(p) for p in parts]

    def join(i: int, j: int) -> None:
        if unions.join(i, j):
            kept.append((i, j))

    def go(i0: int, i1: int, j0: int, j1: int) -> None:
        same = y is None and (i0, i1) == (j0, j1)
        far, near = apart(*around(*(c[i0:i1] for c in own[0])), *around(*(c[j0:j1] for c in own[-1])), epsilon)
        if far and not same:
            return
        ra, rb = (i0 * block, min(i1 * block, n[0])), (j0 * block, min(j1 * block, n[-1]))
        sizes = (a[1][ra[0]], b[1][rb[0]])
        if near and sizes[0] == sizes[1] and (a[1][slice(*ra)] == sizes[0]).all() and (b[1][slice(*rb)] == sizes[0]).all():
            tallies[0][slice(*ra)] += b[2][slice(*rb)].sum()
            if not same:
                tallies[-1][slice(*rb)] += a[2][slice(*ra)].sum()
            for k in range(*ra):
                join(k, rb[0] + shift)
            for k in range(*rb):
                join(ra[0], k + shift)
        elif i1 - i0 == 1 and j1 - j0 == 1:
            hit = _links(a[0][slice(*ra)], b[0][slice(*rb)], a[1][slice(*ra)], b[1][slice(*rb)], cosine)
            if same:
                np.fill_diagonal(hit, True)  # its own copies
            if hit.any():
                tallies[0][slice(*ra)] += hit @ b[2][slice(*rb)]
                if not same:
                    tallies[-1][slice(*rb)] += a[2][slice(*ra)] @ hit
                while True:  # rows and columns that still are not connected; a round joins each row to one more
                    tops_a, tops_b = np.array([unions.top(k) for k in range(*ra)]), np.array([unions.top(k + shift) for k in range(*rb)])
                    new = hit & (tops_a[:, None] != tops_b[None])
                    rows = np.flatnonzero(new.any(1))
                    if not len(rows):
                        break
                    for r, c in zip(rows, new[rows].argmax(1), strict=True):
                        join(ra[0] + int(r), rb[0] + shift + int(c))
        else:
            mid_i, mid_j = (i0 + i1 + 1) // 2, (j0 + j1 + 1) // 2
            for p, q in [(i0, mid_i), (mid_i, i1)]:
                for r, s in [(j0, mid_j), (mid_j, j1)]:
                    if p < q and r < s and not (same and p > r):
                        go(p, q, r, s)

    go(0, len(own[0][0]), 0, len(own[-1][0]))
    return tallies[0], tallies[-1], kept


def compared(pairs: DataFrame, packed: DataFrame, axes, width: int, epsilon: float, cosine: float, most: int, single: bool) -> DataFrame:
    """Rows (v, links, to): links of a vector in copies (its own among them), or, with links null, a link that connects. v is a vector's number: `most` times that of its interval, and its place there."""
    sides = [packed.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("counts", "sizes", "vectors")]) for s in "ab"]
    exact = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                at = {c: column(batch, c)[r].as_py() for c in batch.schema.names}
                same, parts = at["a"] == at["b"], []
                for s in "a" if same else "ab":
                    x = np.frombuffer(at[f"{s}_vectors"], exact).reshape(-1, width).astype(np.float64)
                    parts.append((unit_rows(x), np.frombuffer(at[f"{s}_sizes"], np.int32), np.frombuffer(at[f"{s}_counts"], np.int64)))
                ours, theirs, kept = compare(parts[0], None if same else parts[1], axes.value, epsilon, cosine)
                tally = ours if same else np.concatenate([ours, theirs])
                v = np.concatenate([at[s] * most + np.arange(len(p[0])) for s, p in zip("ab", parts, strict=False)])
                hit, links = np.flatnonzero(tally), np.array(kept, np.int64).reshape(-1, 2)
                first = np.arange(len(hit) + len(links)) < len(hit)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[v[hit], v[links[:, 0]]]), pa.array(np.r_[tally[hit], links[:, 0]], mask=~first), pa.array(np.r_[hit, v[links[:, 1]]], mask=first)], names=["v", "links", "to"])

    return pairs.join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b").mapInArrow(run, "v long, links long, to long")


def unpacked(packed: DataFrame, most: int) -> DataFrame:
    """v, id (of its interval), h1, h2 of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, members in zip(column(batch, "id").to_pylist(), column(batch, "members"), strict=True):
                h = np.frombuffer(members.as_py(), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(k * most + np.arange(len(h))), pa.array(np.full(len(h), k)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["v", "id", "h1", "h2"])

    return packed.select("id", "members").mapInArrow(run, "v long, id long, h1 long, h2 long")


def whole_links(scratch: Scratch, near: DataFrame, levels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What pairs of nodes that are all within epsilon come to: (id, more) for each interval under such a node, the links that each of its vectors has by them; and edges between nodes and their intervals. Node n of level l is -(l * 2^48 + n) - 1 there, and an interval is one of level 0."""
    def number(level, n):
        return -(level * F.lit(1 << 48) + n) - 1

    sizes = None
    for at, level in enumerate(levels):
        own = level.select(F.lit(at).alias("level"), F.col("id").alias("n"), "copies")
        sizes = own if sizes is None else sizes.unionByName(own)
    ends = near.select("level", F.col("a").alias("n"), F.col("b").alias("other")).unionByName(near.where(F.col("a") != F.col("b")).select("level", F.col("b").alias("n"), F.col("a").alias("other")))
    gained = ends.join(sizes.select("level", F.col("n").alias("other"), "copies"), ["level", "other"]).groupBy("level", "n").agg(F.sum("copies").alias("copies"))
    above = levels[0].select("id", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))).alias("level")).withColumn("n", F.floor(F.col("id") / F.pow(F.lit(FANOUT), F.col("level"))))
    under = scratch.put(above.join(gained, ["level", "n"]), "under")
    edges = near.select(number(F.col("level"), F.col("a")).alias("a"), number(F.col("level"), F.col("b")).alias("b")).unionByName(under.select(number(F.col("level"), F.col("n")).alias("a"), number(F.lit(0), F.col("id")).alias("b")))
    return under.groupBy("id").agg(F.sum("copies").alias("more")), edges.where(F.col("a") != F.col("b"))


def vector_links(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, interval_rows: int = INTERVAL_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors with different
    numbers of components. Every row is a vector, so equal ones and rows of one id link with each other. component_id is the
    least id of those reachable, null ids apart; a row with a null id and no others has none, and is not kept. An empty table gives no rows;
    other columns are ignored. The width of vectors, which bounds the matrix of their directions, is taken from the longest.
    """
    scratch, epsilon = Scratch(spark, "vector-join"), sqrt(2 - 2 * cosine)
    rows = keyed(vectors)
    distinct = scratch.put(distinct_vectors(rows), "distinct")
    least, width = distinct.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if width is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    axes = spark.sparkContext.broadcast(principal(distinct, width))  # width x DIRECTIONS
    most = max(16, min(interval_rows, INTERVAL_BYTES // (8 * width)))
    packed = intervals(scratch, distinct, axes, width, epsilon, most)
    levels = [packed.select("id", F.floor(F.col("id") / FANOUT).alias("parent"), *list(_SUMMARY)[2:])]
    n = packed.count()
    while n > 1:
        levels.append(scratch.put(parents_of(levels[-1]), f"level{len(levels)}"))
        n = -(-n // FANOUT)
    pairs, near = expanded(scratch, levels, epsilon, alike=least == width)
    single = distinct.schema["embedding"].dataType.simpleString() == "array<float>"
    found = scratch.put(compared(pairs, packed, axes, width, epsilon, cosine, most, single), "found")
    more, whole = whole_links(scratch, near, levels)
    members = scratch.put(unpacked(packed, most).join(more, "id", "left"), "members")
    own = members.join(found.where(F.col("links").isNotNull()).groupBy("v").agg(F.sum("links").alias("links")), "v", "left")
    own = own.join(distinct.select("h1", "h2", "least"), ["h1", "h2"]).select("v", "h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0)) - 1).alias("n_links"))
    edges = found.where(F.col("links").isNull()).select(F.col("v").alias("a"), F.col("to").alias("b")).unionByName(whole).unionByName(members.where(F.col("more").isNotNull()).select((-F.col("id") - 1).alias("a"), F.col("v").alias("b")))
    labels = components(scratch, edges)
    own = scratch.put(own.join(labels.select(F.col("id").alias("v"), "label"), "v", "left").withColumn("label", F.coalesce("label", "v")), "own")
    heads = own.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = own.join(heads, "label").select("h1", "h2", "n_links", "component_id")
    # what links with nothing isn't among them
    out = rows.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = scratch.put(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "links")
    for name in ("distinct", "packed", "intervals", "level*", "pairs*", "found", "under", "members", "components*", "own"):
        scratch.drop(name)
    return out


def links_sql() -> str:
    """The same for DuckDB."""
    return """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
fit AS (SELECT vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, least.component_id, v.vec_id = least.component_id AS kept FROM v JOIN least ON least.a = v.vec_id"""
