"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF weighted word shingles.

1. Document frequencies of hashed shingles, over all rows: a table of `DF_BINS` counts, summed slice by slice.
2. In one pass a row for each document: a digest of its words (equal texts are one text at once, and all later steps
   are on distinct texts, known by this digest), and the signature: for each of `BANDS` x `ROWS` hash functions the
   shingle, and the quantised weight, that ICWS draws. Two texts draw the same with the probability of their weighted Jaccard similarity.
3. Texts that share a band are bucketed. A bucket is cut into blocks of a bounded size, and in
   each block each text is linked to the first leader, the most typical text, and to the one that its signature agrees
   with best; a text that follows no leader becomes one. Leaders of a bucket's blocks meet again, for `LEVELS` levels. So a bucket of any size
   costs texts times leaders in time, and gives two links a text, not pairs. Each of the bands has leaders of its own.
4. Each of these links is verified by the exact weighted Jaccard similarity of the whole texts.
5. Connected components of verified links, by minimum labels with shortcuts, over tables in the shared folder.
6. What leaders missed: in buckets that still hold several components, each text outside the largest meets every text of its
   bucket, cell by cell of a bounded size, and the exact similarity of all pairs of a cell comes from one matrix product. Only links
   that join components come out, so no pairs are written, and no two texts that share a band are left untested.

A shingle's weight is one and the logarithm of its count in the text, times an inverse document frequency: 1 for a shingle of all
documents, rising with the logarithm of its share of them to 1 + `IDF_RANGE` for one in a share of `RARE` or fewer. The share also
counts copies, so with a steeper one the members of a large group of copies would be pushed apart by the group's own size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, groups, text_groups, with_text
from .words import digested_words, hashed_words, mix, shingle_hashes

SIMILARITY, BANDS, ROWS, IDF_RANGE, RARE = 0.8, 12, 4, 0.5, 0.02
DF_BINS, DF_SLICE = 1 << 20, 1 << 14
#: Rows of a block of signatures; of K places, those that must agree for a link to a leader, and those that keep a text from leading.
BLOCK, CANDIDATE_SHARE, FOLLOW_SHARE = 1024, 0.5, 0.8
#: Leaders of a block that are chosen as typical; levels of leaders.
TYPICAL, LEVELS = 3, 3
#: Texts with more than one in so many of all copies, and leaders with more than one in so many of all links, are dealt apart: at most as many of them.
HEAVY = 4096
#: Floats of a dense part of a cell's matrix.
CELL_FLOATS = 4_000_000
CHUNK_CHARS, CHUNK_SHINGLES = 1_000_000, 32_768
K = BANDS * ROWS
_DRAWS = 4096


def _tables() -> tuple[np.ndarray, ...]:
    """Quantiles of Gamma(2, 1) for r and its inverse, log quantiles for c, and of the uniform distribution for beta, each in an order of its own."""
    rng = np.random.Generator(np.random.PCG64(48))
    x = np.linspace(0, 40, 400_001)
    gamma = np.interp((np.arange(_DRAWS) + 0.5) / _DRAWS, 1 - (1 + x) * np.exp(-x), x)
    r, c, beta = rng.permutation(gamma), rng.permutation(gamma), rng.permutation((np.arange(_DRAWS) + 0.5) / _DRAWS)
    return tuple(a.astype(np.float32) for a in (r, 1 / r, np.log(c), beta))


_R, _INV_R, _LOG_C, _BETA = _tables()
_FUNCTIONS = np.random.Generator(np.random.PCG64(4812)).integers(1, 2**63, K, dtype=np.uint64) | np.uint64(1)


def counted_shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(words), return_counts=True)


def bins_of(shingles: np.ndarray, bins: int) -> np.ndarray:
    return (shingles >> np.uint64(65 - bins.bit_length())).astype(np.int64)


def document_frequencies(docs: DataFrame, bins: int = DF_BINS) -> tuple[np.ndarray, int]:
    """Documents (all rows) for each bin of shingle hashes, and documents with a word. Tasks give slices of counts, which are added up in two steps; the table that comes back has a fixed size."""
    width = min(DF_SLICE, bins)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(bins, np.int64), 0
        for batch in batches:
            for _, _, texts in text_groups(batch, CHUNK_CHARS):
                words, at = hashed_words(texts)
                own = [np.unique(bins_of(shingle_hashes(words[i:j]), bins)) for i, j in zip(at[:-1], at[1:], strict=True) if j > i]
                seen += len(own)
                if own:
                    total += np.bincount(np.concatenate(own), minlength=bins)
        parts = [(k, total[k * width : (k + 1) * width]) for k in range(bins // width)]
        parts = [(k, p.astype(np.int64).tobytes()) for k, p in parts if p.any()] + [(-1, np.array([seen], np.int64).tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["slice", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(0, np.int64)
        for blob in rows.column("counts").to_pylist():
            x = np.frombuffer(blob, np.int64)
            total = x.copy() if not len(total) else total + x
        return pa.table({"slice": rows.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = with_text(docs).select("text").mapInArrow(count, "slice int, counts binary").withColumn("part", F.spark_partition_id() % 64)
    halves = parts.groupBy("slice", "part").applyInArrow(add, "slice int, counts binary")
    out, seen = np.zeros(bins, np.int64), 0
    for r in halves.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():  # bins / DF_SLICE rows
        if r.slice < 0:
            seen = int(np.frombuffer(r.counts, np.int64)[0])
        else:
            out[r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.counts, np.int64)
    return out, seen


def idf_table(df: np.ndarray, documents: int, spread: float = IDF_RANGE, rare: float = RARE) -> np.ndarray:
    """1 for a shingle of all documents to 1 + spread for one of a share of `rare` or fewer."""
    share = np.maximum(df, 1) / max(1, documents)
    return (1 + spread * np.clip(np.log(share) / np.log(rare), 0, 1)).astype(np.float32)


def weights(shingles: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with a logarithmic count: a line that a text says a hundred times must not make it alike to all others that do."""
    return ((1 + np.log(counts)) * idf[bins_of(shingles, len(idf))]).astype(np.float32)


def signatures(shingles: list[np.ndarray], weights_: list[np.ndarray]) -> np.ndarray:
    """K 32-bit draws for each text (one or more shingles each), by ICWS: the shingle with the least ln a = ln c - r (t - beta + 1), where t = floor(ln w / r + beta), and its t."""
    out = np.empty((len(shingles), K), np.uint32)
    for x, y in groups([len(s) for s in shingles], CHUNK_SHINGLES):
        h, log_w = np.concatenate(shingles[x:y]), np.log(np.concatenate(weights_[x:y])).astype(np.float32)
        first = np.concatenate(([0], np.cumsum([len(s) for s in shingles[x : y - 1]], dtype=np.int64)))
        with np.errstate(over="ignore"):
            for k in range(K):
                u = h * _FUNCTIONS[k]
                u ^= u >> np.uint64(32)
                u *= np.uint64(0x9E3779B97F4A7C15)
                i, j, m = (u >> np.uint64(52)).astype(np.int64), ((u >> np.uint64(40)) & np.uint64(4095)).astype(np.int64), ((u >> np.uint64(28)) & np.uint64(4095)).astype(np.int64)
                t = np.floor(log_w * _INV_R[i] + _BETA[j])
                a = _LOG_C[m] - _R[i] * (t - _BETA[j] + np.float32(1))
                bits = a.view(np.int32).astype(np.int64)
                rank = np.where(bits >= 0, bits + (1 << 31), -1 - (bits & 0x7FFFFFFF) + (1 << 31)).astype(np.uint64)  # the floats' order
                draw = (u + t.astype(np.int64).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(3) & np.uint64(0xFFFFFFFF)
                out[x:y, k] = np.minimum.reduceat(rank << np.uint64(32) | draw, first).astype(np.uint32)
    return out


def band_hashes(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band of each signature."""
    out = np.empty((len(sigs), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            x = np.full(len(sigs), b + 1, np.uint64)
            for k in range(ROWS):
                x = mix(x ^ sigs[:, b * ROWS + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[:, b] = x
    return out.view(np.int64)


def profiles(docs: DataFrame, idf) -> DataFrame:
    """doc_id, text_hash (a digest of the words), sig (K draws) and bands of each row; a text without words has neither. idf: a broadcast table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            keys = column(batch, "doc_id")
            for x, y, texts in text_groups(batch, CHUNK_CHARS):
                words, at, digests = digested_words(texts)
                own = [words[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                full = [k for k, w in enumerate(own) if len(w)]
                sig, bands = [None] * len(own), [None] * len(own)
                if full:
                    counted = [counted_shingles(own[k]) for k in full]
                    s = signatures([h for h, _ in counted], [weights(h, n, table) for h, n in counted])
                    for k, a, b in zip(full, s, band_hashes(s), strict=True):
                        sig[k], bands[k] = a.tobytes(), b
                yield pa.RecordBatch.from_arrays([keys[x:y], pa.array(digests, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "sig", "bands"])

    return with_text(docs).mapInArrow(run, "doc_id long, text_hash binary, sig binary, bands array<long>")


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """(bucket, columns as lists) of each run of rows of one bucket and block; the rows come sorted by these."""
    held: list[list[list]] = []
    key = None
    for batch in batches:
        b, k = column(batch, "bucket").to_numpy(), column(batch, "block").to_numpy()
        columns = [column(batch, c).to_pylist() for c in names]
        cut = np.flatnonzero((b[1:] != b[:-1]) | (k[1:] != k[:-1])) + 1
        for x, y in zip([0, *cut], [*cut, len(b)], strict=True):
            if y == x:
                continue
            if held and key != (b[x], k[x]):
                yield (key[0], *([v for part in c for v in part] for c in zip(*held, strict=True)))
                held = []
            key = b[x], k[x]
            held.append([c[x:y] for c in columns])
    if held:
        yield (key[0], *([v for part in c for v in part] for c in zip(*held, strict=True)))


def _typical(sigs: np.ndarray, n: int = 1) -> np.ndarray:
    """The n texts that agree in most places with what is most common at each place: in a group of copies, their origin and what is nearest to it."""
    common = np.empty(K, np.uint32)
    for k in range(K):
        values, counts = np.unique(sigs[:, k], return_counts=True)
        common[k] = values[counts.argmax()]
    return np.argsort(-(sigs == common).sum(1), kind="stable")[:n]


def lead(sigs: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    """Leaders of a block by row, and links of each text to the first leader and to the one that it agrees with best, if in `CANDIDATE_SHARE` of the places. The first leaders are typical texts, later ones the first that follow no leader."""
    leaders, free = [], np.ones(len(sigs), bool)
    best, share, links = np.full(len(sigs), -1), np.zeros(len(sigs)), set()

    def link(to: np.ndarray) -> None:
        links.update((int(j), int(to[j])) for j in np.flatnonzero((share >= CANDIDATE_SHARE) & (to >= 0)))

    while free.any():
        left = np.flatnonzero(free)
        k = int(left[_typical(sigs[left])[0]] if len(left) > 8 and len(leaders) < TYPICAL else left[0])
        leaders.append(k)
        same = (sigs == sigs[k]).mean(1)
        free[k] = False
        free &= same < FOLLOW_SHARE
        same[k] = 0
        best, share = np.where(same > share, k, best), np.maximum(same, share)
        if len(leaders) == 1:
            link(best)
    link(best)
    return leaders, sorted(links)


def _blocks(df: DataFrame, size, salt: int) -> DataFrame:
    """Rows (bucket, id, sig) dealt by bucket and block of about `BLOCK` rows, and sorted by these."""
    dealt = df.select("bucket", "id", "sig", F.pmod(F.xxhash64("id", "bucket", F.lit(salt)), size).alias("block"), F.xxhash64("bucket", "id").alias("turn"))
    return dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "turn")


def bucketed(reps: DataFrame) -> DataFrame:
    """bucket, id, sig, size of texts (id, sig, bands) that share a bucket with others."""
    rows = reps.where(F.col("bands").isNotNull()).select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return rows.join(shared.hint("merge"), "bucket").join(reps.select("id", "sig").hint("merge"), "id")


def leader_links(scratch: Scratch, level: DataFrame) -> DataFrame:
    """(a, b), a < b: distinct links of texts to leaders of their buckets. level: bucketed rows."""
    found, step = None, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, ids, sigs in _runs(batches, "id", "sig"):
            leaders, links = lead(np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, K))
            a, b = [ids[x] for x, _ in links] + [ids[k] for k in leaders], [ids[y] for _, y in links] + [None] * len(leaders)
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(a), pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([None] * len(links) + [sigs[k] for k in leaders], pa.binary())], ["bucket", "a", "b", "sig"])

    while True:
        out = scratch.put(_blocks(level, F.ceil(F.col("size") / BLOCK), step).mapInArrow(run, "bucket long, a binary, b binary, sig binary"), f"links{step}")
        links = out.where(F.col("b").isNotNull()).select("a", "b")
        found = links if found is None else found.unionByName(links)
        step += 1
        large = level.where(F.col("size") > BLOCK).select("bucket").distinct()
        if step == LEVELS or not large.head(1):  # what more levels would find, the cells find
            return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        again = out.where(F.col("b").isNull()).select("bucket", F.col("a").alias("id"), "sig").join(large, "bucket")
        level = scratch.put(again.join(again.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "bucket"), f"level{step}")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts as (ascending hashes, weights): the sum of the lesser weights over the sum of the greater."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    return low / (float(a[1].sum()) + float(b[1].sum()) - low)


def text_profiles(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its distinct shingles, ascending, and their weights."""
    words, at = hashed_words(texts)
    return [(h, weights(h, n, idf)) for h, n in (counted_shingles(words[i:j]) for i, j in zip(at[:-1], at[1:], strict=True))]


def _heavy(rows: DataFrame, key: str, total: int) -> DataFrame:
    """The values of a key with more than one in `HEAVY` of all rows, and in how many parts of about that size theirs fall. At most `HEAVY` rows, whatever the data are, so they may be broadcast."""
    most = max(256, total // HEAVY)
    return F.broadcast(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("parts")))


def verified(links: DataFrame, texts: DataFrame, idf, similarity: float = SIMILARITY) -> DataFrame:
    """The links (a, b) whose texts have at least this weighted Jaccard similarity, with it. texts: id and text, a row an id. The links of a leader with many are dealt over copies of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, tuple | None] = None, None
        for batch in batches:
            a, b, tb = column(batch, "a"), column(batch, "b"), column(batch, "text_b")
            s = []
            for x, y, own_texts in text_groups(batch, CHUNK_CHARS, "text_a"):
                for own, k in zip(text_profiles(own_texts, idf.value), range(x, y), strict=True):
                    if last[0] != b[k].as_py():  # rows come sorted by b, so its text is read once
                        last = b[k].as_py(), text_profiles([tb[k].as_py()], idf.value)[0]
                    s.append(weighted_jaccard(own, last[1]))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(s, pa.float64())], ["a", "b", "similarity"])

    # the end with more links is b, so that heavy leaders stand there
    heavy = _heavy(links.select(F.explode(F.array("a", "b")).alias("h")), "h", 2 * links.count())
    turned = links.join(heavy.select(F.col("h").alias("a"), F.lit(True).alias("swap")), "a", "left").select(F.when(F.col("swap"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("swap"), F.col("a")).otherwise(F.col("b")).alias("b"))
    parts = heavy.withColumnRenamed("h", "b")
    left = turned.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    left = left.join(parts, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1)))).drop("parts")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).join(parts, "b", "left")
    right = right.select("b", "text_b", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("part"))
    both = left.join(right.hint("merge"), ["b", "part"]).select("a", "b", "text_a", "text_b")
    return both.sortWithinPartitions("b").mapInArrow(run, "a binary, b binary, similarity double").where(F.col("similarity") >= similarity)


def cell_similarities(home: list[tuple], asking: list[tuple]) -> np.ndarray:
    """Weighted Jaccard similarity of each asking text (row) with each home text (column), each as (shingles, counts, idf of each).

    min(f(m), f(n)) of two counts is the sum of f's steps up to the lesser, so a column is a shingle and a count
    that occurs, its weight the step times the shingle's idf, and the sum of lesser weights is a product of matrices.
    """
    steps = np.unique(np.concatenate([n for _, n, _ in (*home, *asking)]))
    gain = np.diff(1 + np.log(steps), prepend=0.0)
    keys, values, rows, total = [], [], [], np.zeros(len(home) + len(asking))
    for k, (h, n, idf) in enumerate((*home, *asking)):
        high = np.searchsorted(steps, n)
        total[k] = ((1 + np.log(n)) * idf).sum(dtype=float)
        for step in range(int(high.max()) + 1):
            has = high >= step
            keys.append(mix(h[has] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)))
            values.append(gain[step] * idf[has])
            rows.append(np.full(int(has.sum()), k))
    keys, values, rows = np.concatenate(keys), np.sqrt(np.concatenate(values)).astype(np.float32), np.concatenate(rows)
    order = np.argsort(keys, kind="stable")
    keys, values, rows = keys[order], values[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    shared = np.repeat(size > 1, size)  # what one text alone has adds nothing
    col = np.cumsum(np.concatenate(([True], keys[1:] != keys[:-1]))[shared]) - 1
    values, rows = values[shared], rows[shared]
    low = np.zeros((len(asking), len(home)), np.float32)
    width = max(1, CELL_FLOATS // len(total))
    for x in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, (x, x + width))
        dense = np.zeros((len(total), min(width, int(col[-1]) + 1 - x)), np.float32)
        dense[rows[i:j], col[i:j] - x] = values[i:j]
        low += dense[len(home) :] @ dense[: len(home)].T
    return low / (total[len(home) :, None] + total[None, : len(home)] - low)


def cell_links(labels: list, profiles_: list[tuple], home: list[int], asking: list[int], similarity: float) -> list[tuple[int, int]]:
    """Links of asking with home texts of other classes with at least this similarity: of all that there are, those that join classes not joined yet."""
    codes: dict = {}
    of = np.array([codes.setdefault(x, len(codes)) for x in labels])
    near = cell_similarities([profiles_[k] for k in home], [profiles_[k] for k in asking])
    near[of[asking][:, None] == of[home][None]] = 0
    up, out = list(range(len(codes))), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in zip(*np.nonzero(near >= similarity - 1e-4), strict=True):
        a, b = asking[i], home[j]
        x, y = root(int(of[a])), root(int(of[b]))
        if x != y:
            (ha, na, ia), (hb, nb, ib) = profiles_[a], profiles_[b]
            if weighted_jaccard((ha, (1 + np.log(na)) * ia), (hb, (1 + np.log(nb)) * ib)) >= similarity:  # the product has the precision of its floats
                up[x] = y
                out.append((a, b))
    return out


def _cells(level: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, block, id, label, role: in buckets of several classes each text outside the largest class meets every text. Texts are dealt to parts of about `BLOCK` rows, those outside the largest class also to groups of about `BLOCK`; a block is a part with a group. role: 0 to be compared with, 1 to ask, 2 both."""
    own = level.select("bucket", "id", "size").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = own.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.max("n").alias("most"), F.count(F.lit(1)).alias("classes"))
    rows = own.join(several.where(F.col("classes") > 1), "bucket")
    rows = rows.withColumn("parts", F.ceil(F.col("size") / BLOCK)).withColumn("groups", F.ceil((F.col("size") - F.col("most")) / BLOCK)).withColumn("asks", F.col("label") != F.col("largest"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "bucket", F.lit(-1)), "parts")).withColumn("group", F.pmod(F.xxhash64("id", "bucket", F.lit(-2)), "groups"))

    def cell(part, group, role):
        return F.struct((part * F.col("groups") + group).alias("block"), role.alias("role"))

    home = F.transform(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1), lambda g: cell(F.col("part"), g, F.when(F.col("asks") & (g == F.col("group")), 2).otherwise(0)))
    away = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.col("asks") & (p != F.col("part"))), lambda p: cell(p, F.col("group"), F.lit(1)))
    return rows.select("bucket", "id", "label", F.explode(F.concat(home, away)).alias("c")).select("bucket", "id", "label", "c.block", "c.role")


def cell_rows(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Cells with the shingles and counts of their texts, dealt and sorted by bucket and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, own in text_groups(batch, CHUNK_CHARS):
                words, at = hashed_words(own)
                counted = [counted_shingles(words[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([column(batch, "id")[x:y], pa.array([h.tobytes() for h, _ in counted], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in counted], pa.binary())], ["id", "shingles", "counts"])

    need = texts.join(cells.select("id").distinct().hint("merge"), "id", "left_semi")
    rows = cells.join(need.mapInArrow(run, "id binary, shingles binary, counts binary").hint("merge"), "id")
    return rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block")


def cross_links(rows: DataFrame, idf, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): for each cell, links of texts of different classes that have this similarity, as many as join all classes that any such pair joins. rows: of cell_rows()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, labels, roles, shingles, counts in _runs(batches, "id", "label", "role", "shingles", "counts"):
            own = []
            for s, n in zip(shingles, counts, strict=True):
                h = np.frombuffer(s, np.uint64)
                own.append((h, np.frombuffer(n, np.uint32), idf.value[bins_of(h, len(idf.value))]))
            home, asking = [k for k, r in enumerate(roles) if r != 1], [k for k, r in enumerate(roles) if r != 0]
            if home and asking and (links := cell_links(labels, own, home, asking, similarity)):
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in links], pa.binary()), pa.array([ids[y] for _, y in links], pa.binary())], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def components(scratch: Scratch, edges: DataFrame, name: str = "components") -> DataFrame:
    """id and label (the least id of its component) of each end of an edge (a, b)."""
    both = scratch.put(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.put(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id").select("id", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = scratch.put(low.join(far, "label", "left").select("id", "before", F.least("label", F.coalesce("far", "label")).alias("label")), f"{name}-{step}")
        changed = new.where(F.col("label") != F.col("before")).head(1)
        labels = new.select("id", "label")
        if not changed:
            return labels


def merged(scratch: Scratch, labels: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Labels after more edges: these are drawn between the components so far, and only those that they touch are labelled anew."""
    def end(c: str) -> DataFrame:
        return labels.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}"))

    between = edges.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    moved = components(scratch, between, name).select(F.col("id").alias("label"), F.col("label").alias("moved"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))
    return scratch.put(labels.unionByName(ends).join(moved, "label", "left").select("id", F.coalesce("moved", "label").alias("label")), f"{name}-labels")


def near_duplicates(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of each row with an id.

    Texts with the same words in order are one class, among them those without words (null, empty, marks
    only). Rows of one id but different texts are one document, and their texts are one class. Rows with a
    null id have no class and are not returned. A text of fewer than five words is one shingle. An empty table
    gives no rows; other columns are ignored. The result is a table in the shared folder.
    """
    scratch = Scratch(spark, "near-duplicates")
    df, n = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(idf_table(df, n))  # DF_BINS floats
    docs = with_text(docs.where(F.col("doc_id").isNotNull()))
    rows = scratch.put(profiles(docs, idf), "profiles")
    reps = scratch.put(rows.groupBy(F.col("text_hash").alias("id")).agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")), "reps")
    level = scratch.put(bucketed(reps), "level0")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, own in text_groups(batch, CHUNK_CHARS):
                yield pa.RecordBatch.from_arrays([pa.array(digested_words(own)[2], pa.binary()), column(batch, "text")[x:y]], ["id", "text"])

    first = reps.join(level.select("id").distinct().hint("merge"), "id", "left_semi").select(F.col("least").alias("doc_id")).distinct()
    texts = scratch.put(docs.join(first.hint("merge"), "doc_id", "left_semi").mapInArrow(digests, "id binary, text string").dropDuplicates(["id"]), "texts")
    # an id with several texts links them
    of_id = rows.groupBy("doc_id").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where(F.col("a") != F.col("b"))
    edges = rows.select("doc_id", F.col("text_hash").alias("b")).join(of_id.select("doc_id", "a"), "doc_id").where(F.col("a") != F.col("b")).select("a", "b").distinct()
    tested = scratch.put(leader_links(scratch, level), "tested")
    labels = components(scratch, edges.unionByName(scratch.put(verified(tested, texts, idf, similarity).select("a", "b"), "verified")))
    cells = scratch.put(_cells(level, labels), "cells")
    new = scratch.put(cross_links(cell_rows(cells, texts), idf, similarity), "crossed")
    if new.head(1):
        labels = merged(scratch, labels, new, "crossed")
    out = scratch.put(classes(rows, reps, labels), "classes")
    for name in ("profiles", "reps", "level*", "texts", "links*", "tested", "verified", "components*", "cells", "crossed*"):
        scratch.drop(name)
    return out


def classes(rows: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and class_id: the least doc_id of each text's component. rows: doc_id, text_hash; reps: id, least, copies; labels: id, label of texts that have links. Texts with many copies are few, so their rows meet a broadcast table; the rest are joined by digest."""
    linked = reps.join(labels, "id").select("id", "label", "least", "copies")
    least = linked.groupBy("label").agg(F.min("least").alias("class_id"))
    of_text = linked.join(least, "label").select("id", "class_id", "copies").unionByName(reps.join(labels, "id", "left_anti").select("id", F.col("least").alias("class_id"), "copies"))
    total = reps.agg(F.sum("copies")).first()[0] or 0
    heavy = F.col("copies") > max(256, total // HEAVY)
    own = rows.select("doc_id", F.col("text_hash").alias("id"))
    marked = own.join(F.broadcast(of_text.where(heavy).select("id", F.col("class_id").alias("heavy_class"))), "id", "left")
    few = marked.where(F.col("heavy_class").isNull()).select("doc_id", "id").join(of_text.where(~heavy).select("id", "class_id").hint("merge"), "id").select("doc_id", "class_id")
    both = marked.where(F.col("heavy_class").isNotNull()).select("doc_id", F.col("heavy_class").alias("class_id")).unionByName(few)
    return both.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def keep_one(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of documents, as they are, with one document of each class: that of the least id. A row with a null id is kept; of rows of one id the least is kept, column by column."""
    kept = near_duplicates(spark, docs, similarity).where(F.col("doc_id") == F.col("class_id")).select("doc_id")
    own = docs.join(kept, "doc_id", "left_semi")
    one = own.groupBy("doc_id").agg(F.min(F.struct(*(c for c in docs.columns if c != "doc_id"))).alias("row")).select("doc_id", "row.*").select(docs.columns)
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
