"""Benchmark decontamination: every passage of every document as a BM25 query against an index of test items.

The index is an inverted one with block maxima. A term's impact on an item is its BM25 weight divided by the
item's own threshold, so one threshold (1) holds for all items. An item's threshold is what any passage must
score that holds `OVERLAP` of its shingles: all its terms but the heaviest that could be missing, as a word
that is missing takes at least one shingle with it. So no such passage is lost.

Retrieval is block-max WAND. A passage is dropped when its terms' greatest impacts can't reach 1 (first with
repeats, by one running sum; then distinct terms). Blocks of items form a tree, `FAN` to one, each with its terms' greatest
impacts, and for many passages at once only blocks below one that can reach 1 are looked at. In the blocks that are left, a cursor
a term walks the postings: cursors stand in order of their items, the pivot is the first item at which the maxima of the
cursors up to it reach 1, cursors before it skip to it, and only an item where all of these meet is scored. Those at 1 or above are verified: shared word shingles of the
whole item, and how much of its question (the first part) and of its answer (the rest) they cover.

Passages are windows of twice the longest item's words at steps of the longest item's words, so each run of
words as long as an item is within one. The index of a share of the items has a bounded size and is broadcast; more items
make more shares, and each share meets all passages. Document frequencies and the mean length are of all items, whatever the shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, groups, text_groups, with_text
from .words import hashed_words, shingle_hashes

K1, B = 1.2, 0.75
OVERLAP, PART_OVERLAP, QUESTION_SHARE = 0.8, 0.4, 2 / 3
BLOCK, FAN, SHARE_CHARS, LEAST_STEP = 8, 8, 20_000_000, 32
REACHED = 1 - 1e-6
CHUNK_CHARS, POSTINGS_AT_ONCE = 1_000_000, 2_000_000


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices start[k], start[k] + 1, ... of each run, one after another."""
    stop = np.cumsum(count)
    return np.repeat(start - stop + count, count) + np.arange(stop[-1] if len(stop) else 0)


class Statistics(NamedTuple):
    """Of all items: how many have words, their mean number of words, and words (hashes, ascending) with the number of items that have them."""

    items: int
    mean: float
    words: np.ndarray
    df: np.ndarray


class Level(NamedTuple):
    """Blocks of one size: a row for each term and block that has it, by term and block, with the term's greatest impact there."""

    blocks: int
    key: np.ndarray  # term x blocks + block
    most: np.ndarray


class ItemIndex:
    """Test items (text, and where the answer begins as a share of its words) as an inverted index with block maxima. statistics: of all items, if these are a share of them."""

    def __init__(self, ids: list[int], texts: list[str], overlap: float = OVERLAP, question_share: float = QUESTION_SHARE, statistics: Statistics | None = None):
        words, at = hashed_words(texts)
        full = [k for k in range(len(texts)) if at[k + 1] > at[k]]  # an item without words can't leak
        self.overlap = overlap
        self.ids = np.array([ids[k] for k in full], np.int64)
        own = [words[at[k] : at[k + 1]] for k in full]
        size = np.array([len(w) for w in own], np.int64)
        self.question = np.maximum(1, np.ceil(size * question_share)).astype(np.int64)
        self.size, self.step = size, max(LEAST_STEP, int(size.max(initial=0)))
        self.least = int(size.min(initial=1))
        self.shingles = [shingle_hashes(w) for w in own]
        self.distinct = np.array([len(np.unique(s)) for s in self.shingles], np.int64)
        self.vocab = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        bits = max(10, min(22, int(len(self.vocab) * 8).bit_length()))
        self.shift = np.uint64(64 - bits)
        place = (self.vocab >> self.shift).astype(np.int64)
        self.first = np.full(1 << bits, -1, np.int32)  # the vocabulary by leading bits of the hash; several of one place stand in a row
        self.first[place[::-1]] = np.arange(len(self.vocab) - 1, -1, -1, dtype=np.int32)
        self.most = int(np.bincount(place).max()) if len(place) else 0
        item = np.repeat(np.arange(len(own)), size)
        term = np.searchsorted(self.vocab, np.concatenate(own)) if own else np.zeros(0, np.int64)
        key, tf = np.unique(term * max(1, len(own)) + item, return_counts=True)
        self.p_term, self.p_item = key // max(1, len(own)), key % max(1, len(own))
        n_postings = np.bincount(self.p_term, minlength=len(self.vocab))
        st = statistics or Statistics(len(own), size.mean() if len(size) else 1.0, self.vocab, n_postings)
        df = st.df[np.searchsorted(st.words, self.vocab)] if len(self.vocab) else n_postings
        idf = np.log(1 + (st.items - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(1.0, st.mean))
        weight = idf[self.p_term] * tf * (K1 + 1) / (tf + norm[self.p_item])
        self.total = np.bincount(self.p_item, weight, len(own))
        self.bound = self._bounds(weight)
        self.impact = weight / self.bound[self.p_item]
        self.p_start = np.concatenate(([0], np.cumsum(n_postings)))
        self.top = np.zeros(len(self.vocab))
        np.maximum.at(self.top, self.p_term, self.impact)
        self.levels: list[Level] = []  # from the smallest blocks up
        width = BLOCK
        while True:
            blocks = max(1, -(-len(own) // width))
            key, inverse = np.unique(self.p_term * blocks + self.p_item // width, return_inverse=True)
            most = np.zeros(len(key))
            np.maximum.at(most, inverse, self.impact)
            self.levels.append(Level(blocks, key, most))
            if blocks <= FAN * FAN:
                break
            width *= FAN

    def _bounds(self, weight: np.ndarray) -> np.ndarray:
        """Of each item, the least score of a passage that holds the overlap's share of its distinct shingles."""
        out = self.total.copy()
        order = np.lexsort((-weight, self.p_item))
        start = np.searchsorted(self.p_item[order], np.arange(len(out) + 1))
        for k in range(len(out)):
            missing = int((1 - self.overlap) * self.distinct[k] + 1e-9)
            out[k] -= weight[order[start[k] : min(start[k] + missing, start[k + 1])]].sum()
        return np.maximum(out, 1e-9)

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words of no item."""
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int64)
        for k in range(self.most):
            look = np.minimum(at + k, len(self.vocab) - 1)
            out[(at >= 0) & (self.vocab[look] == hashes)] = look[(at >= 0) & (self.vocab[look] == hashes)]
        return out

    def live_blocks(self, w: np.ndarray, t: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
        """(windows, blocks) whose maxima reach the threshold. w, t: windows and their distinct terms, by window. The largest blocks are tested first, then those within the ones that pass."""
        n = np.bincount(w, minlength=windows)
        first = np.concatenate(([0], np.cumsum(n)))[:-1]
        top = self.levels[-1]
        own = np.repeat(np.arange(windows), top.blocks)
        block = np.tile(np.arange(top.blocks), windows)
        low, size, level = None, 1, len(self.levels) - 1
        while True:
            here = self.levels[level]
            if low is None:  # all blocks of the largest size
                start, stop = np.searchsorted(here.key, t * here.blocks), np.searchsorted(here.key, (t + 1) * here.blocks)
                entry = spread(start, stop - start)
                bound = np.bincount(np.repeat(w, stop - start) * here.blocks + here.key[entry] % here.blocks, here.most[entry], windows * here.blocks)
            else:
                pair = spread(first[own], n[own])  # the terms of each live window and block
                parent = np.repeat(np.arange(len(own)), n[own])
                at = t[pair] * here.blocks
                start = np.searchsorted(here.key, at + block[parent] * FAN)
                stop = np.searchsorted(here.key, at + np.minimum((block[parent] + 1) * FAN, here.blocks))
                entry = spread(start, stop - start)
                parent = np.repeat(parent, stop - start)
                bound = np.bincount(parent * FAN + here.key[entry] % here.blocks - block[parent] * FAN, here.most[entry], len(own) * FAN)
                own, block = np.repeat(own, FAN), (block[:, None] * FAN + np.arange(FAN)).ravel()
            low = bound >= REACHED
            own, block = own[low], block[low]
            if not level or not len(own):
                return own, block
            level -= 1

    def wand(self, terms: list[int], blocks: list[int]) -> Iterator[tuple[int, float]]:
        """(item, score) of the items of these blocks at the threshold or above, by a cursor for each term."""
        base = self.levels[0]
        for block in blocks:
            last = (block + 1) * BLOCK
            cursors = []
            for t in terms:
                k = int(np.searchsorted(base.key, t * base.blocks + block))
                if k < len(base.key) and base.key[k] == t * base.blocks + block:
                    stop = int(self.p_start[t + 1])
                    at = int(self.p_start[t]) + int(np.searchsorted(self.p_item[self.p_start[t] : stop], block * BLOCK))
                    cursors.append([int(self.p_item[at]), at, stop, float(base.most[k])])
            while cursors:
                cursors.sort()
                reach, pivot = 0.0, -1
                for item, _, _, most in cursors:
                    reach += most
                    if reach >= REACHED:
                        pivot = item
                        break
                if pivot < 0:
                    break
                if cursors[0][0] == pivot:
                    score = sum(float(self.impact[c[1]]) for c in cursors if c[0] == pivot)
                    if score >= REACHED:
                        yield pivot, score
                    goal = pivot + 1
                else:
                    goal = pivot
                for c in cursors:
                    if c[0] < goal:
                        c[1] += int(np.searchsorted(self.p_item[c[1] : c[2]], goal))
                        c[0] = int(self.p_item[c[1]]) if c[1] < c[2] else last
                cursors = [c for c in cursors if c[0] < last]

    def candidates(self, terms: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(window, item, score in units of the item's threshold) of all windows and items at the threshold or above."""
        value = np.concatenate(([0.0], np.cumsum(np.where(terms >= 0, self.top[terms], 0.0))))
        for_all = np.flatnonzero(value[end] - value[start] >= REACHED)
        n_terms = len(self.vocab)
        lists = np.concatenate(([0], np.cumsum(np.where(terms >= 0, np.minimum(self.levels[-1].blocks, self.p_start[terms + 1] - self.p_start[terms]), 0))))
        for a, z in groups((lists[end[for_all]] - lists[start[for_all]]).tolist(), POSTINGS_AT_ONCE):
            live = for_all[a:z]
            n = end[live] - start[live]
            t, w = terms[spread(start[live], n)], np.repeat(np.arange(len(live)), n)
            pair = np.unique((w * n_terms + t)[t >= 0])
            w, t = pair // n_terms, pair % n_terms
            fit = np.bincount(w, self.top[t], len(live)) >= REACHED
            w, t = w[fit[w]], t[fit[w]]
            own, block = self.live_blocks(w, t, len(live))
            for k in np.unique(own).tolist():
                i, j = np.searchsorted(w, (k, k + 1))
                for item, score in self.wand(t[i:j].tolist(), sorted(block[own == k].tolist())):
                    yield int(live[k]), item, score

    def verify(self, item: int, words: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's distinct shingles that the words hold, and of the question's and the answer's words that these cover."""
        own = self.shingles[item]
        hit = np.isin(own, shingle_hashes(words) if self.size[item] >= 5 else short_shingles(words, int(self.size[item])))
        share = len(np.unique(own[hit])) / self.distinct[item]
        covered = np.zeros(self.size[item], bool)
        for k in range(min(5, self.size[item])):
            covered[k : k + len(hit)] |= hit
        q = self.question[item]
        return share, float(covered[:q].mean()), float(covered[q:].mean()) if q < len(covered) else 1.0


def short_shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of fewer than five words, as an item of so few words has."""
    return np.concatenate([shingle_hashes(words[k : k + size]) for k in range(max(0, len(words) - size + 1))] or [words[:0]])


def matches(index: ItemIndex, texts: list[str]) -> list[tuple[int, int, float, float, float, float]]:
    """(text, item id, BM25 score, overlap, question overlap, answer overlap) of each text and item that it holds, by its best window."""
    if not len(index.ids):
        return []
    words, at = hashed_words(texts)
    terms = index.terms(words)
    n = np.diff(at)
    count = -(-n // index.step)
    k = spread(np.zeros(len(n), np.int64), count)
    doc = np.repeat(np.arange(len(n)), count)
    start = at[doc] + k * index.step
    end = np.minimum(start + 2 * index.step, at[doc + 1])
    keep = (k == 0) | (end - start >= index.least)
    doc, start, end = doc[keep], start[keep], end[keep]
    best: dict[tuple[int, int], tuple[float, ...]] = {}
    for w, item, score in index.candidates(terms, start, end):
        share, question, answer = index.verify(item, words[start[w] : end[w]])
        if share >= index.overlap - 1e-9 and min(question, answer) >= PART_OVERLAP:
            found = share, score * float(index.bound[item]), question, answer
            key = int(doc[w]), item
            if key not in best or best[key] < found:
                best[key] = found
    return [(d, int(index.ids[i]), s, share, q, a) for (d, i), (share, s, q, a) in sorted(best.items())]


def corpus_statistics(items: DataFrame) -> tuple[int, float, DataFrame]:
    """Items with words, their mean number of words, and a table (word, df) of all items. items: item_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_groups(batch, CHUNK_CHARS):
                words, at = hashed_words(texts)
                n = np.diff(at)
                own = [np.unique(words[i:j]) for i, j in zip(at[:-1], at[1:], strict=True) if j > i]
                each = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
                # a word of an item counts one; the row without a word has the items and their words
                yield pa.RecordBatch.from_arrays([pa.array([None, *each.tolist()], pa.int64()), pa.array([int((n > 0).sum())] + [1] * len(each), pa.int64()), pa.array([int(n.sum())] + [0] * len(each), pa.int64())], ["word", "df", "size"])

    found = items.mapInArrow(run, "word long, df long, size long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("size").alias("size"))
    total = found.where(F.col("word").isNull()).first()
    n, size = (total.df, total["size"]) if total else (0, 0)
    return n, size / max(1, n), found.where(F.col("word").isNotNull()).select("word", "df")


def _indexes(items: DataFrame) -> Iterator[ItemIndex]:
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("item_id").isNotNull())
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shares = math.ceil(chars / SHARE_CHARS)
    n, mean, df = corpus_statistics(rows) if shares > 1 else (0, 0.0, None)
    for k in range(shares):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shares)) == k).orderBy("item_id", "text").collect()  # about SHARE_CHARS characters
        statistics = None
        if df is not None:
            words = np.unique(hashed_words([r.text for r in own])[0])
            asked = rows.sparkSession.createDataFrame(pa.table({"word": words.view(np.int64)}))
            known = df.join(asked, "word").toArrow()  # a row a word of the share
            hashes = known.column("word").to_numpy().astype(np.int64).view(np.uint64)
            order = np.argsort(hashes)
            statistics = Statistics(n, mean, hashes[order], known.column("df").to_numpy()[order])
        yield ItemIndex([r.item_id for r in own], [r.text for r in own], statistics=statistics)


COLUMNS = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document row and test item that it holds.

    A null text counts as empty and holds nothing; an item with a null id or without words is no item; equal
    items each give a row, as do repeated rows of documents; a null doc_id is kept; other columns are ignored.
    Without items or documents there are no rows.
    """
    spark, found = docs.sparkSession, []
    for index in _indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                keys = column(batch, "doc_id")
                for x, _, texts in text_groups(batch, CHUNK_CHARS):
                    hits = matches(index, texts)
                    if hits:
                        d, i, *scores = zip(*hits, strict=True)
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array([x + k for k in d], pa.int64())), pa.array(i, pa.int64()), *(pa.array(s, pa.float64()) for s in scores)], COLUMNS)

        found.append(with_text(docs).mapInArrow(run, "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"))
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double")
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of documents, as they are, that hold no test item; without a shuffle, as each task judges its own rows."""
    spark = docs.sparkSession
    for index in _indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for x, y, texts in text_groups(batch, CHUNK_CHARS):  # handed on run by run
                    held = np.zeros(y - x, bool)
                    held[[d for d, *_ in matches(index, texts)]] = True
                    yield batch.slice(x, y - x).filter(pa.array(~held))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
