"""Toxicity by a noisy channel: restore obfuscated words, then score what they say.

Restoring: a word that holds digits or marks among letters, repeats a letter or mixes look-alikes of other scripts with Latin letters, and a run of
one or two letters at a time set apart by white space or marks of any kind, is read as a lattice; in such a run each gap may be a space. Each written character may stand for some letters (leetspeak, look-alikes), for nothing (a
mark put in), or be one of several copies (repetition). The Viterbi path through the lattice is the most
likely text under a character trigram model, whose counts are taken over all documents. Characters without width are left out first.

Scoring: words and word beginnings of restored texts that go with the label are learned from labelled rows;
a text's evidence is the sum over its distinct words, made a probability by a logistic curve of one variable.

Corpus counts cover every document. The classifier is fitted on at most `TRAIN_ROWS` labelled rows, the
first by a hash of their id, each with one text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import Scratch, column, groups, in_fold, text_groups
from .words import hashed_words, shingle_hashes

FOLD, HELD_OUT = 5, 0
#: Labelled rows for fitting at most; beginnings of words by length; toxic documents that must hold a feature; natural logarithm by which its evidence must beat chance; evidence at which a weight is halved.
TRAIN_ROWS, PREFIXES, LEAST_DOCS, MARGIN, SHRINK = 20_000, (4, 5, 6, 7), 3, 3.0, 40.0
#: Share of their distinct words in which two labelled texts agree that count as one.
ALIKE = 0.8
CHUNK_CHARS = 1_000_000
KEPT_WORDS = 200_000
#: Features that a task counts before it hands them to Spark, which sums them; words of texts held at a time.
KEPT_FEATURES, CHUNK_WORDS = 60_000, 20_000

#: What a digit or mark is written for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
#: Letters of other scripts that look like a Latin one; characters without width.
LOOK_ALIKE = dict(zip("аеорсухіѕјһԁɡкмтвнοαειρτυνκ", "aeopcyxisjhdgkmtbhoaeiptuvk", strict=True))
NO_WIDTH = dict.fromkeys(map(ord, "\u00ad\u034f\u200b\u200c\u200d\u2060\ufeff"))
#: Natural logarithms of the channel: a look-alike for its letter, a letter for itself, a letter for its sign, a mark put in, a sign of LEET put in, a copy more.
ALIKE_LETTER, ITSELF, SIGN, NOTHING, LOST, COPY = -0.2, -0.05, -1.2, -1.0, -5.0, -0.7
#: Natural logarithms of a gap between letters set apart, by 0 for a narrow and 1 for a wide one: within a word, and between words.
WITHIN, BETWEEN = (-0.2, -3.0), (-1.6, -0.1)
DOTS = "·•∙‧⋅●・¤°"
MARKS = set(".,-_~'`^#%&/\\:;=" + DOTS)

LETTERS = re.compile(r"[^\W\d_]+")

# -- character trigrams. Classes: 0 is the border of a word, 1 any other letter, then a to z, then bytes of Latin letters in UTF-8.
CLASSES = 96


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for b in range(256):
        if 97 <= b <= 122:
            out[b] = b - 95
        elif b >= 128:
            out[b] = 28 + (b & 63)
    return out


CLASS_OF = _classes()


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of three neighbouring classes over all texts, as one vector."""
    data = np.frombuffer(("\n" + "\n".join(texts).lower() + "\n").encode("utf-8", "replace"), np.uint8)
    c = CLASS_OF[data]
    if len(c) < 3:
        return np.zeros(CLASSES**3, np.int64)
    return np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)


def corpus_trigrams(docs: DataFrame) -> np.ndarray:
    """The counts over every row's whole text. A row a trigram and task is summed by Spark; a table of fixed size comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for _, _, texts in text_groups(batch, CHUNK_CHARS):
                total += trigram_counts(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["k", "n"])

    pdf = docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CLASSES**3, np.int64)
    out[pdf["k"].to_numpy(np.int64)] = pdf["n"].to_numpy(np.int64)
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """log p(third | first two), with trigrams, bigrams and single classes mixed by their counts."""
    n = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
    one = (n.sum((0, 1)) + 0.5) / (n.sum() + 0.5 * CLASSES)
    two = (n.sum(0) + 5 * one) / (n.sum(0).sum(1, keepdims=True) + 5)
    three = (n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5)
    return np.log(three).astype(np.float32)


class Restorer:
    """Restores texts under a character model; keeps what it has restored, up to a bound."""

    # each alternative starts only where a run of letters or marks does, so that a search is linear in the word's length
    ODD = re.compile(r"(?i)(?<![^\W\d_])(?>[^\W\d_]*?[a-zÀ-ɏ])[^\W\d_]*+[\d@$!|+(€£¡*.\-_~^#%&/\\:;=·•∙‧⋅●・¤°]+[^\W_]|[a-zÀ-ɏ][\d@$!|+(€£¡*]+$|\d[^\s\w]*+[^\W\d_]|(?<![^\s\w])(?>[^\s\w]*?[@$!|€£¡(])[^\s\w]*+[^\W\d_]|([^\W\d_])\1\1")
    EDGE = re.compile(r"([^\w\s])\1{2,}$|^([^\w\s])\2{2,}")
    THRICE = re.compile(r"(.)\1\1")
    # what looks ahead for a piece and a gap keeps the search from trying every word
    APART = re.compile(
        r"(?<![^\W_])(?=(?:[^\W_]{1,2}|[@$!|€£¡])(?:[^\w@$!|€£¡]|_))"
        r"(?:(?:(?:[^\W_]|[@$!|€£¡])(?:[^\w@$!|€£¡]|_)++){3,}(?:[^\W_]|[@$!|€£¡])(?![^\W_])|(?:[^\W\d_]{1,2}+(?:[^\w@$!|€£¡]|_)++){2,}[^\W\d_]{1,2}+(?![^\W_]))"
    )
    GAP = re.compile(r"((?:[^\w@$!|€£¡]|_)+)")

    def __init__(self, logp: np.ndarray):
        self.logp, self.kept, self.runs = logp, {}, {}

    def _cost(self, a: int, b: int, ch: str) -> tuple[float, int, int]:
        total = 0.0
        for byte in ch.encode():
            c = int(CLASS_OF[byte])
            total += float(self.logp[a, b, c])
            a, b = b, c
        return total, a, b

    def decode(self, written: str, gaps: list[int | None] | None = None) -> tuple[str, float]:
        """The most likely text of a word's lattice and its log probability. Input in lower case, of any length. gaps: for each character but the first how wide the gap before it is, if there is one; a gap may be a space."""
        # a state is the last two classes and the letter last read; the best path to each is kept, as (path before, letter)
        states: dict[tuple[int, int, str, bool], tuple[float, tuple | None]] = {(0, 0, "", False): (0.0, None)}
        for k, ch in enumerate(written):
            if gaps and k and gaps[k - 1] is not None:
                width, apart = gaps[k - 1], {}
                for (a, b, last, used), (score, path) in states.items():
                    apart[a, b, last, used] = score + WITHIN[width], path
                    key, ends = (b, 0, "", False), score + BETWEEN[width] + float(self.logp[a, b, 0])
                    if last and (key not in apart or apart[key][0] < ends):
                        apart[key] = ends, (path, " ")
                states = apart
            reads = [(ch, ITSELF), *((x, ALIKE_LETTER) for x in LOOK_ALIKE.get(ch, ""))] if ch.isalpha() else [(x, SIGN) for x in LEET.get(ch, "")]
            skip = not ch.isalpha() and (ch in MARKS or ch in LEET)
            new: dict[tuple[int, int, str, bool], tuple[float, tuple | None]] = {}

            def offer(key, score, path, new=new):
                if key not in new or new[key][0] < score:
                    new[key] = score, path

            for (a, b, last, used), (score, path) in states.items():
                for letter, weight in reads:
                    cost, x, y = self._cost(a, b, letter)
                    offer((x, y, letter, False), score + weight + cost, (path, letter))
                    if letter == last:  # a copy of the letter before
                        offer((a, b, last, True), score + COPY + (ITSELF if used else 0), path)
                if skip or not reads:
                    offer((a, b, last, used), score + (LOST if ch in LEET else NOTHING), path)
            states = new
        best, path = max(((s + float(self.logp[a, b, 0]), p) for (a, b, _, _), (s, p) in states.items()), key=lambda x: x[0])
        letters = []
        while path:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters)), best

    def word(self, w: str) -> str:
        if w not in self.kept:
            if len(self.kept) > KEPT_WORDS:
                self.kept.clear()
            self.kept[w] = self._restored(w)
        return self.kept[w]

    def _restored(self, w: str) -> str:
        if not w.isascii() and not LOOK_ALIKE.keys().isdisjoint(w) and any("a" <= c <= "z" for c in w):
            core = w.strip(".,;:!?\"'()[]")
            return self.decode(core)[0] or core
        if w.isalpha() and not self.THRICE.search(w):
            return w
        core = self.EDGE.sub("", w).strip(".,;:!?\"'()[]")
        return (self.decode(core)[0] or core) if self.ODD.search(core) else core

    def _together(self, m: re.Match) -> str:
        """Letters set apart, as the likeliest words that they make, if these are likelier than words of a letter each. A gap wider than the run's narrowest likely ends a word."""
        run = m[0]
        if len(run) > 64:
            return self._run(run)
        if run not in self.runs:
            if len(self.runs) > KEPT_WORDS:
                self.runs.clear()
            self.runs[run] = self._run(run)
        return self.runs[run]

    def _run(self, run: str) -> str:
        written = self.GAP.split(run)
        singles = sum(len(p) == 1 for p in written[::2])
        first, last = 0, len(written)
        if singles >= 3:  # short words about letters set apart are words
            while len(written[first]) == 2:
                first += 2
            while len(written[last - 1]) == 2:
                last -= 2
        parts, widths = written[first:last:2], [len(g) for g in written[first + 1 : last : 2]]
        if not any(p.isalpha() and len(p) == 1 for p in parts) or sum(map(str.isalpha, parts)) < 2:
            return run  # short words, or figures
        least = min(widths)
        gaps: list[int | None] = []
        for p, w in zip(parts, [None, *widths], strict=True):
            gaps += ([] if w is None else [int(w > least)]) + [None] * (len(p) - 1)
        joined, score = self.decode("".join(parts), gaps)
        alone = sum(self.decode(p)[1] for p in parts) + sum(BETWEEN[int(w > least)] for w in widths)
        return "".join(written[:first]) + f" {joined} " + "".join(written[last:]) if joined and score > alone else run

    def words(self, text: str) -> list[str]:
        """Distinct words of the restored text, in order."""
        return list(dict.fromkeys(x for w in dict.fromkeys(self.joined(text).split()) for x in LETTERS.findall(self.word(w))))

    def joined(self, text: str) -> str:
        """In lower case, with letters set apart joined where they are a word."""
        text = text.lower()
        return self.APART.sub(self._together, text if text.isascii() else text.translate(NO_WIDTH))

    def restore(self, text: str) -> str:
        return " ".join(self.word(w) for w in self.joined(text).split())


def features(word: str) -> list[str]:
    """The whole word, and its beginnings."""
    return [f"={word}", *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


def distinct_features(found: list[tuple[str, float, int]]) -> dict[str, float]:
    """Weights without the beginnings whose documents are nearly all those of one word: the word says it better."""
    docs = {f: t for f, _, t in found}
    told = {p for f, t in docs.items() if f[0] == "=" for p in features(f[1:])[1:] if t >= 0.9 * docs.get(p, math.inf)}
    return {f: w for f, w, _ in found if f not in told}


def word_lists(batch: pa.RecordBatch) -> Iterator[tuple[list[str], int]]:
    """Words and label of each row. Only about `CHUNK_WORDS` words are held as Python strings at a time."""
    words, y = column(batch, "words"), column(batch, "y")
    for a, b in groups(pc.list_value_length(words).to_pylist(), CHUNK_WORDS):
        yield from zip(words[a:b].to_pylist(), y[a:b].to_pylist(), strict=True)


def feature_rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
    """f, t and n: the features and in how many texts with the label and without it they are."""
    t, n = np.array(list(counts.values()), np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(t), pa.array(n)], ["f", "t", "n"])


class Model(NamedTuple):
    logp: np.ndarray
    weights: dict[str, float]
    slope: float
    bias: float


def evidence(words: list[str], weights: dict[str, float]) -> float:
    """Each distinct word counts once, by its strongest feature."""
    return math.fsum(max((weights.get(f, 0.0) for f in features(w)), default=0.0) for w in words)


class Scorer:
    """evidence() of restored texts, with the evidence of each written word kept, up to a bound."""

    def __init__(self, restorer: Restorer, weights: dict[str, float]):
        self.restorer, self.weights, self.kept = restorer, weights, {}

    def _look(self, w: str) -> dict[str, float] | tuple:
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        found = {x: e for x in LETTERS.findall(self.restorer._restored(w)) if (e := evidence([x], self.weights))}
        self.kept[w] = found or ()
        return found

    def evidence(self, text: str) -> float:
        hits: dict[str, float] = {}
        for w in set(self.restorer.joined(text).split()):
            e = self.kept.get(w)
            if e is None:
                e = self._look(w)
            if e:
                hits.update(e)
        return math.fsum(hits.values())


def probability(e: float, slope: float, bias: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, slope * e + bias))))


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 200) -> tuple[float, float]:
    """Slope and bias of a logistic regression on one variable by Newton's method; the slope is penalised and not negative."""
    w = np.zeros(2)
    z = np.column_stack((x, np.ones(len(x))))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
        gradient = z.T @ (p - y) + np.array([penalty, 1e-3]) * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag([penalty, 1e-3])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(0.0, float(w[0])), float(w[1])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Learns from labelled rows outside the held-out fold. A null label or id teaches nothing; a document labelled twice counts by its highest label, one with several rows by its least text; a text whose distinct words agree with an earlier one's in `ALIKE` (copies and near copies) counts once a label, as far as they share the least hash of their shingles."""
    logp = log_model(corpus_trigrams(docs))
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), FOLD, HELD_OUT))
    y = y.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    y = F.broadcast(y.orderBy(F.xxhash64("id"), "id").limit(rows))  # two numbers a row of a bounded sample
    # of rows of one id the least text, so that the sample has at most `rows` rows
    sample = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(y, "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    model = spark.sparkContext.broadcast(logp)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(model.value)
        for batch in batches:
            for a, b, texts in text_groups(batch, CHUNK_CHARS):
                h, o = hashed_words(texts)
                sketch = [int(shingle_hashes(h[i:j]).min().view(np.int64)) if j > i else 0 for i, j in zip(o[:-1], o[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([column(batch, "id")[a:b], column(batch, "y")[a:b], pa.array(sketch, pa.int64()), pa.array([r.words(t) for t in texts], pa.list_(pa.string()))], ["id", "y", "sketch", "words"])

    def unlike(rows: pa.Table) -> pa.Table:
        """Of the rows of one sketch and label, those that are like none kept before them, in order of their words' number, then ids."""
        words = [frozenset(w) for w in rows.column("words").to_pylist()]
        order = sorted(range(len(words)), key=lambda k: (len(words[k]), rows.column("id")[k].as_py()))
        kept, first = [], 0
        for k in order:
            while first < len(kept) and len(words[kept[first]]) < ALIKE * len(words[k]):
                first += 1  # too few words to be like any that follow
            if not any(len(words[j] & words[k]) >= ALIKE * len(words[j] | words[k]) for j in kept[first:]):
                kept.append(k)
        return rows.select(["y", "words"]).take(pa.array(kept, pa.int64()))

    scratch = Scratch(spark, "toxicity")
    read_rows = scratch.put(sample.mapInArrow(read, "id long, y int, sketch long, words array<string>").groupBy("sketch", "y").applyInArrow(unlike, "y int, words array<string>"), "sample")  # groups of a bounded sample
    sizes = {r.y: r.n for r in read_rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not bad or not good:  # nothing to tell apart
        scratch.drop()
        return Model(logp, {}, 0.0, math.log((bad + 0.5) / (good + 0.5)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for words, label in word_lists(batch):
                for f in {f for w in words for f in features(w)}:
                    counts.setdefault(f, [0, 0])[label != 1] += 1
                if len(counts) > KEPT_FEATURES:
                    yield feature_rows(counts)
                    counts = {}
        yield feature_rows(counts)

    c = read_rows.select("words", "y").mapInArrow(count, "f string, t long, n long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    t, n, base = F.col("t"), F.col("n"), bad / (bad + good)
    gain = t * F.log(t / ((t + n) * base)) + F.when(n > 0, n * F.log(n / ((t + n) * (1 - base)))).otherwise(0.0)
    weight = F.log((t + 0.5) / (bad + 1)) - F.log((n + 0.5) / (good + 1))
    c = scratch.put(c.where(t >= LEAST_DOCS).select("f", (weight * gain / (gain + SHRINK)).alias("w"), gain.alias("g"), "t").where(F.col("w") > 0), "counts")
    least = math.log(max(1, c.count())) + MARGIN  # by chance alone, some feature of so many gains as much in exp(-MARGIN) of all cases
    chosen = c.where(F.col("g") >= least)  # of the words of a bounded sample
    weights = distinct_features([(r.f, r.w, r.t) for r in chosen.collect()])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([evidence(w, weights) for w, _ in word_lists(batch)], pa.float64()), column(batch, "y")], ["e", "y"])

    fit = read_rows.select("words", "y").mapInArrow(judge, "e double, y int").toPandas()  # two numbers a row of the bounded sample
    scratch.drop()
    slope, bias = fit_curve(fit["e"].to_numpy(), (fit["y"] == 1).to_numpy(float))
    return Model(logp, weights, slope, bias)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns as they are, score and predicted of each row. A null text counts as empty and gets the score of no evidence; repeated rows and null ids give a row each; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*dict.fromkeys((*keep, "text")))
    schema = StructType([*(rows.schema[c] for c in keep), StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        r = Scorer(Restorer(m.logp), m.weights)
        for batch in batches:
            for a, b, texts in text_groups(batch, CHUNK_CHARS):  # handed on run by run, as kept columns can hold the whole texts
                s = [probability(r.evidence(t), m.slope, m.bias) for t in texts]
                yield pa.RecordBatch.from_arrays([*(column(batch, c)[a:b] for c in keep), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [*keep, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs, train(spark, docs, labels))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(F.col("doc_id"), FOLD, HELD_OUT).alias("held_out"), "score", "predicted")
