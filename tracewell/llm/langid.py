"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting runs over all training rows, by numpy within tasks and by a partial sum in Spark, so what reaches
the driver is one row a language and bucket, however large the corpus is. The log-probability matrix
(buckets x languages, float32) has a fixed size and is broadcast. Scoring looks up the n-grams of many texts at once
and adds them up a text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import column, in_fold, text_groups, with_text
from .words import mix

#: Orders of n-grams, hash buckets, added to each count, languages at most (a bound on the matrix).
ORDERS, BUCKETS, SMOOTHING, MOST_LANGUAGES = (1, 2, 3, 4), 1 << 15, 0.5, 1024
FOLD, HELD_OUT = 3, 1
CHUNK_CHARS = 250_000
UNDETERMINED = "und"
_letter: list[np.ndarray] = []
_SALT = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


def _is_letter() -> np.ndarray:
    if not _letter:
        _letter.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letter[0]


def ngram_buckets(texts: list[str], orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram that begins at each kept character, and the texts' offsets among them.

    Texts are lower-cased; a run of anything but letters is one space; each text begins and ends with a space
    and n-grams may reach over it into the next text only through that space, where they are masked (-1).
    """
    data = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t.lower()) + 2 for t in texts])
    letter = _is_letter()[data]
    code = np.where(letter, data, 32).astype(np.uint64)
    first = np.concatenate(([0], ends[:-1]))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space after a word
    keep[first] = True
    code = code[keep]
    offsets = np.concatenate(([0], np.cumsum(np.add.reduceat(keep, first)))) if len(texts) else np.zeros(1, np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    out = []
    with np.errstate(over="ignore"):
        for n in orders:
            h = np.full(len(code), -1, np.int64)
            m = len(code) - n + 1
            if m > 0:
                x = np.full(m, _SALT[7] + np.uint64(n), np.uint64)
                for k in range(n):
                    x = x + code[k : k + m] * _SALT[k]
                h[:m] = (mix(x) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
                if n > 1:
                    h[:m][owner[n - 1 :] != owner[:m]] = -1
                else:
                    h[:m][code == 32] = -1
            out.append(h)
    return out, offsets


def train(docs: DataFrame, label: str = "lang", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix of log probabilities with a last row of log priors. Learns from rows with a non-null label."""
    rows = with_text(docs.where(F.col(label).isNotNull()), F.col(label).cast("string").alias("label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = column(batch, "label").to_pylist()
            for a, b, texts in text_groups(batch, 4 * CHUNK_CHARS):
                by: dict[str, list[str]] = {}
                for t, y in zip(texts, labels[a:b], strict=True):
                    by.setdefault(y, []).append(t)
                for y, own in by.items():
                    total = sums.setdefault(y, np.zeros(buckets + 1, np.int64))
                    total[buckets] += len(own)
                    for h in ngram_buckets(own, buckets=buckets)[0]:
                        total[:buckets] += np.bincount(h[h >= 0], minlength=buckets)
        for y, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["label", "bucket", "n"])

    found = rows.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counts = found.limit(MOST_LANGUAGES * (buckets + 1) + 1).toPandas()
    names = sorted(counts["label"][counts["bucket"] == buckets])
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    return names, _matrix(names, counts, buckets, smoothing)


def _matrix(names: list[str], counts, buckets: int, smoothing: float) -> np.ndarray:
    n = np.zeros((buckets + 1, max(1, len(names))))
    if names:
        n[counts["bucket"].to_numpy(), np.searchsorted(names, counts["label"].to_numpy(dtype=str))] = counts["n"].to_numpy()
    grams = n[:buckets] + smoothing
    out = np.log(grams / grams.sum(0))
    prior = np.log((n[buckets] + 1) / (n[buckets] + 1).sum())
    return np.vstack((out, prior)).astype(np.float32)


def score_texts(texts: list[str], names: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text; `und` and 0 for a text without a letter, or if no language was learned."""
    buckets = len(matrix) - 1
    grams, offsets = ngram_buckets(texts, buckets=buckets)
    table = np.vstack((matrix[:buckets], np.zeros((1, matrix.shape[1]), np.float32)))  # what is masked (-1) adds nothing
    total = np.zeros((len(texts), matrix.shape[1]))
    for h in grams:
        total += np.add.reduceat(table[h], offsets[:-1], axis=0, dtype=np.float64)
    letters = np.add.reduceat(grams[0] >= 0, offsets[:-1])
    total += matrix[buckets]
    total -= total.max(1, keepdims=True)
    p = np.exp(total)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    known = (letters > 0) & bool(names)
    return [names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, p[np.arange(len(texts)), best], 0.0)


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns as they are, lang_pred and score of each row. A null text counts as empty and is `und`; repeated rows and null ids give a row each; other columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast((names, matrix))
    rows = docs.select(*dict.fromkeys((*keep, "text")))
    schema = StructType([*(rows.schema[c] for c in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = model.value
        for batch in batches:
            for a, b, texts in text_groups(batch, CHUNK_CHARS):  # handed on run by run, as kept columns can hold the whole texts
                langs, scores = score_texts(texts, names, matrix)
                yield pa.RecordBatch.from_arrays([*(column(batch, c)[a:b] for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~in_fold(F.col("doc_id"), FOLD, HELD_OUT))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from two folds of three and predicts every row: doc_id, held_out, lang_pred, score. An empty table gives no rows."""
    names, matrix = train(training_rows(docs))
    p = predict(docs, names, matrix)
    return p.select("doc_id", in_fold(F.col("doc_id"), FOLD, HELD_OUT).alias("held_out"), "lang_pred", "score")
