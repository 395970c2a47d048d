"""Token ids as Arrow stream files of equal-length sequences.

A file holds record batches of one sequence a row: `ids` (fixed-size list of uint16 or uint32) and `mask`
(fixed-size list of uint8, 0 on padding). All batches but the last have the same number of rows, so the
k-th sequence is at a known place, and a reader that maps the file sees ids and masks in place without a copy.

The documents are encoded once, dealt to shards by ranges of doc_id (bounds are quantiles of that column
alone) and sorted within; each shard becomes one file whose last sequence is padded. A file is written
under a name of its own and then renamed, so a task that is run again leaves the same file.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, text_groups, with_text
from .words import byte_hashes, mix

SEQ_LEN, ROWS, END_ID = 2048, 64, 2
BATCH_CHARS = 2_000_000
#: Bytes of input that a file takes at most, about.
SHARD_BYTES = 256 << 20
#: Distinct words whose ids a worker keeps before it starts anew.
KEPT_WORDS = 2_000_000


#: Fixed value: the pre-token pattern of the vocabularies that the shortcut serves.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_words(spec: dict) -> bool:
    """Whether a tokenizer normalises and splits as the shortcut takes it to."""
    steps = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
    split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    return steps == ["NFC", "Replace", "Lowercase"] and split[0].get("pattern") == {"Regex": WORDS} and [x.get("use_regex") for x in split[1:]] == [False] and not spec["post_processor"]


class CachedWordEncoder:
    """The ids of a lower-casing tokenizer that encodes each word by itself, with its words' ids kept.

    The shortcut serves texts of ASCII (but the apostrophe, for contractions) and Latin letters, where the
    library's normalisation is lower-casing and its split is into runs of letters, single digits and runs of
    other marks. There a batch is split and its words hashed (64 bits) by numpy, and only words not met before
    go to the library. A hash only finds a place: the word that is kept there is compared byte by byte, and a text
    with a word that differs goes to the library whole, as do all other texts and those that might hold a special token.
    """

    OTHER = re.compile(r"[^\t\n\r -&(-~À-ÖØ-öø-ɏ]|<\||İ")
    DIRECT = 18

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_str(tokenizer_json)
        self.tk.no_truncation()
        self.tk.no_padding()
        self.known_kind = _splits_words(json.loads(tokenizer_json))
        self.kind = np.array([1 if chr(b).isalpha() or b > 127 else 2 if 48 <= b <= 57 else 0 if b in b"\t\n\r " else 3 for b in range(256)], np.uint8)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and where their ids stand
        self.flat, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.letters, self.word_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # the words themselves, by slot
        self.direct_key, self.direct_slot = np.zeros(1 << self.DIRECT, np.uint64), np.zeros(1 << self.DIRECT, np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """hashes: ascending."""
        written = [w.encode() for w in words]
        self.letters = np.concatenate((self.letters, np.frombuffer(b"".join(written), np.uint8)))
        self.word_at = np.concatenate((self.word_at, self.word_at[-1] + np.cumsum([len(w) for w in written])))
        ids, counts = [], []
        chunks = [words[k : k + 500] for k in range(0, len(words), 500)]
        for own, e in zip(chunks, self.tk.encode_batch([" ".join(c) for c in chunks], add_special_tokens=False), strict=True):
            n = np.bincount(np.array(e.word_ids), minlength=len(own))
            if len(n) != len(own):
                raise ValueError("the tokenizer splits a word")
            ids.append(np.array(e.ids, np.uint32))
            counts.append(n)
        first = len(self.start) - 1
        self.flat = np.concatenate((self.flat, *ids))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(np.concatenate(counts))))
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.slots = np.insert(self.keys, at, hashes), np.insert(self.slots, at, np.arange(first, first + len(words)))

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and which words are known."""
        d = (h >> np.uint64(64 - self.DIRECT)).astype(np.int64)
        slot, known = self.direct_slot[d], self.direct_key[d] == h
        rest = np.flatnonzero(~known)
        if len(rest) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h[rest]), len(self.keys) - 1)
            hit = self.keys[at] == h[rest]
            rest, at = rest[hit], at[hit]
            slot[rest], known[rest] = self.slots[at], True
            free = self.direct_key[d[rest]] == 0
            self.direct_key[d[rest[free]]] = h[rest[free]]
            self.direct_slot[d[rest[free]]] = self.slots[at[free]]
            same = self.direct_key[d[rest[free]]] == h[rest[free]]  # two new words of one place: the last has it
            self.direct_slot[d[rest[free][same]]] = self.slots[at[free][same]]
        return slot, known

    def _other(self, slot: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the words that are not the ones kept in their slots."""
        n, first = end - begin, self.word_at[slot]
        odd = n != self.word_at[slot + 1] - first
        same = np.flatnonzero(~odd)
        n, stop = n[same], np.cumsum(n[same])
        place = np.arange(stop[-1] if len(stop) else 0)
        differs = data[np.repeat(begin[same] - stop + n, n) + place] != self.letters[np.repeat(first[same] - stop + n, n) + place]
        odd[same[np.searchsorted(stop, np.flatnonzero(differs), side="right")]] = True
        return np.flatnonzero(odd)

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        parts = [t.lower().encode() for t in texts]
        raw = b"\n".join(parts) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        kind = self.kind[data]
        edge = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
        edge = np.concatenate(([0], edge, [len(data)]))
        real = kind[edge[:-1]] != 0
        begin, end = edge[:-1][real], edge[1:][real]
        h = byte_hashes(data, begin, end)
        slot, known = self._find(h)
        if not known.all():
            new, at = np.unique(h[~known], return_index=True)
            if len(self.keys) + len(new) > KEPT_WORDS:
                self.clear()
                new, at = np.unique(h, return_index=True)
            else:
                at = np.flatnonzero(~known)[at]
            self._learn(new, [raw[x:y].decode() for x, y in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            slot, known = self._find(h)
        n = self.start[slot + 1] - self.start[slot]
        stop = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[slot] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]
        text_at = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
        cut = np.concatenate(([0], stop))[np.searchsorted(begin, text_at)]
        out = [ids[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        for k in np.unique(np.searchsorted(text_at, begin[self._other(slot, data, begin, end)], side="right") - 1).tolist():
            out[k] = np.array(self.tk.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        slow = [k for k, t in enumerate(texts) if not self.known_kind or self.OTHER.search(t)]
        own = dict(zip(slow, (np.array(e.ids, np.uint32) for e in self.tk.encode_batch([texts[k] for k in slow], add_special_tokens=False)), strict=True))
        fast = iter(self._fast([t for k, t in enumerate(texts) if k not in own]) if len(own) < len(texts) else [])
        return [own[k] if k in own else next(fast) for k in range(len(texts))]


_encoders: dict[str, CachedWordEncoder] = {}


def word_encoder(tokenizer_json: str) -> CachedWordEncoder:
    if tokenizer_json not in _encoders:
        _encoders[tokenizer_json] = CachedWordEncoder(tokenizer_json)
    return _encoders[tokenizer_json]


def _schema(seq_len: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), seq_len)), ("mask", pa.list_(pa.uint8(), seq_len))])


class ShardWriter:
    """Packs ids end to end into equal-length sequences and writes them as an Arrow stream."""

    def __init__(self, uri: str, seq_len: int = SEQ_LEN, rows: int = ROWS, wide: bool = False):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.seq, self.block, self.schema = seq_len, seq_len * rows, _schema(seq_len, wide)
        self.kind = np.uint32 if wide else np.uint16
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.sink = self.fs.open_output_stream(self.temp)
        self.out = ipc.new_stream(self.sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.block:
            flat = np.concatenate(self.held)
            full = len(flat) - len(flat) % self.block
            for x in range(0, full, self.block):
                self._put(flat[x : x + self.block], self.block)
            self.held, self.waiting = [flat[full:]], len(flat) - full

    def _put(self, flat: np.ndarray, real: int) -> None:
        mask = (np.arange(len(flat)) < real).astype(np.uint8)  # a byte each, so that a reader has them in place
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.seq) for v in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        if len(flat):
            self._put(np.pad(flat, (0, -len(flat) % self.seq)), len(flat))
        self.out.close()
        self.sink.close()
        self.fs.move(self.temp, self.path)


class ShardReader:
    """Sequences and ids of a file by place. A local file is mapped; elsewhere only the batches that are asked for are read, as all but the last have one size."""

    KEPT = 4  # batches of a file that isn't mapped

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.mapped = isinstance(files, fs.LocalFileSystem)
        self.held: OrderedDict[int, pa.RecordBatch] = OrderedDict()
        if self.mapped:
            self.batches = list(ipc.open_stream(pa.memory_map(path)))
            first = self.batches[0] if self.batches else None
        else:
            self.file = files.open_input_file(path)
            self.schema = ipc.read_schema(ipc.read_message(self.file))
            self.begin = self.file.tell()
            first = self._read()
            self.size = self.file.tell() - self.begin
        self.seq = first.schema.field("ids").type.list_size if first is not None else 0
        self.rows = first.num_rows if first is not None else 1

    def _read(self) -> pa.RecordBatch | None:
        try:
            message = ipc.read_message(self.file)
        except EOFError:
            return None
        return ipc.read_record_batch(message, self.schema)

    def batch(self, k: int) -> pa.RecordBatch:
        if self.mapped:
            return self.batches[k]
        if k not in self.held:
            if len(self.held) >= self.KEPT:
                self.held.popitem(last=False)
            self.file.seek(self.begin + k * self.size)
            got = self._read()
            if got is None:
                raise IndexError(f"no batch {k}")
            self.held[k] = got
        return self.held[k]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the k-th sequence, both in place."""
        batch, row = self.batch(k // self.rows), k % self.rows
        cut = slice(row * self.seq, (row + 1) * self.seq)
        return batch.column(0).flatten().to_numpy()[cut], batch.column(1).flatten().to_numpy()[cut].view(bool)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place within the file; over batch borders they are put together."""
        size, out = self.rows * self.seq, []
        while n:
            flat = self.batch(start // size).column(0).flatten().to_numpy()
            out.append(flat[start % size : start % size + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return np.concatenate(out) if out else np.zeros(0, np.uint16)


def _deal_keys(spark: SparkSession, shards: int) -> list[int]:
    """For each shard a number that Spark's hash partitioning deals to a partition of its own, so that no task gets two shards while another has none."""
    k = F.col("id").cast("int")
    found = {r.p: r.k for r in spark.range(shards * 32).select(k.alias("k"), F.pmod(F.hash(k), F.lit(shards)).alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect()}
    return [found.get(s, s) for s in range(shards)]


def needs_wide(tokenizer_json: str, end_id: int = END_ID) -> bool:
    """Whether some id takes over 16 bits."""
    from tokenizers import Tokenizer

    return max([end_id, *Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True).values()]) > np.iinfo(np.uint16).max


def shard_of(ids: np.ndarray, cuts: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Shard of each row: the number of cuts below its id. Where several cuts are the same id, its rows are dealt over as many shards by turn (0 up to 1)."""
    low, high = np.searchsorted(cuts, ids, side="left"), np.searchsorted(cuts, ids, side="right")
    return low + (turn * np.maximum(1, high - low)).astype(np.int64)


def write_token_files(docs: DataFrame, tokenizer_json: str, folder: str, shards: int, end_id: int = END_ID, seq_len: int = SEQ_LEN, wide: bool | None = None) -> DataFrame:
    """Writes shard files named by number and returns the index, lazily: doc_id, shard, start (in the shard), n_tokens.

    A null text counts as empty and has the end id alone. A null id comes before all others; rows of one id
    stand in the order of their encoded ids within a shard, and an id with more rows than a shard holds is dealt over
    several. wide: ids of 32 bits; by default where the vocabulary needs them, and a narrow file of such a vocabulary is
    refused. Reading the index writes the files; read it once, into a table.
    """
    spark, needed = docs.sparkSession, needs_wide(tokenizer_json, end_id)
    if wide is False and needed:
        raise ValueError("the vocabulary has ids of over 16 bits")
    wide = needed if wide is None else wide
    js = spark.sparkContext.broadcast(tokenizer_json)
    d = with_text(docs)
    cuts = d.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)] or [0.5], 10_000).alias("q")).first().q or []
    bounds = np.array(cuts if shards > 1 else [], np.int64)
    deal = np.array(_deal_keys(spark, shards), np.int32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = word_encoder(js.value), 0
        for batch in batches:
            keys = column(batch, "doc_id")
            turn = mix(np.arange(seen, seen + batch.num_rows, dtype=np.uint64)).astype(np.float64) / 2**64.001
            shard, seen = shard_of(keys.fill_null(np.iinfo(np.int64).min).to_numpy(), bounds, turn), seen + batch.num_rows
            for x, y, texts in text_groups(batch, BATCH_CHARS):
                ids = [np.append(i, end_id).astype("<u4" if wide else "<u2").tobytes() for i in enc.encode(texts)]
                yield pa.RecordBatch.from_arrays([keys[x:y], pa.array(shard[x:y].astype(np.int32)), pa.array(deal[shard[x:y]]), pa.array(ids, pa.binary())], ["doc_id", "shard", "deal", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = None, None
        for batch in batches:
            starts, counts, shard_of = [], [], column(batch, "shard").to_pylist()
            for shard, blob in zip(shard_of, column(batch, "ids"), strict=True):
                if shard != now:
                    if out:
                        out.close()
                    out, now = ShardWriter(f"{folder}/{shard:06d}.arrows", seq_len, wide=wide), shard
                ids = np.frombuffer(blob.as_buffer(), "<u4" if wide else "<u2")
                starts.append(out.total)
                counts.append(len(ids))
                out.add(ids)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "shard"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "shard", "start", "n_tokens"])
        if out:
            out.close()

    encoded = d.mapInArrow(encode, "doc_id long, shard int, deal int, ids binary")
    return encoded.repartition(shards, "deal").sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(write, "doc_id long, shard int, start long, n_tokens long")


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""
    spark = index.sparkSession
    totals = sorted((r.shard, r.n) for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())  # a row a file
    before = dict(zip((s for s, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: OrderedDict[int, ShardReader] = OrderedDict()
        for batch in batches:
            starts, crcs = [], []
            for shard, at, n in zip(*(column(batch, c).to_pylist() for c in ("shard", "start", "n_tokens")), strict=True):
                if shard not in opened:
                    if len(opened) > 1:
                        opened.popitem(last=False)
                    opened[shard] = ShardReader(f"{folder}/{shard:06d}.arrows")
                starts.append(before[shard] + at)
                crcs.append(zlib.crc32(opened[shard].ids(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(starts, pa.int64()), column(batch, "n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_json: str, shards: int | None = None, **how) -> tuple[DataFrame, str]:
    """Writes the files under the shared folder; what reading them back gives, and where they are."""
    scratch = Scratch(spark, "token-files")
    if shards is None:  # as many tasks as a shuffle has, or more where files would be large
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if docs.inputFiles() else 0
        shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    folder = f"{scratch.root}/files"
    folder = folder if "://" in folder else f"file://{folder}"
    index = scratch.put(write_token_files(docs, tokenizer_json, folder, shards, **how), "index")
    return read_token_files(index, folder), folder
