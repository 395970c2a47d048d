"""Byte-level BPE over whole texts by tree concatenation.

A text longer than a leaf is halved until each part is at most a leaf; the leaves are encoded together (the
library encodes a batch in parallel) and joined up the tree. A join re-encodes a window around the seam and
grows it until both sides agree exactly:

* between pre-tokens: the window starts at a pre-token boundary well before the seam and must meet a boundary
  of the right part well before its own end. The pre-token pattern looks at most three characters ahead and
  never back, so from two agreeing boundaries on both encodings are the same;
* inside one pre-token that spans the seam: a sequence of BPE tokens is the encoding of its text exactly if
  each pair of neighbours is, so it is enough that the window's first and last tokens equal those of the sides.

A window that has grown over both parts is itself the encoding. Strings of special tokens are cut out first,
as the library does.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, text_groups, with_text

#: Characters of a leaf; bytes that a boundary keeps from an edge, over the pattern's look-ahead; pre-tokens of more tokens are joined inside.
LEAF_CHARS, MARGIN, LONG_PIECE = 32_768, 16, 256
BATCH_CHARS = 1_000_000
#: Fixed value: the pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a short text may hold so that both libraries surely split it alike: ASCII and Latin letters and marks.
PLAIN = re.compile(r"[^\t\n\r -~\xa0-ɏ]")


def tokenizer_text(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means: printable Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Part(NamedTuple):
    """Token ids, where each token ends in the segment's bytes, and whether a pre-token ends there."""

    ids: np.ndarray
    ends: np.ndarray
    last: np.ndarray


def check_kind(spec: dict) -> None:
    """Raises for a tokenizer that is not a plain byte-level BPE: the joins rest on its pre-token pattern, the quick library on ids that rank its merges."""
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"] and not spec["post_processor"]
    if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("not a plain byte-level BPE tokenizer")
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if any(b <= a for a, b in zip([255, *made], made, strict=False)) or len(made) + 256 < len(model["vocab"]) - len(spec["added_tokens"]):
        raise ValueError("the ids of the tokens are not the ranks of their merges")


class TreeEncoder:
    """Raises ValueError for tokenizers that the method does not hold for; see check_kind()."""

    def __init__(self, tokenizer_json: str, leaf_chars: int = LEAF_CHARS, window: int = 64):
        import tiktoken
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_str(tokenizer_json)
        self.tk.no_truncation()
        self.tk.no_padding()
        self.leaf, self.window = leaf_chars, window
        spec, byte = json.loads(tokenizer_json), _byte_of()
        check_kind(spec)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.width = np.zeros(max([*vocab.values(), *special.values()]) + 1, np.int64)
        for token, k in vocab.items():
            self.width[k] = len(token.encode()) if token in special else sum(c in byte for c in token)
        for token, k in special.items():
            self.width[k] = len(token.encode())
        self.special = special
        # the same vocabulary in a library that is some times as fast on short texts: its ids are the ranks of its merges
        ranks = {bytes(byte[c] for c in token): k for token, k in vocab.items() if token not in special}
        self.quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.reencoded = 0

    # -- one stretch of text

    def _part(self, encoding, start: int) -> Part:
        ids = np.array(encoding.ids, np.int64)
        words = np.array(encoding.word_ids, np.int64)
        return Part(ids, start + np.cumsum(self.width[ids]), np.append(words[1:] != words[:-1], True) if len(ids) else np.zeros(0, bool))

    def _encode(self, data: bytes, start: int, end: int) -> Part:
        self.reencoded += end - start
        return self._part(self.tk.encode(data[start:end].decode(), add_special_tokens=False), start)

    @staticmethod
    def _starts_character(data: bytes, at: int) -> bool:
        return at >= len(data) or data[at] & 0xC0 != 0x80

    def _inside(self, data: bytes, start: int, seam: int, end: int, a: Part, b: Part) -> Part | None:
        """The join inside one long pre-token that spans the seam; None if there is no such pre-token."""
        inner = np.flatnonzero(a.last[:-1])
        first = int(inner[-1]) + 1 if len(inner) else 0  # of the last pre-token on the left
        stop = int(np.flatnonzero(b.last)[0]) + 1  # of the first one on the right
        lo, hi = int(a.ends[first - 1]) if first else start, int(b.ends[stop - 1])
        if first and lo > seam - MARGIN or not (hi == end or hi + MARGIN <= end) or not (self._starts_character(data, lo) and self._starts_character(data, hi)):
            return None
        far = min(end, hi + 4 * MARGIN)
        while not self._starts_character(data, far):
            far -= 1
        pieces = self.tk.pre_tokenizer.pre_tokenize_str(data[lo:far].decode())
        if pieces[0][1][1] != len(data[lo:hi].decode()):
            return None
        k = 8
        while True:
            i, j = max(first, len(a.ids) - k), min(stop, k)
            while i > first and not self._starts_character(data, int(a.ends[i - 1])):
                i -= 1
            while j < stop and not self._starts_character(data, int(b.ends[j - 1])):
                j += 1
            w = self._encode(data, int(a.ends[i - 1]) if i else start, int(b.ends[j - 1]))
            one = w.last.sum() == 1
            if one and (i == first or w.ids[0] == a.ids[i]) and (j == stop or w.ids[-1] == b.ids[j - 1]):
                return Part(np.concatenate((a.ids[:i], w.ids, b.ids[j:])), np.concatenate((a.ends[:i], w.ends, b.ends[j:])), np.concatenate((a.last[:i], w.last[:-1], [j == stop], b.last[j:])))
            if i == first and j == stop:
                return None
            k *= 4

    def _join(self, data: bytes, start: int, seam: int, end: int, a: Part, b: Part) -> Part:
        if not len(a.ids) or not len(b.ids):
            return b if len(b.ids) else a
        tail = len(a.ids) - (int(np.flatnonzero(a.last[:-1])[-1]) + 1 if a.last[:-1].any() else 0)
        if max(tail, int(np.flatnonzero(b.last)[0])) > LONG_PIECE and (done := self._inside(data, start, seam, end, a, b)):
            return done
        k = self.window
        while True:
            fit = np.flatnonzero(a.last[:-1] & (a.ends[:-1] <= seam - MARGIN))
            fit = fit[fit < len(a.ids) - k]
            i = int(fit[-1]) + 1 if len(fit) else 0
            more = np.flatnonzero(b.last[k:]) if k < len(b.ids) else []
            j = k + int(more[0]) + 1 if len(more) else len(b.ids)
            w = self._encode(data, int(a.ends[i - 1]) if i else start, int(b.ends[j - 1]))
            if j == len(b.ids):
                return Part(*(np.concatenate((x[:i], y)) for x, y in zip(a, w, strict=True)))
            own = b.ends[b.last]
            meet = np.flatnonzero(w.last & (w.ends > seam) & (w.ends <= w.ends[-1] - MARGIN) & np.isin(w.ends, own))
            if len(meet):
                m = int(meet[0]) + 1
                j = int(np.searchsorted(b.ends, w.ends[m - 1])) + 1
                return Part(*(np.concatenate((x[:i], y[:m], z[j:])) for x, y, z in zip(a, w, b, strict=True)))
            k *= 4

    def _tree(self, text: str) -> np.ndarray:
        """Ids of a long text without special tokens."""
        cuts = [0, len(text)]
        while max(np.diff(cuts)) > self.leaf:
            cuts = sorted({*cuts, *((x + y) // 2 for x, y in zip(cuts, cuts[1:], strict=False))})
        leaves = [text[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        data = text.encode()
        edges = [0, *np.cumsum([len(x.encode()) for x in leaves]).tolist()]
        parts = [self._part(e, s) for e, s in zip(self.tk.encode_batch(leaves, add_special_tokens=False), edges, strict=False)]
        spans = list(zip(edges, edges[1:], strict=False))
        while len(parts) > 1:
            joined, wider = [], []
            for k in range(0, len(parts) - 1, 2):
                joined.append(self._join(data, spans[k][0], spans[k][1], spans[k + 1][1], parts[k], parts[k + 1]))
                wider.append((spans[k][0], spans[k + 1][1]))
            if len(parts) % 2:
                joined.append(parts[-1])
                wider.append(spans[-1])
            parts, spans = joined, wider
        return parts[0].ids

    # -- many texts

    def long_ids(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            elif len(piece) > self.leaf:
                out += self._tree(piece).tolist()
            elif piece:
                out += self.tk.encode(piece, add_special_tokens=False).ids
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        found, rest = {}, []
        for k, t in enumerate(texts):
            if len(t) <= self.leaf:
                if PLAIN.search(t) or self.cut and self.cut.search(t):
                    rest.append(k)
                else:
                    found[k] = self.quick.encode_ordinary(t)
        found |= zip(rest, (e.ids for e in self.tk.encode_batch([texts[k] for k in rest], add_special_tokens=False)), strict=True)
        return [found[k] if k in found else self.long_ids(t) for k, t in enumerate(texts)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tk.decode_batch(ids, skip_special_tokens=False)


_encoders: dict[tuple[str, int], TreeEncoder] = {}


def encoder(tokenizer_json: str, leaf_chars: int = LEAF_CHARS) -> TreeEncoder:
    """One a process, since its vocabulary takes a while to read."""
    key = tokenizer_json, leaf_chars
    if key not in _encoders:
        _encoders[key] = TreeEncoder(tokenizer_json, leaf_chars)
    return _encoders[key]


def encode_documents(docs: DataFrame, tokenizer_json: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, text, ids, decoded for each row. A null text counts as empty; an empty one has no ids; repeated rows and null ids give a row each; other columns are ignored."""
    js = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(js.value, leaf_chars)
        for batch in batches:
            keys = column(batch, "doc_id")
            for x, y, texts in text_groups(batch, BATCH_CHARS):
                ids = tree.encode(texts)
                yield pa.RecordBatch.from_arrays([keys[x:y], pa.array(texts), pa.array(ids, pa.list_(pa.int32())), pa.array(tree.decode(ids))], ["doc_id", "text", "ids", "decoded"])

    return with_text(docs).mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, tokenizer_json: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Digests of what encode_documents() gives, made in the same task so that no ids leave Python: doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (of UTF-8)."""
    js = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sha = encoder(js.value, leaf_chars), hashlib.sha256
        for batch in batches:
            keys = column(batch, "doc_id")
            for x, y, texts in text_groups(batch, BATCH_CHARS):
                ids = tree.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [keys[x:y], pa.array(list(map(len, ids)), pa.int64()), pa.array([sha(np.array(i, "<u4").tobytes()).hexdigest() for i in ids]), pa.array([sha(t.encode()).hexdigest() for t in tree.decode(ids)])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return with_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_lengths(docs: DataFrame, tokenizer_json: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id and n_tokens of each row."""
    js = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(js.value, leaf_chars)
        for batch in batches:
            keys = column(batch, "doc_id")
            for x, y, texts in text_groups(batch, BATCH_CHARS):
                yield pa.RecordBatch.from_arrays([keys[x:y], pa.array(list(map(len, tree.encode(texts))), pa.int64())], ["doc_id", "n_tokens"])

    return with_text(docs).mapInArrow(run, "doc_id long, n_tokens long")
