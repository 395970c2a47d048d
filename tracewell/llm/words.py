"""Words of many texts at once as 64-bit hashes, by numpy over UTF-8 bytes.

A word is a run of letters, digits or underscores after lower-casing (characters outside ASCII count as
letters unless Python's ``\\w`` says otherwise). A word's hash takes eight bytes at a time through a mixing
function, all words of a batch at once, so the cost is a pass over words for each eight bytes of the longest; words
over `LONG` bytes are digested one by one. Hashes serve sampling, counting and lookups that are checked; where two
texts must be the same, `word_digests` compares the words themselves.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

OUTSIDE = re.compile(r"[^\w\x00-\x7f]+")
_rng = np.random.Generator(np.random.PCG64(20240229))
_IS_WORD = np.array([chr(b).isalnum() or b == 95 if b < 128 else True for b in range(256)])
SHINGLE, LONG = 5, 128
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_LAST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)  # the first k of eight bytes
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits (the one of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def normal(text: str) -> bytes:
    text = text.lower()
    if not text.isascii():
        text = OUTSIDE.sub(" ", text)
    return text.encode("utf-8", "replace")


def byte_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes, wherever it stands."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    n = end - begin
    out = n.astype(np.uint64) * _STEP
    long = np.flatnonzero(n > LONG)
    for k in long:
        out[k] = int.from_bytes(hashlib.blake2b(data[begin[k] : end[k]], digest_size=8).digest(), "little")
    at, left, live = begin, n, None  # all stretches, then those that go on
    if len(long):
        live = np.flatnonzero(n <= LONG)
        at, left = begin[live], n[live]
    with np.errstate(over="ignore"):
        while len(at):
            x = eight[at] & _LAST[np.minimum(left, 8)]
            if live is None:
                out = mix(out ^ x)
            else:
                out[live] = mix(out[live] * _STEP ^ x)
            on = np.flatnonzero(left > 8)
            live = on if live is None else live[on]
            at, left = at[on] + 8, left[on] - 8
    return out


def _cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the normal texts, begin and end of each word, and each text's first word."""
    parts = [normal(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = _IS_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[::2], edge[1::2]  # the data end with a newline, so every word ends
    return data, begin, end, np.searchsorted(begin, starts)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets): text k has the words offsets[k]:offsets[k + 1]."""
    data, begin, end, at = _cut(texts)
    return byte_hashes(data, begin, end), at


def digested_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """hashed_words(), and a 128-bit digest of each text's words in order, joined by spaces."""
    data, begin, end, at = _cut(texts)
    keep = _IS_WORD[data]
    keep[end] = True  # the mark after each word stands for whatever is between it and the next
    ends = end + 1
    plain = np.where(_IS_WORD[data], data, np.uint8(32))[keep]
    stop = np.concatenate(([0], np.cumsum(ends - begin)))[at]
    digests = [hashlib.blake2b(plain[i:j], digest_size=16).digest() for i, j in zip(stop[:-1], stop[1:], strict=True)]
    return byte_hashes(data, begin, end), at, digests


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash for each run of `size` words; one for the whole text if it has fewer words; none if it has none."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < size:
            return mix(np.array([(words * _PLACE[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], np.uint64))
        n = len(words) - size + 1
        out = words[:n] * _PLACE[0]
        for k in range(1, size):
            out = out + words[k : k + n] * _PLACE[k]
        return mix(out)
