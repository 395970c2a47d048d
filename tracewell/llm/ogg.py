"""Media columns: whole texts as 8-bit samples in Ogg files, written and read back.

The format is that of RFC 3533. A payload becomes one multiplexed file of `TRACKS` logical streams, each
with an identification packet on a page of its own and then packets of `PACKET` samples; the streams take
turns, a packet each. The reader trusts nothing: it verifies every page checksum, puts packets together from
lacing values over page borders, tells streams apart by serial number, checks page order, and derives each
packet's time from granule positions (samples of the stream up to the end of the page).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import column, groups, text_groups, with_text

UNIT, TRACKS, PACKET, RATE = 64, 2, 4096, 8000
#: Pages are closed at the packet that brings them to so many bytes; a page holds 255 segments at most.
PAGE_BYTES = 32_768
MAGIC = b"\x7fSAMPLE8"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
BATCH_CHARS = 2_000_000
_HEAD = struct.Struct("<4sBBqIIIB")
_ID = struct.Struct("<8sBBIIQ")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def page_crc(page: bytes) -> int:
    """CRC-32 with the polynomial 0x04C11DB7, most significant bit first, no inversions: zlib's CRC of mirrored bytes, mirrored."""
    x = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_MIRROR), "big")


def padded(data: bytes) -> bytes:
    return data + bytes(UNIT * max(1, -(-len(data) // UNIT)) - len(data))


class _Stream:
    """Writes the pages of one logical stream."""

    def __init__(self, out: list[bytes], serial: int):
        self.out, self.serial, self.seq = out, serial, 0

    def page(self, laces: bytes, body: bytes, granule: int, flags: int) -> None:
        head = _HEAD.pack(b"OggS", 0, flags, granule, self.serial, self.seq, 0, len(laces)) + laces
        crc = page_crc(head + body)
        self.out.append(head[:22] + crc.to_bytes(4, "little") + head[26:] + body)
        self.seq += 1


def write_ogg(payload: bytes, tracks: int = TRACKS, packet: int = PACKET, rate: int = RATE, page_bytes: int = PAGE_BYTES) -> bytes:
    """The payload as an Ogg file; the same bytes for the same payload. Sample blocks of `packet` go to the tracks in turn."""
    out: list[bytes] = []
    base = zlib.crc32(payload)
    streams = [_Stream(out, (base + k * 0x9E3779B1) & 0xFFFFFFFF) for k in range(tracks)]
    blocks = [payload[x : x + packet] for x in range(0, len(payload), packet)]
    mine = [blocks[k::tracks] for k in range(tracks)]
    for k, s in enumerate(streams):
        ident = _ID.pack(MAGIC, k, tracks, rate, packet, sum(map(len, mine[k])))
        s.page(bytes([len(ident)]), ident, 0, FIRST | (0 if mine[k] else LAST))
    state = [{"laces": bytearray(), "body": bytearray(), "done": 0, "granule": NO_GRANULE, "flags": 0} for _ in streams]

    def flush(k: int, flags: int) -> None:
        st = state[k]
        streams[k].page(bytes(st["laces"]), bytes(st["body"]), st["granule"], st["flags"] | flags)
        st.update(laces=bytearray(), body=bytearray(), granule=NO_GRANULE, flags=0)

    for turn in range(max(map(len, mine), default=0)):
        for k, own in enumerate(mine):
            if turn >= len(own):
                continue
            st, block = state[k], own[turn]
            laces = b"\xff" * (len(block) // 255) + bytes([len(block) % 255])
            at = 0
            while laces:
                room = 255 - len(st["laces"])
                now, laces = laces[:room], laces[room:]
                st["laces"] += now
                st["body"] += block[at : (at := at + sum(now))]
                if laces:  # the packet goes on over the page's end
                    flush(k, 0)
                    st["flags"] = CONTINUED
            st["done"] += len(block)
            st["granule"] = st["done"]
            if turn == len(own) - 1:
                flush(k, LAST)
            elif len(st["laces"]) == 255 or len(st["body"]) >= page_bytes:
                flush(k, 0)
    return b"".join(out)


@dataclass
class Track:
    """What the reader found of one logical stream: packets of samples, and of each the seconds at which it starts and ends."""

    serial: int
    number: int = -1
    rate: int = 0
    declared: int = 0
    pages: int = 0
    granule: int = 0
    ended: bool = False
    partial: bytearray | None = None
    packets: list[bytes] = field(default_factory=list)
    times: list[tuple[float, float]] = field(default_factory=list)


def read_ogg(data: bytes) -> list[Track]:
    """The streams of a file by track number. Raises OggError on a wrong checksum, lost page, broken packet or length that disagrees with the granule positions."""
    tracks: dict[int, Track] = {}
    at = 0
    while at < len(data):
        if len(data) - at < _HEAD.size or data[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, seq, crc, n = _HEAD.unpack_from(data, at)
        laces = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(laces)
        page = data[at : at + size]
        if version or len(page) < size:
            raise OggError(f"the page at byte {at} is cut or of another version")
        if page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        t = tracks.get(serial)
        if (t is None) != bool(flags & FIRST):
            raise OggError(f"stream {serial} begins wrongly")
        if t is None:
            t = tracks[serial] = Track(serial)
        if seq != t.pages or t.ended or (t.partial is not None) != bool(flags & CONTINUED):
            raise OggError(f"stream {serial} lost a page before {seq}")
        t.pages, t.ended = seq + 1, bool(flags & LAST)
        body, done, whole = 27 + n, 0, []
        part = t.partial or bytearray()
        for lace in laces:
            part += page[body : body + lace]
            body += lace
            if lace < 255:
                whole.append(bytes(part))
                part, done = bytearray(), done + 1
        t.partial = part if laces and laces[-1] == 255 else None
        if (granule == NO_GRANULE) != (not whole):
            raise OggError(f"stream {serial}: a granule position without a packet's end, or the reverse")
        if flags & FIRST:
            magic, t.number, _, t.rate, _, t.declared = _ID.unpack(whole.pop(0))
            if magic != MAGIC:
                raise OggError(f"stream {serial} is of another kind")
        if whole:
            start = granule - sum(map(len, whole))  # from the page's end back to each packet
            if start != t.granule:
                raise OggError(f"stream {serial}: granule position {granule} disagrees with the samples")
            for p in whole:
                t.packets.append(p)
                t.times.append((start / t.rate, (start + len(p)) / t.rate))
                start += len(p)
            t.granule = granule
        at += size
    for t in tracks.values():
        if not t.ended or t.partial is not None or t.granule != t.declared:
            raise OggError(f"stream {t.serial} isn't whole")
    return sorted(tracks.values(), key=lambda t: t.number)


def payload_of(tracks: list[Track]) -> bytes:
    """The tracks' packets in turn."""
    return b"".join(t.packets[k] for k in range(max((len(t.packets) for t in tracks), default=0)) for t in tracks if k < len(t.packets))


def feature_of(tracks: list[Track], samples: np.ndarray) -> str:
    """Streams, pages, packets, seconds of the longest stream, and mean and root mean square of the samples about 128."""
    x = samples.astype(np.float64) - 128
    return f"streams={len(tracks)};pages={sum(t.pages for t in tracks)};packets={sum(len(t.packets) for t in tracks)};seconds={max((t.times[-1][1] for t in tracks if t.times), default=0.0):.6f};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f}"


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id and media (the Ogg file) of each row's text. A null text counts as empty, which is stored as 64 zero samples; other columns are ignored; repeated rows and null ids give a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, texts in text_groups(batch, BATCH_CHARS):
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")[x:y], pa.array([write_ogg(padded(t.encode())) for t in texts], pa.binary()), pa.array([len(t.encode()) for t in texts], pa.int64())], ["doc_id", "media", "n_bytes"])

    return with_text(docs).mapInArrow(run, "doc_id long, media binary, n_bytes long")


FEATURES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(keys: pa.Array, sizes: pa.Array, blobs: list[bytes]) -> pa.RecordBatch:
    rows = []
    for blob in blobs:
        tracks = read_ogg(blob)
        data = payload_of(tracks)
        rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(blob), hashlib.sha256(blob).hexdigest(), feature_of(tracks, np.frombuffer(data, np.uint8))))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([keys, sizes, *(pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True))], FEATURES)


def media_features(media: DataFrame) -> DataFrame:
    """What reading a media column back gives: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 samples), media_bytes, media_sha256, feature. A broken file is an error, not a row less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, blobs = (column(batch, c) for c in ("doc_id", "n_bytes", "media"))
            for x, y in groups(pc.fill_null(pc.binary_length(blobs), 0).to_pylist(), BATCH_CHARS):
                yield _features(keys[x:y], sizes[x:y], blobs[x:y].to_pylist())

    return media.mapInArrow(run, FEATURE_SCHEMA)


def stored_features(docs: DataFrame) -> DataFrame:
    """media_features(media_column(docs)) in one task: each file is written, and its bytes read back, without a second passage between Spark and Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, texts in text_groups(batch, BATCH_CHARS):
                data = [t.encode() for t in texts]
                yield _features(column(batch, "doc_id")[x:y], pa.array(list(map(len, data)), pa.int64()), [write_ogg(padded(d)) for d in data])

    return with_text(docs).mapInArrow(run, FEATURE_SCHEMA)
