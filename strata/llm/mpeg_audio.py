"""MPEG audio columns: frames with checksums, tags and seek tables written and read in plain Python.

The carrier is MPEG-2 layer III, mono, 16 kHz, 576 samples a frame. Payload bytes travel unchanged as ancillary data of
frames whose side information says that they hold no coded samples, so any decoder plays silence of the right length. The
reader takes any layer, version and bit rate: it skips tags, finds frames by their headers, resynchronises after foreign
bytes, reads Xing, Info and VBRI tables, verifies checksums, and gives durations as exact fractions and an offset for each frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import columnar as c

UNIT = 576
PAD = 255

#: Fixed values of the format: bit rates in kbit/s by (MPEG-1?, layer), sampling rates in Hz by version bits.
BIT_RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    rate: int
    size: int
    samples: int
    side: int


@lru_cache(maxsize=4096)
def parse_header(four: bytes) -> Header | None:
    """What four bytes say, or None if they start no frame of known length."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bits, rate, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    first, hertz = version == 3, RATES[version][rate]
    bit_rate = BIT_RATES[first, layer][bits] * 1000
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * bit_rate // hertz + pad) * 4 if layer == 1 else samples // 8 * bit_rate // hertz + pad
    mono = four[3] >> 6 == 3
    side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return Header(version, layer, not four[1] & 1, hertz, size, samples, side)


@lru_cache(maxsize=65536)
def checksum(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, all ones at the start."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass
class Audio:
    """A parsed stream. frames: offset of each audio frame; bodies: what follows header, checksum and side information."""

    frames: list[int] = field(default_factory=list)
    bodies: list[bytes] = field(default_factory=list)
    duration: Fraction = Fraction(0)
    rate: int = 0
    verified: int = 0
    damaged: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    seek: list[int] = field(default_factory=list)


def _four_sevens(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _read_tag(data: bytes, tags: dict[str, str]) -> int:
    """Text frames of an ID3v2 tag at the start; gives the tag's length."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    wide, end, at = data[3] >= 4, 10 + _four_sevens(data[6:10]), 10
    while at + 10 <= min(end, len(data)) and data[at]:
        size = _four_sevens(data[at + 4 : at + 8]) if wide else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + size]
        if data[at : at + 1] == b"T" and body:
            kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            tags[data[at : at + 4].decode("latin-1")] = body[1:].decode(kind, "replace").rstrip("\0")
        at += 10 + size
    return end + 10 * (data[5] >> 4 & 1)


def _read_table(data: bytes, at: int, head: Header, out: Audio) -> bool:
    """Whether the frame at this offset is a Xing, Info or VBRI table."""
    place = at + 4 + head.side
    for place in (at + 4 + head.side, at + 6 + head.side):
        if data[place : place + 4] in (b"Xing", b"Info"):
            out.table, flags, place = data[place : place + 4].decode(), int.from_bytes(data[place + 4 : place + 8], "big"), place + 8
            if flags & 1:
                out.table_frames, place = int.from_bytes(data[place : place + 4], "big"), place + 4
            if flags & 2:
                out.table_bytes, place = int.from_bytes(data[place : place + 4], "big"), place + 4
            if flags & 4:
                out.seek = list(data[place : place + 100])
            return True
    if data[at + 36 : at + 40] == b"VBRI":
        out.table, out.table_bytes, out.table_frames = "VBRI", int.from_bytes(data[at + 46 : at + 50], "big"), int.from_bytes(data[at + 50 : at + 54], "big")
        count, scale, width = (int.from_bytes(data[at + k : at + k + 2], "big") for k in (54, 56, 58))
        out.seek = [scale * int.from_bytes(data[at + 62 + i * width : at + 62 + (i + 1) * width], "big") for i in range(count)]
        return True
    return False


def read_audio(data: bytes) -> Audio:
    """Parses a whole stream; bytes that belong to no frame are counted as skipped."""
    out = Audio()
    at = min(_read_tag(data, out.tags), len(data))
    end = len(data)
    if end - at >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").rstrip())
    samples: dict[int, int] = {}
    synced = True
    while at + 4 <= end:
        head = parse_header(data[at : at + 4])
        # out of step, a header counts if another follows its frame or the stream ends there
        fits = head is not None and at + head.size <= end and (synced or at + head.size == end or parse_header(data[at + head.size : at + head.size + 4]) is not None)
        if not fits:
            step = data.find(b"\xff", at + 1, end)
            out.skipped += (end if step < 0 else step) - at
            at, synced = (end if step < 0 else step), False
            continue
        synced = True
        skip = 6 if head.protected else 4
        if not out.frames and not out.table and head.layer == 3 and _read_table(data, at, head, out):
            at += head.size
            continue
        if head.protected and head.layer == 3:
            good = checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + head.side]) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.verified += good
            out.damaged += not good
        out.frames.append(at)
        out.bodies.append(data[at + skip + head.side : at + head.size])
        samples[head.rate] = samples.get(head.rate, 0) + head.samples
        out.rate = head.rate
        at += head.size
    out.skipped += end - at
    out.duration = sum((Fraction(n, r) for r, n in samples.items()), Fraction(0))
    return out


#: MPEG-2 layer III, 144 kbit/s, 16 kHz, mono, original; with and without checksum. 648 bytes a frame.
_CARRIER, _PLAIN = b"\xff\xf2\xd8\xc4", b"\xff\xf3\xd8\xc4"
_SIZE, _SIDE = 648, 9


def _tag() -> bytes:
    body = b"\x03strata"
    text = b"TSSE" + len(body).to_bytes(4, "big") + b"\0\0" + body
    return b"ID3\x03\0\0" + bytes([0, 0, len(text) >> 7, len(text) & 127]) + text


def pad_payload(data: bytes) -> bytes:
    return data + bytes([PAD]) * ((UNIT - len(data) % UNIT) % UNIT if data else UNIT)


def write_audio(payload: bytes) -> bytes:
    """A stream that carries the payload, whose length is a multiple of 576, 576 bytes a frame."""
    if len(payload) % UNIT:
        raise ValueError(f"the payload is no multiple of {UNIT} bytes")
    count = len(payload) // UNIT
    total = (count + 1) * _SIZE
    seek = bytes(min(255, 256 * (_SIZE + i * count // 100 * _SIZE) // total) for i in range(100))
    info = _PLAIN + bytes(_SIDE) + b"Info" + (7).to_bytes(4, "big") + count.to_bytes(4, "big") + total.to_bytes(4, "big") + seek
    frames = np.zeros((count, _SIZE), np.uint8)
    start = _CARRIER + checksum(_CARRIER[2:] + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE)
    frames[:, : len(start)] = np.frombuffer(start, np.uint8)
    frames[:, len(start) : len(start) + UNIT] = np.frombuffer(payload, np.uint8).reshape(count, UNIT)
    return _tag() + info.ljust(_SIZE, b"\0") + frames.tobytes()


def read_payload(audio: Audio) -> bytes:
    return b"".join(body[:UNIT] for body in audio.bodies)


def features(audio: Audio, payload: bytes) -> str:
    """Duration in seconds as a fraction, frames, table kind, and mean, deviation and mean step of the bytes as 8-bit samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n = len(x)
    mean = int(x.sum()) / n if n else 0.0
    spread = (int((x * x).sum()) / n - mean * mean) ** 0.5 if n else 0.0
    step = int(np.abs(np.diff(x)).sum()) / max(1, n - 1)
    return f"duration={audio.duration};frames={len(audio.frames)};table={audio.table};mean={mean:.6f};deviation={spread:.6f};step={step:.6f}"


def audio_column(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", with_media: bool = True) -> DataFrame:
    """Stores every whole text as an audio stream and reads it back, row by row; nothing is shuffled.

    Gives doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (all read back from the stream), media_bytes,
    media_sha256, media (if wanted), n_frames, verified (checksums that hold), samples, rate, frame_offsets, feature. Null is
    the empty text, whose payload is one unit of padding. Equal texts give equal streams.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
    fields += [("media", pa.binary())] * with_media + [("n_frames", pa.int64()), ("verified", pa.int64()), ("samples", pa.int64()), ("rate", pa.int64()), ("frame_offsets", pa.list_(pa.int64())), ("feature", pa.string())]
    schema = pa.schema(fields)
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.slices(batches, "_x"):
            rows: list[tuple] = []
            for doc, raw in zip(batch.column("_id").to_pylist(), batch.column("_x").to_pylist(), strict=True):
                media = write_audio(pad_payload(raw))
                audio = read_audio(media)
                payload = read_payload(audio)
                if audio.damaged or audio.skipped or audio.verified != len(audio.frames):
                    raise ValueError("a stream does not read back")
                row = (doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
                rows.append((*row, *[media] * with_media, len(audio.frames), audio.verified, len(audio.frames) * UNIT, audio.rate, audio.frames, features(audio, payload)))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    source = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_x"))
    return source.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))
