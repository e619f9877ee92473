"""Vectorised views of text columns: every document of an Arrow batch is one slice of a byte buffer.

Nothing here loops over rows or words in Python; the work is NumPy over slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U64(32))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each document; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, b"" if wide == pa.large_binary() else "")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Re-cut batches so that each holds about ``limit`` bytes of text; a longer document stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(lo), int(hi - lo))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes that separate words, [\x20\x09-\x0D]; word bytes of the lower-cased alphanumeric class.
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
SPACE_FREE = ~SPACE
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


@dataclass
class Words:
    """Word spans of a batch: byte start and end of each word, and for each document the index of its first word."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray


def find_words(data: np.ndarray, doc: np.ndarray, member: np.ndarray) -> Words:
    """Maximal runs of ``member`` bytes that do not cross documents."""
    inside = member[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cut = doc[(doc > 0) & (doc < len(data))]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cut - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, doc, start, end, np.searchsorted(start, doc))


_POWER = [np.ones(1, U64), np.ones(1, U64)]
_BASE, _INVERSE = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWER[0]) < n:
        size = 1 << (n - 1).bit_length()
        for at, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, U64)
            table[0] = 1
            _POWER[at] = np.multiply.accumulate(table)
    return _POWER


def word_hashes(words: Words, block: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each word's bytes: polynomial prefix sums modulo 2**64, then a finaliser."""
    out = np.empty(len(words.start), U64)
    at = 0
    while at < len(out):
        lo = words.start[at]
        to = max(at + 1, int(np.searchsorted(words.start, lo + block)))
        s, e = words.start[at:to] - lo, words.end[at:to] - lo
        n = int(e[-1])
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum((words.data[lo : lo + n].astype(U64) + U64(1)) * power[:n], out=total[1:])
        out[at:to] = (total[e] - total[s]) * inverse[s] + (e - s).astype(U64)
        at = to
    return mix(out)


def gram_hashes(value: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of ``value[i:i+size]`` for every i, by doubling; the last step may overlap."""
    if len(value) < size:
        return np.zeros(0, U64)
    have, h = 1, value if not seed else mix(value ^ U64(seed))
    while have < size:
        step = min(have, size - have)
        h = mix(h[: len(h) - step] * U64(0xA24BAED4963EE407) + h[step:])
        have += step
    return h


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    return key


def join_words(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: bytes and document offsets."""
    n = len(words.data)
    edge = np.zeros(n + 1, np.int8)
    start, end = words.start[keep], words.end[keep]
    edge[start] = 1
    edge[end] -= 1
    inside = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
    owner = np.searchsorted(words.doc, start, side="right")
    gap = end[:-1][owner[1:] == owner[:-1]] if len(end) > 1 else end[:0]
    data = words.data.copy()
    inside[gap] = True
    data[gap] = 32
    total = np.concatenate([[0], np.cumsum(inside)])
    return data[inside], total[words.doc]


def binary_array(data: np.ndarray, off: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    kind = kind or pa.binary()
    off = np.ascontiguousarray(off, dtype=np.int32)
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
