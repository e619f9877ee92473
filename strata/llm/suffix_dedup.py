"""Suffix-array dedup with a run-length compressed index.

The index of a set of passages is the Burrows-Wheeler transform of their concatenation cut into runs of equal symbols, with
the text position and the longest common prefix kept only at both ends of each run. In repetitive passages runs are few.
Inside a run neighbouring suffixes are preceded by the same symbol, so the common prefix at a text position is that of the
nearest sampled position before it less the distance. Streaming over the text thus gives every matching statistic: the
longest match that also starts elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from strata.llm.repeats import Unit, remove_repeats


@dataclass
class RunLengthIndex:
    """Runs of the transform (symbol, length) and samples at run heads and run ends (text position, common prefix)."""

    symbol: np.ndarray
    size: np.ndarray
    head: np.ndarray
    head_match: np.ndarray
    end: np.ndarray
    end_match: np.ndarray
    n: int

    @classmethod
    def build(cls, text: np.ndarray) -> RunLengthIndex:
        """text: symbols; separators must be unique symbols."""
        ranks = _prefix_ranks(text)
        n = len(text)
        order = np.empty(n, np.int64)
        order[ranks[-1]] = np.arange(n)
        before = text[order - 1]
        cut = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        stop = np.r_[cut[1:] - 1, n - 1]
        up = _common(ranks, order[cut], order[np.maximum(cut - 1, 0)])
        up[cut == 0] = 0
        down = _common(ranks, order[stop], order[np.minimum(stop + 1, n - 1)])
        down[stop == n - 1] = 0
        return cls(before[cut], stop - cut + 1, order[cut], up, order[stop], down, n)

    def matching_statistics(self) -> np.ndarray:
        """At each text position, the longest match that starts at another one."""
        return np.maximum(_carried(self.head, self.head_match, self.n), _carried(self.end, self.end_match, self.n))


def _carried(place: np.ndarray, match: np.ndarray, n: int) -> np.ndarray:
    source = np.full(n, -1, np.int64)
    value = np.zeros(n, np.int64)
    source[place] = place
    value[place] = match
    source = np.maximum.accumulate(source)
    return np.where(source < 0, 0, np.maximum(value[source] - (np.arange(n) - source), 0))


def _prefix_ranks(text: np.ndarray) -> list[np.ndarray]:
    """Ranks of suffixes by their first 1, 2, 4, ... symbols until all differ."""
    n = len(text)
    bits = np.uint64((max(n, int(text.max(initial=0))) + 1).bit_length())
    rank, out, have = text.astype(np.uint64), [text.astype(np.int32)], 1
    place, one = np.arange(n, dtype=np.uint64), np.uint64(1)
    while True:
        if 3 * bits <= 64:  # one sort of plain values: rank, rank of the second half, place
            key = rank << bits
            key[: n - have] |= rank[have:] + one
            key <<= bits
            key |= place
            key.sort()
            order = (key & ((one << bits) - one)).view(np.int64)
            key >>= bits
        else:
            key = rank * np.uint64(n + int(text.max()) + 2)
            key[: n - have] += rank[have:] + one
            order = np.argsort(key)
            key = key[order]
        step = np.zeros(n, np.uint64)
        np.cumsum(key[1:] != key[:-1], out=step[1:])
        rank = np.empty(n, np.uint64)
        rank[order] = step
        out.append(rank.astype(np.int32))
        have *= 2
        if step[-1] == n - 1:
            return out


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefix of suffixes a and b."""
    n = len(ranks[0])
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n) & (a != b)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        step = same.astype(np.int64) << k
        a, b, out = a + step, b + step, out + step
    return out


class RunLengthMatcher:
    def __init__(self, length: int) -> None:
        self.length = length

    def __call__(self, groups: list[list[bytes]]) -> list[list[np.ndarray]]:
        flat = [x for g in groups for x in g]
        size = np.array([len(x) for x in flat])
        stop = np.cumsum(size + 1) - 1
        text = np.zeros(int(stop[-1]) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[stop] = False
        text[inside] = np.frombuffer(b"".join(flat), np.uint8)
        text[stop] = 256 + np.arange(len(flat))
        long = RunLengthIndex.build(text).matching_statistics() >= self.length
        start = stop - size
        found = iter([np.flatnonzero(long[a:z]) for a, z in zip(start.tolist(), stop.tolist(), strict=True)])
        return [[next(found) for _ in g] for g in groups]


def suffix_dedup(docs: DataFrame, *, length: int = 400, notice: int = 320, doc_id: str = "doc_id", text: str = "text", frequent: int = 1024) -> DataFrame:
    """Removes every byte that a string of ``length`` bytes covers which also starts anywhere else.

    Gives doc_id, n_bytes, n_removed, spans (byte ranges), kept (bytes; a removal may cut inside a character), repeats (whether
    a string of ``notice`` bytes starts elsewhere: passages of 50 words are often shorter than ``length``; they are only marked).
    Null is the empty text; texts shorter than ``length`` stay; rows of equal doc_id and text each get their row; ties do not
    arise, as all places of a repeated string go; an empty table gives an empty result; other columns are ignored.
    """
    gram = 1 << max(0, (length // 4).bit_length() - 1)
    out = remove_repeats(docs, Unit(False, length, gram, notice), RunLengthMatcher(length), doc_id=doc_id, text=text, frequent=frequent, held=1 << 18)
    return out.withColumnRenamed("n_units", "n_bytes")
