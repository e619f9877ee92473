"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Test strings are windows of consecutive item words. For windows of m words, a table of fixed size gives for each hashed
block of two words how far a search may move on: m - 1 where the block is in no window, less where it is, nothing where a
window ends with it. There, a hash of the suffix block selects the windows to compare directly. Stretches of the documents
are searched side by side, so each step of the search is one vectorised move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm import columnar as c

_TABLE = 1 << 20
_STRETCH = 256


class WuManber:
    """Search for windows of one length m, given as rows of word hashes."""

    def __init__(self, windows: np.ndarray) -> None:
        self.windows = windows
        count, self.m = windows.shape
        self.block = min(2, self.m)
        self.shift = np.full(_TABLE, self.m - self.block + 1, np.int64)
        for end in range(self.block, self.m + 1):
            at = self._blocks(windows[:, end - self.block], windows[:, end - 1])
            np.minimum.at(self.shift, self._slot(at), self.m - end)
        suffix = self._blocks(windows[:, self.m - self.block], windows[:, self.m - 1])
        self.bucket_of = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.bucket_of]

    def _blocks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return c.mix(b) if self.block == 1 else c.mix(a * np.uint64(0x9FB21C651E98DF25) + b)

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block & np.uint64(_TABLE - 1)).astype(np.int64)

    def find(self, value: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence; ends: for each word, where its document ends."""
        n, m = len(value), self.m
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        at = np.arange(0, n - m + 1, _STRETCH)
        stop = np.minimum(at + _STRETCH, n - m + 1)
        found = []
        while len(at):
            step = self.shift[self._slot(self._blocks(value[at + m - self.block], value[at + m - 1]))]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return none, none
        first = np.sort(np.concatenate(found))
        first = first[first + m <= ends[first]]
        suffix = self._blocks(value[first + m - self.block], value[first + m - 1])
        lo, hi = (np.searchsorted(self.suffix, suffix, side) for side in ("left", "right"))
        out = []
        for part in range(0, len(first), 1 << 14):
            size = (hi - lo)[part : part + (1 << 14)]
            place = np.repeat(first[part : part + (1 << 14)], size)
            within = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
            window = self.bucket_of[np.repeat(lo[part : part + (1 << 14)], size) + within]
            same = np.ones(len(place), bool)
            for k in range(m):
                left = np.flatnonzero(same)
                same[left] = value[place[left] + k] == self.windows[window[left], k]
            out.append((place[same], window[same]))
        return np.concatenate([x for x, _ in out] or [none]), np.concatenate([x for _, x in out] or [none])


class Patterns:
    """All windows of a set of items, by length, with the items of each window."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int) -> None:
        text = pa.array([t or b"" for _, t in items], pa.binary())
        words, value = _words(text)
        by_size: dict[int, dict[bytes, set]] = {}
        for row, (item, _) in enumerate(items):
            mine = value[words.off[row] : words.off[row + 1]]
            size = min(window, len(mine))
            for at in range(len(mine) - size + 1 if size else 0):
                by_size.setdefault(size, {}).setdefault(mine[at : at + size].tobytes(), set()).add(item)
        self.parts = [(WuManber(np.frombuffer(b"".join(w), np.uint64).reshape(len(w), size)), [sorted(x, key=lambda i: (i is None, i)) for x in w.values()]) for size, w in sorted(by_size.items())]


def _words(column: pa.Array) -> tuple[c.Words, np.ndarray]:
    data, doc = c.text_buffer(column)
    words = c.find_words(c.lower_ascii(data), doc, c.ALNUM)
    return words, c.word_hashes(words)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value.parts
        for batch in c.slices(batches, "_x"):
            words, value = _words(batch.column("_x"))
            ends = np.repeat(words.off[1:], np.diff(words.off))
            edge = np.zeros(len(value) + 1, np.int64)
            items: list[set] = [set() for _ in range(batch.num_rows)]
            for searcher, owners in parts:
                first, window = searcher.find(value, ends)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + searcher.m, -1)
                for row, w in zip((np.searchsorted(words.off, first, side="right") - 1).tolist(), window.tolist(), strict=True):
                    items[row].update(owners[w])
            hit = np.cumsum(edge[:-1]) > 0
            spans: list[list] = [[] for _ in items]
            for row in np.unique(np.searchsorted(words.off, np.flatnonzero(hit), side="right") - 1).tolist():
                mine = np.diff(np.r_[0, hit[words.off[row] : words.off[row + 1]].astype(np.int8), 0])
                spans[row] = [{"start": a, "end": z} for a, z in zip(np.flatnonzero(mine == 1).tolist(), np.flatnonzero(mine == -1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_t"), pa.array(np.diff(words.off)), pa.array(spans, _SPAN), pa.array([sorted(x, key=lambda i: (i is None, i)) for x in items], pa.list_(pa.int64()))], schema=schema)

    return run


def contaminated_words(docs: DataFrame, items: DataFrame, *, window: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, spans (hit word ranges), items (ids of items with a window in the document), a row for each row.

    Words are runs of 0-9, a-z and bytes over 127 after A-Z are lower-cased; null has none. An item of fewer words than a
    window is one window; one without words is never found. Items are broadcast at most ``most_bytes`` at a time: more are
    searched in blocks, each against all documents, and the blocks' results are merged.
    """
    spark = docs.sparkSession
    tests = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).cast("binary").alias("words"))
    size = tests.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = -(-size // most_bytes) or 1
    schema = pa.schema([("doc_id", pa.int64()), ("_t", pa.int64()), ("n_words", pa.int64()), ("spans", _SPAN), ("items", pa.list_(pa.int64()))])
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_x")).withColumn("_t", F.xxhash64("_x"))
    out = None
    for block in range(blocks):
        mine = tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(Patterns([(r.item, bytes(r.words) if r.words is not None else None) for r in mine.toLocalIterator()], window))
        found = rows.mapInArrow(_search(shared, schema), "doc_id long, _t long, n_words long, spans array<struct<start:long,end:long>>, items array<long>")
        out = found.withColumn("_b", F.lit(block)) if out is None else out.unionByName(found.withColumn("_b", F.lit(block)))
    if blocks > 1:
        copies = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))
        out = out.groupBy("doc_id", "_t", "n_words").agg(F.count_if(F.col("_b") == 0).alias("_copies"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")).withColumn("_copy", copies)
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(x["end"] - F.greatest(s["end"], x["start"]), F.lit(0).cast("long"))).alias("n")),
        lambda s: s["n"],
    )
    return out.select("doc_id", "n_words", covered.alias("n_hit"), "spans", "items")


def is_contaminated() -> Column:
    """At least one hit, and a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
