"""Passages that start at more than one place of a corpus: the plan that substring and suffix-array removal share.

A window is ``length`` consecutive tokens of one document. The plan never compares documents pairwise:

1. Every window names one of its token grams (the smallest by hash), so equal windows name equal grams. Only
   (gram, document, first window, windows) rows are written once, counted with partial sums, and joined to the counts of
   grams seen twice. Grams of more than 1/4096 of all counted rows, at most 4096 of them, are joined by broadcast, so
   no task of the join gets a frequent gram's rows.
2. Windows of the remaining grams are cut out of the texts, with whole-text copies standing in once, and dealt by gram.
   A group holds at most ``frequent`` of them. A matcher (suffix automaton, run-length index) tells which windows of a
   group occur twice.
3. Windows of more frequent grams are resolved inside each batch and then by their own hash: one row announces a
   window, one asks, so no task ever holds a frequent gram's documents.
4. Found windows return to their documents as spans. Texts are shuffled once; both joins read the same exchange.

Nulls are empty texts. Rows that share doc_id and text are copies of each other and each gets a result. Other columns
are ignored. Every decision is about the input, so removing one copy does not save another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import columnar as c
from strata.llm.storage import bound_batches, cut, stored

#: rows of one group: (document key, first window, windows, content); gives spans (row, first window, windows).
Matcher = Callable[[list[list[bytes]]], list[list[np.ndarray]]]

_POSITION = np.uint64((1 << 22) - 1)
_SLICE = 1 << 19
_BYTE_VALUE = c.mix(np.arange(1, 257, dtype=np.uint64))


@dataclass(frozen=True)
class Unit:
    """What a token is: words joined by one space, or bytes."""

    words: bool
    length: int
    gram: int
    #: passages of this many tokens are noticed, though not removed; 0: none
    notice: int = 0

    def view(self, column: pa.Array) -> Tokens:
        data, doc = c.text_buffer(column)
        if not self.words:
            return Tokens(data, doc, None, None, doc, _BYTE_VALUE[data])
        found = c.find_words(data, doc, c.SPACE_FREE)
        value = c.word_hashes(found)
        data, doc = c.join_words(found, np.ones(len(found.start), bool))
        size = found.end - found.start
        total = np.concatenate([[0], np.cumsum(size + 1)])
        first = np.zeros(len(size), np.int64)
        first[found.off[:-1][np.diff(found.off) > 0]] = 1
        # a document's words take its joined bytes, with a separator before all but its first
        start = total[:-1] - (np.cumsum(first) - 1)
        return Tokens(data, doc, start, start + size, found.off, value)


@dataclass
class Tokens:
    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray | None
    end: np.ndarray | None
    off: np.ndarray
    value: np.ndarray

    def content(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of token ranges, ends included."""
        return (first, last + 1) if self.start is None else (self.start[first], self.end[last])


def named_grams(tokens: Tokens, unit: Unit) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gram, first window, windows) for each stretch of windows that name the same gram; first window as token index of the batch."""
    n, length = len(tokens.value), unit.length
    ends = np.repeat(tokens.off[1:], np.diff(tokens.off))
    width = length - unit.gram + 1
    for lo in range(0, max(0, n - length + 1), _SLICE):
        hi = min(n, lo + _SLICE + length - 1)
        gram = c.gram_hashes(tokens.value[lo:hi], unit.gram)
        at = np.arange(len(gram), dtype=np.uint64)
        place = (c.sliding_min((gram & ~_POSITION) | at, width) & _POSITION).astype(np.int64)
        window = np.flatnonzero(np.arange(lo, lo + len(place)) + length <= ends[lo : lo + len(place)])
        if not len(window):
            continue
        place = place[window]
        cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)])
        yield gram[place[cut]], window[cut] + lo, np.diff(np.r_[cut, len(window)])


def _fingerprints(unit: Unit, schema: pa.Schema):
    """Rows of named grams, and with _where -1 those of the grams by which shorter passages are noticed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.slices(batches, "_x"):
            tokens = unit.view(batch.column("_x"))
            key, salt = (batch.column(k) for k in ("_id", "_t"))
            for other in [unit, *([Unit(unit.words, unit.notice, unit.notice // 2)] if unit.notice else [])]:
                for gram, first, count in named_grams(tokens, other):
                    row = np.searchsorted(tokens.off, first, side="right") - 1
                    where = ((first - tokens.off[row]) << 22) | count if other is unit else np.full(len(row), -1)
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), key.take(row), salt.take(row), pa.array(where)], schema=schema)

    return run


def _merge(spans: np.ndarray) -> np.ndarray:
    """Union of [start, end) rows."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[head, 0], reach[np.r_[head[1:] - 1, len(spans) - 1]]], axis=1)


def _pieces(unit: Unit, frequent: int, deals: int, schema: pa.Schema):
    """Cuts windows out of texts. kind 0: content for a matcher; 1: hashes of a frequent gram's windows; 2: spans already known."""
    length = unit.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.slices(batches, "_x"):
            tokens = unit.view(batch.column("_x"))
            body = memoryview(np.ascontiguousarray(tokens.data)).cast("B") if len(tokens.data) else b""
            out: list[tuple] = []
            far: list[np.ndarray] = []
            ids, salts, spare = (batch.column(k).to_pylist() for k in ("_id", "_t", "_spare"))
            for row, packed in enumerate(batch.column("_runs").to_pylist()):
                if not packed or spare[row]:
                    continue
                base, most = int(tokens.off[row]), int(tokens.off[row + 1])
                runs = np.array([(r["_where"], r["_gram"], r["_n"]) for r in packed], dtype=np.int64).reshape(-1, 3)
                first, count = (runs[:, 0] >> 22) + base, runs[:, 0] & int(_POSITION)
                ok = first + count + length - 1 <= most
                first, count, gram, often = first[ok], count[ok], runs[ok, 1], runs[ok, 2] > frequent
                lo, hi = tokens.content(first, first + count + length - 2)
                for f, n, g, o, a, z in zip(first.tolist(), count.tolist(), gram.tolist(), often.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    if o:
                        far.append(np.stack([np.full(n, row), np.arange(f, f + n)], axis=1))
                    else:
                        out.append((0, g, ids[row], salts[row], f - base, n, bytes(body[a:z])))
            if far:
                out += _resolve(np.concatenate(far), tokens, unit, ids, salts, deals)
            for at in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out[at : at + 20_000], strict=True), schema, strict=True)], schema=schema)

    return run


def _resolve(window: np.ndarray, tokens: Tokens, unit: Unit, ids: list, salts: list, deals: int) -> list[tuple]:
    """Windows (row, token index) of frequent grams: those that a batch repeats are settled; each distinct one goes on once, by hash."""
    row, at = window.T
    lo, hi = int(at.min()), int(at.max()) + unit.length
    a, b = (c.gram_hashes(tokens.value[lo:hi], unit.length, seed)[at - lo] for seed in (11, 17))
    order = np.lexsort((b, a))
    a, b, row, at = a[order], b[order], row[order], at[order]
    head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    group = np.cumsum(head) - 1
    many = np.bincount(group)[group] > 1
    out: list[tuple] = []
    for r in np.unique(row[many]).tolist():
        start = at[many & (row == r)] - tokens.off[r]
        spans = _merge(np.stack([start, start + unit.length], axis=1))
        out.append((2, 0, ids[r], salts[r], 0, 0, spans.astype("<i8").tobytes()))
    mine = np.flatnonzero(head)
    deal = (a[mine] % np.uint64(deals)).astype(np.int64)
    order = np.argsort(deal, kind="stable")
    mine, deal = mine[order], deal[order]
    known = np.array([x if x is not None else 0 for x in ids], np.int64)
    null = np.array([x is None for x in ids], bool)
    salt = np.array(salts, np.int64)
    packed = np.stack([a[mine].view(np.int64), b[mine].view(np.int64), known[row[mine]], salt[row[mine]], at[mine] - tokens.off[row[mine]], many[mine].astype(np.int64) | (null[row[mine]].astype(np.int64) << 1)], axis=1)
    for x in np.split(packed, np.flatnonzero(np.diff(deal)) + 1):
        out.append((1, int(x[0, 0].view(np.uint64) % np.uint64(deals)), None, 0, 0, 0, x.astype("<i8").tobytes()))
    return out


def _answer(rows: list[bytes], length: int) -> list[tuple]:
    """Of windows dealt by hash: the askers whose window is known elsewhere."""
    x = np.concatenate([np.frombuffer(r, "<i8").reshape(-1, 6) for r in rows])
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    head = np.r_[True, (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])]
    group = np.cumsum(head) - 1
    found = x[(np.bincount(group)[group] > 1) & (x[:, 5] & 1 == 0)]
    return [(None if f & 2 else int(d), int(t), np.array([[s, s + length]], "<i8").tobytes()) for _, _, d, t, s, f in found.tolist()]


def _match(unit: Unit, matcher: Matcher, limit: int, schema: pa.Schema):
    """Groups arrive sorted by kind and key."""
    length = unit.length

    def settle(groups: list[list[tuple]]) -> list[tuple]:
        """One row for each document of these groups."""
        distinct = [dict.fromkeys(r[3] for r in g) for g in groups]
        hard = [i for i, d in enumerate(distinct) if len(d) > 1]
        times: dict[int, list[np.ndarray]] = dict(zip(hard, matcher([list(distinct[i]) for i in hard]) if hard else [], strict=True))
        out: dict[tuple, list] = {}
        for i, g in enumerate(groups):
            seen = {}
            for r in g:
                seen[r[3]] = seen.get(r[3], 0) + 1
            place = {content: k for k, content in enumerate(distinct[i])}
            for key, first, count, content in g:
                if seen[content] > 1:
                    spans = np.array([[first, first + count + length - 1]], np.int64)
                elif i in times:
                    starts = times[i][place[content]]
                    if not len(starts):
                        continue
                    spans = _merge(np.stack([first + starts, first + starts + length], axis=1))
                else:
                    continue
                out.setdefault(key, []).append(spans)
        return [(*key, _merge(np.concatenate(spans)).astype("<i8").tobytes()) for key, spans in out.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        groups: list[list[tuple]] = []
        last, held = None, 0
        asks: list[bytes] = []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("_kind", "_key", "_id", "_t", "_first", "_count", "_body")]
            ready: list[tuple] = []
            for kind, key, doc, salt, first, count, body in zip(*cols, strict=True):
                if (kind, key) != last:
                    if asks:
                        ready += _answer(asks, length)
                        asks = []
                    if held > limit:
                        ready += settle(groups)
                        groups, held = [], 0
                    last = (kind, key)
                    groups.append([])
                if kind == 0:
                    groups[-1].append(((doc, salt), first, count, body))
                    held += len(body)
                elif kind == 1:
                    asks.append(body)
                else:
                    ready.append((doc, salt, body))
            yield from emit(ready)
        yield from emit((_answer(asks, length) if asks else []) + (settle(groups) if groups else []))

    return run


def _outcome(unit: Unit, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.slices(batches, "_x"):
            data, doc = c.text_buffer(batch.column("_x"))
            words = c.find_words(data, doc, c.SPACE_FREE) if unit.words else None
            off = words.off if words else doc
            edge = np.zeros(int(off[-1]) + 1, np.int32)
            least = unit.notice or unit.length
            seen = np.array([x is not None for x in batch.column("_spans").to_pylist()], bool) | (batch.column("_copied").to_numpy(zero_copy_only=False).astype(bool) & (np.diff(off) >= least))
            for row, (whole, packed) in enumerate(zip(batch.column("_copied").to_pylist(), batch.column("_spans").to_pylist(), strict=True)):
                lo, hi = int(off[row]), int(off[row + 1])
                if whole:
                    spans = np.array([[0, hi - lo]]) if hi - lo >= unit.length else np.zeros((0, 2), np.int64)
                else:
                    spans = _merge(np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in packed])) if packed else np.zeros((0, 2), np.int64)
                edge[lo + spans[:, 0]] += 1
                edge[lo + spans[:, 1]] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            first = off[:-1][np.diff(off) > 0]
            head[first] = gone[first]
            total, heads = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, head))
            tail = gone.copy()
            tail[:-1] &= ~gone[1:]
            last = off[1:][np.diff(off) > 0] - 1
            tail[last] = gone[last]
            if words:
                kept, at = c.join_words(words, ~gone)
            else:
                kept = data[~gone]
                at = np.concatenate([[0], np.cumsum(~gone)])[doc]
            owner = np.searchsorted(off, np.flatnonzero(head), side="right") - 1
            span = pa.StructArray.from_arrays([pa.array(np.flatnonzero(head) - off[owner]), pa.array(np.flatnonzero(tail) + 1 - off[owner])], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(heads[off].astype(np.int32)), span)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(np.diff(off)), pa.array(total[off[1:]] - total[off[:-1]]), spans, c.binary_array(kept, at), pa.array(seen | (total[off[1:]] > total[off[:-1]]))], schema=schema)

    return run


def remove_repeats(docs: DataFrame, unit: Unit, matcher: Matcher, *, doc_id: str = "doc_id", text: str = "text", frequent: int = 1024, held: int = 4 << 20) -> DataFrame:
    """doc_id, n_units, n_removed, spans (removed runs, maximal), kept (bytes), repeats. See the module for the plan.

    repeats: whether anything is removed or, with ``unit.notice``, a passage of that many tokens starts elsewhere, too; then
    none of less than half of them counts, and those between may (they are known by a gram of that size).

    frequent: rows of a gram's group above which its windows are dealt by their own hash. held: bytes of content that a
    matcher gets at once, besides one group.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    deals = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), raw.alias("_x")).withColumn("_t", F.xxhash64("_x"))
    key = [F.coalesce(F.col("_id"), F.lit(-(1 << 62))).alias("_k"), F.col("_t").alias("_s")]

    drawn = rows.mapInArrow(_fingerprints(unit, pa.schema([("_gram", pa.int64()), ("_id", pa.int64()), ("_t", pa.int64()), ("_where", pa.int64())])), "_gram long, _id long, _t long, _where long")
    grams = stored(drawn, "grams")
    often = cut(grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    counted = often.agg(F.sum("_n")).first()[0] or 0
    heavy = F.broadcast(often.filter(F.col("_n") * 4096 > counted))
    rare = grams.join(heavy, "_gram", "left_anti").join(often.filter(F.col("_n") * 4096 <= counted).hint("merge"), "_gram")
    named = rare.unionByName(grams.join(heavy, "_gram"))
    runs = named.filter("_where >= 0").groupBy(*key).agg(F.collect_set(F.struct("_where", "_gram", F.least("_n", F.lit(1 << 40)).alias("_n"))).alias("_runs"))

    marks = rows.select(*key, F.sha2("_x", 256).alias("_h"))
    copies = marks.groupBy("_h").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("_k", "_s")).alias("_first")).filter("_c > 1")
    copied = marks.join(copies.hint("merge"), "_h").groupBy("_k", "_s").agg(F.max(F.struct("_k", "_s") != F.col("_first")).alias("_spare"))

    # both joins need the same columns of it, so that they read one exchange
    keyed = rows.select("_id", "_x", *key).repartition("_k", "_s")
    cut_schema = pa.schema([("_kind", pa.int32()), ("_key", pa.int64()), ("_id", pa.int64()), ("_t", pa.int64()), ("_first", pa.int64()), ("_count", pa.int64()), ("_body", pa.binary())])
    one = keyed.groupBy("_k", "_s").agg(F.first("_id").alias("_id"), F.first("_x").alias("_x"))
    asked = one.join(runs.join(copied, ["_k", "_s"], "left").hint("merge"), ["_k", "_s"], "left").filter("_runs is not null and not coalesce(_spare, false)")
    pieces = asked.select("_id", F.col("_s").alias("_t"), "_x", "_runs", "_spare").mapInArrow(_pieces(unit, frequent, deals, cut_schema), "_kind int, _key long, _id long, _t long, _first long, _count long, _body binary")
    found = pieces.repartition("_kind", "_key").sortWithinPartitions("_kind", "_key").mapInArrow(_match(unit, matcher, held, pa.schema([("_id", pa.int64()), ("_t", pa.int64()), ("_span", pa.binary())])), "_id long, _t long, _span binary")
    noticed = named.filter("_where < 0").select(*key, F.lit(None).cast("binary").alias("_span")).distinct()
    spans = found.select(*key, "_span").unionByName(noticed).groupBy("_k", "_s").agg(F.collect_list("_span").alias("_spans"))

    full = keyed.join(copied.hint("merge"), ["_k", "_s"], "left").join(spans.hint("merge"), ["_k", "_s"], "left")
    return full.select("_id", "_x", F.col("_spare").isNotNull().alias("_copied"), "_spans").mapInArrow(
        _outcome(unit, pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("repeats", pa.bool_())])),
        "doc_id long, n_units long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, repeats boolean",
    )
