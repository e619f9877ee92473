"""Smallest enclosing range of each range by one sweep over sorted ranges; no range meets all others of its file.

Rows are dealt by ranges of (file, start) and swept in order of start, longest first. What a task keeps is the open ranges
that can still be the smallest around a later one: by end they have growing lengths, so a lookup is a binary search. Where a
long file is cut, the open ranges at a cut are carried to the tasks that go on with the file.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.storage import cut

_NAMES = ("file", "start", "end", "id", "query")
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
_ROW = "file string, start long, end long, id long, query boolean"


class Open:
    """Open ranges as (end, length, id), by end; none has another with as late an end that is shorter (or as long with a lesser id)."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int]] = []

    def add(self, start: int, end: int, number: int) -> None:
        at = bisect_left(self.rows, (end, end - start, number))
        if at < len(self.rows) and self.rows[at][1:] <= (end - start, number):
            return
        low = at
        while low and self.rows[low - 1][1:] >= (end - start, number):
            low -= 1
        self.rows[low:at] = [(end, end - start, number)]

    def forget(self, before: int) -> None:
        """Drops ranges that end before a start that no later one precedes."""
        at = bisect_left(self.rows, (before,))
        if at:
            del self.rows[:at]

    def around(self, end: int) -> int | None:
        at = bisect_left(self.rows, (end,))
        return self.rows[at][2] if at < len(self.rows) else None


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(x).to_pylist() for x in names), strict=True)


def _sweep(rows: Iterator[tuple]) -> Iterator[tuple[tuple, int | None, Open]]:
    """Each row with its parent and the ranges that are open behind it. Equal ranges do not enclose each other; queries enclose nothing."""
    file, spread, waiting, state = None, None, [], Open()
    for row in rows:
        if row[0] != file or row[1:3] != spread:
            for _, start, end, number, *_ in waiting:
                state.add(start, end, number)
            waiting = []
        if row[0] != file:
            file, state = row[0], Open()
        spread = row[1:3]
        state.forget(row[1])
        if not row[4]:
            waiting.append(row)
            yield row, state.around(row[2]), state
        else:
            own = min((x[3] for x in waiting), default=None)
            around = state.around(row[2])
            # a range equal to the query is the smallest that holds it
            yield row, around if own is None else own, state
    for _, start, end, number, *_ in waiting:
        state.add(start, end, number)


def _at_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is open at the end of a task's rows: its last file, and its first one, to know who goes on."""
    state, first, last = Open(), None, None
    for row, _, state in _sweep(_rows(batches, _NAMES)):
        first = first or (row[0],)
        last = (row[0],)
    if last is None:
        return
    part = TaskContext.get().partitionId()
    rows = [(part, first[0], last[0], end - length, end, number) for end, length, number in state.rows] or [(part, first[0], last[0], None, None, None)]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["_part", "first", "last", "start", "end", "id"])


_PARENT = "file string, id long, start long, end long, query boolean, parent_id long"


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of task; what is carried into a task is swept like its own rows, but gives no result."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    out: list[tuple] = []

    def packed() -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PARENT.split(", ")])

    for _, of_part in groupby(_rows(batches, (*_NAMES, "_part", "_own")), key=lambda r: r[5]):
        for (file, start, end, number, query, _, own), parent, _ in _sweep(of_part):
            if own:
                out.append((file, number, start, end, query, parent))
            if len(out) >= 4096:
                yield packed()
    if out:
        yield packed()


def smallest_enclosing(ranges: DataFrame, *, queries: DataFrame | None = None) -> DataFrame:
    """file, id, start, end, query, parent_id: of each of ranges(file, id, start, end) the smallest longer range of its file around it.

    Ranges of equal length are told apart by the least id. queries(file, id, start, end) get the smallest range that holds
    them, one of their own extent included; they enclose nothing. Rows with a null file or end and ranges that end before they
    start enclose nothing and get no parent. Repeated rows have a result each; an empty table gives none.
    """
    shape = lambda rows, query: rows.select(F.col("file").cast("string").alias("file"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("id").cast("bigint").alias("id"), F.lit(query).alias("query"))
    every = shape(ranges, False)
    if queries is not None:
        every = every.unionByName(shape(queries, True))
    sound = F.coalesce(F.col("file").isNotNull() & (F.col("start") <= F.col("end")) & F.col("id").isNotNull(), F.lit(False))
    order = [F.col("file"), F.col("start"), F.col("end").desc(), F.col("query"), F.col("id")]
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = every.filter(sound).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    laid = cut(laid)
    at_cuts = cut(laid.mapInArrow(_at_cuts, "_part int, first string, last string, start long, end long, id long"))
    # what is open at a part's end goes to the later parts that begin with the same file: a row a part tells which
    later = at_cuts.select(F.col("_part").alias("_to"), F.col("first").alias("file")).distinct()
    carried = at_cuts.filter("id is not null").withColumnRenamed("last", "file").join(later, "file").filter("_to > _part")
    carried = carried.select("file", "start", "end", "id", F.lit(False).alias("query"), F.col("_to").alias("_part"), F.lit(False).alias("_own"))
    both = laid.withColumn("_own", F.lit(True)).unionByName(carried)
    swept = both.repartition(parts, "_part").sortWithinPartitions("_part", *order, "_own").mapInArrow(_parents, _PARENT)
    return swept.unionByName(every.filter(~sound).select("file", "id", "start", "end", "query", F.lit(None).cast("bigint").alias("parent_id")))
