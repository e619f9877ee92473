"""Product codes of vectors: a codebook for each part of a vector, fitted by treeAggregate over columnar NumPy blocks.

Rows are packed once into blocks that hold their components column by column, and the blocks are written to the shared folder.
A round is one treeAggregate over an RDD of the blocks: a task adds up the squared distances of a block's parts and all
entries dimension by dimension, takes the least, and adds the parts to its entries' sums and counts with np.add.at; the
int64 tensors of sums and counts merge through a reduction tree, so the driver gets a few of them, of a size that only
depends on the codebooks. Codebooks go back to the tasks in the next round's closure. Everything is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.integer_vectors import finite, matrix, scaled
from strata.llm.storage import cut, stored

_ROWS = 1024


def assign(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """columns: dimensions x rows, book: entries x dimensions. Of each row the nearest entry (ties: the lower) and its squared distance."""
    width, n = columns.shape
    most = int(np.abs(columns).max(initial=0)) + int(np.abs(book).max(initial=0))
    kind = np.int32 if width * most * most < 1 << 31 else np.int64
    columns, book = columns.astype(kind), np.ascontiguousarray(book.T.astype(kind))
    code, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at in range(0, n, _ROWS):
        part = columns[:, at : at + _ROWS]
        total = np.zeros((part.shape[1], book.shape[1]), kind)
        for x, y in zip(part, book, strict=True):
            apart = x[:, None] - y
            apart *= apart
            total += apart
        best = total.argmin(1)
        code[at : at + _ROWS], least[at : at + _ROWS] = best, total[np.arange(len(best)), best]
    return code, least


def _columns(body: bytes, n: int, parts: int) -> np.ndarray:
    """parts x dimensions x rows of a block."""
    return np.frombuffer(body, "<i4").reshape(parts, -1, n) if n else np.zeros((parts, 0, 0), np.int32)


def _pack(rows_in_block: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_in_block):
                batch = whole.slice(at, rows_in_block)
                n = batch.num_rows
                body = np.ascontiguousarray(matrix(batch.column("x"), dims).T.astype("<i4")).tobytes()
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), one(batch.column("vec_id")), one(batch.column("label")), pa.array([body], pa.binary())], names=["n", "vec_id", "label", "body"])

    return run


def fit_codebooks(blocks: DataFrame, books: np.ndarray, *, rounds: int, depth: int = 2) -> np.ndarray:
    """blocks(n, body) and the first codebooks (parts x entries x dimensions): the codebooks after ``rounds`` rounds."""
    packed = blocks.select("n", "body").rdd
    parts = len(books)
    for _ in range(rounds):

        def add(have, block, books=books):
            sums, counts = have or (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
            for p, columns in enumerate(_columns(block.body, block.n, parts)):
                code, _ = assign(columns, books[p])
                np.add.at(sums[p], code, columns.T)
                np.add.at(counts[p], code, 1)
            return sums, counts

        def merge(a, b):
            return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

        got = packed.treeAggregate(None, add, merge, depth)
        if got is None:
            break
        sums, counts = got
        used = counts > 0
        books = books.copy()
        books[used] = sums[used] // counts[used][:, None]
    return books


def _encode(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                found = [assign(x, book) for x, book in zip(_columns(batch.column("body")[i].as_py(), n, len(books)), books, strict=True)]
                code = np.stack([x[0] for x in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[i].values, batch.column("label")[i].values, pa.array([x.tobytes().hex() for x in code], pa.string()), pa.array(sum(x[1] for x in found))], names=["vec_id", "label", "code", "error"])

    return run


def vector_codes(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, block_rows: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) and the codebooks (parts x entries x dimensions).

    Null vectors and those with null or non-finite components are left out. Vectors must have one length that ``parts``
    divides; where there are several, the commonest (then the longest) is coded, and the others get a null code and error and
    add nothing to label_error. Codebooks start as the vectors of the least vec_ids, equal ones in order of their components,
    null ones last; fewer vectors than ``entries`` give fewer entries. label_error is the error summed over equal labels,
    nulls together. Repeated rows count as often as they occur; an empty table gives no rows and empty codebooks. Other
    columns do not matter. A component beyond 2**27 after scaling is an error, as distances must fit a long.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    named = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("e")).filter(finite(F.col("e")))
    lengths = named.groupBy(F.size("e").alias("n")).agg(F.count(F.lit(1)).alias("k")).filter(F.col("n") % parts == 0)
    dims = (lengths.orderBy(F.desc("k"), F.desc("n")).first() or [0])[0]
    rows = named.filter(F.size("e") == dims).select("vec_id", "label", scaled(F.col("e"), scale).alias("x"))
    kind = named.schema["label"].dataType.simpleString()
    blocks = stored(rows.mapInArrow(_pack(block_rows, dims), f"n int, vec_id array<long>, label array<{kind}>, body binary"), "blocks")
    start = rows.select("x", "vec_id").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    first = np.array([r.x for r in start], np.int64).reshape(len(start), parts, dims // parts)
    books = np.ascontiguousarray(first.transpose(1, 0, 2))
    books = fit_codebooks(blocks, books, rounds=rounds if len(start) else 0)
    coded = cut(blocks.mapInArrow(_encode(books), f"vec_id long, label {kind}, code string, error long"))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    others = named.filter(F.size("e") != dims).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    every = coded.unionByName(others).join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return every.select("vec_id", "label", "code", "error", "label_error"), books
