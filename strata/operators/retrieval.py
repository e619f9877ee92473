"""Vector retrieval: exact top-k, filtered, boosted, per level, coarse to fine, and many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata import config
from strata.functions import vectors as v

#: Rows and queries that meet at once in a task.
_ROWS, _QUERIES = 2048, 1024


def query_vector(vectors: DataFrame, key: str, value: int, vector: str = "embedding") -> DataFrame:
    """One row with the query's vector; a scalar subquery joins it to every row without a shuffle."""
    return vectors.filter(F.col(key) == value).limit(1).select(F.col(vector).alias("_q"))


def scored(rows: DataFrame, query: DataFrame, measure=v.cosine, vector: str = "embedding") -> DataFrame:
    """Adds similarity; rows without one (zero vectors) are left out."""
    return rows.crossJoin(F.broadcast(query.limit(1))).withColumn("similarity", measure(vector, "_q")).drop("_q").filter("similarity is not null")


def top(rows: DataFrame, k: int, *ties: str, by: str = "similarity") -> DataFrame:
    return rows.orderBy(F.desc(by), *ties).limit(k)


def retrieve_with_filters(rows: DataFrame, keep: Column, k: int, tie: str, *, pre_filter: bool = False) -> DataFrame:
    """Over-fetches 3k rows by similarity, applies the predicates, keeps k; with pre_filter the predicates come first."""
    return top(rows.filter(keep), k, tie) if pre_filter else top(top(rows, 3 * k, tie).filter(keep), k, tie)


def structure_boost(rows: DataFrame, header: Column, first_paragraph: Column, partial: Column, k: int, tie: str) -> DataFrame:
    """Of the 2k most similar: headers, opening paragraphs and partial entities change their score; k stay."""
    factor = F.when(header, config.HEADER_BOOST).otherwise(1.0) * F.when(first_paragraph, config.FIRST_PARAGRAPH_BOOST).otherwise(1.0) * F.when(partial, config.PARTIAL_BOOST).otherwise(1.0)
    return top(top(rows, 2 * k, tie).withColumn("similarity", F.col("similarity") * factor), k, tie)


def top_per(rows: DataFrame, group: str, k: int, *ties: str, by: str = "similarity") -> DataFrame:
    """The k best of each group with their rank; Spark keeps only k rows of a group per task before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(by), *ties)
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def wavelet_cascade(rows: DataFrame, query: DataFrame, k: int, levels: int, tie: str, *, vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Scores candidates at the coarsest level, keeps min(max(factor * k, share of them), most), and goes one level finer.

    Stops early when the best score is over the threshold at level 1 or below, or when it gains less than 0.02 for the second
    level on. A candidate keeps the score of the last level that it reached. At most ``most`` candidates leave the first stage.
    """
    q = query.select(v.haar_pyramid("_q", levels).alias("_qp"))
    pool = rows.select(tie, v.haar_pyramid(vector, levels).alias("_p")).crossJoin(F.broadcast(q))
    count, before, start = pool.count(), None, levels
    best = None
    for level in range(levels, -1, -1):
        pool = pool.withColumn("similarity", v.cosine(F.col("_p")[level], v.unit(F.col("_qp")[level])))
        keep = int(min(max(config.CASCADE_FACTOR * k, config.CASCADE_SHARE * count), config.CASCADE_MOST))
        pool, count = top(pool, keep, tie).persist(), min(count, keep)
        best = pool.agg(F.max("similarity")).first()[0]
        if best is None or level == 0 or (best >= threshold and level <= 1):
            break
        if before is not None and best - before < 0.02 and level <= start - 2:
            break
        before = best
    return top(pool.select(tie, "similarity"), k, tie)


def _best(held: list[np.ndarray], exact: np.ndarray, ids: np.ndarray, k: int, digits: int | None) -> list[np.ndarray]:
    """(query, -score to digits, id, score) sorted, k of a query: those held and those of exact (a row a query, a column an id) that may join them."""
    score = exact if digits is None else np.round(exact, digits)
    least = np.full(len(score), -np.inf)
    if score.shape[1] > k:
        least = np.partition(score, -k, axis=1)[:, -k]
    full = np.flatnonzero(np.bincount(held[0], minlength=len(score)) == k)
    last = np.searchsorted(held[0], full, "right") - 1
    least[full] = np.maximum(least[full], -held[1][last])
    q, at = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    q, s, i, e = (np.concatenate(x) for x in zip(held, (q, -score[q, at], ids[at], exact[q, at]), strict=True))
    order = np.lexsort((i, s, q))
    q = q[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return [q[first], *(x[order][first] for x in (s, i, e))]


def task_top_k(batches: Iterator[tuple[np.ndarray, np.ndarray]], n: int, measure: Callable[[slice, np.ndarray, np.ndarray], np.ndarray], k: int, digits: int | None = None, meeting: tuple[int, int] = (_ROWS, _QUERIES)) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row id, score, score to digits) of the k best rows of a task for each of n queries by score to digits, ties by least id.

    batches: ids and vectors. measure(queries, ids, vectors) scores a slice of queries against some rows, -inf for no pair. A
    meeting has at most as many rows and queries as ``meeting`` says; besides it a task holds k rows a query, however many rows it reads.
    """
    none = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)]
    most, wide = meeting
    held = [none for _ in range(0, n, wide)]
    for ids, x in batches:
        for at in range(0, len(ids), most):
            some, rows = ids[at : at + most], x[at : at + most]
            for t in range(len(held)):
                held[t] = _best(held[t], measure(slice(t * wide, min(n, (t + 1) * wide)), some, rows), some, k, digits)
    for t, (q, s, i, e) in enumerate(held):
        yield q + t * wide, i, e, -s


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int, *, row_id: str, query_id: str, vector: str = "embedding", most_bytes: int = 64 << 20) -> DataFrame:
    """query_id, row_id, similarity, rank: the k nearest rows of every query by cosine to nine digits, exactly.

    Queries are broadcast as one matrix, in blocks of at most most_bytes; each task multiplies its rows with the matrix, some rows
    and queries at a time, and passes on k rows a query, so the shuffle is tasks * queries * k rows and no pair table is built.
    Rows that differ less than that are ties, as sums of equal vectors differ with their place in a block.
    """
    spark = rows.sparkSession
    schema = pa.schema([("query_id", pa.int64()), ("row_id", pa.int64()), ("similarity", pa.float64()), ("_key", pa.float64())])

    def block(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value

            def measure(some: slice, _: np.ndarray, x: np.ndarray) -> np.ndarray:
                size = np.linalg.norm(x, axis=1)
                score = q[some] @ np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0).T
                score[:, ~(size > 0)] = -np.inf
                score[np.isnan(score)] = -np.inf
                return score

            some = ((b.column(0).to_numpy(zero_copy_only=False)[at : at + _ROWS], np.array(b.column(1).slice(at, _ROWS).to_pylist(), np.float64)) for b in batches for at in range(0, len(b), _ROWS))
            for query, row, score, key in task_top_k(some, len(ids), measure, k, 9):
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(row), pa.array(score), pa.array(key)], schema=schema)

        return run

    found, ids, held = None, [], []

    def flush() -> None:
        nonlocal found, ids, held
        q = np.array(held, np.float64).reshape(len(held), -1)
        size = np.linalg.norm(q, axis=1, keepdims=True) if len(q) else q
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64)[(size[:, 0] > 0)] if len(q) else np.zeros(0, np.int64), (q / np.where(size > 0, size, 1))[size[:, 0] > 0] if len(q) else q))
        part = rows.select(F.col(row_id).cast("long"), F.col(vector)).mapInArrow(block(shared), "query_id long, row_id long, similarity double, _key double")
        found = part if found is None else found.unionByName(part)
        ids, held = [], []

    for r in queries.select(F.col(query_id).cast("long").alias("i"), v.as_double(vector).alias("x")).toLocalIterator():
        ids.append(r.i)
        held.append(r.x)
        if len(held) * len(r.x) * 8 >= most_bytes:
            flush()
    if held or found is None:
        flush()
    return top_per(found, "query_id", k, "row_id", by="_key").drop("_key")
