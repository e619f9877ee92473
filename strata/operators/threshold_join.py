"""Exact search for all vectors within a cosine of queries, over blocks that triangle bounds rule out.

The index holds unit vectors in blocks of near neighbours: rows are dealt to the nearest of a few pivots and, within a pivot,
sorted by their angle to it. A block keeps the least and greatest angle of its vectors to every pivot. Angles obey the
triangle inequality, so a query whose angle to some pivot is farther outside a block's interval than the threshold's angle
has no match in the block, and the block is compared only with the queries that no pivot rules out. Pivots come from a
bounded sample; the index holds every vector, and the answer is exact whatever the pivots are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.storage import cut

#: what bounds and comparisons in floating point give way by
_SLACK = 1e-6


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    x = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), dims).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, e (array<double>): vectors without null or non-finite components and with a norm above 0."""
    e = F.col("e")
    named = rows.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    return named.filter(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))).filter(F.exists(e, lambda x: x != 0))


def build_index(vectors: DataFrame, *, pivots: int = 32, block_rows: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Blocks (n, ids, body, low, high) of all usable vectors of the commonest length, and the pivots.

    Pivots are the ``pivots`` vectors of least hash: that is all that the driver holds. Rows go to tasks by ranges of pivot and
    angle, so a pivot that most vectors are near to is spread over tasks.
    """
    rows = usable(vectors, vec_id, embedding)
    dims = (rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first() or [0])[0]
    rows = rows.filter(F.size("e") == dims)
    drawn = [r.e for r in rows.orderBy(F.xxhash64("id", "e"), "id").limit(pivots).collect()]
    centre = np.array(drawn, np.float64).reshape(len(drawn), dims)
    centre /= np.sqrt((centre * centre).sum(1))[:, None]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = _angles(_unit(batch.column("e"), dims), centre)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("e"), pa.array(angle.argmin(1).astype(np.int32)), pa.array(angle.min(1))], names=["id", "e", "pivot", "angle"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot = batch.column("pivot").to_numpy()
            edge = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]]) if len(pivot) else []
            for lo, hi in zip(edge, [*edge[1:], len(pivot)], strict=False):
                for at in range(lo, hi, block_rows):
                    part = batch.slice(at, min(block_rows, hi - at))
                    x = _unit(part.column("e"), dims)
                    angle = _angles(x, centre)
                    one = lambda y: pa.array([y.tolist()], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), one(angle.min(0)), one(angle.max(0))], names=["n", "ids", "body", "low", "high"])

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.mapInArrow(near, "id long, e array<double>, pivot int, angle double").repartitionByRange(parts, "pivot", "angle").sortWithinPartitions("pivot", "angle", "id")
    return cut(laid.mapInArrow(pack, "n int, ids array<long>, body binary, low array<double>, high array<double>")), centre


_FOUND = "query_id long, vec_id long, similarity double"


def search(index: tuple[DataFrame, np.ndarray], queries: DataFrame, *, least: float = 0.75, query_block: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, similarity) of all pairs with a cosine of ``least`` or more, and (query_block, n_blocks, n_pairs, n_compared).

    Queries are a stated set: they meet the index in blocks of ``query_block``, by hash, each a broadcast of that many vectors.
    n_pairs counts block and query pairs, n_compared those that bounds did not rule out. Queries that are not usable or of
    another length find nothing; a query that is in the index finds itself.
    """
    blocks, centre = index
    spark = blocks.sparkSession
    dims, reach = centre.shape[1], float(np.arccos(least))
    asked = usable(queries, vec_id, embedding).filter(F.size("e") == dims)
    parts = -(-asked.count() // query_block) if len(centre) else 0
    pairs, counts = spark.createDataFrame([], _FOUND), spark.createDataFrame([], "query_block int, n_blocks long, n_pairs long, n_compared long")
    for k in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("id", "e"), F.lit(parts)) == k).collect()
        x = np.array([r.e for r in own], np.float64).reshape(len(own), dims)
        x /= np.sqrt((x * x).sum(1))[:, None]
        shared = spark.sparkContext.broadcast(([r.id for r in own], x, _angles(x, centre)))

        def possible(low, high, angle):
            return ~((angle < low - reach - _SLACK) | (angle > high + reach + _SLACK)).any(1)

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, x, angle = shared.value
            for batch in batches:
                low, high = (np.array(batch.column(c).to_pylist()) for c in ("low", "high"))
                for i in range(batch.num_rows):
                    rows = np.flatnonzero(possible(low[i], high[i], angle))
                    body = np.frombuffer(batch.column("body")[i].as_py(), np.float64).reshape(-1, dims)
                    ids = batch.column("ids")[i].as_py()
                    q, v = np.nonzero((cos := x[rows] @ body.T) >= least - _SLACK)
                    kept = [(names[rows[a]], ids[b], float(cos[a, b])) for a, b in zip(q, v, strict=True)]
                    if kept:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "similarity"])

        def count(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            _, _, angle = shared.value
            for batch in batches:
                n = sum(int(possible(np.array(lo), np.array(hi), angle).sum()) for lo, hi in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([batch.num_rows]), pa.array([batch.num_rows * len(angle)]), pa.array([n])], names=["query_block", "n_blocks", "n_pairs", "n_compared"])

        pairs = pairs.unionByName(blocks.mapInArrow(compare, _FOUND))
        counts = counts.unionByName(blocks.select("low", "high").mapInArrow(count, "query_block int, n_blocks long, n_pairs long, n_compared long"))
    # cosines within the slack of the threshold are decided at nine digits
    exact = pairs.withColumn("similarity", F.round("similarity", 9)).filter(F.col("similarity") >= least)
    return exact, counts.groupBy("query_block").agg(*(F.sum(c).alias(c) for c in ("n_blocks", "n_pairs", "n_compared")))


def threshold_join(vectors: DataFrame, queries: DataFrame, *, least: float = 0.75, **index: object) -> DataFrame:
    return search(build_index(vectors, **index), queries, least=least)[0]
