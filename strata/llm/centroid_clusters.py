"""Clusters around centroids with block-norm screening, in whole numbers.

A vector is cut into segments, and the norms of its segments are computed once and kept beside it: they are its compressed
form. By the Cauchy-Schwarz inequality two segments are at least the difference of their norms apart, so the sum of the
squared differences over segments is a lower bound of the squared distance of vector and centroid. A round computes these
bounds for all centroids by one product of small matrices, the exact distance of the centroid with the least bound, and exact
whole-number distances of only those centroids whose bound does not exceed that; the rest can't be nearest. Bounds are in
floating point and give way by more than their error, so screening never changes a result.

Tasks send a sum and a count for each centroid; the centroids (k vectors) are all that passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.integer_vectors import finite, matrix, scaled
from strata.llm.storage import cut

_ROWS = 1024


def segment_norms(x: np.ndarray, segments: int) -> np.ndarray:
    """Norm of each of ``segments`` nearly equal stretches of each row."""
    square = x.astype(np.float64) ** 2
    return np.sqrt(np.add.reduceat(square, np.linspace(0, x.shape[1], segments, endpoint=False).astype(int), axis=1))


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, centroid_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the number of the nearest centroid (ties: the smaller), its squared distance, and how many exact distances that took."""
    n, k = len(x), len(centroids)
    own, theirs = (norms**2).sum(1), (centroid_norms**2).sum(1)
    low = own[:, None] + theirs - 2 * norms @ centroid_norms.T
    low -= 1e-12 * (own[:, None] + theirs) + 0.5
    first = low.argmin(1)
    reach = ((x - centroids[first]) ** 2).sum(1)
    row, number = np.nonzero(low <= reach[:, None])
    exact = ((x[row] - centroids[number]) ** 2).sum(1)
    begin = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(exact, begin)
    best = np.minimum.reduceat(np.where(exact == least[row], number, k), begin)
    return best, least, np.bincount(row, minlength=n)


def _chunks(batches: Iterator[pa.RecordBatch], width: int, segments: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            yield batch, matrix(batch.column("x"), width).astype(np.int64), matrix(batch.column("norms"), segments)


def _sums(centroids: np.ndarray, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        norms = segment_norms(centroids, segments)
        total = np.zeros((k, width + 1), np.int64)  # sums, then the count
        for _, x, own in _chunks(batches, width, segments):
            best, _, _ = nearest(x, own, centroids, norms)
            np.add.at(total[:, :width], best, x)
            total[:, width] += np.bincount(best, minlength=k)
        used = np.flatnonzero(total[:, width])
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "total"])

    return run


def _assigned(centroids: np.ndarray, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = segment_norms(centroids, segments)
        for batch, x, own in _chunks(batches, centroids.shape[1], segments):
            best, least, compared = nearest(x, own, centroids, norms)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(least), pa.array(compared.astype(np.int32))], names=["vec_id", "cluster", "distance", "compared"])

    return run


def centroid_clusters(vectors: DataFrame, *, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, segments: int = 8, seed: int = 2, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, compared (exact distances that it took), cluster_inertia, inertia, centroid (final components, comma-joined).

    Vectors of another length than ``dims``, null ones and those with null or non-finite components are left out. Centroids
    start as the k vectors with the least hash of seed and vec_id; equal vec_ids are in order of their components, null ones
    come last. Fewer than k vectors give fewer centroids, an empty table gives no rows. Repeated rows count as often as they
    occur. Other columns do not matter. A component beyond 2**27 after scaling is an error, as distances must fit a long.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("e")).filter((F.size("e") == dims) & finite(F.col("e"))).select("vec_id", scaled(F.col("e"), scale).alias("x"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = segment_norms(matrix(batch.column("x"), dims), segments)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.FixedSizeListArray.from_arrays(pa.array(norms.ravel()), segments).cast(pa.list_(pa.float64()))], names=["vec_id", "x", "norms"])

    rows = cut(kept.mapInArrow(compress, "vec_id long, x array<int>, norms array<double>"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = rows.select("x", "vec_id", name.alias("h")).orderBy(F.col("h").asc_nulls_last(), "vec_id", "x").limit(k).collect()
    centroids = np.array([r.x for r in start], np.int64).reshape(len(start), dims)
    for _ in range(rounds if len(start) else 0):
        sums = rows.mapInArrow(_sums(centroids, segments), "cluster int, total array<long>").select("cluster", F.posexplode("total").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("part").alias("part"))
        total = np.zeros((len(start), dims + 1), np.int64)
        for r in sums.collect():  # a row for each component of a centroid
            total[r.cluster, r["at"]] = r.part
        used = total[:, dims] > 0
        centroids[used] = total[used, :dims] // total[used, dims:]
    out = cut(rows.mapInArrow(_assigned(centroids, segments), "vec_id long, cluster int, distance long, compared int"))
    inertia = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = [(j, s, sum(inertia.values()), ",".join(map(str, centroids[j].tolist()))) for j, s in inertia.items()]
    of = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid string")
    return out.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "compared", "cluster_inertia", "inertia", "centroid")
