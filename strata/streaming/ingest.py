"""Incremental ingest: a file stream whose micro-batches are merged into the catalog by content hash.

The reference semantics are a skip of unchanged files; there is no event time, so there are no watermarks. Every batch writes a
new version of the catalog, so a batch that is run again after a failure gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.sources import files


def merge_batch(catalog: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Catalog rows after a batch: of a document's rows in the batch the latest counts; unchanged ones are skipped."""
    rows = files.with_hash(batch.select(F.col("path").alias("filepath"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content"))
    rows = rows.groupBy("document_id").agg(F.max_by(F.struct("filepath", "modified", "size", "file_type", "file_hash"), "modified").alias("r")).select("document_id", "r.*")
    return rows if catalog is None else files.upsert(catalog, files.changed(rows, catalog))


def ingest(spark: SparkSession, folder: str, catalog: str, checkpoint: str, pattern: str = "*") -> StreamingQuery:
    """Follows a folder; catalog/version=N holds the catalog after batch N. Processes what is there and ends."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        before = None
        if number > 0:
            before = spark.read.parquet(f"{catalog}/version={number - 1}")
        merge_batch(before, batch).write.mode("overwrite").parquet(f"{catalog}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
