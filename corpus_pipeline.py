"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, contaminated documents go, sources are
mixed to their target weights, and token ids are stored.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and but for the last returns the columns of
its input. Decisions go back to rows by a key of the whole row, so null and repeated doc_ids do not matter, and a row travels as
one value, so its columns may have any names. Null texts are kept by the filters; the mix takes nothing of texts without words.
Every stage makes an empty table of an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.decontaminate import contaminated_words, is_contaminated
from strata.llm.jaccard_join import jaccard_classes
from strata.llm.mixing import mix_sources
from strata.llm.storage import cut, new_path
from strata.llm.token_store import read_tokens, write_tokens
from strata.llm.toxicity import toxicity


def _keyed(docs: DataFrame) -> DataFrame:
    """row (the whole row as one value, so its column names meet no others) and _row, which rows share if they are equal in everything.

    _row is a 64-bit hash of all columns; where rows with another second hash have it too (n * n / 2**65 keys are expected of
    n rows, so that table is small), those get a key of both hashes.
    """
    column = lambda c, kind: F.sort_array(F.map_entries(_named(c))) if kind.startswith("map<") else _named(c)
    every = [x for c, kind in docs.dtypes for x in (column(c, kind), _named(c).isNull())]
    rows = docs.select(F.struct(*map(_named, docs.columns)).alias("row"), F.xxhash64(*every).alias("_row"), F.xxhash64(F.lit(1), *every).alias("_check"))
    shared = cut(rows.groupBy("_row").agg(F.min("_check").alias("_least"), F.max("_check").alias("_most")).filter("_least != _most").drop("_most"))
    if not shared.isEmpty():
        told = rows.join(F.broadcast(shared), "_row", "left")
        rows = told.withColumn("_row", F.when(F.col("_check") != F.col("_least"), F.xxhash64("_row", "_check")).otherwise(F.col("_row")))
    return rows.select("row", "_row")


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _texts(keyed: DataFrame) -> DataFrame:
    """What operators see: the key as doc_id, text and source."""
    return keyed.select(F.col("_row").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.source").alias("source"))


def _without(keyed: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows whose key is not a doc_id of judged."""
    bad = judged.select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(bad.hint("merge"), "_row", "left_anti").select("row.*")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_number", F.row_number().over(Window.partitionBy("_row").orderBy("_row")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject; each row is judged by its own text. An empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = _keyed(docs)
    return _without(keyed, toxicity(_texts(keyed), labels, labelled=docs.select("doc_id", "text")).filter("rejected"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of similarity 0.8 or more on five-word shingles connect, that with the least doc_id.

    A null doc_id counts as largest, and of rows with the least doc_id that of the least key stays, once. Rows without words
    are no group: all stay.
    """
    keyed = _keyed(docs)
    groups = jaccard_classes(_texts(keyed), words=5, threshold=(8, 10)).select(F.col("doc_id").alias("_row"), "n_shingles", "component_id").distinct()
    named = groups.filter("n_shingles > 0").join(keyed.select("_row", F.col("row.doc_id").alias("doc_id")).distinct().hint("merge"), "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("first"))
    wanted = first.select("first._row", F.lit(True).alias("_once")).unionByName(groups.filter("n_shingles = 0").select("_row", F.lit(False).alias("_once")))
    return _numbered(keyed.join(wanted.hint("merge"), "_row")).filter("_number = 1 or not _once").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in benchmark windows; each row is judged by its own text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs)
    return _without(keyed, contaminated_words(_texts(keyed), items).filter(is_contaminated()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words, rounded to whole documents; equal rows together as often as the sum."""
    keyed = _keyed(docs)
    times = F.sum(F.round(F.col("taken") / F.greatest("size", F.lit(1)))).cast("int")
    taken = mix_sources(_texts(keyed)).groupBy(F.col("doc_id").alias("_row")).agg(times.alias("_times")).filter("_times > 0")
    one = _numbered(keyed.join(taken.hint("merge"), "_row")).filter("_number = 1")
    return one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, read back from the files."""
    path = new_path(spark, "pipeline-tokens")
    write_tokens(docs, path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
    ("token_binary_output", store_tokens),
]

#: SQL can't express the classifier chain or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
