"""Queries that split documents, conversations and code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import chunking as c
from strata.plans.derived import frame
from strata.plans.registry import query, table


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "chunk_index", F.length("text").alias("chars"), F.md5("text").alias("hash"))


@query()
def fixed_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(c.split_rows(table(spark, sf_dir, "documents"), c.fixed_sentence_chunks))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(c.split_rows(table(spark, sf_dir, "documents"), c.semantic_chunks))


@query()
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(c.split_rows(table(spark, sf_dir, "documents"), c.section_chunks))


@query()
def line_pack_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(c.split_rows(table(spark, sf_dir, "documents"), c.line_pack))


@query("""SELECT doc_id, kind, level, CASE title WHEN 'Alpha' THEN 'Alpha' || doc_id WHEN 'Beta' THEN lang WHEN 'Gamma' THEN source ELSE title END AS title, start_line, end_line FROM documents, (VALUES ('header', 1, 'Alpha', 0, 0), ('paragraph', 0, '', 1, 1), ('header', 2, 'Beta', 2, 2), ('list', 0, '', 3, 4), ('header', 3, 'Gamma', 5, 5), ('paragraph', 0, '', 6, 6), ('header', 2, 'Delta', 7, 7), ('paragraph', 0, '', 8, 8), ('header', 1, 'SUMMARY', 9, 9), ('header', 2, 'Numbered', 10, 10), ('paragraph', 0, '', 11, 11)) v(kind, level, title, start_line, end_line)""")
def document_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.structure_rows(frame(spark, "notes", sf_dir)).select("doc_id", "kind", "level", "title", "start_line", "end_line")


@query("""SELECT doc_id, n, level, replace(replace(replace(path, 'Alpha', 'Alpha' || doc_id), 'Beta', lang), 'Gamma', source) AS path, parent FROM documents, (VALUES (0, 1, 'Alpha', NULL::INTEGER), (1, 2, 'Alpha/Beta', 0), (2, 3, 'Alpha/Beta/Gamma', 1), (3, 2, 'Alpha/Delta', 0)) v(n, level, path, parent)""")
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.section_rows(frame(spark, "notes", sf_dir)).select("doc_id", "n", "level", "path", "parent")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), s AS (SELECT *, sum((length(line) < 40)::INT) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS section FROM l)
SELECT doc_id, section, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM s GROUP BY ALL""")
def flat_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines stand for headings, which the documents lack."""
    return c.flat_sections(table(spark, sf_dir, "documents"), F.length("line") < 40)


@query("SELECT doc_id, CAST((length(text) - 1) // 800 + 1 AS INTEGER) AS n_windows, length(substr(text, 801, 1000)) AS second FROM documents WHERE length(text) > 0")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = c.fixed_windows(F.col("text"), 1000, 800)
    return table(spark, sf_dir, "documents").filter("length(text) > 0").select("doc_id", F.size(w).alias("n_windows"), F.coalesce(F.length(F.get(w, F.lit(1))), F.lit(0)).cast("bigint").alias("second"))


@query()
def notebook_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation stand for the cells of a notebook; their number in one conversation is bounded."""
    cells = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\x1e").alias("text"))
    rows = c.split_rows(cells, lambda t: c.notebook_chunks(t.split("\x1e")), "conv_id")
    return rows.select(F.col("doc_id").alias("conv_id"), "chunk_index", F.length("text").alias("chars"))
