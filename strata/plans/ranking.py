"""Queries on hybrid ranking. Chunks are embeddings, their concepts the labels, documents groups of five chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators import ranking as r
from strata.operators import retrieval
from strata.plans.derived import frame, with_sql
from strata.plans.registry import query, table
from strata.plans.retrieval import SCORED, _scored

CONF = "((vec_id * 37) % 100) / 100.0::DOUBLE"
BASE = f"WITH {SCORED}, chunks AS (SELECT vec_id AS chunk_id, 'l#' || label AS uri, {CONF} AS confidence, vec_id // 5 AS doc, similarity FROM scored), wanted(uri, confidence) AS (VALUES ('l#1', 0.9::DOUBLE), ('l#4', 0.6::DOUBLE))"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return rows.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("l#"), F.col("label").cast("string")).alias("uri"), ((F.col("vec_id") * 37) % 100 / 100.0).alias("confidence"), F.expr("vec_id div 5").alias("doc"), "similarity")


def _wanted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("l#1", 0.9), ("l#4", 0.6)], "uri string, confidence double")


@query(with_sql("axioms", "chunk_concepts", "query_concepts") + """, up AS (SELECT DISTINCT source AS child, target AS parent FROM axioms WHERE type = 'subsumption'), kin AS (SELECT DISTINCT x.child AS a, y.child AS b FROM up x JOIN up y USING (parent) WHERE x.child <> y.child),
q AS (SELECT uri, confidence AS c FROM query_concepts UNION ALL SELECT a, 0.7::DOUBLE * confidence FROM query_concepts JOIN kin ON b = uri) SELECT chunk_id, round(max(k.confidence * q.c), 6) AS concept FROM chunk_concepts k JOIN q USING (uri) GROUP BY chunk_id""")
def concept_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = r.concept_scores(frame(spark, "chunk_concepts", sf_dir), frame(spark, "query_concepts", sf_dir), frame(spark, "axioms", sf_dir))
    return out.select("chunk_id", F.round("concept", 6).alias("concept"))


HYBRID = BASE + """, c AS (SELECT chunk_id, max(k.confidence * w.confidence) AS concept FROM chunks k JOIN wanted w USING (uri) GROUP BY 1),
s AS (SELECT k.chunk_id, k.uri, k.doc, (0.7::DOUBLE * similarity + 0.3::DOUBLE * coalesce(concept, 0.0::DOUBLE) + CASE WHEN doc % 10 = 3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) * CASE WHEN doc = 7 THEN 1.35::DOUBLE WHEN doc % 10 = 7 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS score FROM chunks k LEFT JOIN c USING (chunk_id))"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    joined = chunks.join(r.concept_scores(chunks, _wanted(spark)), "chunk_id", "left")
    doc = F.col("doc")
    return joined.select("chunk_id", "uri", "doc", r.combined(F.col("similarity"), F.col("concept"), doc % 10 == 3, doc == 7, doc % 10 == 7).alias("score"))


@query(HYBRID + " SELECT chunk_id, uri, round(score, 6) AS score FROM s ORDER BY s.score DESC, chunk_id LIMIT 20")
def search_with_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(_hybrid(spark, sf_dir), 20, "chunk_id", by="score").select("chunk_id", "uri", F.round("score", 6).alias("score"))


@query(HYBRID + """, top AS (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 50), h AS (SELECT doc, max(score) AS best FROM (SELECT * FROM top ORDER BY score DESC, chunk_id LIMIT 10) GROUP BY doc)
SELECT chunk_id, round(score * CASE WHEN best IS NOT NULL AND score < 0.9::DOUBLE * best THEN CASE WHEN best <= 0.4 THEN 1.05::DOUBLE ELSE 1.5::DOUBLE END ELSE 1.0::DOUBLE END, 6) AS score FROM top LEFT JOIN h USING (doc)""")
def related_entity_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.top(_hybrid(spark, sf_dir), 50, "chunk_id", by="score")
    return r.related_boost(rows, "doc", "score", 50, "chunk_id").select("chunk_id", F.round("score", 6).alias("score"))


@query(HYBRID + """, best AS (SELECT doc, max(score) AS score, count(*) AS n_chunks, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) AS chunks FROM (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 50) GROUP BY doc)
SELECT doc, n_chunks, chunks, round(score, 6) AS score FROM best""")
def grouped_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one entity become one passage: parts in order, best score."""
    rows = retrieval.top(_hybrid(spark, sf_dir), 50, "chunk_id", by="score")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("chunk_id")), lambda x: x.cast("string")), ",")
    return rows.groupBy("doc").agg(F.round(F.max("score"), 6).alias("score"), F.count(F.lit(1)).alias("n_chunks"), ids.alias("chunks"))


@query(with_sql("entities") + " SELECT name FROM entities e WHERE NOT EXISTS (SELECT 1 FROM entities i WHERE i.file = e.file AND i.entity_id <> e.entity_id AND e.start_line <= i.start_line AND e.end_line >= i.end_line AND e.end_line - e.start_line > i.end_line - i.start_line)")
def drop_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.drop_containers(frame(spark, "entities", sf_dir)).select("name")


@query(BASE + " SELECT chunk_id, round(similarity, 6) AS similarity FROM chunks WHERE confidence >= 0.4 AND uri IN (SELECT uri FROM wanted) ORDER BY chunks.similarity DESC, chunk_id LIMIT 10")
def search_by_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return r.search_by_concept(chunks.select("chunk_id", "similarity"), chunks, _wanted(spark).select("uri"), 10).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query(BASE + ", d AS (SELECT doc FROM chunks GROUP BY doc HAVING avg(confidence) >= 0.5), k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY similarity DESC, chunk_id) AS rn FROM chunks WHERE doc IN (SELECT doc FROM d)) SELECT doc, chunk_id, round(similarity, 6) AS similarity FROM k WHERE rn <= 3 ORDER BY k.similarity DESC, chunk_id LIMIT 10")
def search_in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that belong to the domain with confidence; three passages of each, then the best."""
    chunks = _chunks(spark, sf_dir)
    inside = chunks.groupBy("doc").agg(F.avg("confidence").alias("c")).filter("c >= 0.5")
    rows = retrieval.top_per(chunks.join(inside, "doc", "left_semi"), "doc", 3, "chunk_id")
    return retrieval.top(rows, 10, "chunk_id").select("doc", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query(BASE + """, hits AS (SELECT k.*, w.confidence AS wc, row_number() OVER (PARTITION BY k.uri ORDER BY similarity DESC, chunk_id) AS rn FROM chunks k JOIN wanted w USING (uri) WHERE k.confidence >= 0.3),
b AS (SELECT chunk_id, max(0.7::DOUBLE * similarity + 0.3::DOUBLE * wc) AS score FROM hits WHERE rn <= 4 GROUP BY 1) SELECT chunk_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, chunk_id LIMIT 6""")
def auto_concept_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detected concept is searched for max(2, k / 3) + 2 chunks; similarity and the concept's confidence are combined. One job for all concepts."""
    hits = _chunks(spark, sf_dir).filter("confidence >= 0.3").join(_wanted(spark).withColumnRenamed("confidence", "wc"), "uri")
    rows = retrieval.top_per(hits, "uri", 4, "chunk_id").groupBy("chunk_id").agg(F.max(0.7 * F.col("similarity") + 0.3 * F.col("wc")).alias("score"))
    return retrieval.top(rows, 6, "chunk_id", by="score").select("chunk_id", F.round("score", 6).alias("score"))


@query(BASE + """, rel(src, dst, c) AS (VALUES ('l#0', 'l#2', 0.8::DOUBLE), ('l#0', 'l#3', 0.5::DOUBLE), ('l#9', 'l#5', 0.9::DOUBLE)), hits AS (SELECT k.chunk_id, k.similarity, row_number() OVER (PARTITION BY k.uri ORDER BY similarity DESC, chunk_id) AS rn FROM chunks k JOIN rel ON rel.dst = k.uri WHERE src = 'l#0' AND k.confidence >= 0.4)
SELECT chunk_id, round(similarity, 6) AS similarity FROM hits WHERE rn <= 3""")
def search_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = spark.createDataFrame([("l#0", "l#2", 0.8), ("l#0", "l#3", 0.5), ("l#9", "l#5", 0.9)], "src string, uri string, c double").filter("src = 'l#0'")
    return retrieval.top_per(_chunks(spark, sf_dir).filter("confidence >= 0.4").join(rel, "uri"), "uri", 3, "chunk_id").select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH p AS (SELECT 'o' || l_orderkey || '_part_' || l_linenumber AS name, l_linenumber AS part, l_linenumber * 10 AS s, l_linenumber * 10 + 9 AS e, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS total, l_orderkey, l_quantity FROM lineitem), k AS (SELECT * FROM p WHERE l_quantity > 5)
SELECT 'o' || l_orderkey AS base, min(s) AS start_line, max(e) AS end_line, any_value(total) AS total, count(DISTINCT part) = any_value(total) AS complete, count(DISTINCT part)::INTEGER AS n_parts FROM k GROUP BY l_orderkey""")
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for split entities, line items for their parts; parts with small quantities are missing."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").withColumn("total", F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))).filter("l_quantity > 5")
    parts = rows.select(F.concat(F.lit("o"), "l_orderkey", F.lit("_part_"), "l_linenumber").alias("name"), F.col("l_linenumber").alias("part"), (F.col("l_linenumber") * 10).alias("start_line"), (F.col("l_linenumber") * 10 + 9).alias("end_line"), "total")
    return r.group_parts(parts)


@query(BASE + " SELECT doc, chunk_id, round(similarity, 6) AS similarity FROM chunks QUALIFY row_number() OVER (PARTITION BY doc ORDER BY confidence DESC, chunk_id) = 1")
def primary_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of each document: its chunk of greatest confidence."""
    best = F.min_by(F.struct("chunk_id", "similarity"), F.struct(-F.col("confidence"), F.col("chunk_id"))).alias("best")
    return _chunks(spark, sf_dir).groupBy("doc").agg(best).select("doc", "best.chunk_id", F.round("best.similarity", 6).alias("similarity"))


@query(HYBRID + ", t AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS n FROM s), d AS (SELECT n, '--SOURCE ' || n || ' (' || doc || ':' || chunk_id || ')' AS head FROM t WHERE n <= 5) SELECT string_agg(head, chr(10) ORDER BY n) AS context FROM d")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.top(_hybrid(spark, sf_dir), 5, "chunk_id", by="score").withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
    head = F.struct("n", F.format_string("--SOURCE %d (%d:%d)", "n", "doc", "chunk_id").alias("h"))
    return top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(head)), lambda x: x["h"]), "\n").alias("context"))
