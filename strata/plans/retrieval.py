"""Queries over the embeddings table: exact and coarse-to-fine retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import vectors as v
from strata.operators import retrieval as r
from strata.plans.registry import query, table

COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
DOT = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
SCORED = f"scored AS (SELECT e.vec_id, e.label, {COS} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
LEVELS = ("document", "section", "paragraph")
LEVEL_SQL = "CASE label % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'section' ELSE 'paragraph' END"


def _scored(spark: SparkSession, sf_dir: str, measure=v.cosine) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return r.scored(rows, r.query_vector(rows, "vec_id", 0), measure)


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.round("similarity", 6).alias("similarity"))


def level() -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("label") % 3 + 1).cast("int"))


@query(f"SELECT vec_id, label, round({DOT}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {DOT} DESC, vec_id LIMIT 10".replace("SELECT vec_id, label", "SELECT e.vec_id, e.label").replace("DESC, vec_id", "DESC, e.vec_id"))
def vector_topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(r.top(_scored(spark, sf_dir, v.dot), 10, "vec_id"), "vec_id", "label")


@query(f"WITH {SCORED} SELECT vec_id, label, round(similarity, 6) AS similarity FROM scored ORDER BY scored.similarity DESC, vec_id LIMIT 10")
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(r.top(_scored(spark, sf_dir), 10, "vec_id"), "vec_id", "label")


@query(f"""WITH {SCORED}, ranked AS (SELECT s.*, d.lang, d.source, d.n_chars FROM scored s JOIN documents d ON d.doc_id = s.vec_id),
fetched AS (SELECT * FROM ranked ORDER BY similarity DESC, vec_id LIMIT 60)
SELECT vec_id, lang, source, round(similarity, 6) AS similarity FROM fetched WHERE lang = 'en' AND n_chars >= 500 ORDER BY fetched.similarity DESC, vec_id LIMIT 20""")
def retrieve_with_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source", "n_chars")
    rows = _scored(spark, sf_dir).join(docs, "vec_id")
    return _rounded(r.retrieve_with_filters(rows, (F.col("lang") == "en") & (F.col("n_chars") >= 500), 20, "vec_id"), "vec_id", "lang", "source")


@query(f"""WITH {SCORED} SELECT vec_id, source, round(similarity, 6) AS similarity FROM scored s JOIN documents d ON d.doc_id = s.vec_id
WHERE source IN ('src1', 'src2', 'src3') ORDER BY s.similarity DESC, vec_id LIMIT 10""")
def retrieve_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    rows = _scored(spark, sf_dir).join(docs, "vec_id")
    return _rounded(r.retrieve_with_filters(rows, F.col("source").isin("src1", "src2", "src3"), 10, "vec_id", pre_filter=True), "vec_id", "source")


@query(f"""WITH {SCORED}, fetched AS (SELECT * FROM scored ORDER BY similarity DESC, vec_id LIMIT 20),
boosted AS (SELECT vec_id, label, similarity * CASE WHEN label % 3 = 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN label % 3 = 1 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN vec_id % 7 = 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS s FROM fetched)
SELECT vec_id, label, round(s, 6) AS similarity FROM boosted ORDER BY s DESC, vec_id LIMIT 10""")
def structure_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.structure_boost(_scored(spark, sf_dir), F.col("label") % 3 == 0, F.col("label") % 3 == 1, F.col("vec_id") % 7 == 0, 10, "vec_id")
    return _rounded(rows, "vec_id", "label")


@query(f"""WITH {SCORED}, ranked AS (SELECT vec_id, {LEVEL_SQL} AS chunk_level, similarity, row_number() OVER (PARTITION BY {LEVEL_SQL} ORDER BY similarity DESC, vec_id) AS rank FROM scored)
SELECT chunk_level, vec_id, rank, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 5""")
def level_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(r.top_per(_scored(spark, sf_dir).withColumn("chunk_level", level()), "chunk_level", 5, "vec_id"), "chunk_level", "vec_id", "rank")


@query(f"""WITH {SCORED}, named AS (SELECT *, CASE WHEN label % 2 = 0 THEN NULL ELSE 'component' END AS conceptual, {LEVEL_SQL} AS chunk_level FROM scored),
mapped AS (SELECT *, coalesce(conceptual, CASE chunk_level WHEN 'document' THEN 'container' WHEN 'section' THEN 'component' ELSE 'detail' END) AS conceptual_level FROM named),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conceptual_level ORDER BY similarity DESC, vec_id) AS rank FROM mapped)
SELECT conceptual_level, vec_id, rank, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 3""")
def conceptual_level_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = F.element_at(F.create_map(*map(F.lit, ("document", "container", "section", "component", "paragraph", "detail"))), level())
    rows = _scored(spark, sf_dir).withColumn("conceptual_level", F.coalesce(F.when(F.col("label") % 2 != 0, F.lit("component")), mapped))
    return _rounded(r.top_per(rows, "conceptual_level", 3, "vec_id"), "conceptual_level", "vec_id", "rank")


@query(f"""WITH {SCORED}, ranked AS (SELECT vec_id, {LEVEL_SQL} AS chunk_level, similarity, row_number() OVER (PARTITION BY {LEVEL_SQL} ORDER BY similarity DESC, vec_id) AS rank FROM scored),
kept AS (SELECT * FROM ranked WHERE rank <= 3)
SELECT CAST(row_number() OVER (ORDER BY CASE chunk_level WHEN 'document' THEN 1 WHEN 'section' THEN 2 ELSE 3 END, rank) AS INTEGER) AS source_index, chunk_level, vec_id AS document_id, lang, substr(text, 1, 40) AS passage, round(similarity, 6) AS similarity FROM kept JOIN documents d ON d.doc_id = kept.vec_id""")
def hierarchical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-level hits first, texts joined to the few that stay."""
    from pyspark.sql import Window

    hits = r.top_per(_scored(spark, sf_dir).withColumn("chunk_level", level()), "chunk_level", 3, "vec_id").drop("embedding")
    order = Window.orderBy(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("chunk_level")), "rank")
    rows = table(spark, sf_dir, "documents").join(F.broadcast(hits), F.col("doc_id") == F.col("vec_id"))
    return _rounded(rows.withColumn("source_index", F.row_number().over(order)), "source_index", "chunk_level", F.col("vec_id").alias("document_id"), "lang", F.substring("text", 1, 40).alias("passage"))


@query()
def wavelet_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return _rounded(r.wavelet_cascade(rows, r.query_vector(rows, "vec_id", 0), 10, 5, "vec_id"), "vec_id")


@query("""WITH pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS row_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, row_id) AS rank FROM pairs)
SELECT query_id, row_id, rank, round(s, 6) AS similarity FROM ranked WHERE rank <= 10""")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return _rounded(r.batch_top_k(rows, rows.filter("vec_id % 50 = 0"), 10, row_id="vec_id", query_id="vec_id"), "query_id", "row_id", "rank")


@query("""WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round((v[1] + v[2]) / sqrt(2.0), 6) AS approx_first, round((v[63] - v[64]) / sqrt(2.0), 6) AS detail_last, 32 AS n_approx FROM n""")
def dwt_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.norm("embedding").alias("norm"), v.haar("embedding").alias("a"), v.haar("embedding", -1).alias("d"))
    return rows.select("vec_id", F.round("norm", 6).alias("norm"), F.round(F.col("a")[0], 6).alias("approx_first"), F.round(F.element_at("d", -1), 6).alias("detail_last"), F.size("a").alias("n_approx"))


@query("""WITH m AS (SELECT vec_id // 5 AS doc_id, count(*) AS n_chunks, """ + ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS m{i}" for i in range(64)) + """ FROM embeddings GROUP BY 1),
v AS (SELECT doc_id, n_chunks, [""" + ", ".join(f"m{i}" for i in range(64)) + """] AS v FROM m), u AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v)
SELECT doc_id, n_chunks, round(v[1] / norm, 5) AS first, round(v[64] / norm, 5) AS last, round(norm, 5) AS mean_norm FROM u""")
def document_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a document's chunk vectors, normalised."""
    rows = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 5").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_chunks"), v.mean_of("embedding", 64).alias("m"))
    u = rows.withColumn("u", v.unit("m"))
    return u.select("doc_id", "n_chunks", F.round(F.col("u")[0], 5).alias("first"), F.round(F.col("u")[63], 5).alias("last"), F.round(v.norm("m"), 5).alias("mean_norm"))


@query("SELECT label, count(*) AS members, " + ", ".join(f"round(avg(embedding[{i + 1}]::DOUBLE), 6) AS c{i}" for i in range(8)) + " FROM embeddings GROUP BY label")
def domain_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("members"), *(F.round(v.mean_vector("embedding", i + 1), 6).alias(f"c{i}") for i in range(8)))


@query("""SELECT e.vec_id, e.label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id AND d.lang = 'en')""")
def incremental_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have no stored vector yet: the English documents stand for those stored."""
    stored = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").join(stored, "vec_id", "left_anti").select("vec_id", "label")


_FIRST = " + ".join(f"({c!r}::DOUBLE) * v[{i}]" for c, i in zip(v.LOW_PASS["db3"], (2, 1, 1, 2, 3, 4), strict=True))


@query(f"WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round({_FIRST}, 6) AS approx_first, 34 AS n_approx FROM n")
def dwt_long_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.dwt("embedding", "db3").alias("a"))
    return rows.select("vec_id", F.round(F.col("a")[0], 6).alias("approx_first"), F.size("a").alias("n_approx"))
