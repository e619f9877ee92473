"""Queries on associative memory: label centroids of the embeddings are the stored patterns, labels the concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import vectors as v
from strata.operators import domains as d
from strata.operators import memory as m
from strata.plans.registry import query, table

PATTERNS = "patterns AS (SELECT label, [" + ", ".join(f"avg(embedding[{i + 1}]::DOUBLE)" for i in range(64)) + "] AS p FROM embeddings GROUP BY label)"
PAIRS = f"{PATTERNS}, pairs AS (SELECT e.vec_id, p.label, list_cosine_similarity(e.embedding::DOUBLE[], p.p) AS s FROM embeddings e, patterns p)"
PEAK = "peak AS (SELECT *, max(s) OVER (PARTITION BY vec_id) AS mx FROM pairs)"
HIERARCHY = "hierarchy AS (SELECT label, CASE WHEN label < 3 THEN 1 WHEN label < 6 THEN 2 ELSE 3 END AS level, CASE WHEN label < 3 THEN NULL ELSE label - 3 END AS parent FROM (SELECT DISTINCT label FROM embeddings))"


def patterns(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(v.mean_of("embedding", 64).alias("embedding"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return m.similarities(rows.select("vec_id", "embedding"), patterns(rows), state="vec_id", pattern="label")


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a three-level hierarchy: 0-2 are roots and label l + 3 is below label l."""
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    return labels.select("label", F.when(F.col("label") < 3, 1).when(F.col("label") < 6, 2).otherwise(3).alias("level"), F.when(F.col("label") >= 3, F.col("label") - 3).alias("parent"))


def _round(rows: DataFrame, *columns: str, value: str = "confidence", digits: int = 6) -> DataFrame:
    return rows.select(*columns, F.round(value, digits).alias(value))


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rank FROM pairs)
SELECT vec_id, label, rank, round((s + 1) / 2, 6) AS confidence FROM r WHERE rank <= 3""")
def hopfield_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    near = d.nearest(rows.select("vec_id", "embedding"), patterns(rows), 3, state="vec_id", pattern="label")
    return _round(near.withColumn("confidence", (F.col("similarity") + 1) / 2), "vec_id", "label", "rank")


@query(f"""WITH {PAIRS}, {PEAK}, w AS (SELECT vec_id, label, exp(22.0::DOUBLE * (s - mx)) AS e FROM peak)
SELECT vec_id, label, round(e / sum(e) OVER (PARTITION BY vec_id), 4) AS weight FROM w""")
def hopfield_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(m.attention(pairs(spark, sf_dir), "vec_id"), "vec_id", "label", value="weight", digits=4)


@query(f"""WITH {PAIRS}, {PEAK}, w AS (SELECT vec_id, label, exp(22.0::DOUBLE * (s - mx)) AS e FROM peak), a AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS weight FROM w),
x AS (SELECT a.vec_id, [""" + ", ".join(f"sum(weight * p[{i + 1}])" for i in range(64)) + """] AS v FROM a JOIN patterns USING (label) GROUP BY a.vec_id), u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM x)
SELECT vec_id, round(v[1] / n, 4) AS first, round(v[64] / n, 4) AS last FROM u""")
def hopfield_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    out = m.iterate(rows.select("vec_id", "embedding"), patterns(rows), 1, state="vec_id", pattern="label", size=64)
    return out.select("vec_id", F.round(F.col("embedding")[0], 4).alias("first"), F.round(F.col("embedding")[63], 4).alias("last"))


@query(f"""WITH {PAIRS}, {PEAK}, z AS (SELECT vec_id, -(max(mx) + ln(sum(exp(22.0::DOUBLE * (s - mx)))) / 22.0::DOUBLE) AS e FROM peak GROUP BY vec_id)
SELECT vec_id, round(e, 4) AS energy, round(exp(-e) / (1 + exp(-e)), 4) AS confidence FROM z""")
def hopfield_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return d.energies(rows.select("vec_id", "embedding"), patterns(rows), state="vec_id").select("vec_id", F.round("energy", 4).alias("energy"), F.round("confidence", 4).alias("confidence"))


@query()
def hopfield_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three retrieval steps and the energy after them."""
    rows = table(spark, sf_dir, "embeddings")
    states = m.iterate(rows.select("vec_id", "embedding"), patterns(rows), 3, state="vec_id", pattern="label", size=64)
    return d.energies(states, patterns(rows), state="vec_id").select("vec_id", F.round("energy", 4).alias("energy"))


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rank FROM pairs WHERE s >= 0.3)
SELECT vec_id, label, rank, round(s, 6) AS similarity FROM r WHERE rank <= 5""")
def classify_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    near = d.nearest(rows.select("vec_id", "embedding"), patterns(rows), 5, state="vec_id", pattern="label", least=0.3)
    return _round(near, "vec_id", "label", "rank", value="similarity")


_STEP = "SELECT *, row_number() OVER (PARTITION BY vec_id, parent ORDER BY c DESC, label) AS rn FROM"
CASCADE = f"""WITH {PAIRS}, {HIERARCHY}, ok AS (SELECT vec_id, p.label, (s + 1) / 2 AS c, level, parent FROM pairs p JOIN hierarchy h USING (label) WHERE (s + 1) / 2 >= 0.5),
l1 AS ({_STEP} (SELECT *, label::VARCHAR AS path FROM ok WHERE level = 1) QUALIFY rn <= 3),
l2 AS ({_STEP} (SELECT o.*, a.path || '/' || o.label AS path FROM ok o JOIN l1 a ON a.vec_id = o.vec_id AND a.label = o.parent WHERE o.level = 2) QUALIFY rn <= 3),
l3 AS ({_STEP} (SELECT o.*, a.path || '/' || o.label AS path FROM ok o JOIN l2 a ON a.vec_id = o.vec_id AND a.label = o.parent WHERE o.level = 3) QUALIFY rn <= 3),
flat AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.classify_cascade(pairs(spark, sf_dir), hierarchy(spark, sf_dir), 3, state="vec_id", pattern="label")


@query(f"{CASCADE} SELECT vec_id, label, level, round(c, 6) AS confidence FROM flat")
def classify_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_cascade(spark, sf_dir), "vec_id", "label", "level")


@query(f"{CASCADE} SELECT vec_id, path, level FROM flat")
def flatten_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).select("vec_id", "path", "level")


AUTO = f"""WITH {PAIRS}, {HIERARCHY}, r AS (SELECT vec_id, p.label, level, (s + 1) / 2 AS c, row_number() OVER (PARTITION BY vec_id ORDER BY level DESC, (s + 1) / 2 DESC, p.label) AS rank FROM pairs p JOIN hierarchy USING (label) WHERE (s + 1) / 2 >= 0.5)"""


@query(f"{AUTO} SELECT vec_id, label, level, rank, round(c, 6) AS confidence FROM r WHERE rank <= 4")
def auto_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(m.auto_detect(pairs(spark, sf_dir), hierarchy(spark, sf_dir), state="vec_id", pattern="label", most=4, least=0.5), "vec_id", "label", "level", "rank")


@query(CASCADE.replace("flat AS", "up AS (SELECT vec_id, p.label, (s + 1) / 2 AS c, row_number() OVER (PARTITION BY vec_id ORDER BY level DESC, (s + 1) / 2 DESC, p.label) AS rank FROM pairs p JOIN hierarchy USING (label) WHERE (s + 1) / 2 >= 0.5), flat AS") + """,
merged AS (SELECT vec_id, label, max(c) AS c FROM (SELECT vec_id, label, c FROM flat UNION ALL SELECT vec_id, label, c FROM up WHERE rank <= 4) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS rank FROM merged) SELECT vec_id, label, rank, round(c, 6) AS confidence FROM best WHERE rank <= 10""")
def smart_concept_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = m.auto_detect(pairs(spark, sf_dir), hierarchy(spark, sf_dir), state="vec_id", pattern="label", most=4, least=0.5)
    return _round(m.smart_detection(up, _cascade(spark, sf_dir), state="vec_id", pattern="label"), "vec_id", "label", "rank")


@query(f"""WITH {PAIRS}, near AS (SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rn FROM pairs WHERE vec_id % 50 = 0) WHERE rn <= 4),
inside AS (SELECT n.vec_id, n.label, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM near n JOIN embeddings e ON e.label = n.label JOIN embeddings q ON q.vec_id = n.vec_id),
pk AS (SELECT *, max(s) OVER (PARTITION BY vec_id, label) AS mx FROM inside), z AS (SELECT vec_id, label, -(max(mx) + ln(sum(exp(22.0::DOUBLE * (s - mx)))) / 22.0::DOUBLE) AS e FROM pk GROUP BY ALL),
r AS (SELECT vec_id, label, exp(-e) / (1 + exp(-e)) AS c, row_number() OVER (PARTITION BY vec_id ORDER BY exp(-e) / (1 + exp(-e)) DESC, label) AS rank FROM z)
SELECT vec_id, label, rank, round(c, 4) AS confidence FROM r WHERE rank <= 2""")
def domain_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    out = d.domain_classify(rows.filter("vec_id % 50 = 0").select("vec_id", "embedding"), patterns(rows), rows.select("label", "embedding"), state="vec_id", domain="label", k=2)
    return _round(out, "vec_id", "label", "rank", digits=4)


MEMORY = f"""WITH {HIERARCHY}, c AS (SELECT q.vec_id, e.label, -(1 + ln(sum(exp(22.0::DOUBLE * (list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) - 1)))) / 22.0::DOUBLE) AS e FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ok AS (SELECT vec_id, c.label, parent, level, exp(-e) / (1 + exp(-e)) AS c FROM c JOIN hierarchy USING (label) WHERE exp(-e) / (1 + exp(-e)) >= 0.5)"""


@query(MEMORY + f""", l1 AS ({_STEP} (SELECT *, label::VARCHAR AS path FROM ok WHERE level = 1) QUALIFY rn <= 2), l2 AS ({_STEP} (SELECT o.*, a.path || '/' || o.label AS path FROM ok o JOIN l1 a ON a.vec_id = o.vec_id AND a.label = o.parent) QUALIFY rn <= 2), l3 AS ({_STEP} (SELECT o.*, a.path || '/' || o.label AS path FROM ok o JOIN l2 a ON a.vec_id = o.vec_id AND a.label = o.parent) QUALIFY rn <= 2),
l4 AS ({_STEP} (SELECT o.*, a.path || '/' || o.label AS path FROM ok o JOIN l3 a ON a.vec_id = o.vec_id AND a.label = o.parent) QUALIFY rn <= 2)
SELECT vec_id, label, n AS level, round(c, 6) AS confidence, path FROM (SELECT *, 1 AS n FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3 UNION ALL SELECT *, 4 FROM l4)""")
def domain_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    out = d.domain_cascade(rows.filter("vec_id % 50 = 0"), hierarchy(spark, sf_dir), rows.select("label", "embedding"), state="vec_id", domain="label", k=2)
    return _round(out, "vec_id", "label", "level", "path")


@query()
def context_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twenty chunks are one context."""
    rows = table(spark, sf_dir, "embeddings").withColumn("context", F.expr("vec_id div 20"))
    return m.leader_clusters(rows, "context", "vec_id", least=0.2)
