"""Corpus-wide aggregations: concepts, themes, statistics, deduplication, scopes, incremental loads, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators import metrics
from strata.plans.derived import frame, with_sql
from strata.plans.registry import query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT source AS uri, count(*) AS n, round(avg((n_chars % 100) / 100.0::DOUBLE), 6) AS mean_confidence, count(DISTINCT lang) AS documents, round(count(*) * avg((n_chars % 100) / 100.0::DOUBLE) * count(DISTINCT lang), 4) AS importance FROM documents GROUP BY source")
def global_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per concept: occurrences, mean confidence, documents; importance is their product."""
    c = (F.col("n_chars") % 100) / 100.0
    g = _docs(spark, sf_dir).groupBy(F.col("source").alias("uri")).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("m"), F.countDistinct("lang").alias("documents"))
    return g.select("uri", "n", F.round("m", 6).alias("mean_confidence"), "documents", F.round(F.col("n") * F.col("m") * F.col("documents"), 4).alias("importance"))


@query("WITH c AS (SELECT lang, source, count(*) AS n, avg(n_chars) AS m FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n * m DESC, source) AS rank FROM c) SELECT lang, source, n, rank FROM r WHERE rank <= 5")
def document_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _docs(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("m"))
    order = Window.partitionBy("lang").orderBy(F.desc(F.col("n") * F.col("m")), "source")
    return c.withColumn("rank", F.row_number().over(order).cast("bigint")).filter("rank <= 5").select("lang", "source", "n", "rank")


@query("SELECT 'file_type' AS kind, lang AS name, count(*) AS n FROM documents GROUP BY lang HAVING count(*) > 1 UNION ALL SELECT * FROM (SELECT 'concept', source, count(*) FROM documents GROUP BY source HAVING count(*) > 1 ORDER BY count(*) DESC, source LIMIT 5)")
def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    types = d.groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("file_type").alias("kind"), "name", "n")
    concepts = d.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "name").limit(5).select(F.lit("concept").alias("kind"), "name", "n")
    return types.unionByName(concepts)


@query("SELECT count(*) AS documents, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS types, count(DISTINCT source) AS projects, round(avg(n_chars), 4) AS mean_chars FROM documents")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("types"), F.countDistinct("source").alias("projects"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("SELECT r_name AS domain, count(DISTINCT n_nationkey) AS subdomains, count(c_custkey) AS members FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def domain_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.col("r_name").alias("domain")).agg(F.countDistinct("n_nationkey").alias("subdomains"), F.count("c_custkey").alias("members"))


@query("WITH f AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents), k AS (SELECT * FROM f WHERE rn = 1) SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT AS chunk_index, count(*) OVER (PARTITION BY source) AS total FROM k")
def chunk_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per content hash (the first), renumbered per document in order, with the total."""
    first = _docs(spark, sf_dir).groupBy(F.md5("text").alias("h")).agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("k")).select("k.*")
    w = Window.partitionBy("source")
    return first.withColumn("chunk_index", F.row_number().over(w.orderBy("doc_id")).cast("bigint") - 1).withColumn("total", F.count(F.lit(1)).over(w))


@query("SELECT lang, mode(source) AS source, count(*) AS n FROM (SELECT lang, source FROM documents WHERE source = 'src1') GROUP BY lang")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.operators.scopes import in_scope

    rows = in_scope(_docs(spark, sf_dir), "project:SRC1", project="source", kind="lang")
    return rows.groupBy("lang").agg(F.max("source").alias("source"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'fr' AND source <> 'src2'")
def remove_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter("lang = 'fr'").filter(F.col("source") != "src2").select("doc_id", "source")


@query("SELECT l.quality, l.toxic, count(*) AS n FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY ALL")
def label_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT doc_id, toxic, contains(lower(text), 'idiot') OR contains(lower(text), 'scum') OR contains(lower(text), 'moron') AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE p AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (WHERE p AND toxic = 0)::DOUBLE AS fp, count(*) FILTER (WHERE NOT p AND toxic = 1)::DOUBLE AS fn FROM s) SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(_docs(spark, sf_dir), "doc_id")
    hit = F.lower("text").rlike("idiot|scum|moron")
    return metrics.precision_recall(rows, hit, F.col("toxic") == 1)


@query("""WITH n AS (SELECT count(*) FILTER (c_custkey % 3 <> 0) AS d, count(*) FILTER (c_custkey % 2 = 0) AS g, count(*) FILTER (c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AND c_custkey % 8 <> 0) AS tp FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT 'triples' AS kind, round(tp / d::DOUBLE, 6) AS precision, round(tp / g::DOUBLE, 6) AS recall, round(2.0::DOUBLE * tp / (d + g), 6) AS f1 FROM n""")
def kg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.triple_metrics(frame(spark, "triples_detected", sf_dir), frame(spark, "triples_gold", sf_dir)).select(F.lit("triples").alias("kind"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT count(*) AS n, (SELECT count(*) FROM (SELECT source FROM documents WHERE lang = 'en' EXCEPT SELECT source FROM documents WHERE lang = 'fr')) AS only_en, (SELECT count(*) FROM (SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'fr')) AS common FROM (SELECT DISTINCT source FROM documents)")
def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    en, fr = (d.filter(F.col("lang") == k).select("source").distinct() for k in ("en", "fr"))
    n = d.agg(F.countDistinct("source").alias("n"))
    return n.crossJoin(en.exceptAll(fr).agg(F.count(F.lit(1)).alias("only_en"))).crossJoin(en.intersect(fr).agg(F.count(F.lit(1)).alias("common")))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS questions, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def conversation_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("questions"), F.sum(tokens).cast("bigint").alias("tokens"))


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.page')) AS with_page FROM events GROUP BY event_type")
def json_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.page")).alias("with_page"))


@query("SELECT source, role, confidence FROM (SELECT source, CASE WHEN count(*) > 1 THEN 'primary' ELSE 'supporting' END AS role, round(least(1.0::DOUBLE, count(*) / 3.0::DOUBLE), 6) AS confidence FROM documents WHERE lang = 'es' GROUP BY source)")
def agent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return _docs(spark, sf_dir).filter("lang = 'es'").groupBy("source").agg(F.when(n > 1, "primary").otherwise("supporting").alias("role"), F.round(F.least(F.lit(1.0), n / 3.0), 6).alias("confidence"))


@query(with_sql("entity_concepts") + " SELECT count(*) AS total, count(DISTINCT label) AS distinct_labels, round(avg(confidence), 6) AS mean_confidence FROM entity_concepts")
def concept_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "entity_concepts", sf_dir).agg(F.count(F.lit(1)).alias("total"), F.countDistinct("label").alias("distinct_labels"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("SELECT n_name AS directory, count(*) AS files FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name ORDER BY files DESC, directory LIMIT 5")
def file_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("directory")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "directory").limit(5)
