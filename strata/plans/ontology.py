"""Queries on ontologies that the geography of the given tables makes: axioms, Turtle texts, and the hierarchy down to customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import ontology as o
from strata.plans.derived import frame, with_sql
from strata.plans.registry import query, table
from strata.sources import turtle

PREFIXES = """@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
@prefix ex: <http://example.org/o#> .
"""

AX = with_sql("axioms")
CLOSE = AX + """, up AS (SELECT DISTINCT source AS child, target AS parent FROM axioms WHERE type = 'subsumption'), reach(start, node, d) AS (SELECT parent, child, 1 FROM up UNION SELECT r.start, u.child, r.d + 1 FROM reach r JOIN up u ON u.parent = r.node WHERE r.d < 8),
near AS (SELECT DISTINCT uri, neighbor FROM (SELECT source AS uri, target AS neighbor FROM axioms UNION ALL SELECT target, source FROM axioms) WHERE uri <> neighbor)"""


SPACE = "regexp_extract({0}, '^(.*[#/])[^#/]*$', 1)"


def _axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "axioms", sf_dir)


def turtle_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of a Turtle text for each region, nation and supplier."""
    return turtle.triples(frame(spark, "turtle", sf_dir).select("file", F.concat(F.lit(PREFIXES), "body").alias("text")))


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers below nations below regions below the world, as axioms."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sub = lambda rows, a, b: rows.select(F.lit("subsumption").alias("type"), a.alias("source"), b.alias("target"))
    people = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    region, country = F.concat(F.lit("geo#"), "r_name"), F.concat(F.lit("geo#"), "n_name")
    return sub(nation, region, F.lit("geo#world")).distinct().unionByName(sub(nation, country, region)).unionByName(sub(people, F.concat(F.lit("geo#"), "c_name"), country))


@query("""WITH g AS (SELECT 'ex:' || n_name AS n, 'ex:' || replace(r_name, ' ', '_') AS r, 'ex:has' || n_name AS p FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT 'subsumption' AS type, n AS source, r AS target FROM g UNION SELECT 'subsumption', 'ex:' || replace(s_name, '#', '_'), 'ex:' || n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT 'domain', p, r FROM g UNION SELECT 'range', p, n FROM g""")
def load_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.load_axioms(turtle_triples(spark, sf_dir))


@query("""SELECT 'ex:' || replace(r_name, ' ', '_') AS uri, lower(r_name) AS label, 'Region ' || r_name || '.' AS description FROM region UNION SELECT 'ex:' || n_name, lower(n_name), '' FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT 'ex:' || replace(s_name, '#', '_'), replace(s_name, '#', '_'), '' FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def concept_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.concept_semantics(turtle_triples(spark, sf_dir))


@query(CLOSE + """, top AS (SELECT parent AS uri FROM up EXCEPT SELECT child FROM up), far AS (SELECT uri, 1 AS level FROM top UNION ALL SELECT node, d + 1 FROM reach WHERE start IN (SELECT uri FROM top)) SELECT u.uri, coalesce(min(level), 3)::INTEGER AS level FROM (SELECT child AS uri FROM up UNION SELECT parent FROM up) u LEFT JOIN far USING (uri) GROUP BY u.uri""")
def concept_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.concept_levels(_axioms(spark, sf_dir))


@query("""WITH l AS (SELECT 'geo#world' AS uri, 1 AS level UNION ALL SELECT 'geo#' || r_name, 2 FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT 'geo#' || n_name, 3 FROM nation UNION ALL SELECT DISTINCT 'geo#' || c_name, 4 FROM customer) SELECT level, count(*) AS n FROM l GROUP BY level""")
def concept_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.concept_levels(_hierarchy(spark, sf_dir)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(CLOSE + " SELECT DISTINCT start AS ancestor, node AS uri FROM reach WHERE start <> node")
def subconcepts_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.subconcepts(_axioms(spark, sf_dir))


@query("""SELECT ancestor, count(*) AS n FROM (SELECT 'geo#' || r_name AS ancestor FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'geo#' || r_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT 'geo#' || n_name FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT 'geo#world' FROM (SELECT DISTINCT n_regionkey FROM nation) UNION ALL SELECT 'geo#world' FROM nation UNION ALL SELECT 'geo#world' FROM customer) GROUP BY ancestor""")
def subdomain_closure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.subconcepts(_hierarchy(spark, sf_dir)).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'geo#' || n_name AS uri, 'geo#world > geo#' || r_name || ' > geo#' || n_name AS chain FROM nation JOIN region ON n_regionkey = r_regionkey""")
def hierarchy_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.hierarchy_chains(_hierarchy(spark, sf_dir)).filter("size(split(chain, ' > ')) = 3")


@query(CLOSE + """ SELECT 'cycle' AS kind, start AS uri FROM reach WHERE start = node GROUP BY 2 UNION ALL SELECT 'no_domain', 'rel#' || n_name FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT 'no_range', 'rel#' || n_name FROM nation WHERE n_nationkey % 3 > 0""")
def validate_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumn("uri", F.concat(F.lit("rel#"), "n_name"))
    about = lambda kind, k: nation.filter(F.col("n_nationkey") % k == 0).select(F.lit(kind).alias("type"), F.col("uri").alias("source"), F.lit("geo#world").alias("target"))
    axioms = _axioms(spark, sf_dir).unionByName(about("domain", 2)).unionByName(about("range", 3))
    return o.validate(axioms, nation.select("uri"))


@query(CLOSE + " SELECT uri, neighbor FROM near")
def concept_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.neighbors(_axioms(spark, sf_dir))


@query(CLOSE + """, d AS (SELECT uri AS a, neighbor AS b, 1 AS d FROM near UNION ALL SELECT x.uri, y.uri, 2 FROM near x JOIN near y ON x.neighbor = y.neighbor WHERE x.uri <> y.uri
UNION ALL SELECT x.uri, y.uri, CASE WHEN x.uri = y.uri THEN 0 ELSE 3 END FROM (SELECT DISTINCT uri FROM near) x JOIN (SELECT DISTINCT uri FROM near) y ON regexp_extract(x.uri, '^(.*[#/])', 1) = regexp_extract(y.uri, '^(.*[#/])', 1)) SELECT a, b, min(d) AS distance FROM d GROUP BY a, b""")
def ontology_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.distances(_axioms(spark, sf_dir))


@query(CLOSE + """, c AS (SELECT child AS a, parent AS b, 0.8::DOUBLE AS s, 1 AS r FROM up UNION ALL SELECT parent, child, 0.8::DOUBLE, 1 FROM up UNION ALL SELECT source, target, CASE type WHEN 'semantic_equivalent' THEN 0.9::DOUBLE WHEN 'semantic_related' THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END, 2 FROM axioms WHERE type LIKE 'semantic%'
UNION ALL SELECT target, source, CASE type WHEN 'semantic_equivalent' THEN 0.9::DOUBLE WHEN 'semantic_related' THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END, 2 FROM axioms WHERE type LIKE 'semantic%' UNION ALL SELECT x.uri, y.uri, CASE WHEN x.uri = y.uri THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END, CASE WHEN x.uri = y.uri THEN 0 ELSE 3 END FROM (SELECT DISTINCT uri FROM near) x JOIN (SELECT DISTINCT uri FROM near) y ON regexp_extract(x.uri, '^(.*[#/])', 1) = regexp_extract(y.uri, '^(.*[#/])', 1))
SELECT a, b, arg_min(s, (r, -s)) AS score FROM c GROUP BY a, b""")
def pairwise_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.compatibility(_axioms(spark, sf_dir))


@query(with_sql("axioms", "chunk_concepts") + """, f AS (SELECT uri, confidence AS w FROM chunk_concepts UNION ALL SELECT target, 0.5::DOUBLE * confidence FROM chunk_concepts JOIN (SELECT DISTINCT source, target FROM axioms WHERE type = 'subsumption') ON source = uri UNION ALL SELECT target, 0.3::DOUBLE * confidence FROM chunk_concepts JOIN axioms ON source = uri AND type LIKE 'semantic%'),
d AS (SELECT regexp_extract(uri, '^(.*[#/])', 1) AS domain, sum(w) AS w FROM f GROUP BY 1) SELECT domain, round(w / sum(w) OVER (), 6) AS weight FROM d""")
def domain_context_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.domain_context_weights(frame(spark, "chunk_concepts", sf_dir), _axioms(spark, sf_dir)).select("domain", F.round("weight", 6).alias("weight"))


@query(AX + """, u AS (SELECT source AS uri FROM axioms UNION SELECT target FROM axioms), n AS (SELECT regexp_extract(uri, '^(.*[#/])', 1) AS d, count(*) AS n FROM u GROUP BY 1), l AS (SELECT least(regexp_extract(source, '^(.*[#/])', 1), regexp_extract(target, '^(.*[#/])', 1)) AS a, greatest(regexp_extract(source, '^(.*[#/])', 1), regexp_extract(target, '^(.*[#/])', 1)) AS b, count(*) FILTER (type = 'subsumption') AS h, count(*) FILTER (type LIKE 'semantic%') AS r, max((type IN ('semantic_opposite', 'semantic_exclusive'))::INT) AS o FROM axioms GROUP BY 1, 2)
SELECT x.d AS a, y.d AS b, round(0.6::DOUBLE * coalesce(h, 0) / (x.n * y.n) + 0.4::DOUBLE * coalesce(r, 0) / (x.n * y.n) - 0.2::DOUBLE * coalesce(o, 0), 6) AS score FROM n x JOIN n y ON x.d <= y.d LEFT JOIN l ON l.a = x.d AND l.b = y.d""")
def domain_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.domain_compatibility(_axioms(spark, sf_dir)).select("a", "b", F.round("score", 6).alias("score"))


@query("""WITH f AS (SELECT doc_id, source AS label, 'u#' || lang AS uri, (n_chars % 100) / 100.0::DOUBLE AS confidence FROM documents), c(uri, context) AS (VALUES ('u#en', 0.5::DOUBLE), ('u#fr', 0.2::DOUBLE)),
s AS (SELECT doc_id, label, f.uri, confidence + CASE WHEN count(*) OVER (PARTITION BY label) = 1 THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END * coalesce(context, 0.0::DOUBLE) AS score FROM f LEFT JOIN c USING (uri)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, uri) AS rn FROM s) SELECT label, uri, round(score, 6) AS score FROM r WHERE rn = 1""")
def resolve_ambiguities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.lit(0).alias("g"), F.col("source").alias("label"), F.concat(F.lit("u#"), "lang").alias("uri"), ((F.col("n_chars") % 100) / 100.0).alias("confidence"))
    context = spark.createDataFrame([("u#en", 0.5), ("u#fr", 0.2)], "uri string, context double")
    return o.resolve_ambiguities(found, context, "g").select("label", "uri", F.round("score", 6).alias("score"))


@query("""WITH c(label, conf, generic) AS (VALUES ('the', 0.4::DOUBLE, true), ('eine', 0.6::DOUBLE, false)) SELECT doc_id, label, round(conf + least(0.3::DOUBLE, 0.1::DOUBLE * ((length(lower(text)) - length(replace(lower(text), label, ''))) / length(label))) + CASE WHEN contains(substr(lower(text), 1, 200), label) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN generic THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 6) AS dominance FROM documents, c""")
def dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.explode(F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("c"), F.lit(g).alias("generic")) for a, b, g in (("the", 0.4, True), ("eine", 0.6, False)))))
    rows = table(spark, sf_dir, "documents").withColumn("k", listed)
    return rows.select("doc_id", F.col("k.label").alias("label"), F.round(o.dominance(F.col("text"), F.col("k.label"), F.col("k.c"), F.col("k.generic")), 6).alias("dominance"))


@query(with_sql("domain_concepts", "domain_names", "short_names") + """, own AS (SELECT ref, min(c.uri) AS uri FROM short_names s JOIN domain_concepts c ON ends_with(c.uri, s.source || '_' || s.uri) GROUP BY ref),
other AS (SELECT ref, arg_min(c.uri, (domain, c.uri)) AS uri FROM short_names s, domain_names d, domain_concepts c WHERE ends_with(c.uri, d.domain || '_' || s.uri) GROUP BY ref)
SELECT s.ref, CASE WHEN starts_with(s.uri, 'http://') THEN s.uri ELSE coalesce(own.uri, other.uri, s.uri) END AS resolved FROM short_names s LEFT JOIN own USING (ref) LEFT JOIN other USING (ref)""")
def cross_domain_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, listed, domains = (frame(spark, x, sf_dir) for x in ("short_names", "domain_concepts", "domain_names"))
    return o.resolve_across_domains(refs, listed, domains).select("ref", "resolved")
