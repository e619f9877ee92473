"""Queries on converters and on ontologies from several files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import chunking
from strata.operators import ontology as o
from strata.plans.registry import query, table
from strata.plans.samples import sample
from strata.sources import jsonld, office, rdfxml, turtle
from strata.storage import cut, spread


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation as a file: in turn docx, xlsx, pptx, zip of a docx and a note, text, HTML, a broken docx, and an unknown kind."""

    kinds = F.array(*map(F.lit, "docx xlsx pptx zip txt html docx bin".split()))
    kind = F.col("n_nationkey") % 8
    return table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("."), F.element_at(kinds, (kind + 1).cast("int"))).alias("path"), F.udf(sample, "binary")(kind.cast("int"), "n_name").alias("content"))


_WORD = "'## ' || n || chr(10) || chr(10) || b || chr(10) || chr(10) || '* point' || chr(10) || chr(10) || '| key | value |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n || ' | 1 |'"


@query(f"""WITH f AS (SELECT n_name AS n, 'about ' || n_name AS b, n_nationkey % 8 AS k FROM nation)
SELECT n || '.' || ['docx', 'xlsx', 'pptx', 'zip', 'txt', 'html', 'docx', 'bin'][k + 1] AS path, ['docx', 'xlsx', 'pptx', 'zip', 'txt', 'html', 'docx', NULL][k + 1] AS converter, CASE k WHEN 6 THEN 'BadZipFile' END AS error,
CASE k WHEN 0 THEN {_WORD} WHEN 1 THEN '## ' || n || chr(10) || '| name |  | 7 |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || b || ' | in |  |'
WHEN 2 THEN '<!-- Slide number: 1 -->' || chr(10) || '# ' || n || chr(10) || b || chr(10) || '<!-- Slide number: 2 -->' || chr(10) || '![a map](Picture1.jpg)' || chr(10) || '<!-- Slide number: 3 -->' || chr(10) || 'last'
WHEN 3 THEN '## File: a.txt' || chr(10) || chr(10) || b || chr(10) || chr(10) || '## File: b.docx' || chr(10) || chr(10) || {_WORD} WHEN 4 THEN n || chr(10) || chr(10) || b WHEN 5 THEN '# ' || n || chr(10) || chr(10) || b END AS text FROM f""")
def convert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.to_text(_files(spark, sf_dir))


LINKED = {
    "@context": {"rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "ex": "http://example.org/o#", "sub": {"@id": "rdfs:subClassOf"}},
    "@graph": [
        {"@id": "ex:Grid", "@type": "owl:Class", "sub": {"@id": "ex:Thing"}, "rdfs:label": [{"@value": "grid", "@language": "en"}]},
        {"@id": "ex:Thing", "@type": ["owl:Class"]},
        {"@id": "ex:has", "@type": "owl:ObjectProperty", "rdfs:domain": {"@id": "ex:Grid"}, "rdfs:range": [{"@id": "ex:Thing"}]},
        {"sub": {"@id": "ex:Lost"}},
    ],
}
_EX = "http://example.org/o#"


@query(f"SELECT 'subsumption' AS type, '{_EX}' || n_name AS source, '{_EX}Thing' AS target FROM nation UNION ALL SELECT 'domain', '{_EX}has' || n_name, '{_EX}' || n_name FROM nation UNION ALL SELECT 'range', '{_EX}has' || n_name, '{_EX}Thing' FROM nation")
def jsonld_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON-LD text for each nation."""
    text = F.replace(F.replace(F.lit(json.dumps(LINKED)), F.lit("ex:Grid"), F.concat(F.lit("ex:"), "n_name")), F.lit("ex:has"), F.concat(F.lit("ex:has"), "n_name"))
    return o.load_axioms(jsonld.triples(table(spark, sf_dir, "nation").select(text.alias("text"))))


_RDF = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE rdf:RDF [<!ENTITY owl "http://www.w3.org/2002/07/owl#">]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:ex="http://example.org/o#" xml:base="http://example.org/o">
<owl:Class rdf:ID="REGION"><rdfs:label xml:lang="en">REGION</rdfs:label></owl:Class>
<rdf:Description rdf:about="#NATION" rdfs:label="NATION &amp; co"><rdf:type rdf:resource="&owl;Class"/><rdfs:subClassOf rdf:resource="#REGION"/></rdf:Description>
<owl:Class rdf:about="#SUPPLIER"><rdfs:subClassOf><owl:Class rdf:about="#NATION"/></rdfs:subClassOf></owl:Class>
<rdf:Statement><rdf:subject rdf:resource="#SUPPLIER"/><rdf:predicate rdf:resource="#ships"/><rdf:object rdf:resource="#REGION"/></rdf:Statement>
<owl:ObjectProperty rdf:ID="inNATION"><rdfs:domain rdf:resource="#SUPPLIER"/><rdfs:range><owl:Class><owl:unionOf rdf:parseType="Collection"><rdf:Description rdf:about="#NATION"/></owl:unionOf></owl:Class></rdfs:range></owl:ObjectProperty>
</rdf:RDF>"""


def _rdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An RDF/XML text for each supplier, with its nation and region."""
    geography = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey").join(F.broadcast(geography), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.lit(_RDF)
    for word, name in (("SUPPLIER", F.replace("s_name", F.lit("#"), F.lit("_"))), ("NATION", F.replace("n_name", F.lit(" "), F.lit("_"))), ("REGION", F.replace("r_name", F.lit(" "), F.lit("_")))):
        text = F.replace(text, F.lit(word), name)
    return rows.select(text.alias("text"))


_GEO = f"WITH g AS (SELECT '{_EX}' || replace(s_name, '#', '_') AS s, '{_EX}' || replace(n_name, ' ', '_') AS n, '{_EX}' || replace(r_name, ' ', '_') AS r, '{_EX}in' || replace(n_name, ' ', '_') AS p, replace(n_name, ' ', '_') AS nn, replace(r_name, ' ', '_') AS rn FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"


@query(_GEO + """ SELECT r AS s, 'rdf:type' AS p, 'owl:Class' AS o FROM g UNION SELECT n, 'rdf:type', 'owl:Class' FROM g UNION SELECT s, 'rdf:type', 'owl:Class' FROM g UNION SELECT p, 'rdf:type', 'owl:ObjectProperty' FROM g UNION SELECT r, 'rdfs:label', rn FROM g UNION SELECT n, 'rdfs:label', nn || ' & co' FROM g
UNION SELECT n, 'rdfs:subClassOf', r FROM g UNION SELECT s, 'rdfs:subClassOf', n FROM g UNION SELECT p, 'rdfs:domain', s FROM g UNION SELECT s, 'semantic_ships', r FROM g""")
def rdfxml_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.merge(rdfxml.triples(_rdf_texts(spark, sf_dir)))


@query(_GEO + " SELECT 'subsumption' AS type, n AS source, r AS target FROM g UNION SELECT 'subsumption', s, n FROM g UNION SELECT 'domain', p, s FROM g UNION SELECT 'semantic_ships', s, r FROM g")
def rdfxml_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(rdfxml.triples(_rdf_texts(spark, sf_dir)).distinct())  # read by each kind of axiom
    stated = found.filter("p like 'semantic\\_%'").select(F.col("p").alias("type"), F.col("s").alias("source"), F.col("o").alias("target"))
    return o.load_axioms(found).unionByName(stated).distinct()


@query("WITH t AS (SELECT 'r:' || replace(r_name, ' ', '_') AS s, 'is' AS p, 'region' AS o FROM region UNION ALL SELECT 'n:' || n_name, 'in', 'r:' || replace(r_name, ' ', '_') FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'r:' || replace(r_name, ' ', '_'), 'is', 'region' FROM nation JOIN region ON r_regionkey = n_regionkey) SELECT DISTINCT * FROM t")
def ontology_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Turtle file for each region and for each nation; those of nations repeat their region."""
    region, nation = table(spark, sf_dir, "region").withColumn("r_name", F.replace("r_name", F.lit(" "), F.lit("_"))), table(spark, sf_dir, "nation")
    one = region.select(F.concat(F.lit("r:"), "r_name", F.lit(" is region .")).alias("text"))
    two = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("r:"), "r_name", F.lit(" is region .\nn:"), "n_name", F.lit(" in r:"), "r_name", F.lit(" .")).alias("text"))
    return jsonld.merge(turtle.triples(one), turtle.triples(two))


@query("SELECT 'n' || n_nationkey AS uri, CASE WHEN n_nationkey % 5 = 1 THEN lower(n_name) ELSE n_name END AS label FROM nation WHERE n_nationkey % 5 <> 2 UNION ALL SELECT 'new', 'new'")
def concept_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth nation is renamed, every fifth removed, one added."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("uri"), F.col("n_name").alias("label"), (F.col("n_nationkey") % 5).alias("k"))
    changed = n.filter("k in (1, 2)").select("uri", F.lower("label").alias("label"), (F.col("k") == 2).alias("removed"))
    return jsonld.change_concepts(n.select("uri", "label"), changed.unionByName(spark.createDataFrame([("new", "new", False)], changed.schema)))


CODE = "SELECT doc_id, 'module m' || chr(10) || repeat('use a' || chr(10), (doc_id % 9)::INT) || '! note' || chr(10) || repeat(' call b' || chr(10), (doc_id % 7 + 3)::INT) || 'contains' || chr(10) || repeat('write(*)' || chr(10), (doc_id % 8)::INT) || 'end' AS text FROM documents"


@query(f"""WITH d AS ({CODE}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM d),
k AS (SELECT *, CASE WHEN l = 'contains' THEN 'contains' WHEN l LIKE 'use%' THEN 'declarations' WHEN l LIKE ' call%' THEN 'executable' WHEN l LIKE 'write%' THEN 'io' END AS k FROM l),
b AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'code') AS p FROM k), s AS (SELECT *, sum((k IS NOT NULL AND k <> p)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM b),
g AS (SELECT doc_id, s, coalesce(max(k) FILTER (WHERE k <> p), 'code') AS kind, min(n) AS first, max(n) AS last FROM s GROUP BY doc_id, s) SELECT doc_id, kind, first, last FROM g WHERE last - first >= 5 QUALIFY count(*) OVER (PARTITION BY doc_id) > 1""")
def code_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code made from the ids of documents."""
    d = table(spark, sf_dir, "documents")
    times = lambda text, n: F.expr(f"repeat('{text}\\n', cast({n} as int))")
    text = F.concat(F.lit("module m\n"), times("use a", "doc_id % 9"), F.lit("! note\n"), times(" call b", "doc_id % 7 + 3"), F.lit("contains\n"), times("write(*)", "doc_id % 8"), F.lit("end"))
    return chunking.code_sections(d.select("doc_id", text.alias("text")), "doc_id")


PAPER = "SELECT doc_id, '# Paper ' || doc_id || chr(10) || text || chr(10) || '## One' || chr(10) || lang || chr(10) || '### Deep' || chr(10) || 'x' || chr(10) || '## Two' || chr(10) || source AS text FROM documents"


@query(f"""WITH d AS ({PAPER}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM d), h AS (SELECT doc_id, n, length(regexp_extract(l, '^(#{{1,6}})\\s+\\S', 1)) AS level, trim(regexp_extract(l, '^#{{1,6}}\\s+(.*)$', 1)) AS title FROM l WHERE regexp_matches(l, '^#{{1,6}}\\s+\\S')),
e AS (SELECT h.*, coalesce((SELECT min(g.n) FROM h g WHERE g.doc_id = h.doc_id AND g.n > h.n AND g.level <= h.level), (SELECT max(n) + 1 FROM l WHERE l.doc_id = h.doc_id)) - 1 AS last FROM h),
t AS (SELECT e.doc_id, e.level, e.title, e.n AS first, e.last, sum(length(l.l)) + count(*) - 1 AS n_chars FROM e JOIN l ON l.doc_id = e.doc_id AND l.n BETWEEN e.n AND e.last GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS chunk, level, title, first, last, n_chars FROM t WHERE n_chars >= 12""")
def paper_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the first section of a paper."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("# Paper "), F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\n## One\n"), "lang", F.lit("\n### Deep\nx\n## Two\n"), "source")
    return chunking.paper_chunks(d.select("doc_id", text.alias("text")), "doc_id", least=12)
