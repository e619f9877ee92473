"""Queries on contexts: code entities and questions that parts give, and the texts and names of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import contexts as c
from strata.operators import graph as g
from strata.operators import ontology as o
from strata.plans.derived import DERIVED, TABLES, frame, with_sql
from strata.plans.graph import SQL, _all
from strata.plans.ontology import _axioms, turtle_triples
from strata.plans.registry import query, table
from strata.storage import spread

NAMES = "names(label, part) AS (VALUES " + ", ".join(f"('{k}', '{p}')" for k, parts in c.NAME_PARTS.items() for p in parts) + ")"
#: Part names of the driver's table as entities: modules, subroutines and functions by turns.
PARTS = "parts AS (SELECT p_partkey AS entity_id, p_name || ' ' || p_type AS name, CASE p_partkey % 3 WHEN 0 THEN 'module' WHEN 1 THEN 'subroutine' ELSE 'function' END AS etype, p_brand AS file FROM part)"
CHILDREN = ", kids AS (SELECT e.*, (SELECT count(*) FROM parents p WHERE p.parent_id = e.entity_id) AS children FROM fan e)"
NEAR = ", near AS (SELECT DISTINCT uri, neighbor FROM (SELECT source AS uri, target AS neighbor FROM axioms UNION ALL SELECT target, source FROM axioms) WHERE uri <> neighbor)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 3 == 0, "module").when(F.col("p_partkey") % 3 == 1, "subroutine").otherwise("function")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), kind.alias("etype"), F.col("p_brand").alias("file"))


def _fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u, k, _ = _all(spark, sf_dir)
    return g.fan(e, u, k)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(SQL + " SELECT entity_id, name, CASE WHEN etype IN ('module', 'program') THEN 1 WHEN etype = 'type_definition' THEN 2 ELSE 5 END AS priority, deps, outgoing FROM fan")
def entities_by_priority(spark, sf_dir):
    return c.by_priority(_fan(spark, sf_dir)).select("entity_id", "name", "priority", "deps", "outgoing")


@query(f"WITH {PARTS} SELECT file, arg_min(name, (CASE etype WHEN 'module' THEN 1 WHEN 'subroutine' THEN 3 ELSE 4 END)::BIGINT * 1000000000 + entity_id) AS name FROM parts GROUP BY file")
def main_entity_of_file(spark, sf_dir):
    return c.main_entity(_parts(spark, sf_dir))


@query(f"WITH {PARTS}, w(wanted) AS (VALUES ('RING'), ('steel x')), r AS (SELECT wanted, name, row_number() OVER (PARTITION BY wanted ORDER BY entity_id) AS rank FROM parts, w WHERE contains(lower(name), lower(wanted)) OR contains(lower(wanted), lower(name))) SELECT wanted, name, rank FROM r WHERE rank <= 5")
def similar_names(spark, sf_dir):
    return c.similar_names(_parts(spark, sf_dir), ["RING", "steel x"], "entity_id", "name")


@query()
def sequence_similarity(spark, sf_dir):
    """Each part's name and the next one's."""
    a = _parts(spark, sf_dir).select("entity_id", "name")
    b = a.select((F.col("entity_id") - 1).alias("entity_id"), F.col("name").alias("other"))
    return a.join(b, "entity_id").select("entity_id", F.round(c.sequence_similarity("name", "other"), 6).alias("similarity"))


@query(with_sql("patterned") + f", {NAMES}, {PARTS}, e AS (SELECT entity_id::BIGINT AS entity_id, name FROM patterned UNION ALL SELECT -entity_id, name FROM parts) SELECT entity_id, label, string_agg(part, ',' ORDER BY pos) AS keywords FROM (SELECT *, row_number() OVER () AS pos FROM names) n JOIN e ON contains(lower(name), part) GROUP BY entity_id, label")
def name_concepts(spark, sf_dir):
    both = frame(spark, "patterned", sf_dir).select(F.col("entity_id").cast("long").alias("entity_id"), "name").unionByName(_parts(spark, sf_dir).select((-F.col("entity_id")).alias("entity_id"), "name"))
    return c.name_concepts(both)


TYPED = "e AS (" + DERIVED["typed"].format(**{t: t for t in TABLES}) + ")"


@query(f"""WITH {TYPED} SELECT entity_id, CASE WHEN etype = 'module' AND lower(name) LIKE '%constants%' THEN 'physical_constants' WHEN etype = 'module' AND lower(name) LIKE '%util%' THEN 'utility_functions' WHEN lower(name) LIKE '%force%' THEN 'force_calculation' ELSE 'energy_calculation' END AS label,
CASE WHEN etype = 'module' AND lower(name) LIKE '%constants%' THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence, CASE WHEN etype <> 'module' THEN 'physics' WHEN lower(name) LIKE '%util%' THEN 'functional' ELSE 'data' END AS category FROM e WHERE etype <> 'module' OR lower(name) LIKE '%constants%' OR lower(name) LIKE '%util%'""")
def type_concepts(spark, sf_dir):
    return c.type_concepts(frame(spark, "typed", sf_dir))


@query(SQL + f", {NAMES} SELECT entity_id, label, max(confidence) AS confidence FROM (SELECT entity_id, label, confidence FROM entity_concepts UNION ALL SELECT entity_id, label, 0.8::DOUBLE FROM entities JOIN names ON contains(lower(name), part)) GROUP BY entity_id, label")
def detected_concepts(spark, sf_dir):
    e, _, _, k = _all(spark, sf_dir)
    return c.detected_concepts(e, k)


def _family(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


@query("SELECT a.doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {_family('a.text', w)} AND {_family('b.text', w)} THEN '{k}' END" for k, w in c.CODE_FAMILIES.items()) + ") AS patterns FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def common_code_patterns(spark, sf_dir):
    a = _docs(spark, sf_dir).select("doc_id", "text")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return a.join(b, "doc_id").select("doc_id", c.common_patterns(F.col("text"), F.col("other")).alias("patterns"))


@query(with_sql("sources") + r""" SELECT id, concat_ws(',', CASE WHEN regexp_matches(text, 'do\s+\w+\s*=.*\n.*?\n\s*end\s*do', 'is') AND NOT regexp_matches(text, '!\$OMP|!\$ACC|!DIR\$') THEN 'vectorization_opportunity' END, CASE WHEN regexp_matches(text, 'allocate\s*\([^)]+\)', 'i') THEN 'memory_optimization_opportunity' END, CASE WHEN regexp_matches(text, 'do\s+.*?call\s+\w+.*?end\s*do', 'is') THEN 'function_inlining_opportunity' END) AS hints FROM sources""")
def optimisation_hints(spark, sf_dir):
    return frame(spark, "sources", sf_dir).select("id", F.array_join(c.optimisations(F.col("text")), ",").alias("hints"))


@query("SELECT source, CASE WHEN bool_or(lang = 'xx') THEN 'none' WHEN bool_or(lang = 'de') THEN 'german' WHEN bool_or(lang = 'fr') THEN 'french' ELSE 'general' END AS tag FROM documents GROUP BY source")
def domain_tag(spark, sf_dir):
    found = _docs(spark, sf_dir).groupBy("source").agg(F.collect_set("lang").alias("labels"))
    return found.select("source", c.decision_tag(F.col("labels"), [("xx", "none"), ("de", "german"), ("fr", "french")]).alias("tag"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), t AS (SELECT doc_id, n, trim(l, ' ') AS l FROM l)
SELECT doc_id, 'L' || n || ': ' || CASE WHEN length(l) > 80 THEN substring(l, 1, 77) || '...' ELSE l END AS line FROM t WHERE l <> '' AND NOT starts_with(l, '!') AND (contains(lower(l), 'license') OR contains(lower(l), 'tion'))""")
def concept_relevant_lines(spark, sf_dir):
    return c.relevant_lines(_docs(spark, sf_dir), "doc_id", "text", ["License", "tion"])


LEVEL = "CASE etype WHEN 'module' THEN 1 WHEN 'program' THEN 1 WHEN 'type_definition' THEN 2 ELSE 4 END"


@query(with_sql("entities", "asked") + rf""" SELECT query_id, target, max(level) AS level FROM (SELECT query_id, lower(name) AS target, {LEVEL} AS level FROM entities JOIN asked ON contains(lower(query), lower(name)) UNION ALL
SELECT query_id, lower(regexp_extract(query, '10\.\d{{4,9}}/[A-Za-z0-9_\-.;()/:]+')), 5 FROM asked WHERE regexp_matches(query, '10\.\d{{4,9}}/[A-Za-z0-9_\-.;()/:]+')) GROUP BY query_id, target""")
def query_specificity(spark, sf_dir):
    names = frame(spark, "entities", sf_dir).select("name", "etype", F.lit(False).alias("is_internal"))
    return c.mentions(frame(spark, "asked", sf_dir), names)


@query(r"SELECT doc_id, lower(regexp_extract(text || ' (doi:10.' || (1000 + doc_id) || '/' || source || '-X.' || doc_id || ' )', '10\.\d{4,9}/[A-Za-z0-9_\-.;()/:]+')) AS doi FROM documents")
def doi_extraction(spark, sf_dir):
    cited = F.concat("text", F.lit(" (doi:10."), (1000 + F.col("doc_id")).cast("string"), F.lit("/"), "source", F.lit("-X."), F.col("doc_id").cast("string"), F.lit(" )"))
    return _docs(spark, sf_dir).select("doc_id", F.lower(F.regexp_extract(cited, c.DOI, 0)).alias("doi"))


@query(with_sql("ranked", "targets") + """, f AS (SELECT r.query_id, chunk_id, rank, part_of, bool_or(contains(lower(text), 'function ' || lower(target)) OR contains(lower(text), 'subroutine ' || lower(target)) OR lower(name) = lower(target) OR ends_with(lower(name), '_' || lower(target))) AS direct, bool_or(contains(lower(text), lower(target))) AS holds FROM ranked r JOIN targets USING (query_id) GROUP BY ALL),
w AS (SELECT *, coalesce(part_of IS NOT NULL AND bool_or(direct) OVER (PARTITION BY query_id, part_of), false) AS part, bool_or(direct) OVER (PARTITION BY query_id) AS d, bool_or(holds AND rank <= 20) OVER (PARTITION BY query_id) AS t FROM f),
h AS (SELECT query_id, chunk_id, CASE WHEN direct THEN 'direct' WHEN part THEN 'part' WHEN NOT d AND holds AND rank <= 20 THEN 'text' WHEN NOT d AND NOT t AND rank <= 5 THEN 'top' END AS how FROM w) SELECT * FROM h WHERE how IS NOT NULL""")
def filter_by_specificity(spark, sf_dir):
    return c.filter_by_targets(frame(spark, "ranked", sf_dir), frame(spark, "targets", sf_dir))


@query(with_sql("sources") + ", l AS (SELECT id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM sources WHERE id % 3 = 2) SELECT id, '    ! ... [Context from parent function] ...' || chr(10) || string_agg(l, chr(10) ORDER BY n) FILTER (WHERE n < 5 AND trim(l) NOT LIKE '!%') || chr(10) || chr(10) || string_agg(l, chr(10) ORDER BY n) FILTER (WHERE n BETWEEN 5 AND 7) AS text FROM l GROUP BY id")
def internal_function(spark, sf_dir):
    found = c.internal_function(F.col("text"), "inner")
    return spread(frame(spark, "sources", sf_dir), "id").select("id", F.explode(F.array_compact(F.array(found))).alias("text"))  # a filter would compute it twice


@query(SQL + CHILDREN + " SELECT count(*) AS n_modules, avg(deps)::DOUBLE AS mean_deps, avg(children)::DOUBLE AS mean_children, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE deps = 0), '') AS independent FROM kids WHERE etype = 'module'")
def module_statistics(spark, sf_dir):
    return c.module_statistics(_fan(spark, sf_dir))


@query(SQL + ", r AS (SELECT o.a AS entity_id, m.name AS module, o.overlap AS similarity, row_number() OVER (PARTITION BY o.a ORDER BY o.overlap DESC, o.b) AS rank FROM overlap o JOIN entities m ON m.entity_id = o.b AND m.etype = 'module' WHERE o.overlap > 0.2) SELECT * FROM r WHERE rank <= 8")
def related_modules(spark, sf_dir):
    e, _, _, k = _all(spark, sf_dir)
    return c.related_modules(e, k)


LEVELS = CHILDREN + ", levels AS (SELECT entity_id, name, deps, outgoing, children, CASE WHEN deps > 5 OR outgoing > 8 OR children > 5 THEN 'high' WHEN deps > 2 OR outgoing > 4 OR children > 2 THEN 'medium' ELSE 'low' END AS complexity, CASE WHEN deps + outgoing + children > 10 THEN 'high' WHEN deps + outgoing + children > 5 THEN 'medium' ELSE 'low' END AS local FROM kids)"


@query(SQL + LEVELS + " SELECT * FROM levels")
def context_levels(spark, sf_dir):
    return c.context_levels(_fan(spark, sf_dir))


@query(with_sql("crossing") + """ SELECT entity_id, concat_ws('; ', CASE WHEN local = 'high' AND risk = 'high' THEN 'critical complexity' END, CASE WHEN local = 'low' AND risk = 'high' THEN 'hidden importance' END, CASE WHEN n > 0 AND outgoing > 5 THEN 'complex algorithmic implementation' END) AS insights FROM crossing""")
def cross_context_insights(spark, sf_dir):
    rows = frame(spark, "crossing", sf_dir)
    known = lambda name: rows.filter(F.col(name).isNotNull()).select("entity_id", name)
    return c.insights(rows.select("entity_id", "local", "outgoing"), known("risk"), known("n"))


@query(SQL + """ SELECT e.entity_id, e.etype || ' ' || e.name || ' (' || e.file || ':' || e.start_line || ')' AS definition, coalesce((SELECT string_agg(DISTINCT lower(dst_name), ',' ORDER BY lower(dst_name)) FROM uses u WHERE u.src_id = e.entity_id), '') AS uses, coalesce((SELECT string_agg(DISTINCT lower(dst_name), ',' ORDER BY lower(dst_name)) FROM calls u WHERE u.src_id = e.entity_id), '') AS calls,
coalesce((SELECT p.name FROM parents x JOIN entities p ON p.entity_id = x.parent_id WHERE x.entity_id = e.entity_id), '') AS parent, coalesce((SELECT string_agg(k.name, ',' ORDER BY k.name) FROM parents x JOIN entities k ON k.entity_id = x.entity_id WHERE x.parent_id = e.entity_id), '') AS children FROM entities e""")
def local_context(spark, sf_dir):
    e, u, k, _ = _all(spark, sf_dir)
    return c.local_context(e, u, k)


@query("WITH s AS (SELECT conv_id, turn, sum(ceil(length(text) / 4.0))  OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS spent FROM conversations) SELECT * FROM s WHERE spent <= 600")
def context_within_budget(spark, sf_dir):
    return c.within_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 600).select("conv_id", "turn", "spent")


CONTENT = "content AS (SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS code, count(*) FILTER (WHERE lang <> 'en' AND doc_id % 2 = 0) AS texts, count(*) FILTER (WHERE n_chars > 2000) AS conceptual, count(DISTINCT CASE WHEN lang = 'en' THEN 'fortran' ELSE lang END) AS types FROM documents)"


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents stand for code; of the others every second one is a section."""
    kind = F.when(F.col("lang") == "en", "fortran").otherwise(F.col("lang"))
    return c.content_statistics(_docs(spark, sf_dir).select(kind.alias("content_type"), F.when(F.col("doc_id") % 2 == 0, "section").otherwise("other").alias("level"), (F.col("n_chars") > 2000).alias("conceptual")))


@query(f"WITH {CONTENT} SELECT * FROM content")
def content_statistics(spark, sf_dir):
    return _content(spark, sf_dir)


def _score(words: tuple[str, ...]) -> str:
    return " + ".join(f"contains(lower(query), '{w}')::INT" for w in words)


@query(with_sql("asked") + f", {CONTENT}, s AS (SELECT query_id, {_score(c.CODE_WORDS)} AS k, {_score(c.TEXT_WORDS)} AS t, n, code, texts FROM asked, content) SELECT query_id, CASE WHEN k > t AND code / n > 0.3 THEN 'fortran' WHEN t > k AND texts / n > 0.3 THEN 'text' ELSE 'unified' END AS mode FROM s")
def best_mode(spark, sf_dir):
    return c.best_mode(frame(spark, "asked", sf_dir), _content(spark, sf_dir))


@query(with_sql("alike") + ", m AS (SELECT src, name, max(similarity) AS similarity, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, CASE WHEN count(DISTINCT method) > 1 THEN 'hybrid' ELSE min(method) END AS method FROM alike GROUP BY src, name) SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, name) AS rank FROM m QUALIFY rank <= 8")
def merge_similar(spark, sf_dir):
    return c.merge_similar(frame(spark, "alike", sf_dir), "src")


@query(SQL + ", both_ways AS (SELECT src_id AS a, dst_id AS b FROM edges UNION SELECT dst_id, src_id FROM edges), reach(node, level) AS (SELECT min(src_id), 0 FROM uses UNION SELECT b, level + 1 FROM reach JOIN both_ways ON a = node WHERE level < 2) SELECT node, min(level) AS level FROM reach GROUP BY node")
def focus_exploration(spark, sf_dir):
    e, u, k, _ = _all(spark, sf_dir)
    start = u.agg(F.min("src_id")).first()[0] or 0
    return c.focus(g.graph_edges(e, u, k), start, 2)


@query(with_sql("axioms", "chunk_concepts") + NEAR + """, one AS (SELECT chunk_id AS context, neighbor AS uri FROM chunk_concepts JOIN near USING (uri)) SELECT DISTINCT context, uri FROM (SELECT chunk_id AS context, uri FROM chunk_concepts UNION ALL SELECT * FROM one UNION ALL SELECT context, neighbor FROM one JOIN near USING (uri))""")
def search_space(spark, sf_dir):
    return c.search_space(frame(spark, "chunk_concepts", sf_dir).withColumnRenamed("chunk_id", "context"), _axioms(spark, sf_dir))


@query(with_sql("axioms", "links") + " SELECT * FROM axioms UNION SELECT 'subsumption', child, parent FROM links WHERE child <> parent")
def explicit_hierarchy(spark, sf_dir):
    return c.explicit_hierarchy(_axioms(spark, sf_dir), frame(spark, "links", sf_dir))


@query("""SELECT 'ex:' || replace(r_name, ' ', '_') AS uri, lower(r_name) || ': Region ' || r_name || '.' AS text FROM region UNION SELECT 'ex:' || n_name, lower(n_name) || ' (type de: ' || lower(r_name) || ')' FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT 'ex:' || replace(s_name, '#', '_'), replace(s_name, '#', '_') || ' (type de: ' || lower(n_name) || ')' FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def concept_text(spark, sf_dir):
    triples = turtle_triples(spark, sf_dir)
    return c.concept_text(o.concept_semantics(triples), o.load_axioms(triples))


@query(with_sql("axioms") + ", up AS (SELECT DISTINCT source AS child, target AS parent FROM axioms WHERE type = 'subsumption'), reach(node, d) AS (SELECT parent, 1 FROM up WHERE parent NOT IN (SELECT child FROM up) UNION SELECT child, d + 1 FROM reach JOIN up ON parent = node) SELECT (SELECT count(*) FROM (SELECT source FROM axioms UNION SELECT target FROM axioms)) AS concepts, (SELECT count(DISTINCT node) FROM reach WHERE d = 1) AS roots, greatest(3, (SELECT max(d) FROM (SELECT node, min(d) AS d FROM reach GROUP BY node))) AS deepest, (SELECT count(*) FROM axioms WHERE type = 'subsumption') AS subsumptions, (SELECT count(*) FROM axioms WHERE type <> 'subsumption') AS others")
def ontology_report(spark, sf_dir):
    return c.ontology_report(_axioms(spark, sf_dir))


@query(with_sql("relation_edges") + ", reach(s, o, d) AS (SELECT s, o, 1 FROM relation_edges UNION SELECT r.s, e.o, r.d + 1 FROM reach r JOIN relation_edges e ON e.s = r.o WHERE r.d < 3) SELECT s, o, round(power(0.8::DOUBLE, min(d)), 6) AS score FROM reach WHERE s <> o GROUP BY s, o HAVING min(d) > 1")
def implied_relations(spark, sf_dir):
    return c.implied(frame(spark, "relation_edges", sf_dir)).withColumn("score", F.round("score", 6))


@query("SELECT lang AS etype, source AS file, count(*) AS n, min(doc_id) AS sample FROM documents GROUP BY lang, source")
def entity_diagnostics(spark, sf_dir):
    """Documents stand for entities: counts by type and file with one sample each."""
    return g.diagnostics(_docs(spark, sf_dir).select(F.col("doc_id").alias("entity_id"), F.col("lang").alias("etype"), F.col("source").alias("file")))


@query(f"WITH {PARTS} SELECT entity_id, name FROM parts WHERE lower(name) = 'small ring economy'")
def chunks_by_entity_name(spark, sf_dir):
    return g.by_name(_parts(spark, sf_dir), "Small RING economy").select("entity_id", "name")


@query(with_sql("entity_concepts") + " SELECT category, count(DISTINCT label) AS n_patterns, count(*) AS n_uses, round(avg(confidence), 6) AS mean_confidence FROM entity_concepts GROUP BY category")
def pattern_statistics(spark, sf_dir):
    return g.pattern_statistics(frame(spark, "entity_concepts", sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))
