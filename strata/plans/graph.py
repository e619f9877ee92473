"""Queries on a graph of code entities that parts and line items give, and on a trade graph of nations that the driver's tables give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import graph as g
from strata.plans.derived import frame, with_sql
from strata.plans.registry import query, table
from strata.storage import cut

SQL = with_sql("entities", "uses", "calls", "entity_concepts") + """, parents AS (SELECT e.entity_id, arg_min(o.entity_id, (o.end_line - o.start_line, o.entity_id)) AS parent_id FROM entities e JOIN entities o ON o.file = e.file AND o.entity_id <> e.entity_id AND o.start_line <= e.start_line AND o.end_line >= e.end_line AND o.end_line - o.start_line > e.end_line - e.start_line GROUP BY e.entity_id),
callers AS (SELECT DISTINCT e.entity_id, c.src_id AS caller_id FROM calls c JOIN entities e ON lower(e.name) = lower(c.dst_name) WHERE e.entity_id <> c.src_id),
edges AS (SELECT DISTINCT * FROM (SELECT u.src_id, e.entity_id AS dst_id, 'uses' AS kind FROM uses u JOIN entities e ON lower(e.name) = lower(u.dst_name) UNION ALL SELECT c.src_id, e.entity_id, 'calls' FROM calls c JOIN entities e ON lower(e.name) = lower(c.dst_name) UNION ALL SELECT parent_id, entity_id, 'contains' FROM parents)),
fan AS (SELECT e.*, (SELECT count(DISTINCT lower(dst_name)) FROM uses u WHERE u.src_id = e.entity_id) AS deps, (SELECT count(DISTINCT lower(dst_name)) FROM calls c WHERE c.src_id = e.entity_id) AS outgoing, (SELECT count(*) FROM calls c WHERE c.src_id = e.entity_id) AS n_calls, (SELECT count(*) FROM callers c WHERE c.entity_id = e.entity_id) AS incoming,
(SELECT count(DISTINCT src_id) FROM uses u WHERE lower(u.dst_name) = lower(e.name)) AS dependents FROM entities e),
sizes AS (SELECT entity_id, count(DISTINCT label) AS n FROM entity_concepts GROUP BY 1), overlap AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) / greatest(any_value(sx.n), any_value(sy.n))::DOUBLE AS overlap FROM entity_concepts x JOIN entity_concepts y ON x.label = y.label AND x.entity_id <> y.entity_id JOIN sizes sx ON sx.entity_id = x.entity_id JOIN sizes sy ON sy.entity_id = y.entity_id GROUP BY 1, 2)"""
TRADE = "WITH RECURSIVE edges AS (SELECT s_nationkey AS src_id, c_nationkey AS dst_id, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return frame(spark, "entities", sf_dir), frame(spark, "uses", sf_dir), frame(spark, "calls", sf_dir), frame(spark, "entity_concepts", sf_dir)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u, c, _ = _all(spark, sf_dir)
    return g.graph_edges(e, u, c)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_id, dst_id, n: line items from a supplier's nation to a customer's."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("s_nationkey").alias("src_id"), F.col("c_nationkey").alias("dst_id")).agg(F.count(F.lit(1)).alias("n"))


@query(SQL + " SELECT entity_id, name FROM entities WHERE etype = 'module'")
def entity_by_type(spark, sf_dir):
    return g.by_type(frame(spark, "entities", sf_dir), "module").select("entity_id", "name")


@query(SQL + " SELECT entity_id, name, file || '#' || etype || '#' || name || '#' || start_line AS key FROM entities WHERE file = 'brand_2_0.f90'")
def entity_in_file(spark, sf_dir):
    key = g.entity_key(F.col("file"), F.col("etype"), F.col("name"), F.col("start_line"))
    return g.in_file(frame(spark, "entities", sf_dir), "brand_2_0.f90").select("entity_id", "name", key.alias("key"))


@query(SQL + " SELECT e.name AS child, p.name AS parent FROM parents x JOIN entities e USING (entity_id) JOIN entities p ON p.entity_id = x.parent_id")
def entity_children(spark, sf_dir):
    e = frame(spark, "entities", sf_dir)
    return g.parents(e).join(e.select("entity_id", F.col("name").alias("child")), "entity_id").join(e.select(F.col("entity_id").alias("parent_id"), F.col("name").alias("parent")), "parent_id").select("child", "parent")


@query(SQL + """, w(wanted) AS (VALUES ('SMALL_RING_0'), ('widget'), ('a_blue_anvil'), ('nothing like it')), r AS (SELECT wanted, name, row_number() OVER (PARTITION BY wanted ORDER BY lower(name) = lower(wanted) DESC, abs(length(name) - length(wanted)), name) AS k FROM w JOIN entities ON contains(lower(name), lower(wanted)) OR contains(lower(wanted), lower(name)))
SELECT wanted, name FROM r WHERE k = 1""")
def find_entity(spark, sf_dir):
    e = frame(spark, "entities", sf_dir)
    one = [g.find_entity(e, n).select(F.lit(n).alias("wanted"), "name") for n in ("SMALL_RING_0", "widget", "a_blue_anvil", "nothing like it")]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3])


@query(SQL + """ SELECT name, round((100.0::DOUBLE + 100.0::DOUBLE * (1 - levenshtein(lower(name), 'small_rign_1') / greatest(length(name), 12)::DOUBLE) + 100.0::DOUBLE * 6 / length(file)) / 3, 4) AS score FROM entities WHERE etype = 'subroutine' AND contains(file, 'brand_') AND 100.0::DOUBLE * (1 - levenshtein(lower(name), 'small_rign_1') / greatest(length(name), 12)::DOUBLE) >= 60""")
def find_entities_by_criteria(spark, sf_dir):
    return g.find_by_criteria(frame(spark, "entities", sf_dir), kind="Subroutine", name="small_rign_1", file="brand_", least_ratio=60).select("name", F.round("score", 4).alias("score"))


@query(SQL + """, lines AS (SELECT DISTINCT file, start_line + 3 AS line FROM entities) SELECT l.file, l.line, arg_min(e.name, (e.end_line - e.start_line, e.entity_id)) AS owner FROM lines l JOIN entities e ON e.file = l.file AND l.line BETWEEN e.start_line AND e.end_line GROUP BY 1, 2""")
def assign_owner(spark, sf_dir):
    e = frame(spark, "entities", sf_dir)
    return g.owner_of_line(e, e.select("file", (F.col("start_line") + 3).alias("line")))


@query(SQL + " SELECT src_id, dst_id, kind FROM edges")
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(SQL + " SELECT e.name, k.name AS caller FROM callers c JOIN entities e USING (entity_id) JOIN entities k ON k.entity_id = c.caller_id")
def callers(spark, sf_dir):
    e, _, c, _ = _all(spark, sf_dir)
    return g.callers(e, c).join(e.select("entity_id", "name"), "entity_id").join(e.select(F.col("entity_id").alias("caller_id"), F.col("name").alias("caller")), "caller_id").select("name", "caller")


@query(SQL + """, indirect AS (SELECT DISTINCT a.entity_id, b.caller_id FROM callers a JOIN callers b ON b.entity_id = a.caller_id WHERE a.entity_id <> b.caller_id AND NOT EXISTS (SELECT 1 FROM callers d WHERE d.entity_id = a.entity_id AND d.caller_id = b.caller_id)),
c AS (SELECT e.entity_id, e.name, (SELECT count(*) FROM callers x WHERE x.entity_id = e.entity_id) AS n_direct, (SELECT count(*) FROM indirect x WHERE x.entity_id = e.entity_id) AS n_indirect, coalesce((SELECT string_agg(DISTINCT replace(k.file, '.f90', ''), ',' ORDER BY replace(k.file, '.f90', '')) FROM (SELECT * FROM callers UNION ALL SELECT * FROM indirect) x JOIN entities k ON k.entity_id = x.caller_id WHERE x.entity_id = e.entity_id), '') AS modules FROM entities e)
SELECT entity_id, name, n_direct, n_indirect, modules, n_direct + n_indirect AS total, CASE WHEN n_direct + n_indirect = 0 THEN 'low' WHEN n_direct + n_indirect <= 5 THEN 'medium' ELSE 'high' END AS risk FROM c""")
def impact_analysis(spark, sf_dir):
    e, _, c, _ = _all(spark, sf_dir)
    return g.impact(e, c)


@query(SQL + """, start AS (SELECT min(src_id) AS src_id FROM edges WHERE kind = 'uses'), reach(node, level) AS (SELECT src_id, 0 FROM start UNION SELECT e.dst_id, r.level + 1 FROM reach r JOIN edges e ON e.src_id = r.node WHERE e.kind <> 'contains' AND r.level < 3) SELECT node, min(level) AS level FROM reach GROUP BY node ORDER BY level, node LIMIT 50""")
def dependency_subgraph(spark, sf_dir):
    edges = cut(_edges(spark, sf_dir))
    return g.subgraph(edges, edges.filter("kind = 'uses'").agg(F.min("src_id")).first()[0] or 0, depth=3)


@query(SQL + """, l AS (SELECT DISTINCT lower(s.name) AS a, lower(u.dst_name) AS b FROM uses u JOIN entities s ON s.entity_id = u.src_id WHERE lower(u.dst_name) IN (SELECT lower(name) FROM entities) AND lower(s.name) <> lower(u.dst_name)), far(a, b) AS (SELECT a, b FROM l UNION SELECT f.a, l.b FROM far f JOIN l ON l.a = f.b),
comp AS (SELECT x.a AS node, least(x.a, min(x.b)) AS c FROM far x JOIN far y ON y.a = x.b AND y.b = x.a GROUP BY x.a), dense AS (SELECT x.c, count(*) AS m, (SELECT count(*) FROM comp z WHERE z.c = x.c) AS n FROM l JOIN comp x ON x.node = l.a JOIN comp y ON y.node = l.b WHERE x.c = y.c GROUP BY x.c), own AS (SELECT l.* FROM l JOIN comp x ON x.node = l.a JOIN comp y ON y.node = l.b JOIN dense d ON d.c = x.c WHERE x.c = y.c AND m - n <= 6),
path(first, last, p) AS (SELECT a, b, [a, b] FROM own WHERE a < b UNION ALL SELECT p.first, o.b, list_append(p.p, o.b) FROM path p JOIN own o ON o.a = p.last WHERE o.b > p.first AND NOT list_contains(p.p, o.b))
SELECT array_to_string(list_append(p, first), ' -> ') AS cycle FROM path JOIN own ON own.a = last AND own.b = first UNION SELECT n || ' entities around ' || c FROM dense WHERE m - n > 6""")
def circular_dependencies(spark, sf_dir):
    e, u, _, _ = _all(spark, sf_dir)
    return g.cycles(e, u)


@query(TRADE + ", ab AS (SELECT * FROM edges WHERE src_id <> dst_id AND n >= 95) SELECT a.src_id AS a, a.dst_id AS b FROM ab a JOIN ab b ON a.src_id = b.dst_id AND a.dst_id = b.src_id WHERE a.src_id < a.dst_id")
def trade_two_cycles(spark, sf_dir):
    e = trade(spark, sf_dir).filter("src_id != dst_id and n >= 95")
    return e.alias("x").join(e.alias("y"), (F.col("x.src_id") == F.col("y.dst_id")) & (F.col("x.dst_id") == F.col("y.src_id"))).filter("x.src_id < x.dst_id").select(F.col("x.src_id").alias("a"), F.col("x.dst_id").alias("b"))


@query(TRADE + ", e AS (SELECT src_id, dst_id FROM edges WHERE src_id <> dst_id AND n >= 95), d AS (SELECT src_id AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst_id, 0, 1 FROM e) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM d GROUP BY node")
def graph_degrees(spark, sf_dir):
    return g.degrees(trade(spark, sf_dir).filter("src_id != dst_id and n >= 95"))


@query(SQL + """, l AS (SELECT DISTINCT src_id, dst_id FROM edges WHERE src_id <> dst_id), two AS (SELECT src_id AS a, dst_id AS b FROM l UNION SELECT dst_id, src_id FROM l), w(node, start) AS (SELECT entity_id, entity_id FROM entities UNION SELECT two.b, w.start FROM w JOIN two ON two.a = w.node),
far(a, b) AS (SELECT * FROM l UNION SELECT f.a, l.dst_id FROM far f JOIN l ON l.src_id = f.b)
SELECT (SELECT count(*) FROM entities) AS n_nodes, (SELECT count(*) FROM l) AS n_edges, (SELECT count(DISTINCT c) FROM (SELECT node, min(start) AS c FROM w GROUP BY node)) AS n_components, NOT EXISTS (SELECT 1 FROM far WHERE a = b) AS acyclic, (SELECT count(*) FROM l) / ((SELECT count(*) FROM entities) * ((SELECT count(*) FROM entities) - 1))::DOUBLE AS density""")
def graph_metrics(spark, sf_dir):
    return g.metrics(_edges(spark, sf_dir), frame(spark, "entities", sf_dir).select(F.col("entity_id").alias("node")))


@query(SQL + " SELECT name, least(n_calls, 10) + least(incoming, 5) + least(outgoing, 8) AS score, CASE WHEN least(n_calls, 10) + least(incoming, 5) + least(outgoing, 8) <= 5 THEN 'low' WHEN least(n_calls, 10) + least(incoming, 5) + least(outgoing, 8) <= 15 THEN 'medium' ELSE 'high' END AS level FROM fan")
def entity_complexity(spark, sf_dir):
    e, u, c, _ = _all(spark, sf_dir)
    return g.complexity(g.fan(e, u, c)).select("name", "score", "level")


@query(SQL + " SELECT name, least(CASE etype WHEN 'module' THEN 40 WHEN 'program' THEN 45 WHEN 'type_definition' THEN 20 ELSE 25 END + least(2 * deps, 15) + least(outgoing, 10), 70) AS size FROM fan")
def node_size(spark, sf_dir):
    e, u, c, _ = _all(spark, sf_dir)
    return g.fan(e, u, c).select("name", g.node_size().alias("size"))


@query(SQL + " SELECT name, deps + outgoing + dependents AS centrality FROM fan ORDER BY centrality DESC, name LIMIT 3")
def critical_entities(spark, sf_dir):
    e, u, c, _ = _all(spark, sf_dir)
    return g.fan(e, u, c).select("name", (F.col("deps") + F.col("outgoing") + F.col("dependents")).alias("centrality")).orderBy(F.desc("centrality"), "name").limit(3)


@query(SQL + " SELECT sum(deps)::BIGINT AS total_deps, sum(n_calls)::BIGINT AS total_calls, round(avg(deps), 6) AS mean_deps, round(avg(n_calls), 6) AS mean_calls, count(*) FILTER (WHERE deps + n_calls > 10) AS coupled FROM fan")
def dependency_stats(spark, sf_dir):
    e, u, c, _ = _all(spark, sf_dir)
    return g.fan(e, u, c).agg(F.sum("deps").alias("total_deps"), F.sum("n_calls").alias("total_calls"), F.round(F.avg("deps"), 6).alias("mean_deps"), F.round(F.avg("n_calls"), 6).alias("mean_calls"), F.count_if(F.col("deps") + F.col("n_calls") > 10).alias("coupled"))


@query(SQL + ", r AS (SELECT c.src_id, e.entity_id AS dst, e.file AS f2, s.file AS f1 FROM calls c JOIN entities s ON s.entity_id = c.src_id LEFT JOIN entities e ON lower(e.name) = lower(c.dst_name)) SELECT src_id, count(*) AS n_calls, count(dst) AS resolved, count(*) - count(dst) AS external, count(*) FILTER (WHERE f1 <> f2) AS cross_file FROM r GROUP BY src_id")
def call_statistics(spark, sf_dir):
    e, _, c, _ = _all(spark, sf_dir)
    r = g.resolved(e, c).join(e.select(F.col("entity_id").alias("dst_id"), F.col("file").alias("f2")), "dst_id", "left").join(e.select(F.col("entity_id").alias("src_id"), F.col("file").alias("f1")), "src_id")
    return r.groupBy("src_id").agg(F.count(F.lit(1)).alias("n_calls"), F.count("dst_id").alias("resolved"), F.count_if(F.col("dst_id").isNull()).alias("external"), F.count_if(F.col("f1") != F.col("f2")).alias("cross_file"))


@query(SQL + ", kids AS (SELECT parent_id, count(*) AS n FROM parents GROUP BY 1) SELECT name, 2 * coalesce(n, 0) + greatest(0, 5 - deps) + CASE WHEN regexp_matches(name, 'main|core|base|driver') THEN 5 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM entity_concepts k WHERE k.entity_id = fan.entity_id AND label IN ('solver', 'grid', 'simulation')) THEN 3 ELSE 0 END + CASE WHEN is_grouped THEN 2 ELSE 0 END AS score FROM fan LEFT JOIN kids ON parent_id = entity_id WHERE etype IN ('module', 'program') ORDER BY score DESC, name LIMIT 5")
def main_modules(spark, sf_dir):
    e, u, c, k = _all(spark, sf_dir)
    return g.main_modules(g.fan(e, u, c), k).select("name", "score")


@query(SQL + ", kids AS (SELECT parent_id, count(*) AS n FROM parents GROUP BY 1), m AS (SELECT avg(deps) AS mean_deps, avg(CASE WHEN deps = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS independent, avg(coalesce(n, 0)) AS mean_children FROM fan LEFT JOIN kids ON parent_id = entity_id WHERE etype = 'module') SELECT *, CASE WHEN independent > 0.7 THEN 'modular' WHEN mean_deps > 5 THEN 'highly_coupled' WHEN mean_children > 10 THEN 'monolithic' WHEN mean_deps > 2 THEN 'layered' ELSE 'simple' END AS style FROM m")
def architecture_style(spark, sf_dir):
    e, u, c, _ = _all(spark, sf_dir)
    return g.architecture_style(g.fan(e, u, c))


@query(SQL + " SELECT a, b, round(overlap, 6) AS overlap FROM overlap WHERE overlap > 0.2")
def shared_concepts(spark, sf_dir):
    return g.concept_overlap(frame(spark, "entity_concepts", sf_dir)).filter("overlap > 0.2").select("a", "b", F.round("overlap", 6).alias("overlap"))


@query(SQL + """, s AS (SELECT o.a, o.b, 0.6::DOUBLE * overlap + CASE WHEN x.etype = y.etype THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN x.file = y.file OR px.parent_id = py.parent_id THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN EXISTS (SELECT 1 FROM uses u JOIN uses w ON lower(u.dst_name) = lower(w.dst_name) WHERE u.src_id = o.a AND w.src_id = o.b) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM overlap o JOIN entities x ON x.entity_id = a JOIN entities y ON y.entity_id = b LEFT JOIN parents px ON px.entity_id = a LEFT JOIN parents py ON py.entity_id = b), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s WHERE score > 0.3) SELECT a, b, round(score, 6) AS score, rank FROM r WHERE rank <= 8""")
def semantic_neighbors(spark, sf_dir):
    e, u, _, k = _all(spark, sf_dir)
    return g.semantic_neighbors(e, k, u).select("a", "b", F.round("score", 6).alias("score"), "rank")


@query(SQL + """, s AS (SELECT a, b, sum(w) AS score FROM (SELECT a, b, 0.6::DOUBLE * overlap AS w FROM overlap UNION ALL SELECT DISTINCT src_id, dst_id, 0.4::DOUBLE FROM edges WHERE kind = 'uses' UNION ALL SELECT DISTINCT src_id, dst_id, 0.3::DOUBLE FROM edges WHERE kind = 'calls') GROUP BY 1, 2),
r AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s JOIN entities x ON x.entity_id = a JOIN entities y ON y.entity_id = b WHERE x.file <> y.file AND score > 0.2) SELECT a, b, round(score, 6) AS score, rank FROM r WHERE rank <= 6""")
def cross_file_relations(spark, sf_dir):
    e, u, c, k = _all(spark, sf_dir)
    return g.cross_file_relations(e, k, u, c).select("a", "b", F.round("score", 6).alias("score"), "rank")


@query()
def similar_entities(spark, sf_dir):
    e, u, _, k = _all(spark, sf_dir)
    return g.similar_entities(e, k, u).select("a", "b", F.round("score", 6).alias("score"), "reasons", "rank")


@query("""WITH b AS (SELECT conv_id, sum(ceil(length(text) / 4.0))::INTEGER AS tokens FROM conversations GROUP BY conv_id), w(role, task, l, g, s) AS (VALUES ('developer', 'debugging', 0.6::DOUBLE, 0.2::DOUBLE, 0.2::DOUBLE), ('developer', 'understanding', 0.5, 0.3, 0.2), ('reviewer', 'review', 0.4, 0.3, 0.3), ('analyst', 'dependency', 0.3, 0.5, 0.2), ('documenter', 'documentation', 0.4, 0.2, 0.4), ('any', 'any', 0.5, 0.3, 0.2))
SELECT conv_id, role, task, floor(l / (l + g + s) * tokens + 1e-9)::INTEGER AS local_tokens, floor(g / (l + g + s) * tokens + 1e-9)::INTEGER AS global_tokens, floor(s / (l + g + s) * tokens + 1e-9)::INTEGER AS semantic_tokens FROM b, w""")
def agent_context(spark, sf_dir):
    """Each conversation's length in tokens is the budget that is shared out."""
    spent = F.sum(F.ceil(F.length("text") / 4.0)).cast("int").alias("tokens")
    return g.agent_context(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(spent), "conv_id")


@query(SQL + " SELECT etype, count(*) AS n, count(*) FILTER (WHERE is_grouped) AS grouped, count(*) FILTER (WHERE NOT is_complete) AS incomplete, count(DISTINCT file) AS files FROM entities GROUP BY etype")
def entity_stats(spark, sf_dir):
    return frame(spark, "entities", sf_dir).groupBy("etype").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_grouped").alias("grouped"), F.count_if(~F.col("is_complete")).alias("incomplete"), F.countDistinct("file").alias("files"))


@query(SQL + " SELECT label, count(*) AS n, round(avg(k.confidence), 6) AS mean_confidence, count(DISTINCT file) AS files FROM entity_concepts k JOIN entities USING (entity_id) WHERE label = 'grid' GROUP BY label")
def concept_patterns(spark, sf_dir):
    rows = frame(spark, "entity_concepts", sf_dir).filter("label = 'grid'").join(frame(spark, "entities", sf_dir).drop("confidence"), "entity_id")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.countDistinct("file").alias("files"))


@query(SQL + " SELECT label, max(confidence) AS confidence, count(*) AS n, CASE WHEN count(*) > 1 THEN 'hybrid' ELSE 'single' END AS method FROM entity_concepts GROUP BY label")
def merge_concepts(spark, sf_dir):
    return frame(spark, "entity_concepts", sf_dir).groupBy("label").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) > 1, "hybrid").otherwise("single").alias("method"))


@query(SQL + """, k AS (SELECT entity_id, count(*) AS n, avg(confidence) AS c FROM entity_concepts GROUP BY 1), q AS (SELECT 100.0::DOUBLE * avg(is_complete::INT) AS complete, 100.0::DOUBLE * avg((k.n IS NOT NULL)::INT) AS with_concepts, avg((deps + n_calls > 10)::INT) AS high FROM fan LEFT JOIN k USING (entity_id)), m AS (SELECT avg(confidence) AS c FROM entity_concepts)
SELECT round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.30::DOUBLE * complete + 0.25::DOUBLE * with_concepts + 25.0::DOUBLE * c - 20.0::DOUBLE * least(high, 0.2::DOUBLE))), 4) AS score FROM q, m""")
def project_quality_score(spark, sf_dir):
    e, u, c, k = _all(spark, sf_dir)
    f = g.fan(e, u, c).join(k.select("entity_id").distinct().withColumn("_k", F.lit(1)), "entity_id", "left")
    parts = f.agg((100.0 * F.avg(F.col("is_complete").cast("int"))).alias("complete"), (100.0 * F.avg(F.col("_k").isNotNull().cast("int"))).alias("named"), F.avg((F.col("deps") + F.col("n_calls") > 10).cast("int")).alias("high")).crossJoin(k.agg(F.avg("confidence").alias("c")))
    score = 0.30 * F.col("complete") + 0.25 * F.col("named") + 25.0 * F.col("c") - 20.0 * F.least("high", F.lit(0.2))
    return parts.select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 4).alias("score"))
