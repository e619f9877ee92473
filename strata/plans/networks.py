"""Queries on networks, ranges, names and vectors of the given tables: centrality, components, nesting, containment, threshold search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators import containment, nesting, paths, threshold_join
from strata.plans.graph import TRADE, trade
from strata.plans.registry import query, table

#: pairs of nations with more trade than a pair has on average
BUSY = TRADE + ", busy AS (SELECT src_id, dst_id FROM edges WHERE src_id <> dst_id AND n > 1.05 * (SELECT avg(n) FROM edges))"
#: suppliers whose lines follow each other in an order, both of a large quantity
NEXT = "WITH RECURSIVE link AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 47 AND b.l_quantity >= 47), reach(a, b) AS (SELECT src, dst FROM link UNION SELECT r.a, l.dst FROM reach r JOIN link l ON l.src = r.b)"


def busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trade(spark, sf_dir)
    mean = rows.agg(F.avg("n").alias("mean"))
    return rows.join(F.broadcast(mean), F.col("n") > 1.05 * F.col("mean")).filter("src_id != dst_id").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def following(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 47").select("l_orderkey", "l_linenumber", "l_suppkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("dst"))
    return lines.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_suppkey").alias("src"), "dst").distinct()


@query(BUSY + """, dist(s, v, d) AS (SELECT src_id, src_id, 0 FROM busy UNION SELECT r.s, b.dst_id, r.d + 1 FROM dist r JOIN busy b ON b.src_id = r.v WHERE r.d < 8), near AS (SELECT s, v, min(d) AS d FROM dist GROUP BY s, v),
way(s, v, d, n) AS (SELECT s, s, 0, 0 FROM (SELECT DISTINCT s FROM near) UNION ALL SELECT w.s, b.dst_id, w.d + 1, 0 FROM way w JOIN busy b ON b.src_id = w.v JOIN near x ON x.s = w.s AND x.v = b.dst_id AND x.d = w.d + 1),
ways AS (SELECT s, v, d, count(*)::DOUBLE AS n FROM way GROUP BY s, v, d), part AS (SELECT a.v AS node, sum(a.n * b.n / c.n) AS share FROM ways a JOIN ways b ON b.s = a.v JOIN ways c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 GROUP BY a.v)
SELECT n_nationkey AS node, round(coalesce(share, 0) / 552.0::DOUBLE, 6) AS centrality FROM nation LEFT JOIN part ON node = n_nationkey ORDER BY centrality DESC, node LIMIT 10""")
def betweenness_centrality(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return paths.betweenness(busy(spark, sf_dir), nodes).select("node", F.round("centrality", 6).alias("centrality")).orderBy(F.desc("centrality"), "node").limit(10)


@query(NEXT + " SELECT node, coalesce(least(node, min(other)), node) AS component FROM (SELECT src AS node FROM link UNION SELECT dst FROM link) LEFT JOIN (SELECT x.a, x.b AS other FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a) ON a = node GROUP BY node")
def strong_components(spark, sf_dir):
    return paths.strong_components(following(spark, sf_dir))


@query(NEXT + " SELECT DISTINCT a AS node FROM reach WHERE a = b")
def nodes_on_cycles(spark, sf_dir):
    return paths.on_cycles(following(spark, sf_dir))


@query(NEXT + ", top AS (SELECT DISTINCT src AS node FROM link WHERE src NOT IN (SELECT dst FROM link)), far(node, d) AS (SELECT node, 0 FROM top UNION SELECT l.dst, f.d + 1 FROM far f JOIN link l ON l.src = f.node WHERE f.d < 60) SELECT node, min(d)::BIGINT AS level FROM (SELECT node, d FROM far UNION ALL SELECT src, NULL FROM link UNION ALL SELECT dst, NULL FROM link) GROUP BY node")
def dependency_levels(spark, sf_dir):
    return paths.levels(following(spark, sf_dir).toDF("parent", "child"))


#: each event lasts as many minutes as its value has units; ranges of a user nest and overlap
SPANS = "WITH span AS (SELECT user_id::VARCHAR AS file, event_id AS id, epoch(date_trunc('second', ts))::BIGINT AS start, epoch(date_trunc('second', ts))::BIGINT + floor(value * 60)::BIGINT AS stop FROM events WHERE value IS NOT NULL AND value >= 0)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").filter("value >= 0").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("id"), start.alias("start"), (start + F.floor(F.col("value") * 60)).alias("end"))


@query(SPANS + " SELECT s.id, arg_min(o.id, (o.stop - o.start, o.id)) FILTER (o.id IS NOT NULL) AS parent_id FROM span s LEFT JOIN span o ON o.file = s.file AND o.start <= s.start AND o.stop >= s.stop AND o.stop - o.start > s.stop - s.start GROUP BY s.id")
def event_nesting(spark, sf_dir):
    return nesting.smallest_enclosing(_spans(spark, sf_dir)).select("id", "parent_id")


@query(SPANS + ", q AS (SELECT file, start + 30 AS at, id FROM span) SELECT q.id, arg_min(o.id, (o.stop - o.start, o.id)) FILTER (o.id IS NOT NULL) AS owner FROM q LEFT JOIN span o ON o.file = q.file AND q.at BETWEEN o.start AND o.stop GROUP BY q.id")
def event_owner(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    at = spans.select("file", "id", (F.col("start") + 30).alias("start"), (F.col("start") + 30).alias("end"))
    return nesting.smallest_enclosing(spans, queries=at).filter("query").select("id", F.col("parent_id").alias("owner"))


NAMED = "WITH name AS (SELECT DISTINCT lower(name) AS name FROM (SELECT unnest(string_split(p_name, ' ')) AS name FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT substr(text, 1, 24) FROM benchmark) WHERE name <> '')"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(F.explode(F.split("p_name", " ")).alias("name")).union(parts.select("p_name")).union(table(spark, sf_dir, "benchmark").select(F.substring("text", 1, 24)))


@query(NAMED + " SELECT doc_id, name, ((length(low) - length(replace(low, name, ''))) // length(name))::BIGINT AS n FROM (SELECT doc_id, lower(text) AS low FROM documents) JOIN name ON contains(low, name)")
def contained_names(spark, sf_dir):
    found = containment.contained_names(table(spark, sf_dir, "documents"), _names(spark, sf_dir), text_id="doc_id")
    return found.select(F.col("text_id").alias("doc_id"), "name", "n")


@query(NAMED + " SELECT page_id, name FROM (SELECT page_id, lower(html) AS low FROM pages) JOIN name ON regexp_matches(low, '(^|[^\\p{L}\\p{N}_])' || regexp_escape(name) || '([^\\p{L}\\p{N}_]|$)')")
def contained_words(spark, sf_dir):
    found = containment.contained_names(table(spark, sf_dir, "pages"), _names(spark, sf_dir), text_id="page_id", text="html", whole_words=True)
    return found.select(F.col("text_id").alias("page_id"), "name")


def _index(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "embeddings")
    return threshold_join.build_index(rows), rows.filter("vec_id % 50 = 0")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0)
SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v q JOIN v ON list_cosine_similarity(q.e, v.e) >= 0.3 WHERE q.vec_id % 50 = 0""")
def vector_threshold_join(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    return threshold_join.search(index, queries, least=0.3)[0].select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.label, v.vec_id, max(round(list_cosine_similarity(q.e, v.e), 9)) AS similarity FROM v q JOIN v ON v.vec_id <> q.vec_id AND list_cosine_similarity(q.e, v.e) >= 0.25 WHERE q.vec_id % 50 = 0 AND q.label IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT label, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 20""")
def relation_bootstrap(spark, sf_dir):
    """Examples of a concept found among chunks: at most 20 vectors of highest similarity to one of a label's seeds (reports, not caps)."""
    index, queries = _index(spark, sf_dir)
    found = threshold_join.search(index, queries, least=0.25)[0].filter("query_id != vec_id")
    labels = queries.filter("label is not null").select(F.col("vec_id").alias("query_id"), "label")
    best = found.join(labels, "query_id").groupBy("label", "vec_id").agg(F.max("similarity").alias("similarity"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id")).cast("bigint"))
    return ranked.filter("rank <= 20").withColumn("similarity", F.round("similarity", 6))


@query()
def threshold_index_share(spark, sf_dir):
    """Block and query pairs that bounds leave to compare at the usual threshold of 0.75."""
    index, queries = _index(spark, sf_dir)
    return threshold_join.search(index, queries)[1]
