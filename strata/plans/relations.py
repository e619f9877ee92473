"""Queries on relation learning and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import relations as r
from strata.operators import translation
from strata.plans.derived import frame, with_sql
from strata.plans.registry import query, table


@query(with_sql("relation_edges") + """, reach(s, o, d) AS (SELECT s, o, 1 FROM relation_edges UNION SELECT r.s, e.o, r.d + 1 FROM reach r JOIN relation_edges e ON e.s = r.o WHERE r.d < 60) SELECT s, o, min(d)::INTEGER AS hops, round(power(0.8::DOUBLE, min(d)), 6) AS score FROM reach WHERE s <> o GROUP BY s, o HAVING min(d) > 1""")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.transitive_closure(frame(spark, "relation_edges", sf_dir)).withColumn("score", F.round(r.chained_score(F.col("hops")), 6))


@query()
def relation_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring ids stand for examples of a relation, the parity of the first's label; maps are fitted on all of them and applied to every 50th vector, with all vectors as concepts."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    pairs = e.alias("x").join(e.alias("y"), F.col("y.id") == F.col("x.id") + 1).select(F.concat(F.lit("r"), (F.col("x.label") % 2).cast("string")).alias("relation"), F.col("x.vec").alias("s"), F.col("y.vec").alias("o"))
    return r.predict(e.filter("id % 50 = 0").select("id", "vec"), r.fit_maps(pairs, 64), e.select("id", "vec"), 3, 0.1).select("subject", "relation", "object", "rank", F.round("similarity", 5).alias("similarity"))


@query("""WITH e AS (SELECT DISTINCT o_orderstatus AS relation, o_custkey AS s, o_custkey % 97 AS o FROM orders UNION SELECT DISTINCT 'rev', o_custkey % 97, o_custkey FROM orders UNION SELECT DISTINCT 'rev', o_custkey, o_custkey % 97 FROM orders), b AS (SELECT e.*, f.s IS NOT NULL AS back FROM e LEFT JOIN e f ON f.relation = e.relation AND f.s = e.o AND f.o = e.s)
SELECT relation, count(*) AS n, bool_and(back) AS symmetric, bool_and(s = o) AS reflexive, (SELECT max(k) = 1 FROM (SELECT count(*) AS k FROM e x WHERE x.relation = b.relation GROUP BY x.s)) AS functional FROM b GROUP BY relation""")
def relation_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    e = o.select(F.col("o_orderstatus").alias("relation"), F.col("o_custkey").alias("s"), (F.col("o_custkey") % 97).alias("o"))
    both = o.select(F.lit("rev").alias("relation"), (F.col("o_custkey") % 97).alias("s"), F.col("o_custkey").alias("o")).unionByName(o.select(F.lit("rev").alias("relation"), F.col("o_custkey").alias("s"), (F.col("o_custkey") % 97).alias("o")))
    return r.properties(e.unionByName(both))


@query("SELECT o_orderstatus AS relation, count(*) AS n, round(least(0.8::DOUBLE, 0.4::DOUBLE * (1 + count(*) / 50.0::DOUBLE)), 6) AS threshold FROM orders GROUP BY 1 HAVING count(*) >= 3")
def learnable_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with three examples or more, and the adaptive threshold of inference."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("relation")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return g.withColumn("threshold", F.round(r.infer_threshold(0.4, F.col("n")), 6))


@query("""WITH p AS (SELECT DISTINCT c_nationkey AS s, c_custkey % 97 AS o FROM customer) SELECT s, o FROM (SELECT DISTINCT s FROM p), (SELECT DISTINCT o FROM p) EXCEPT SELECT s, o FROM p""")
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrupted pairs: subjects and objects that never occur together."""
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s"), (F.col("c_custkey") % 97).alias("o")).distinct()
    return p.select("s").distinct().crossJoin(F.broadcast(p.select("o").distinct())).join(p, ["s", "o"], "left_anti")


@query()
def translation_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts on customers, suppliers, parts and places; the region of every tenth customer is held out and ranked among all names."""
    names = F.concat_ws(":", F.lit("nation"), "n_name").alias("nation"), F.concat_ws(":", F.lit("region"), "r_name").alias("region")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", *names)
    customer = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    part = table(spark, sf_dir, "part")
    fact = lambda rows, s, relation, o: rows.select(F.col(s).alias("s"), F.lit(relation).alias("relation"), F.col(o).alias("o"))
    held = F.col("c_custkey") % 10 == 3
    known = fact(places, "nation", "lies_in", "region").unionByName(fact(customer, "c_name", "lives_in", "nation")).unionByName(fact(supplier, "s_name", "lives_in", "nation"))
    known = known.unionByName(fact(part, "p_name", "of_brand", "p_brand")).unionByName(fact(part, "p_name", "of_type", "p_type")).unionByName(fact(customer.filter(~held), "c_name", "belongs_to", "region"))
    entities, relations = translation.fit(known, step_rows=64)
    tests = customer.filter(held).select(F.col("c_custkey").alias("test"), F.col("c_name").alias("s"), F.lit("belongs_to").alias("relation"), F.col("region").alias("o"))
    return translation.link_ranks(tests, known, entities, relations).select(F.col("s").alias("customer"), F.col("o").alias("region"), "rank")
