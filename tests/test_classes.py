"""Pairs that are found between classes: the rows are those of the plain joins, and no pair of members is shuffled."""

import random
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import classes
from strata.operators import contexts as c
from strata.operators import ontology as o
from strata.operators import ranking as r

SPACE = r"^(.*[#/])[^#/]*$"


def axioms(spark, n=60, seed=3):
    rng = random.Random(seed)
    kinds = ["subsumption", "semantic_equivalent", "semantic_opposite", "semantic_odd", "domain"]
    name = lambda: f"{rng.choice('pq')}#{rng.randrange(14)}"
    rows = [(rng.choice(kinds), name(), name()) for _ in range(n)] + [("subsumption", f"p#leaf{i}", "p#1") for i in range(30)]
    rows += [("subsumption", "p#self", "p#self"), ("domain", "r#only", "p#1"), ("domain", "r#too", "p#1"), ("subsumption", None, "p#2"), ("semantic_equivalent", "p#3", None), (None, "p#4", "q#4"), ("semantic_odd", "bare", "plain")]
    return spark.createDataFrame(rows, "type string, source string, target string")


def plain_distances(a):
    near = o.neighbors(a)
    names = o.concepts(a).withColumn("space", F.regexp_extract("uri", SPACE, 1))
    one = near.select(F.col("uri").alias("a"), F.col("neighbor").alias("b"), F.lit(1).alias("d"))
    two = near.alias("x").join(near.alias("y"), F.col("x.neighbor") == F.col("y.neighbor")).select(F.col("x.uri").alias("a"), F.col("y.uri").alias("b"), F.lit(2).alias("d")).filter("a != b")
    three = names.select(F.col("uri").alias("a"), "space").join(names.select(F.col("uri").alias("b"), "space"), "space").select("a", "b", F.when(F.col("a") == F.col("b"), 0).otherwise(3).alias("d"))
    return reduce(DataFrame.unionByName, [one, two, three]).groupBy("a", "b").agg(F.min("d").alias("distance"))


def plain_compatibility(a):
    scores = F.create_map(*(x for k, v in o.RELATION_SCORES.items() for x in (F.lit(k), F.lit(v))))
    hier = o.parents(a).select(F.col("child").alias("a"), F.col("parent").alias("b"), F.lit(0.8).alias("score"), F.lit(1).alias("rank"))
    related = a.filter("type like 'semantic_%'").select(F.col("source").alias("a"), F.col("target").alias("b"), F.coalesce(F.element_at(scores, F.col("type")), F.lit(0.3)).alias("score"), F.lit(2).alias("rank"))
    both = hier.unionByName(related)
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "score", "rank"))
    names = o.concepts(a).withColumn("space", F.regexp_extract("uri", SPACE, 1))
    space = names.select(F.col("uri").alias("a"), "space").join(names.select(F.col("uri").alias("b"), "space"), "space")
    flat = space.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.4).alias("score"), F.when(F.col("a") == F.col("b"), 0).otherwise(3).alias("rank"))
    return both.unionByName(flat).groupBy("a", "b").agg(F.min_by("score", F.struct("rank", -F.col("score"))).alias("score"))


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_distances_equal_the_plain_joins(spark):
    for seed in (3, 4):
        a = axioms(spark, seed=seed)
        assert rows(o.distances(a)) == rows(plain_distances(a))


def test_compatibility_equals_the_plain_joins(spark):
    for seed in (3, 4):
        a = axioms(spark, seed=seed)
        assert rows(o.compatibility(a)) == rows(plain_compatibility(a))


def shuffled(frame):
    """Rows of all exchanges in the final plan of a frame that has run."""
    frame.collect()
    return [int(x) for x in _metrics(frame._jdf.queryExecution().executedPlan())]


def _metrics(plan):
    text = plan.getClass().getSimpleName()
    if text == "AdaptiveSparkPlanExec":
        yield from _metrics(plan.executedPlan())
        return
    if text == "ShuffleQueryStageExec":
        yield from _metrics(plan.plan())
        return
    if text == "ShuffleExchangeExec":
        yield plan.metrics().apply("shuffleRecordsWritten").value()
    for i in range(plan.children().size()):
        yield from _metrics(plan.children().apply(i))


def test_pairs_are_not_shuffled(spark):
    a = spark.createDataFrame([("subsumption", f"p#{i}", "p#top") for i in range(300)], "type string, source string, target string")
    for found in (o.distances(a), o.compatibility(a)):
        assert found.count() == 301 * 301
        assert sum(shuffled(found)) < 5000
    held = spark.createDataFrame([(i, "p#0") for i in range(300)], "context int, uri string")
    found = c.search_space(held, a)
    assert found.count() == 300 * 301
    assert sum(shuffled(found)) < 5000


def test_search_space_equals_the_plain_joins(spark):
    rng = random.Random(5)
    a, near = axioms(spark), o.neighbors(axioms(spark))
    held = [(rng.randrange(20), f"p#{rng.randrange(16)}") for _ in range(60)] + [(None, "p#1"), (3, None), (21, "no such")]
    held = spark.createDataFrame(held, "context int, uri string")
    one = held.join(near, "uri").select("context", F.col("neighbor").alias("uri"))
    two = one.join(near, "uri").select("context", F.col("neighbor").alias("uri"))
    assert rows(c.search_space(held, a)) == rows(held.unionByName(one).unionByName(two).distinct())


def test_only_concepts_of_a_query_meet_their_siblings(spark):
    a = spark.createDataFrame([("subsumption", f"p#{i}", f"p#top{k}") for i in range(300) for k in (0, 1)], "type string, source string, target string")
    chunks = spark.createDataFrame([(1, "p#1", 0.5), (2, "p#2", 0.5), (3, "p#top0", 1.0)], "chunk_id int, uri string, confidence double")
    found = r.concept_scores(chunks, spark.createDataFrame([("p#1", 0.8)], "uri string, confidence double"), a)
    assert sorted((x.chunk_id, round(x.concept, 6)) for x in found.collect()) == [(1, 0.4), (2, 0.28)]
    assert sum(shuffled(found)) < 5000


def test_one_side_is_not_copied_for_each_block_of_the_other(spark):
    left, right = spark.range(4000).selectExpr("'k' as key", "id as context"), spark.range(50).selectExpr("'k' as key", "id as uri")
    for held in (256, 20):  # one group of right blocks, several
        found = classes.crossed(left, right, "key", "context", "uri", rows=1, held=held)
        assert found.count() == found.distinct().count() == 4000 * 50
        # blocks, a row each: members_of dealt some 200,000
        assert sum(shuffled(found)) < 60_000
    none = classes.crossed(left, right.limit(0), "key", "context", "uri")
    assert none.count() == 0 == classes.crossed(left.limit(0), right, "key", "context", "uri").count()
