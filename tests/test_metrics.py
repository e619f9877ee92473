"""Triples that match: as the plain join of all triples of a relation finds them, without that join."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.functions import text as t
from strata.operators import metrics


def plain(detected, gold):
    d, g = (x.select(F.lower("rel").alias("rel"), t.normalise_name("sub").alias(f"s{k}"), t.normalise_name("obj").alias(f"o{k}"), F.xxhash64("sub", "rel", "obj").alias(f"i{k}")) for x, k in ((detected, "d"), (gold, "g")))
    inside = lambda a, b: F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a))
    pairs = d.join(g, "rel").filter(inside("sd", "sg") & inside("od", "og"))
    pairs = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("ig").orderBy("id"))).filter("_r = 1").withColumn("_q", F.row_number().over(Window.partitionBy("id").orderBy("ig"))).filter("_q = 1")
    n = pairs.agg(F.count(F.lit(1)).alias("tp")).crossJoin(detected.agg(F.count(F.lit(1)).alias("d"))).crossJoin(gold.agg(F.count(F.lit(1)).alias("g")))
    return n.select(*metrics.scores(F.col("tp"), F.col("d"), F.col("g")))


def triples(spark, seed, n):
    rng = random.Random(seed)
    text = lambda: rng.choice(["", "(x)", None, *("".join(rng.choice("ab ") for _ in range(rng.randrange(1, 6))) for _ in range(12))])
    rows = [(text(), rng.choice(["is", "IS", "has", None]), text()) for _ in range(n)]
    return spark.createDataFrame(rows, "sub string, rel string, obj string")


def test_matches_equal_the_plain_join(spark):
    for seed in range(4):
        d, g = triples(spark, seed, 25), triples(spark, seed + 100, 30)
        assert metrics.triple_metrics(d, g).collect() == plain(d, g).collect()
    assert metrics.triple_metrics(triples(spark, 1, 20).limit(0), triples(spark, 2, 5)).first().f1 == 0


def test_one_relation_is_not_paired(spark):
    d = spark.range(40_000).select(F.format_string("Name %06d", "id").alias("sub"), F.lit("in").alias("rel"), F.concat(F.lit("Place_"), (F.col("id") % 25).cast("string")).alias("obj"))
    rows = metrics.triple_metrics(d, d.filter("sub like '%0'"))
    joins = rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.first().precision == 0.1 and rows.first().recall == 1
    assert "contains" not in joins.lower()
