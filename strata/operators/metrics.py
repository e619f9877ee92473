"""Evaluation: precision, recall and F1 of predictions and of extracted triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import text as t
from strata.operators import containment
from strata.storage import cut


def scores(tp: Column, detected: Column, gold: Column) -> list[Column]:
    p, r = F.coalesce(F.try_divide(tp, detected), F.lit(0.0)), F.coalesce(F.try_divide(tp, gold), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def precision_recall(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    c = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted).alias("d"), F.count_if(actual).alias("g"))
    return c.select(*scores(F.col("tp"), F.col("d"), F.col("g"))).select(*(F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")))


def _inside(left: DataFrame, right: DataFrame) -> DataFrame:
    """rel, x, y: texts of one relation of which one holds the other. Neither side has empty texts."""
    both = (containment.held_texts(*sides, "rel").select("rel", "x", "y") for sides in ((left, "x", right, "y"), (right, "y", left, "x")))
    return reduce(DataFrame.unionByName, both).distinct()


def triple_metrics(detected: DataFrame, gold: DataFrame) -> DataFrame:
    """Triples match one to one: equal relation in any case, subject and object one inside the other after normalising names.

    Each gold triple takes its first matching detected one, so the matches are the detected triples that some gold one takes. Subjects
    are compared with subjects and objects with objects, each text once; a detected triple is then looked up by a subject
    and an object that match, never met with all of its relation. An empty text matches every text: ``*`` stands for any.
    """
    d, g = (x.select(F.lower("rel").alias("rel"), t.normalise_name("sub").alias("s"), t.normalise_name("obj").alias("o"), F.xxhash64("sub", "rel", "obj").alias("id")).dropna(subset=["rel", "s", "o"]) for x in (detected, gold))
    d, g = cut(d.groupBy("rel", "s", "o").agg(F.min("id").alias("id"))), cut(g.select("rel", "s", "o").distinct())
    keys = g
    for c in ("s", "o"):
        texts = (x.select("rel", F.col(c).alias(n)).filter(F.col(n) != "").distinct() for x, n in ((d, "x"), (g, "y")))
        found = _inside(*texts)
        every = g.select("rel", F.col(c).alias("y")).distinct().select("rel", F.when(F.col("y") == "", "*").otherwise("").alias("x"), "y")
        keys = keys.join(cut(found.unionByName(every)).select("rel", F.col("x").alias(f"_{c}"), F.col("y").alias(c)), ["rel", c])
    wide = d.withColumn("_s", F.explode(F.array("s", F.lit("*")))).withColumn("_o", F.explode(F.array("o", F.lit("*")))).groupBy("rel", "_s", "_o").agg(F.min("id").alias("id"))
    taken = keys.join(wide, ["rel", "_s", "_o"]).groupBy("rel", "s", "o").agg(F.min("id").alias("id"))
    n = taken.agg(F.countDistinct("id").alias("tp")).crossJoin(detected.agg(F.count(F.lit(1)).alias("d"))).crossJoin(gold.agg(F.count(F.lit(1)).alias("g")))
    return n.select(*scores(F.col("tp"), F.col("d"), F.col("g")))
