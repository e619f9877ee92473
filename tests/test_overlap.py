"""Best partners by overlap: as plain joins of all pairs find them, without those pairs."""

import random
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as t
from strata.operators import contexts as c
from strata.operators import graph as g
from strata.operators import overlap


def code(spark, seed, n=70):
    rng = random.Random(seed)
    name = lambda: "_".join(rng.choice(["grid", "Gr", "a", "b", "c", "", "run", "x1", "x2"]) for _ in range(rng.choice([1, 2, 3, 3, 9])))
    entities = [(i, rng.choice([name(), name(), None if i % 9 == 0 else "plain"]), rng.choice(["module", "function", None]), rng.choice(["f", "g", "h", None]), (s := rng.randrange(60)), s + rng.randrange(1, 50)) for i in range(n)]
    concepts = [(rng.randrange(n + 3), rng.choice(["hot", "hot", "warm", *"abcdefg"])) for _ in range(n * 4)]
    uses = [(rng.randrange(n), rng.choice(["M1", "m1", "m2", "m3", "m4"])) for _ in range(n)]
    return spark.createDataFrame(entities, "entity_id int, name string, etype string, file string, start_line int, end_line int"), spark.createDataFrame(concepts, "entity_id int, label string"), spark.createDataFrame(uses, "src_id int, dst_name string")


def best(rows, score, k):
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(score), "b")).cast("bigint")).filter(F.col("rank") <= k)


def plain_similar(e, concepts, uses, k):
    o = e.select(F.col("entity_id").alias("b"), F.col("name").alias("name_b"), "etype", F.col("file").alias("file_b"))
    same_type = e.select(F.col("entity_id").alias("a"), "name", "etype", "file").join(o, "etype").filter("a != b")
    p = g.parents(e)
    kin = p.toDF("a", "pa").join(p.toDF("b", "pb"), F.col("pa") == F.col("pb")).select("a", "b", F.lit(0.2).alias("kin"))
    typed = same_type.join(kin, ["a", "b"], "left").select("a", "b", (0.3 + 0.4 * t.name_similarity(F.col("name"), F.col("name_b")) + F.coalesce("kin", F.lit(0.0))).alias("score"), F.lit("type").alias("reason")).filter("score > 0.4")
    deps = g.concept_overlap(uses.select(F.col("src_id").alias("entity_id"), F.lower("dst_name").alias("label")))
    near = e.select(F.col("entity_id").alias("a"), "file").join(e.select(F.col("entity_id").alias("b"), "file"), "file").filter("a != b").join(deps, ["a", "b"], "left")
    filed = near.select("a", "b", (0.4 + 0.3 * F.coalesce("overlap", F.lit(0.0))).alias("score"), F.lit("file").alias("reason")).filter("score > 0.4")
    shared = g.concept_overlap(concepts).filter("overlap > 0.2").select("a", "b", F.col("overlap").alias("score"), F.lit("concepts").alias("reason"))
    merged = reduce(DataFrame.unionByName, [typed, filed, shared]).groupBy("a", "b").agg(F.max("score").alias("score"), F.array_join(F.slice(F.array_sort(F.collect_set("reason")), 1, 4), ",").alias("reasons"))
    return best(merged, "score", k)


def rows(frame):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.select(*sorted(frame.columns)).collect()), key=repr)


def test_similar_entities_equal_the_plain_joins(spark):
    for seed, k in ((1, 2), (2, 8)):
        e, concepts, uses = code(spark, seed)
        assert rows(g.similar_entities(e, concepts, uses, k)) == rows(plain_similar(e, concepts, uses, k).select("a", "b", "score", "reasons", "rank"))


def test_related_modules_equal_the_plain_joins(spark):
    e, concepts, _ = code(spark, 3)
    modules = e.filter("etype = 'module'").select(F.col("entity_id").alias("b"), F.col("name").alias("module"))
    plain = best(g.concept_overlap(concepts).join(modules, "b").filter("overlap > 0.2"), "overlap", 3)
    assert rows(c.related_modules(e, concepts, 3)) == rows(plain.select(F.col("a").alias("entity_id"), "module", F.col("overlap").alias("similarity"), "rank"))


def test_a_common_item_makes_no_pairs(spark):
    sets = spark.range(2000).select("id", F.array(F.lit("hot"), F.concat(F.lit("u"), F.col("id").cast("string"))).alias("items"))
    assert overlap.candidates(sets, 3).count() <= 2000 * 4


def plain_cross(e, concepts, uses, calls, k):
    part = lambda refs, w: g.resolved(e, refs).filter("dst_id is not null").select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), F.lit(w).alias("score")).distinct()
    found = g.concept_overlap(concepts).select("a", "b", (0.6 * F.col("overlap")).alias("score")).unionByName(part(uses, 0.4)).unionByName(part(calls, 0.3)).groupBy("a", "b").agg(F.sum("score").alias("score"))
    f = e.select("entity_id", "file")
    found = found.join(f.toDF("a", "fa"), "a").join(f.toDF("b", "fb"), "b").filter("fa != fb").filter(F.col("score") > 0.2).drop("fa", "fb")
    return best(found.withColumn("score", F.round("score", 9)), "score", k)


def test_cross_file_relations_equal_the_plain_joins(spark):
    e, concepts, uses = code(spark, 4)
    calls = uses.select("src_id", F.lit("plain").alias("dst_name"))
    assert rows(g.cross_file_relations(e, concepts, uses, calls, 2)) == rows(plain_cross(e, concepts, uses, calls, 2))


def test_cross_file_relations_make_no_pairs_of_a_common_label(spark, monkeypatch):
    e = spark.range(600).selectExpr("cast(id as int) as entity_id", "concat('n', id) as name", "'module' as etype", "concat('f', id % 3) as file", "1 as start_line", "2 as end_line")
    concepts = e.select("entity_id", F.lit("hot").alias("label")).unionByName(e.select("entity_id", F.concat(F.lit("u"), F.col("entity_id").cast("string")).alias("label")))
    seen = []
    whole = overlap.overlaps
    monkeypatch.setattr(overlap, "overlaps", lambda pairs, sets: seen.append(pairs.count()) or whole(pairs, sets))
    none = spark.createDataFrame([], "src_id int, dst_name string")
    assert g.cross_file_relations(e, concepts, none, none, 2).count() == 1200
    assert seen and seen[0] <= 600 * 4


def test_candidates_are_the_k_best_alone(spark):
    rng = random.Random(5)
    held = {i: sorted(rng.sample("abcdefg", rng.randrange(1, 5))) for i in range(90)}
    found = overlap.candidates(spark.createDataFrame(list(held.items()), "id int, items array<string>"), 3).collect()
    common = lambda a, b: len({*held[a]} & {*held[b]}) / max(len(held[a]), len(held[b]))
    assert sorted((r.a, r.b) for r in found) == sorted((a, b) for a in held for b in sorted((b for b in held if b != a and common(a, b)), key=lambda b: (-common(a, b), b))[:3])


def test_similar_entities_agree_in_parts(spark):
    e, concepts, uses = code(spark, 6)
    assert rows(g.similar_entities(e, concepts, uses, 3, most_pairs=200)) == rows(plain_similar(e, concepts, uses, 3).select("a", "b", "score", "reasons", "rank"))
