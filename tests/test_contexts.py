"""Contexts: what SQL does not express, and odd inputs."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from strata.operators import contexts as c


def test_sequence_similarity(spark):
    rows = [("kitten", "sitting"), ("", ""), (None, "a"), ("same", "same"), ("abcabc" * 40, "acbacb" * 40)]
    frame = spark.createDataFrame(rows, "a string, b string")
    found = [r.s for r in frame.select(c.sequence_similarity("a", "b").alias("s")).collect()]
    assert found == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in rows]


def test_internal_function_without_end_or_name(spark):
    text = "function f(x)\n" + "\n".join(f"line {i}" for i in range(80))
    row = spark.createDataFrame([(text,)], "t string").select(c.internal_function(F.col("t"), "f").alias("a"), c.internal_function(F.col("t"), "g").alias("b")).first()
    assert row.a.split("\n") == text.split("\n")[:51] and row.b is None


def test_targets_without_hits_fall_back_to_the_first(spark):
    chunks = spark.createDataFrame([(1, i, i, None, None, None) for i in range(1, 9)], "query_id int, chunk_id int, rank int, name string, text string, part_of string")
    out = c.filter_by_targets(chunks, spark.createDataFrame([(1, "zzz")], "query_id int, target string"))
    assert sorted((r.chunk_id, r.how) for r in out.collect()) == [(i, "top") for i in range(1, 6)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "entity_id int, name string, etype string, file string, start_line int, end_line int")
    assert c.name_concepts(none).count() == c.type_concepts(none).count() == c.main_entity(none).count() == 0
