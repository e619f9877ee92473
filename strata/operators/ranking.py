"""Hybrid ranking: similarity, concept match and names fused; parts of entities regrouped; containers dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata import config
from strata.operators.ontology import parents


def concept_scores(chunks: DataFrame, wanted: DataFrame, axioms: DataFrame | None = None) -> DataFrame:
    """chunk_id, concept: best product of confidences over equal concepts, and over concepts with a common parent times 0.7.

    Both are equi-joins on a uri, so chunks are never paired with all concepts of a query, and only a query's concepts are paired with their siblings.
    """
    q = wanted.select(F.col("uri").alias("_u"), F.col("confidence").alias("_c"), F.lit(1.0).alias("_f"))
    if axioms is not None:
        up = parents(axioms)
        above = wanted.join(up, F.col("uri") == F.col("child")).select("parent", F.col("uri").alias("_of"), F.col("confidence").alias("_c")).distinct()
        near = above.join(up, "parent").filter("child != _of").select(F.col("child").alias("_u"), "_c", F.lit(config.RELATED_FACTOR).alias("_f")).distinct()
        q = q.unionByName(near)
    return chunks.join(q, F.col("uri") == F.col("_u")).groupBy("chunk_id").agg(F.max(F.col("confidence") * F.col("_c") * F.col("_f")).alias("concept"))


def combined(similarity: Column, concept: Column, named: Column, exact: Column, partial: Column, weight: float = config.CONCEPT_WEIGHT) -> Column:
    """(1 - w) * similarity + w * concept + 0.1 for a name in the query; times 1.35 for an exact target, 0.25 for a partial one."""
    score = (1 - weight) * similarity + weight * F.coalesce(concept, F.lit(0.0)) + F.when(named, config.NAME_BONUS).otherwise(0.0)
    return score * F.when(exact, config.EXACT_FACTOR).when(partial, config.PARTIAL_FACTOR).otherwise(1.0)


def drop_containers(rows: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows whose range in the file encloses another row's are left out."""
    inner = rows.select(F.col("file").alias("_f"), F.col(key).alias("_k"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    inside = (F.col("file") == F.col("_f")) & (F.col(key) != F.col("_k")) & (F.col("start_line") <= F.col("_s")) & (F.col("end_line") >= F.col("_e")) & ((F.col("end_line") - F.col("start_line")) > (F.col("_e") - F.col("_s")))
    return rows.join(inner, inside, "left_anti")


def related_boost(rows: DataFrame, group: str, score: str, k: int, tie: str) -> DataFrame:
    """Entities among the best max(3, n/5) rows lift their other chunks that score under 0.9 of the best: by 1.5, or 1.05 where the best is 0.4 or less."""
    head = rows.orderBy(F.desc(score), tie).limit(max(3, k // 5)).groupBy(group).agg(F.max(score).alias("_best")).filter(F.col(group).isNotNull())
    factor = F.when(F.col("_best").isNotNull() & (F.col(score) < 0.9 * F.col("_best")), F.when(F.col("_best") <= 0.4, 1.05).otherwise(1.5)).otherwise(1.0)
    return rows.join(F.broadcast(head), group, "left").withColumn(score, F.col(score) * factor).drop("_best")


def group_parts(parts: DataFrame) -> DataFrame:
    """Split entities put together: bounds, parts in order, and whether all of 1..total are there."""
    rows = parts.withColumn("base", F.regexp_replace("name", r"_part_\d+$", ""))
    g = rows.groupBy("base").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sort_array(F.collect_set("part")).alias("_p"), F.max("total").alias("total"))
    return g.withColumn("complete", F.col("_p") == F.sequence(F.lit(1), F.col("total"))).withColumn("n_parts", F.size("_p")).drop("_p")


def search_by_concept(vectors: DataFrame, found: DataFrame, wanted: DataFrame, k: int, least: float = 0.4) -> DataFrame:
    """The k most similar chunks that have a wanted concept with enough confidence; a chunk counts once."""
    hit = found.filter(F.col("confidence") >= least).join(wanted, "uri").select("chunk_id").distinct()
    return vectors.join(hit, "chunk_id", "left_semi").orderBy(F.desc("similarity"), "chunk_id").limit(k)
