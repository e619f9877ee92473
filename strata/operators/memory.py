"""Associative memory over stored patterns: softmax attention, log-sum-exp energy, and concept classification built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata import config
from strata.functions import vectors as v
from strata.operators.retrieval import top_per
from strata.storage import cut


def similarities(states: DataFrame, patterns: DataFrame, *, state: str, pattern: str, vector: str = "embedding") -> DataFrame:
    """state, pattern, similarity for every state and stored pattern. Patterns are the small side (one per concept or domain)
    and are broadcast only under Spark's size threshold; beyond it the join streams them in blocks."""
    left = states.select(F.col(state), F.col(vector).alias("_s"))
    right = patterns.select(F.col(pattern), F.col(vector).alias("_p"))
    return left.crossJoin(right).select(state, pattern, v.cosine("_s", "_p").alias("similarity")).filter("similarity is not null")


def closest(pairs: DataFrame, state: str, pattern: str, k: int) -> DataFrame:
    """The k most similar patterns of each state; confidence maps cosine to 0..1."""
    return top_per(pairs, state, k, pattern).withColumn("confidence", (F.col("similarity") + 1) / 2)


def attention(pairs: DataFrame, state: str, beta: float = config.HOPFIELD_BETA) -> DataFrame:
    """Adds weight, the softmax of beta * similarity over a state's patterns, computed from the maximum down."""
    w = Window.partitionBy(state)
    shifted = pairs.withColumn("_e", F.exp(beta * (F.col("similarity") - F.max("similarity").over(w))))
    return shifted.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def update(weighted: DataFrame, patterns: DataFrame, state: str, pattern: str, size: int, vector: str = "embedding") -> DataFrame:
    """One retrieval step: the weighted sum of patterns, normalised."""
    rows = weighted.join(patterns.select(pattern, F.col(vector).alias("_p")), pattern)
    sums = rows.groupBy(state).agg(F.array(*(F.sum(F.col("weight") * F.element_at(v.as_double("_p"), i + 1)) for i in range(size))).alias("_m"))
    return sums.select(state, v.unit("_m").alias(vector))


def energy(pairs: DataFrame, state: str, beta: float = config.HOPFIELD_BETA) -> DataFrame:
    """-logsumexp(beta * similarity) / beta over all patterns, and the confidence e^-E / (1 + e^-E).

    No cosine exceeds 1, so the sum is taken from there down in one aggregate; that holds for any beta under 350.
    """
    summed = pairs.groupBy(state).agg(F.sum(F.exp(beta * (F.col("similarity") - 1))).alias("_z"))
    e = -(1 + F.ln("_z") / beta)
    return summed.select(state, e.alias("energy"), (F.exp(-e) / (1 + F.exp(-e))).alias("confidence"))


def iterate(states: DataFrame, patterns: DataFrame, steps: int, *, state: str, pattern: str, size: int, vector: str = "embedding") -> DataFrame:
    """``steps`` retrieval steps for all states."""
    for _ in range(steps):
        pairs = attention(similarities(states, patterns, state=state, pattern=pattern, vector=vector), state)
        states = update(pairs, patterns, state, pattern, size, vector)
    return states


def classify_direct(pairs: DataFrame, state: str, pattern: str, k: int, least: float) -> DataFrame:
    """Patterns with at least this similarity, the k best of each state."""
    return top_per(pairs.filter(F.col("similarity") >= least), state, k, pattern)


def classify_cascade(pairs: DataFrame, hierarchy: DataFrame, levels: int, *, state: str, pattern: str, least: float = 0.5, k: int = 3) -> DataFrame:
    """Level by level: the k best patterns of a level among the children of those accepted above, with confidence over ``least``.

    hierarchy: pattern, parent (null at level 1), level. The result is flat: level and the path from the root. Children are filtered by parent first, then ranked.
    """
    scored = pairs.withColumn("confidence", (F.col("similarity") + 1) / 2).filter(F.col("confidence") >= least)
    rows = scored.join(hierarchy.filter(F.col("level") <= levels).select(pattern, "parent", "level"), pattern)
    # the rank among a parent's children does not depend on what is accepted above, so one window serves all levels
    order = Window.partitionBy(state, "level", "parent").orderBy(F.desc("confidence"), pattern)
    best = cut(rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select(state, pattern, "parent", "level", "confidence"))
    above = best.filter("level = 1").withColumn("path", F.col(pattern).cast("string"))
    out = above
    for level in range(2, levels + 1):
        upper = above.select(state, F.col(pattern).alias("parent"), F.col("path").alias("_above"))
        above = best.filter(F.col("level") == level).join(upper, [state, "parent"]).withColumn("path", F.concat_ws("/", "_above", F.col(pattern).cast("string"))).drop("_above")
        out = out.unionByName(above)
    return out.select(state, pattern, F.col("level").cast("int").alias("level"), "confidence", "path")


def auto_detect(pairs: DataFrame, levels: DataFrame, *, state: str, pattern: str, most: int, least: float) -> DataFrame:
    """Bottom up: patterns of the deepest level first, then by confidence, until a state has ``most``."""
    rows = pairs.withColumn("confidence", (F.col("similarity") + 1) / 2).filter(F.col("confidence") >= least).join(levels.select(pattern, "level"), pattern)
    order = Window.partitionBy(state).orderBy(F.desc("level"), F.desc("confidence"), pattern)
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= most)


def smart_detection(bottom_up: DataFrame, top_down: DataFrame, *, state: str, pattern: str, most: int = config.TOP_CONCEPTS) -> DataFrame:
    """Both detections merged: a pattern keeps its best confidence; the ``most`` best stay."""
    both = bottom_up.select(state, pattern, "confidence").unionByName(top_down.select(state, pattern, "confidence"))
    return top_per(both.groupBy(state, pattern).agg(F.max("confidence").alias("confidence")), state, most, pattern, by="confidence")


def leader_clusters(rows: DataFrame, context: str, key: str, vector: str = "embedding", least: float = 0.7) -> DataFrame:
    """context, key, cluster: in the order of the key, an item joins the nearest centroid with a dot product over ``least`` and
    moves it, else leads a new cluster. Order matters, so a context is one group: the concepts of one document."""
    schema = f"{context} long, {key} long, cluster int"

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        sums: list[np.ndarray] = []
        found = []
        for x in group[vector]:
            x = np.asarray(x, float)
            x = x / (np.linalg.norm(x) or 1.0)
            near = [float(s @ x / (np.linalg.norm(s) or 1.0)) for s in sums]
            best = int(np.argmax(near)) if near else -1
            if best >= 0 and near[best] > least:
                sums[best] = sums[best] + x
            else:
                best = len(sums)
                sums.append(x)
            found.append(best)
        return pd.DataFrame({context: group[context], key: group[key], "cluster": found})

    return rows.select(F.col(context).cast("long"), F.col(key).cast("long"), vector).groupBy(context).applyInPandas(fold, schema)
