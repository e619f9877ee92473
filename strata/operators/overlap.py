"""The best partners of each row by the overlap of sets, without pairing all rows that share an item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sets of more items have too many parts; they meet all partners of an item instead.
LONGEST = 6


def candidates(sets: DataFrame, k: int, *, partners: DataFrame | None = None, least: float = 0.0, most: float = 1.0, group: str | None = None, apart: str | None = None) -> DataFrame:
    """a, b: pairs of sets(id, items, perhaps group) that hold the k best partners b of each a by shared items over the larger set, ties by least id.

    Partners come from ``partners`` (same columns), from all sets if not given; only those of one group if it is given, where partners that
    share nothing are listed too if ``least`` is negative; only those that differ in column apart if it is given, though others may come. Overlaps of ``least`` or under may be missing, those of ``most`` or over are ties. More pairs than needed may come.

    A partner with just the common items c precedes, or follows, others of its size that hold c: those have as much in common or more. So
    it is among the k + 1 least ids (one may be a) of all partners of that size that hold c, and a needs just those lists for the parts of
    its own set. An item that many rows have costs a list of k + 1 ids, not pairs. A partner that is needed comes with the part that it has in
    common, others with that or less; so by the largest parts the k best are kept. With apart a list has the least 2 k of the k least ids of each
    value of it, of which at most k have the value of a.
    """
    partners = sets if partners is None else partners
    key = [] if group is None else [group]
    value = [] if apart is None else [apart]
    known = lambda rows: rows.select("id", *key, *value, F.array_sort(F.array_distinct("items")).alias("items")).withColumn("_m", F.size("items")).filter(F.col("_m") > 0 if least >= 0 else F.lit(True))
    a, b = known(sets), known(partners)
    short = F.col("_m") <= LONGEST
    none = F.array(F.array().cast(a.schema["items"].dataType))
    grown = F.aggregate("items", none, lambda parts, x: F.concat(parts, F.transform(parts, lambda p: F.concat(p, F.array(x)))))
    parts = lambda rows: rows.filter(short).select("id", *key, *value, "_m", F.explode(grown).alias("_part")).filter(F.size("_part") > 0 if least >= 0 else F.lit(True))
    first = lambda rows, most, *by: rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "_part", "_m", *by).orderBy("id"))).filter(F.col("_r") <= most)
    listed = first(parts(b), k + 1) if apart is None else first(first(parts(b), k, apart), 2 * k)
    lists = listed.groupBy(*key, "_part", "_m").agg(F.collect_list("id").alias("_ids"))
    lists = lists.select(*key, "_part", F.col("_m").alias("_n"), "_ids")
    common = F.size("_part") / F.greatest("_m", "_n")
    near = parts(a).join(lists, [*key, "_part"]).filter(common > least)
    if apart is None:  # lists are dealt to each a before they are written out, and just its k best go on
        near = near.select(F.col("id").alias("a"), F.least(common, F.lit(most)).alias("_s"), "_ids").repartition("a").select("a", "_s", F.explode("_ids").alias("b"))
        near = near.filter("a != b").groupBy("a", "b").agg(F.max("_s").alias("_s"))
        pairs = [near.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("_s"), "b"))).filter(F.col("_r") <= k).select("a", "b")]
    else:
        pairs = [near.select(F.col("id").alias("a"), F.explode("_ids").alias("b"))]
    items = lambda rows, end: rows.select(F.col("id").alias(end), *key, F.explode("items").alias("_item"))
    on = [*key, "_item"] if least >= 0 else key
    for x, y in ((a.filter(~short), b), (a.filter(short), b.filter(~short))):
        pairs.append(items(x, "a").join(items(y, "b"), on).select("a", "b") if least >= 0 else x.select(F.col("id").alias("a"), *key).join(y.select(F.col("id").alias("b"), *key), on).select("a", "b"))
    return reduce(DataFrame.unionByName, pairs).filter("a != b").distinct()


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with overlap: shared items of sets(id, items) over the larger set; 0 where a side has none."""
    left, right = (sets.select(F.col("id").alias(end), F.array_distinct("items").alias(f"_{end}")) for end in "ab")
    rows = pairs.join(left, "a", "left").join(right, "b", "left")
    share = F.size(F.array_intersect("_a", "_b")) / F.greatest(F.size("_a"), F.size("_b"))
    return rows.withColumn("overlap", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.greatest(F.size("_a"), F.size("_b")) > 0), share).otherwise(0.0)).drop("_a", "_b")
