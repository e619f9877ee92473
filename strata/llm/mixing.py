"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

Slots of about equal numbers of tokens are numbered 0, 1, 2, ...; the van der Corput point of a slot, mapped through the
cumulative target shares, names its source, so every stretch of the schedule is close to the target mix; a source between
two points gets a slot of its own. Slots are ranked within their source and share its target, rounded to words, evenly: a
slot's length differs a little between sources, so that each source, small ones too, gives just its target. Each source's
documents are laid end to end in hash order; its slots take its words one after another and begin again at the end. A
document's words are taken as often as slots hold them.

Ranks and positions are prefix sums in two levels (sums of buckets, then inside each bucket), so that a source with most of
the rows is not one task. Only the total and the number of sources' tokens, a scalar, reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.storage import cut

_BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def source_targets(sizes: DataFrame, total: int, weights: tuple[int, ...], most: int) -> DataFrame:
    """sizes: source, source_size. Adds sid (rank of the source, null last), target, and the share [low, high) of the schedule.

    Targets share the total by weight and stop at ``most`` times their source's size: with sources by size over weight,
    there is one level at which those below it stop and the others share what is left.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("sid", F.row_number().over(order)).withColumn("weight", cycle.cast("double"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(float(total)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    capped = named.withColumn("cap", F.col("source_size") * float(most)).withColumn("level", level)
    # the level of the first source that does not stop holds for all after it
    kept = capped.withColumn("free", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    common = F.first("free", ignorenulls=True).over(ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = kept.withColumn("target", F.least("cap", F.coalesce(common * F.col("weight"), F.col("cap"))))
    share = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = F.sum("target").over(share) / F.greatest(F.sum("target").over(Window.partitionBy(F.lit(0))), F.lit(1.0))
    return target.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0.0))).drop("cap", "level", "free")


def _prefix(rows: DataFrame, group: list[str], bucket: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """Adds the sum of amount over rows before this one in its group; buckets are ordered, rows ordered inside them."""
    sums = rows.groupBy(*group, bucket).agg(F.sum(amount).alias("_sum"))
    lower = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(lower), F.lit(0).cast("long"))).drop("_sum")
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0).cast("long"))).join(base, [*group, bucket]).withColumn(name, F.col("_base") + F.col("_in")).drop("_base", "_in")


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, slots: int = 1 << 16, most_tokens: int = 4096, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, taken (words, repeats counted), a row for each row.

    Of each source round(target) words are taken. A slot has about the tokens that make about ``slots`` slots of the whole, between 1 and ``most_tokens``. Null and wordless texts have size
    0 and nothing is taken of them; a null source is a source, the last one. Rows with equal doc_id and text are laid out
    next to each other. No document is taken more than ``most`` times.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(doc_id), F.col(text)).alias("place"))
    rows = cut(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    token = max(1, min(most_tokens, total // slots))
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), total, weights, most)
    sources = cut(sources.withColumn("words", F.round("target").cast("long")))
    rows = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    width = max(1, (total // token + 1).bit_length())
    point = F.conv(F.reverse(F.lpad(F.bin("id"), width, "0")), 2, 10).cast("double") / float(1 << width)
    schedule = docs.sparkSession.range(-(-total // token)).withColumn("u", point).withColumn("cell", F.floor(F.col("u") * _BUCKETS))
    cells = sources.filter("high > low").select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * _BUCKETS), F.least(F.floor(F.col("high") * _BUCKETS), F.lit(_BUCKETS - 1).cast("long")))).alias("cell"))
    slot = schedule.join(cells, "cell").filter("u >= low and u < high").select("id", "sid", F.expr(f"id div {_BUCKETS}").alias("chunk"))
    ranked = _prefix(slot, ["sid"], "chunk", ["id"], F.lit(1).cast("long"), "rank").select("sid", "rank")
    slots_of = slot.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    shares = sources.filter("words > 0").select("sid", "source_size", "words").join(slots_of, "sid", "left")
    own = shares.filter("n is null").select("sid", F.lit(0).cast("long").alias("rank"), "source_size", "words", F.lit(1).cast("long").alias("n"))
    owned = ranked.join(shares.filter("n is not null"), "sid").select(*own.columns).unionByName(own)

    # a slot's words in the source's endless row of words, cut where the source begins again, and then into blocks
    first = lambda rank: rank * F.expr("words div n") + F.least(rank, F.expr("words % n"))
    span = owned.select("sid", "source_size", first(F.col("rank")).alias("a"), first(F.col("rank") + 1).alias("z")).filter("a < z")
    turn = span.select("*", F.explode(F.expr("sequence(a div source_size, (z - 1) div source_size)")).alias("turn"))
    turn = turn.select("sid", F.expr("greatest(a - turn * source_size, 0)").alias("a"), F.expr("least(z - turn * source_size, source_size)").alias("z"))
    part = turn.select("*", F.explode(F.expr(f"sequence(a div {token}, (z - 1) div {token})")).alias("block"))
    part = part.select("sid", "block", F.struct(F.expr(f"greatest(a, block * {token})").alias("a"), F.expr(f"least(z, (block + 1) * {token})").alias("z")).alias("part"))
    taken = part.groupBy("sid", "block").agg(F.collect_list("part").alias("parts"))  # few: a block is taken at most ``most`` times

    full = rows.filter("size > 0").withColumn("bucket", F.shiftright("place", 52))
    laid = _prefix(full, ["sid"], "bucket", ["place", "doc_id", "size"], F.col("size"), "start")
    piece = laid.withColumn("block", F.explode(F.sequence(F.expr(f"start div {token}"), F.expr(f"(start + size - 1) div {token}"))))
    common = lambda x: F.greatest(F.least(F.col("start") + F.col("size"), x["z"]) - F.greatest(F.col("start"), x["a"]), F.lit(0))
    held = F.aggregate(F.coalesce("parts", F.array().cast("array<struct<a:bigint,z:bigint>>")), F.lit(0).cast("long"), lambda n, x: n + common(x))
    columns = ["doc_id", "size", "source", "source_size", "target"]
    drawn = piece.join(taken, ["sid", "block"], "left").withColumn("held", held).groupBy("sid", "start").agg(*(F.first(x).alias(x) for x in columns), F.sum("held").alias("taken"))
    empty = rows.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return drawn.select(*columns, "taken").unionByName(empty)
