"""Exact Jaccard self-join on word shingles, down to its connected components, by prefix filters under several global orders.

Order 1 is the one that is shuffled: long shingles first, as a long shingle is seldom met by chance, ties by hash. A set of
n shingles whose partners share at least o of them hands out its first n - o + l shingles; two similar sets then have at
least l of these in common. That leaves room to drop what only meets by chance, as long as a set drops fewer than l / 2 of the shingles that it handed out:

* shingles handed out once are dropped; a set left with fewer than l of them is dropped;
* shingles handed out more than ``frequent`` times are dropped from sets that have few of them, so texts that merely share a
  well-known passage do not meet there;
* each shingle's group is named after its least member; names under which a set has the fewest shingles are dropped.

Sets of equal shingles are one node. What is left are (name, member) rows, cut into blocks of bounded size. In a block, pairs
must also share a prefix shingle under two more orders (rare in the block first; another hash) before they are compared,
and pairs that links already connect are skipped. Names of several blocks get a second look: members outside of
the largest component visit the other blocks. No pair is ever a row; a block gives at most as many links as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import columnar as c
from strata.llm.components import components
from strata.llm.storage import bound_batches, cut

_BLOOM_BITS = 1 << 25


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, concatenated, and their offsets."""
    return measured_sets(column, words)[:2]


def measured_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with the number of word bytes of every shingle."""
    data, doc = c.text_buffer(column)
    found = c.find_words(c.lower_ascii(data), doc, c.SPACE_FREE)
    value = c.word_hashes(found)
    count = np.diff(found.off)
    length = np.concatenate([[0], np.cumsum(found.end - found.start)])
    owner, token, size = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(value) >= words:
        gram = c.gram_hashes(value, words)
        ends = np.repeat(found.off[1:], count)[: len(gram)]
        at = np.flatnonzero(np.arange(len(gram)) + words <= ends)
        owner.append(np.searchsorted(found.off, at, side="right") - 1)
        token.append(gram[at])
        size.append(length[at + words] - length[at])
    for n in range(1, words):  # texts of fewer words are one shingle
        rows = np.flatnonzero(count == n)
        if len(rows):
            owner.append(rows)
            token.append(c.mix(c.gram_hashes(value, n)[found.off[rows]] + np.uint64(n)))
            size.append(length[found.off[rows] + n] - length[found.off[rows]])
    owner, token, size = np.concatenate(owner), np.concatenate(token), np.concatenate(size)
    order = np.lexsort((token, owner))
    owner, token, size = owner[order], token[order], size[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    owner, token, size = owner[new], token[new], size[new]
    return token, np.searchsorted(owner, np.arange(len(count) + 1)), size


def set_names(token: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set; equal sets have equal names."""
    total = np.zeros(len(off) - 1, np.uint64)
    full = np.diff(off) > 0
    if full.any():
        total[full] = np.add.reduceat(c.mix(token + np.uint64(0x51ED270B)), off[:-1][full])
    return c.mix(total + np.diff(off).astype(np.uint64)).view(np.int64)


class Filter:
    """Prefix lengths for one threshold, given as a fraction of integers so that bounds are exact."""

    def __init__(self, threshold: tuple[int, int]) -> None:
        self.top, self.bottom = threshold

    def shared(self, n: np.ndarray | int):
        """Least overlap with any partner."""
        return -(-self.top * n // self.bottom)

    def need(self, n: np.ndarray | int):
        """l: how many handed-out shingles a similar pair has in common."""
        return np.minimum(self.shared(n), (self.bottom - self.top) * n // (2 * self.bottom) + 3)

    def prefix(self, n: np.ndarray | int):
        return n - self.shared(n) + self.need(n)


def _tokens(words: int, rule: Filter, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.slices(batches, "_x"):
            token, off, length = measured_sets(batch.column("_x"), words)
            size = np.diff(off)
            name = set_names(token, off)
            # equal sets of a batch hand out their shingles once
            first = np.zeros(len(size), bool)
            first[np.unique(name, return_index=True)[1]] = True
            owner = np.repeat(np.arange(len(size)), size)
            rank = np.empty(len(token), np.int64)
            rank[np.lexsort((token, -length, owner))] = np.arange(len(token)) - off[:-1][owner]
            keep = first[owner] & (rank < rule.prefix(size)[owner])
            owner = owner[keep]
            yield pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(name[owner]), pa.array(size[owner].astype(np.int32))], schema=schema)

    return run


def _sets(words: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.slices(batches, "_x"):
            token, off = shingle_sets(batch.column("_x"), words)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(set_names(token, off)), pa.array(np.diff(off))], schema=schema)

    return run


def _bloom_bits(names: np.ndarray) -> np.ndarray:
    x = names.view(np.uint64)
    return np.concatenate([(c.mix(x + np.uint64(s)) % np.uint64(_BLOOM_BITS)).astype(np.int64) for s in (3, 5, 7)])


def _bloom(names: DataFrame) -> np.ndarray:
    """Bloom filter of fixed size (4 MB); where it fills up, it lets everything pass and the join behind it decides."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_BLOOM_BITS, bool)
        for batch in batches:
            bits[_bloom_bits(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(_BLOOM_BITS // 8, np.uint8)
    for row in names.coalesce(4).mapInArrow(part, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def _wanted(words: int, bloom, schema: pa.Schema):
    """(name, text) of the texts whose set the filter lets pass, one of equal sets in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        for batch in c.slices(batches, "_x"):
            name = set_names(*shingle_sets(batch.column("_x"), words))
            at = _bloom_bits(name).reshape(3, -1)
            hit = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
            first = np.zeros(len(name), bool)
            first[np.unique(name, return_index=True)[1]] = True
            keep = np.flatnonzero(hit & first)
            yield pa.RecordBatch.from_arrays([pa.array(name[keep]), batch.column("_x").take(pa.array(keep))], schema=schema)

    return run


class _Block:
    """Members of one block: sorted shingle sets, and which of them must be compared (with everyone)."""

    def __init__(self, rule: Filter, orders: int) -> None:
        self.rule, self.orders = rule, orders

    def links(self, sets: list[np.ndarray], asks: np.ndarray) -> list[tuple[int, int]]:
        """Pairs that join what was not joined yet; a pair is looked at if either side asks."""
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        token, place, often = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        off = np.concatenate([[0], np.cumsum(size)])
        prefix = size - self.rule.shared(size) + 1
        filters = []
        for order in range(2, self.orders + 1):
            key = c.mix(token + np.uint64(order))
            rank = np.empty(len(token), np.int64)
            rank[np.lexsort((key, often)) if order == 2 else np.argsort(key)] = np.arange(len(token))
            by = np.lexsort((rank[place], owner))
            chosen = by[(np.arange(len(by)) - off[:-1][owner]) < prefix[owner]]
            filters.append((_postings(place[chosen], owner[chosen], len(token)), _lists(owner[chosen], place[chosen], len(sets))))
        full = _postings(place, owner, len(token))
        root = np.arange(len(sets))

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        out = []
        for x in np.flatnonzero(asks).tolist():
            near = None
            for posting, mine in filters:
                met = np.zeros(len(sets), bool)
                met[_gather(posting, mine[0][mine[1][x] : mine[1][x + 1]])] = True
                near = met if near is None else near & met
            near &= (self.rule.bottom * np.minimum(size, size[x]) >= self.rule.top * np.maximum(size, size[x])) & (~asks | (np.arange(len(sets)) > x))
            near[x] = False
            others = np.flatnonzero(near)
            if len(others):
                mine = find(x)
                others = others[[find(y) != mine for y in others.tolist()]]
            if not len(others):
                continue
            common = np.bincount(_gather(full, place[off[x] : off[x + 1]]), minlength=len(sets))[others]
            for y in others[common * self.rule.bottom >= self.rule.top * (size[x] + size[others] - common)].tolist():
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((x, y))
        return out


def _lists(key: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    return value[order], np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n))])


_postings = _lists


def _gather(lists: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """All values of these keys, end to end."""
    value, off = lists
    size = off[keys + 1] - off[keys]
    return value[np.repeat(off[keys] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] if len(keys) else value[:0]


def _compare(words: int, rule: Filter, orders: int, schema: pa.Schema):
    """Blocks arrive one after another, their members together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(rule, orders)
        last, nodes, sets, asks = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                found = block.links(sets, np.array(asks, bool))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in found], pa.int64()), pa.array([nodes[y] for _, y in found], pa.int64())], schema=schema)

        for batch in c.slices(batches, "_x"):
            token, off = shingle_sets(batch.column("_x"), words)
            for i, (key, node, ask) in enumerate(zip(zip(batch.column("name").to_pylist(), batch.column("block").to_pylist(), strict=True), batch.column("node").to_pylist(), batch.column("ask").to_pylist(), strict=True)):
                if key != last:
                    yield from close()
                    last, nodes, sets, asks = key, [], [], []
                nodes.append(node)
                sets.append(token[off[i] : off[i + 1]])
                asks.append(ask)
        yield from close()

    return run


def jaccard_classes(docs: DataFrame, *, words: int = 5, threshold: tuple[int, int] = (8, 10), orders: int = 3, frequent: int = 64, block: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach, itself included), one row for each input row.

    Two texts link when the Jaccard similarity of their sets of ``words``-word shingles is at least the threshold, a
    fraction (numerator, denominator). Letters A-Z are lower-cased; a text of fewer words is one shingle. Null or wordless
    texts have no shingles and link with nothing, so each is its own component. Rows that share a doc_id share the least
    component that any of them reaches through equal or similar texts. Null doc_ids count as largest. Set names have 64 bits.
    """
    bound_batches(docs.sparkSession)
    rule = Filter(threshold)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_x"))
    i64 = pa.int64()
    sets = rows.mapInArrow(_sets(words, pa.schema([("_id", i64), ("node", i64), ("size", i64)])), "_id long, node long, size long")
    handed = rows.select("_x").mapInArrow(_tokens(words, rule, pa.schema([("token", i64), ("node", i64), ("size", pa.int32())])), "token long, node long, size int")

    often = handed.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = cut(handed.join(often.hint("merge"), "token").select("token", "node", "size", (F.col("n") > frequent).alias("hot")).dropDuplicates(["token", "node"]))
    # need() and shared() in SQL; the least partner has shared(size) shingles
    least = f"least(cast(ceil({rule.top} * m / {rule.bottom}) as int), cast(floor({rule.bottom - rule.top} * m / {2 * rule.bottom}) as int) + 3)".replace("m", f"cast(ceil({rule.top} * size / {rule.bottom}) as int)")
    able = many.groupBy("node").agg(F.count(F.lit(1)).alias("all"), F.count_if("hot").alias("hots"), F.first("size").alias("size")).withColumn("l", F.expr(least)).filter("all >= l")
    able = able.select("node", F.expr("2 * hots >= l").alias("dense"), F.expr("(l - 1) div 2 - if(2 * hots >= l, 0, hots)").alias("spare"))
    members = many.join(able.hint("merge"), "node").filter("not hot or dense").select("token", "node", "spare")

    heads = members.groupBy("token").agg(F.min("node").alias("name"))
    named = members.join(heads.hint("merge"), "token").groupBy("node", "name").agg(F.count(F.lit(1)).alias("k"), F.first("spare").alias("spare"))
    fewest = Window.partitionBy("node").orderBy("k", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = named.withColumn("gone", F.sum("k").over(fewest)).filter("gone > spare").select("node", "name")
    shares = kept.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", F.expr(f"(n + {block - 1}) div {block}").alias("blocks"))
    kept = cut(kept.join(shares.hint("merge"), "name").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))

    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(kept.select("node")))
    wanted = rows.select("_x").mapInArrow(_wanted(words, bloom, pa.schema([("node", i64), ("_x", pa.binary())])), "node long, _x binary")
    texts = wanted.groupBy("node").agg(F.min("_x").alias("_x"))

    def linked(members: DataFrame, texts: DataFrame) -> DataFrame:
        dealt = members.join(texts.hint("merge"), "node").select("name", "block", "node", "ask", "_x").repartition("name", "block").sortWithinPartitions("name", "block", "node")
        return dealt.mapInArrow(_compare(words, rule, orders, pa.schema([("a", i64), ("b", i64)])), "a long, b long")

    links = cut(linked(kept.withColumn("ask", F.lit(True)), texts))
    group = components(links, "a", "b")

    wide = kept.filter("blocks > 1")
    if not wide.isEmpty():
        member = wide.join(group.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        major = member.groupBy("name", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("name").agg(F.max_by("component", F.struct("k", "component")).alias("major"))
        member = member.join(major, "name").select("name", "node", "block", "blocks", (F.col("component") != F.col("major")).alias("ask"))
        # names of several blocks are few, so these two joins are left to the size that Spark measures
        # a piece of at most about ``block`` guests meets one block at a time, so no task holds more than two blocks
        pieces = member.filter("ask").groupBy("name").agg(F.expr(f"(count(1) + {block - 1}) div {block}").alias("pieces"))
        member = member.join(pieces, "name").withColumn("home", F.col("block"))
        guests = member.filter("ask").withColumn("piece", F.pmod(F.xxhash64("node", "name"), F.col("pieces"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        hosts = member.withColumn("ask", F.lit(False)).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        visit = guests.unionByName(hosts).select("name", "node", "ask", (F.col("block") * F.col("pieces") + F.col("piece")).alias("block"))
        group = components(links.unionByName(linked(visit, texts)), "a", "b")

    placed = sets.join(group.hint("merge"), "node", "left").withColumn("class", F.when(F.col("size") > 0, F.coalesce("component", "node")))
    least_id = placed.filter("class is not null").groupBy("class").agg(F.min("_id").alias("component_id"))
    return placed.join(least_id.hint("merge"), "class", "left").select(F.col("_id").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))
