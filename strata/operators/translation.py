"""Relations as translations (TransE): entity and relation vectors with s + r near o, trained by stochastic gradient in bucket pairs.

Entities are dealt to buckets by hash. A triple belongs to the pair of its entities' buckets. In the first round of an epoch each
bucket is trained by itself, in round r bucket b with bucket (r - b) mod n, so no two pairs of a round share a bucket and all of them
are trained at once; after n more rounds every pair was trained, and rounds without triples are left out. A task holds the entities of one
pair and streams its triples, so its memory is bounded by a bucket and not by the triples, which may be as many as they like for one entity.

With many buckets the few entities that have many triples (hubs) belong to none: as relations do, they go to each task that needs them
and move by the mean of its moves. A triple with a hub is trained in the bucket of its other end, so facts that lead to hubs
take one round an epoch however many buckets there are. Vectors are stored after each round, and those of the round before go.
Triples are encoded once, as blocks of the places that their names have in the task; blocks of an epoch come in an order of its own and
rows are mixed among 16 blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strata.operators.domains import packed
from strata.storage import clean, cut, discard, new_folder, partitioned, stored

_RELATION, _HUB, _ENTITY, _TRIPLE = 0, 1, 2, 3
_ROW = "kind int, name string, bucket int, pair int, vec binary"
#: Triples of a block, blocks that are mixed at once, and steps whose exchanged entities are drawn at once.
_BLOCK, _MIXED, _STEPS = 1024, 16, 128
#: Entities and tests that meet at once.
_ROWS, _TESTS = 2048, 1024


def _start(rows: DataFrame, dim: int) -> DataFrame:
    """rows with vec: a vector of length one whose direction comes from a hash of name and seed, the columns _h (xxhash64 of the name) and _seed.

    The hashes are xxhash64(name, j, seed) of Spark, whose last two steps are taken here.
    """

    def hashed(number: np.ndarray, seed: np.ndarray) -> np.ndarray:
        one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
        x = (seed + five + np.uint64(4)) ^ (number.astype(np.uint64) & np.uint64(0xFFFFFFFF)) * one
        x = (x << np.uint64(23) | x >> np.uint64(41)) * two + three
        x = (x ^ x >> np.uint64(33)) * two
        x = (x ^ x >> np.uint64(29)) * three
        return x ^ x >> np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, seed = (batch.column(c).to_numpy()[:, None] for c in ("_h", "_seed"))
            x = hashed(seed, hashed(np.arange(dim)[None], h.view(np.uint64)))
            x = (x & np.uint64((1 << 20) - 1)) / float(1 << 20) - 0.5
            yield batch.drop_columns(["_h", "_seed"]).append_column("vec", _bodies(x / _norm(x)[:, None]))

    kept = [c for c in rows.columns if c not in ("_h", "_seed")]
    shape = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "_h", F.col("_seed").cast("int").alias("_seed")).mapInArrow(run, shape + ", vec binary")


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _bodies(vectors: np.ndarray) -> pa.Array:
    """A value of bytes for each vector. A null list costs Arrow's writer far more than null bytes, and triples have no vector."""
    vectors = np.ascontiguousarray(vectors, np.float64)
    offsets = np.arange(len(vectors) + 1, dtype=np.int32) * np.int32(vectors.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(vectors)])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a column of bytes or lists without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(np.float64).reshape(len(column), -1)


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors moved by the mean of their moves, added up in their order; hubs have length one."""
    for batch in batches:
        if batch.num_rows:
            x, kind = _matrix(batch.column("vec")).copy(), batch.column("kind").to_numpy()
            for i, moves in enumerate(batch.column("_m").to_pylist()):
                if moves:
                    x[i] += np.array([np.frombuffer(m["vec"]) for m in moves]).sum(0) / len(moves)
            x[kind == _HUB] /= np.maximum(_norm(x[kind == _HUB]), 1e-9)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("name"), _bodies(x)], names=["kind", "name", "vec"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[batch.schema.names[0], "vec"])


class _Places:
    """Where the vectors of names stand: entities (hubs first) and relations."""

    def __init__(self, entities: pa.Array, relations: pa.Array) -> None:
        self.entities, self.relations = (pd.Index(x.to_numpy(zero_copy_only=False)) for x in (entities, relations))

    def of(self, triples: pa.Table) -> np.ndarray:
        columns = (("s", self.entities), ("relation", self.relations), ("o", self.entities))
        return np.stack([names.get_indexer(triples.column(c).to_numpy()) for c, names in columns], axis=1)


class _Pair:
    """The vectors that one pair of buckets trains, and the steps over its triples."""

    def __init__(self, key: int, rows: pa.Table, seed: tuple[int, ...], margin: float, rate: float) -> None:
        self.key, self.margin, self.rate, self.rng = key, margin, rate, np.random.default_rng((*seed, key))
        kinds = rows.column("kind").to_numpy()
        vectors = _matrix(rows.column("vec"))
        names = rows.column("name").combine_chunks()
        self.relations, self.hubs, own = (names.filter(pa.array(kinds == k)) for k in (_RELATION, _HUB, _ENTITY))
        self.entities = pa.concat_arrays([self.hubs, own])
        self.bucket = np.concatenate([np.full(len(self.hubs), -1), rows.column("bucket").to_numpy()[kinds == _ENTITY]])
        self.r, self.e = (np.concatenate([vectors[kinds == k] for k in ks]) for ks in ((_RELATION,), (_HUB, _ENTITY)))
        self.before, self.hubs_before = self.r.copy(), self.e[: len(self.hubs)].copy()
        self.members = {b: np.flatnonzero(self.bucket == b) if b >= 0 else np.arange(len(self.bucket)) for b in np.unique(self.bucket).tolist()}

    @cached_property
    def places(self) -> _Places:
        return _Places(self.entities, self.relations)

    def step(self, triples: pa.Table) -> None:
        """One step on some triples."""
        self.steps(self.places.of(triples), triples.num_rows)

    def steps(self, triples: np.ndarray, rows: int) -> None:
        """Steps of so many rows each on triples as places, which are a multiple of that."""
        for at in range(0, len(triples), rows * _STEPS):
            self._steps(*triples[at : at + rows * _STEPS].T, rows)

    def _exchanged(self, group: np.ndarray, s: np.ndarray, o: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The triples with their object or subject exchanged, and whether that changed them. group: a relation in a step.

        Half of the exchanged entities are drawn from the bucket (for a hub from all that the task holds), half are what another
        triple of the relation has in that place.
        """
        n, many = len(s), len(self.entities)
        # many subjects for an object: exchange the object, as an exchanged subject is likely to be right too
        ns, no = (np.bincount(np.unique(group * many + x) // many)[group] for x in (s, o))
        drawn, draw, alike, order = self.rng.random((n // rows, 4, rows)).transpose(1, 0, 2).reshape(4, n)
        tail = drawn < ns / (ns + no)
        old = np.where(tail, o, s)
        new = np.empty_like(old)
        for b, own in self.members.items():
            at = self.bucket[old] == b
            new[at] = own[(draw[at] * len(own)).astype(int)]
        order = np.lexsort((order, group))
        starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
        following = np.arange(1, n + 1)
        following[np.r_[starts[1:], n] - 1] = starts  # the last triple of a relation is followed by its first
        other = np.empty_like(order)
        other[order] = order[following]
        new = np.where(alike < 0.5, np.where(tail, o[other], s[other]), new)
        return np.where(tail, s, new), np.where(tail, new, o), new != old

    def _steps(self, s: np.ndarray, r: np.ndarray, o: np.ndarray, rows: int) -> None:
        """What does not depend on vectors is worked out for all steps at once."""
        k, many, dim = len(s) // rows, len(self.entities), self.e.shape[1]
        relations, group = np.unique(np.repeat(np.arange(k), rows) * len(self.relations) + r, return_inverse=True)
        s2, o2, changed = self._exchanged(group, s, o, rows)
        ids = np.stack([s, o, s2, o2]).reshape(4, k, rows).transpose(1, 0, 2).reshape(k, 4 * rows)
        names, inverse = np.unique(np.arange(k)[:, None] * many + ids, return_inverse=True)
        of_names, of_relations = _Sums(names // many, inverse.ravel(), k), _Sums(relations // len(self.relations), group, k)
        names, relations, changed = names % many, relations % len(self.relations), changed.reshape(k, rows)
        moves = np.empty((2, 2, rows, dim + 1))  # of subject and object in the right and the exchanged triple, and whether it counts
        for i in range(k):
            at, place, total = of_names.of(i)
            e = self.e.take(names[at], 0)
            x = e.take(place, 0).reshape(2, 2, rows, dim)
            apart = x[:, 0] + self.r.take(r[i * rows : (i + 1) * rows], 0) - x[:, 1]
            far = np.sqrt((apart * apart).sum(2))
            on = ((self.margin + far[0] - far[1] > 0) & changed[i]).astype(float)
            apart /= np.maximum(far, 1e-9)[:, :, None]
            apart *= on[:, None]
            moves[0, 0, :, :dim], moves[1, 1, :, :dim], moves[..., dim] = apart[0], apart[1], on
            moves[0, 1, :, :dim], moves[1, 0, :, :dim] = -apart[0], -apart[1]
            # against the sum of gradients of each vector, over the root of their number: frequent names don't run away
            moved = total(moves.reshape(4 * rows, dim + 1))
            e -= self.rate * moved[:, :dim] / np.sqrt(np.maximum(moved[:, dim:], 1))
            self.e[names[at]] = e / np.maximum(_norm(e), 1e-9)[:, None]
            at, _, total = of_relations.of(i)
            apart[0] -= apart[1]
            self.r[relations[at]] -= self.rate * total(apart[0]) / np.sqrt(np.maximum(total(on), 1))[:, None]

    def result(self) -> pa.RecordBatch:
        """All entities of the buckets, and by how much relations and hubs moved."""
        ne, nh, nr = len(self.entities) - len(self.hubs), len(self.hubs), len(self.relations)
        vec = np.concatenate([self.e[nh:], self.e[:nh] - self.hubs_before, self.r - self.before])
        bucket = pa.concat_arrays([pa.array(self.bucket[nh:], pa.int32()), pa.nulls(nh + nr, pa.int32())])
        columns = [pa.array(np.repeat([_ENTITY, _HUB, _RELATION], [ne, nh, nr]), pa.int32()), pa.concat_arrays([self.entities.slice(nh), self.hubs, self.relations]), bucket, pa.array([self.key] * len(vec), pa.int32()), _bodies(vec)]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "name", "bucket", "pair", "vec"])


class _Sums:
    """Sums over rows of each name of a step, in the order of rows. step: of each name, in order; inverse: the name of each row, as many rows a step."""

    def __init__(self, step: np.ndarray, inverse: np.ndarray, k: int) -> None:
        self.rows = len(inverse) // k
        self.edge = np.searchsorted(step, np.arange(k + 1))
        self.inverse, self.order = inverse, np.argsort(inverse, kind="stable")
        self.first = np.flatnonzero(np.r_[True, np.diff(inverse[self.order]) != 0])

    def of(self, i: int) -> tuple[slice, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """Of a step: its names, the place of each row's name among them, and sums of some rows for them."""
        at, row = slice(self.edge[i], self.edge[i + 1]), slice(i * self.rows, (i + 1) * self.rows)
        order, first = self.order[row] - row.start, self.first[at] - row.start
        return at, self.inverse[row] - at.start, lambda x: np.add.reduceat(x.take(order, 0), first, axis=0)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(pair, whether they are triples, rows) of rows sorted by pair and kind."""
    for batch in batches:
        keys, kinds = batch.column("pair").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((np.diff(keys) != 0) | ((kinds[1:] == _TRIPLE) != (kinds[:-1] == _TRIPLE))) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
            if lo < hi:
                yield int(keys[lo]), bool(kinds[lo] == _TRIPLE), batch.slice(lo, hi - lo)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pair and kind to blocks of triples: the places of their names among those of the pair, sorted by kind and name."""
    for pair, own in groupby(_parts(batches), key=lambda x: x[0]):
        head, places, held, block = [], None, np.zeros((0, 3), np.int32), 0
        for _, triples, rows in own:
            if not triples:
                head.append(rows)
                continue
            if places is None:
                names, kinds = (pa.Table.from_batches(head).column(c).combine_chunks() for c in ("name", "kind"))
                relation = pa.array(kinds.to_numpy() == _RELATION)
                places, head = _Places(names.filter(pc.invert(relation)), names.filter(relation)), []
            held = np.concatenate([held, places.of(pa.Table.from_batches([rows])).astype(np.int32)])
            at = len(held) - len(held) % _BLOCK
            if at:
                yield _blocks(pair, block, held[:at])
                held, block = held[at:], block + at // _BLOCK
        if len(held):
            yield _blocks(pair, block, held)


def _blocks(pair: int, first: int, triples: np.ndarray) -> pa.RecordBatch:
    bodies = [triples[at : at + _BLOCK].tobytes() for at in range(0, len(triples), _BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array([pair] * len(bodies), pa.int32()), pa.array(range(first, first + len(bodies)), pa.int32()), pa.array(bodies, pa.binary())], names=["pair", "block", "vec"])


def _train(seed: tuple[int, ...], margin: float, rate: float, step_rows: int):
    """Rows sorted by pair and kind to the trained vectors; triples are mixed and steps cut by counts alone, so Arrow's batches don't show in the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in groupby(_parts(batches), key=lambda x: x[0]):
            pair, head, blocks, held = None, [], [], np.zeros((0, 3), np.int64)

            def mixed() -> np.ndarray:
                rows = np.concatenate(blocks)
                blocks.clear()
                return np.concatenate([held, rows[pair.rng.permutation(len(rows))]])

            for _, triples, rows in own:
                if not triples:
                    head.append(rows)
                    continue
                if pair is None:
                    pair, head = _Pair(key, pa.Table.from_batches(head), seed, margin, rate), []
                for body in rows.column("vec"):
                    blocks.append(np.frombuffer(body.as_buffer(), np.int32).reshape(-1, 3).astype(np.int64))
                    if len(blocks) == _MIXED:
                        held = mixed()
                        at = len(held) - len(held) % step_rows
                        pair.steps(held[:at], step_rows)
                        held = held[at:]
            pair = pair or _Pair(key, pa.Table.from_batches(head), seed, margin, rate)
            held = mixed() if blocks else held
            at = len(held) - len(held) % step_rows
            pair.steps(held[:at], step_rows)
            if at < len(held):
                pair.steps(held[at:], len(held) - at)
            yield pair.result()

    return run


def fit(triples: DataFrame, *, dim: int = 32, epochs: int = 20, margin: float = 2.0, rate: float = 0.1, step_rows: int = 256, most_entities: int = 1 << 17, most_triples: int = 1 << 17, least_buckets: int = 2, hub_share: int = 1 << 12, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(entities: entity, vec of length one; relations: relation, vec) trained on all rows of triples(s, relation, o).

    Rows with a null in any of the three are left out; a repeated row counts as often as it stands there. ``most_entities``
    bounds a bucket (on average), and with it what a task holds: two buckets of vectors, the hubs of their triples and a block of steps.
    Above ``least_buckets`` a bucket has ``most_triples`` at most (on average) too, and what has more than one in ``hub_share`` of all triples
    is a hub. Reruns agree: buckets, first vectors, order and exchanged entities come from hashes and seeds. An entity alone in its
    bucket is never exchanged. Without triples both results are empty.
    """
    spark = triples.sparkSession
    given = triples.select(F.col("s").cast("string").alias("s"), F.col("relation").cast("string").alias("relation"), F.col("o").cast("string").alias("o")).dropna()
    tables = [new_folder(spark)]
    names = stored(given.select(F.explode(F.array("s", "o")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")), tables[0])
    count, ends = names.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n = max(least_buckets, -(-count // most_entities), -(-ends // 2 // most_triples))
    hubs = F.broadcast(names.filter(F.col("n") > max(ends // 2 // hub_share, 1) if n > least_buckets else F.lit(False)).select("name"))
    bucket = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    for end in "so":
        given = given.join(hubs.select(F.col("name").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    given = given.select("s", "relation", "o", F.when(F.col("_s").isNull(), bucket("s")).alias("_a"), F.when(F.col("_o").isNull(), bucket("o")).alias("_b"))
    # triples of two hubs are dealt evenly, repeated ones too
    loose = given.filter("_a is null and _b is null").groupBy("s", "relation", "o").agg(F.count(F.lit(1)).alias("_n"))
    loose = loose.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_n"), F.lit(n)) - 1)).alias("_i"))
    dealt = F.pmod(F.xxhash64("s", "relation", "o") + F.col("_i"), F.lit(n)).cast("int")
    loose = loose.select("s", "relation", "o", dealt.alias("_a"), dealt.alias("_b"), F.floor(F.col("_n") / n).cast("int").alias("_w"), (F.col("_i") < F.col("_n") % n).cast("int").alias("_m"))
    loose = loose.withColumn("_x", F.explode(F.array_repeat(F.lit(0), F.col("_w") + F.col("_m")))).select("s", "relation", "o", "_a", "_b")
    a, b = F.coalesce("_a", "_b"), F.coalesce("_b", "_a")
    turn = F.when(a == b, 0).otherwise(1 + F.pmod(a + b - 1, F.lit(n)))
    tables.append(new_folder(spark))
    rounds = partitioned(given.filter("_a is not null or _b is not null").unionByName(loose).select("s", "relation", "o", F.least(a, b).alias("pair"), turn.alias("round")), "round", path=tables[1])
    shared = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in ((_RELATION, "relation"), (_HUB, "s"), (_HUB, "o"))))).alias("_x")
    needed = rounds.select("round", "pair", shared).select("round", "pair", "_x.*").distinct().join(hubs.withColumn("_hub", F.lit(True)), "name", "left")
    needed = cut(needed.filter((F.col("kind") == _RELATION) | F.col("_hub")).drop("_hub"))
    turns = sorted(x[0] for x in needed.select("round").distinct().collect())
    last = [new_folder(spark), new_folder(spark)]
    kept = names.join(hubs, "name", "left_anti")
    hashed = F.xxhash64("name").alias("_h")
    placed = stored(_start(kept.select(F.lit(_ENTITY).alias("kind"), "name", bucket("name").alias("bucket"), hashed, F.lit(seed).alias("_seed")), dim), last[0])
    known = stored(_start(needed.select("kind", "name").distinct().select("kind", "name", hashed, F.when(F.col("kind") == _HUB, seed).otherwise(seed + 1).alias("_seed")), dim), last[1])
    nothing, nowhere = F.lit(None).cast("string"), F.lit(None).cast("int").alias("bucket")
    keys = "pair", "kind", "at", "name"

    def heads(turn: int) -> DataFrame:
        met = F.col("bucket") if turn == 0 else F.least("bucket", F.pmod(F.lit(turn) - F.col("bucket"), F.lit(n)))
        entities = placed.select("kind", "name", "bucket", met.alias("pair"), "vec")
        own = needed.filter(F.col("round") == turn).select("pair", "kind", "name").join(known, ["kind", "name"]).select("kind", "name", nowhere, "pair", "vec")
        return own.unionByName(entities).withColumn("at", F.lit(0).cast("long"))

    codes = {}
    for turn in turns:
        head = heads(turn).drop("bucket", "vec").select("*", nothing.alias("s"), nothing.alias("relation"), nothing.alias("o"))
        body = rounds.filter(F.col("round") == turn).select(F.lit(_TRIPLE).alias("kind"), nothing.alias("name"), "pair", F.xxhash64("s", "relation", "o", F.lit(seed)).alias("at"), "s", "relation", "o")
        rows = head.unionByName(body).repartitionById(n, F.col("pair")).sortWithinPartitions(*keys, "s", "relation", "o")
        tables.append(new_folder(spark))
        codes[turn] = stored(rows.mapInArrow(_encode, "pair int, block int, vec binary"), tables[-1])
    for epoch in range(epochs):
        for turn in turns:
            body = codes[turn].select(F.lit(_TRIPLE).alias("kind"), nothing.alias("name"), nowhere, "pair", "vec", F.xxhash64("pair", "block", F.lit(seed + epoch)).alias("at"))
            rows = heads(turn).unionByName(body).repartitionById(n, F.col("pair")).sortWithinPartitions(*keys)
            new = [new_folder(spark), new_folder(spark)]
            trained = partitioned(rows.mapInArrow(_train((seed, epoch, turn), margin, rate, step_rows), _ROW), "kind", path=new[0])
            # relations and hubs move by the mean of their pairs' moves, added up in the order of pairs
            moves = trained.filter(F.col("kind") != _ENTITY).groupBy("kind", "name").agg(F.array_sort(F.collect_list(F.struct("pair", "vec"))).alias("_m"))
            both = known.join(moves, ["kind", "name"], "left").select("kind", "name", "vec", F.coalesce("_m", F.array().cast("array<struct<pair:int,vec:binary>>")).alias("_m"))
            known = stored(both.mapInArrow(_moved, "kind int, name string, vec binary"), new[1])
            placed = trained.filter(F.col("kind") == _ENTITY)
            discard(spark, *last)
            last = new
        clean(spark)
    discard(spark, *tables)
    entities = placed.select(F.col("name").alias("entity"), "vec").unionByName(known.filter(F.col("kind") == _HUB).select(F.col("name").alias("entity"), "vec"))
    relations = known.filter(F.col("kind") == _RELATION).select(F.col("name").alias("relation"), "vec")
    return entities.mapInArrow(_lists, "entity string, vec array<double>"), relations.mapInArrow(_lists, "relation string, vec array<double>")


def _better(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            q, e = (np.frombuffer(batch.column(f"{p}body")[i].as_py(), np.float64).reshape(batch.column(f"{p}n")[i].as_py(), -1) for p in ("s_", "p_"))
            keys = batch.column("s_ids")[i].values
            least = np.array(keys.field("cos").to_pylist())
            yield pa.RecordBatch.from_arrays([keys.field("test"), pa.array((q @ e.T > least[:, None] + 1e-9).sum(1))], names=["test", "n"])


def _nearer(shared):
    """Entities to the number of them that are nearer than each test's own, for tests that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, least, bodies = shared.value
        q = np.frombuffer(bodies, np.float64).reshape(len(least), -1)
        rough, least = q.astype(np.float32), least + 1e-9
        slack = (q.shape[1] + 4) * 2.0**-22  # more than products of unit vectors in single precision are off
        low, sure = ((least + x).astype(np.float32) for x in (-slack, slack))
        found = np.zeros(len(least), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            e = _matrix(batch.column(0))
            size = _norm(e)
            e = e[size > 0] / size[size > 0, None]
            for lo in range(0, len(e), _ROWS):
                some = e[lo : lo + _ROWS]
                other = some.astype(np.float32).T.copy()
                for at in range(0, len(q), _TESTS):
                    cos = rough[at : at + _TESTS] @ other
                    above = cos > low[at : at + _TESTS, None]
                    if above.any():
                        row, column = np.nonzero(above)
                        better = cos[row, column] > sure[at + row]
                        near = np.flatnonzero(~better)  # only these need double precision
                        for part in np.array_split(near, -(-len(near) // 65536)) if len(near) else ():
                            better[part] = (q[at + row[part]] * some[column[part]]).sum(1) > least[at + row[part]]
                        found[at : at + _TESTS] += np.bincount(row[better], minlength=len(cos))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([tests.take(pa.array(some)), pa.array(found[some])], names=["test", "n"])

    return run


def _counts(at: DataFrame, entities: DataFrame, kind: str, most_bytes: int) -> DataFrame:
    """test, n: entities nearer to each test's image than its object. Tests are broadcast, ``most_bytes`` of them at a time."""
    found, blocks, held = None, [], 0

    def flush() -> None:
        nonlocal found, blocks, held
        tests = pa.concat_arrays([pa.array([x["test"] for x in b.s_ids], at_kind) for b in blocks]) if blocks else pa.array([], at_kind)
        least = np.array([x["cos"] for b in blocks for x in b.s_ids], float)
        shared = at.sparkSession.sparkContext.broadcast((tests, least, b"".join(bytes(b.s_body) for b in blocks)))
        part = entities.select("vec").mapInArrow(_nearer(shared), kind)
        found, blocks, held = part if found is None else found.unionByName(part), [], 0

    at_kind = to_arrow_type(at.schema["test"].dataType)
    for b in packed(at, "_id", "_q", "s_").toLocalIterator():
        blocks.append(b)
        held += len(b.s_body)
        if held >= most_bytes:
            flush()
    if blocks:
        flush()
    return found if found is not None else at.sparkSession.createDataFrame([], kind)


def link_ranks(tests: DataFrame, known: DataFrame, entities: DataFrame, relations: DataFrame, *, most_bytes: int = 64 << 20) -> DataFrame:
    """test, s, relation, o, rank: the filtered rank of each test's object among all entities by nearness to s + r.

    tests: test (a key), s, relation, o. Objects that ``known`` (s, relation, o) has for the same subject and relation don't count.
    Entities have length one, so the nearest has the greatest cosine; tests are broadcast in blocks of ``most_bytes`` and meet entities
    as matrices, and only a count for each test goes on. Tests with an unknown subject, relation or object are left out; equal ones don't count as better.
    """
    e, r = entities.select(F.col("entity").alias("_e"), F.col("vec").alias("_ev")), relations.select("relation", F.col("vec").alias("_rv"))
    image = F.zip_with("_sv", "_rv", lambda x, y: x + y)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    at = tests.select("test", F.col("s").cast("string").alias("s"), F.col("relation").cast("string").alias("relation"), F.col("o").cast("string").alias("o")).join(e.withColumnRenamed("_ev", "_sv"), F.col("s") == F.col("_e")).drop("_e").join(r, "relation").join(e, F.col("o") == F.col("_e")).drop("_e")
    at = at.withColumn("_q", image).withColumn("_cos", dot("_q", "_ev") / F.sqrt(dot("_q", "_q")))
    at = cut(at.select("test", "s", "relation", "o", "_q", F.struct("test", F.col("_cos").alias("cos")).alias("_id"), F.struct("s", "relation").alias("_g")))
    kind = f"test {at.schema['test'].dataType.simpleString()}, n long"
    every = _counts(at, entities, kind, most_bytes).groupBy("test").agg(F.sum("n").alias("_all"))
    have = known.select(F.struct(F.col("s").cast("string").alias("s"), F.col("relation").cast("string").alias("relation")).alias("_g"), F.col("o").cast("string").alias("_e")).distinct().join(at.select("_g").distinct(), "_g", "left_semi").join(e, "_e")
    gone = packed(at, "_id", "_q", "s_", key="_g").join(packed(have, "_e", "_ev", "p_", key="_g"), "_g").mapInArrow(_better, kind).groupBy("test").agg(F.sum("n").alias("_known"))
    ranked = at.join(every, "test", "left").join(gone, "test", "left")
    return ranked.select("test", "s", "relation", "o", (1 + F.coalesce("_all", F.lit(0)) - F.coalesce("_known", F.lit(0))).alias("rank"))
