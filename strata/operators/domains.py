"""Memories of domains over packed blocks: nearest patterns, energies and the cascade through a hierarchy of domains.

States and patterns travel as blocks of unit vectors. A block of states meets a block of patterns as two matrices; what goes on
is k rows a state, or one partial sum a state, never a row for each pair. Sums of exponentials are taken from a cosine of 1
down, which no cosine exceeds, so partial sums of any blocks add up; that holds for any beta under 350.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata import config
from strata.functions import vectors as v
from strata.operators.retrieval import top_per
from strata.storage import cut


def packed(rows: DataFrame, ident: str, vector: str, prefix: str, *, key: str | None = None, block_rows: int = 1024) -> DataFrame:
    """Blocks (<prefix>ids, <prefix>n, <prefix>body and, where a key is given, key) of the rows' unit vectors; null and zero vectors are left out.

    With a key a block holds rows of one key; rows are dealt by ranges of key and id, so a key with most of the rows is many
    blocks on many tasks.
    """
    chosen = rows.select(F.col(ident).alias("_i"), v.as_double(vector).alias("_v"), *([F.col(key).alias("_k")] if key else [])).filter("size(_v) > 0")
    kind = chosen.schema["_i"].dataType.simpleString()
    if key:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chosen = chosen.repartitionByRange(parts, F.col("_k"), F.xxhash64("_i")).sortWithinPartitions("_k", "_i")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("_v")
            x = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(batch.num_rows, -1)
            norm = np.sqrt((x * x).sum(1))
            keys = batch.column("_k") if key else None
            edge = [0, batch.num_rows]
            if key and batch.num_rows > 1:
                values = keys.to_pylist()
                edge = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
            for lo, hi in zip(edge, edge[1:], strict=False):
                for at in range(lo, hi, block_rows):
                    own = np.arange(at, min(at + block_rows, hi))
                    own = own[norm[own] > 0]
                    if len(own):
                        arrays = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), batch.column("_i").take(pa.array(own))), pa.array([len(own)], pa.int32()), pa.array([(x[own] / norm[own, None]).tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays([*arrays, *([keys.slice(at, 1)] if key else [])], names=[f"{prefix}ids", f"{prefix}n", f"{prefix}body", *([key] if key else [])])

    shape = f"{prefix}ids array<{kind}>, {prefix}n int, {prefix}body binary" + (f", {key} {chosen.schema['_k'].dataType.simpleString()}" if key else "")
    return chosen.mapInArrow(pack, shape)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(f"{p}body")[i].as_py(), np.float64).reshape(batch.column(f"{p}n")[i].as_py(), -1) for p in ("s_", "p_"))
            yield batch, i, a @ b.T


def nearest(states: DataFrame, patterns: DataFrame, k: int, *, state: str, pattern: str, vector: str = "embedding", least: float | None = None) -> DataFrame:
    """state, pattern, similarity, rank: the k patterns of greatest cosine of each state (ties: the lesser pattern), of those with ``least`` or more."""
    left, right = packed(states, state, vector, "s_"), packed(patterns.sortWithinPartitions(pattern), pattern, vector, "p_")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, cos in _meetings(batches):
            order = np.argsort(-cos, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(cos, order, 1)
            row, column = np.nonzero(best >= (-2 if least is None else least))
            ids, known = batch.column("s_ids")[i].values, batch.column("p_ids")[i].values
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), known.take(pa.array(order[row, column])), pa.array(best[row, column])], names=[state, pattern, "similarity"])

    kinds = [f.schema[n].dataType.simpleString() for f, n in ((states, state), (patterns, pattern))]
    rows = left.crossJoin(right).mapInArrow(meet, f"{state} {kinds[0]}, {pattern} {kinds[1]}, similarity double")
    return top_per(rows, state, k, pattern)


def _sums(beta: float, state: str, key: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, cos in _meetings(batches):
            ids = batch.column("s_ids")[i].values
            own = [pa.repeat(batch.column(key)[i], len(ids))] if key else []
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.exp(beta * (cos - 1)).sum(1)), *own], names=[state, "_z", *([key] if key else [])])

    return run


def energies(states: DataFrame, patterns: DataFrame, *, state: str, domain: str | None = None, vector: str = "embedding", beta: float = config.HOPFIELD_BETA) -> DataFrame:
    """state (and domain), energy -logsumexp(beta * cosine) / beta over the patterns (of the state's row's domain), confidence.

    states: a row for each state, or for each state and domain that it is compared with.
    """
    left, right = packed(states, state, vector, "s_", key=domain), packed(patterns, domain or state, vector, "p_", key=domain) if domain else packed(patterns.withColumn("_one", F.lit(1)), "_one", vector, "p_")
    both = left.join(right, domain) if domain else left.crossJoin(right)
    shape = f"{state} {states.schema[state].dataType.simpleString()}, _z double" + (f", {domain} {states.schema[domain].dataType.simpleString()}" if domain else "")
    summed = both.mapInArrow(_sums(beta, state, domain), shape).groupBy(state, *([domain] if domain else [])).agg(F.sum("_z").alias("_z"))
    e = -(1 + F.ln("_z") / beta)
    return summed.select(state, *([domain] if domain else []), e.alias("energy"), (F.exp(-e) / (1 + F.exp(-e))).alias("confidence"))


def domain_classify(states: DataFrame, centroids: DataFrame, members: DataFrame, *, state: str, domain: str, k: int, vector: str = "embedding", beta: float = config.HOPFIELD_BETA) -> DataFrame:
    """The 2k domains with the nearest centroids, ranked by the confidence of each domain's own memory; k stay."""
    near = nearest(states, centroids, 2 * k, state=state, pattern=domain, vector=vector).select(state, domain)
    asked = near.join(states.select(state, vector), state)
    return top_per(energies(asked, members, state=state, domain=domain, vector=vector, beta=beta), state, k, domain, by="confidence").select(state, domain, "confidence", "rank")


def domain_cascade(states: DataFrame, hierarchy: DataFrame, members: DataFrame, *, state: str, domain: str, k: int, least: float = 0.5, vector: str = "embedding", beta: float = config.HOPFIELD_BETA) -> DataFrame:
    """state, domain, level, confidence, path: the k best domains of the first level, then of the children of each accepted one, and so on.

    hierarchy: domain, parent (null at the top). A domain's confidence comes from its own memory and must be ``least`` or more.
    Levels go on until no accepted domain has children; domains in a cycle are never reached from the top.
    """
    tree = cut(hierarchy.select(domain, "parent"))
    given = cut(states.select(state, vector))
    level, out, above = 1, None, None
    while True:
        if above is None:
            asked = given.select(state, F.lit(0).alias("_top")).join(tree.filter("parent is null").select(domain, F.lit(0).alias("_top")), "_top").select(state, domain, F.lit("").alias("_above"), F.lit(None).cast(tree.schema[domain].dataType).alias("parent"))
        else:
            asked = above.select(state, F.col(domain).alias("parent"), F.concat("path", F.lit("/")).alias("_above")).join(tree.filter("parent is not null"), "parent")
        asked = cut(asked)
        if asked.isEmpty():
            break
        scored = energies(asked.select(state, domain).distinct().join(given, state), members, state=state, domain=domain, vector=vector, beta=beta)
        good = asked.join(scored.filter(F.col("confidence") >= least), [state, domain])
        above = cut(top_per(good.withColumn("_g", F.struct(state, "_above")), "_g", k, domain, by="confidence").select(state, domain, F.lit(level).alias("level"), "confidence", F.concat("_above", F.col(domain).cast("string")).alias("path")))
        out, level = above if out is None else out.unionByName(above), level + 1
    if out is None:
        return asked.select(state, domain, F.lit(1).alias("level"), F.lit(0.0).alias("confidence"), F.lit("").alias("path"))
    return out
