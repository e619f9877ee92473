"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. The model of a category sees the text's features and the log-odds that the
models before it gave; in training those come from models fitted without the document's fold, as they will for new texts.
Features are sets of hashed words, word beginnings, and the share of symbols; fitting uses the features that tell a
category apart best, on a sample of labelled rows whose size is bounded by a parameter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import columnar as c
from strata.llm.storage import bound_batches

_BITS = 22
_PREFIX = 4
LEAST_SEEN = 3


def text_features(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, distinct and sorted; wanted: which features count."""
    data, doc = c.text_buffer(column)
    words = c.find_words(c.lower_ascii(data), doc, c.ALNUM)
    owner = np.repeat(np.arange(len(doc) - 1), np.diff(words.off))
    head = c.Words(words.data, words.doc, words.start, np.minimum(words.end, words.start + _PREFIX), words.off)
    drop = np.uint64(64 - _BITS)
    symbol = np.concatenate([[0], np.cumsum((data > 32) & ~c.ALNUM[c.lower_ascii(data)])])
    share = (symbol[doc[1:]] - symbol[doc[:-1]]) * 40 // np.maximum(1, np.diff(doc))
    rows = np.arange(len(doc) - 1)
    feature = np.concatenate([c.word_hashes(words) >> drop, c.mix(c.word_hashes(head) + np.uint64(1)) >> drop, c.mix(share.astype(np.uint64) + np.uint64(1 << 40)) >> drop]).astype(np.int64)
    row = np.concatenate([owner, owner, rows])
    if wanted is not None:
        keep = wanted[feature]
        row, feature = row[keep], feature[keep]
    pair = np.unique(row << _BITS | feature)
    return pair >> _BITS, pair & ((1 << _BITS) - 1)


@dataclass
class Linear:
    """Log-odds: bias + weights of the features present + weights of the earlier categories' log-odds."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float
    earlier: np.ndarray

    def log_odds(self, row: np.ndarray, feature: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.feature, feature)
        at[at == len(self.feature)] = 0
        ok = self.feature[at] == feature if len(self.feature) else np.zeros(len(feature), bool)
        return np.bincount(row[ok], self.weight[at[ok]], n) + self.bias + before @ self.earlier


def fit_linear(row: np.ndarray, feature: np.ndarray, y: np.ndarray, before: np.ndarray, *, features: int = 4096, rounds: int = 120, decay: float = 2e-4) -> Linear:
    """Logistic regression on the features with the largest likelihood ratio, by Adam on the whole sample."""
    n, seen = len(y), 1 << _BITS
    have = np.bincount(feature, minlength=seen)
    good = np.bincount(feature, y[row], minlength=seen)
    used = np.flatnonzero(have >= LEAST_SEEN)
    rate = y.mean() if n else 0.0
    p = np.clip(good[used] / have[used], 1e-9, 1 - 1e-9)
    gain = have[used] * (p * np.log(p / max(rate, 1e-9)) + (1 - p) * np.log((1 - p) / max(1 - rate, 1e-9)))
    chosen = np.sort(used[np.argsort(-gain, kind="stable")[:features]])
    at = np.searchsorted(chosen, feature)
    at[at == len(chosen)] = 0
    ok = chosen[at] == feature if len(chosen) else np.zeros(len(feature), bool)
    row, at = row[ok], at[ok]
    size = len(chosen) + 1 + before.shape[1]
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    w[len(chosen)] = np.log(max(rate, 1e-4) / max(1 - rate, 1e-4))
    for step in range(1, rounds + 1 if n else 1):
        z = np.bincount(row, w[at], n) + w[len(chosen)] + before @ w[len(chosen) + 1 :]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.concatenate([np.bincount(at, error[row], len(chosen)), [error.sum()], before.T @ error]) / n + decay * w
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Linear(chosen, w[: len(chosen)], float(w[len(chosen)]), w[len(chosen) + 1 :])


def fit_chain(row: np.ndarray, feature: np.ndarray, labels: np.ndarray, folds: int = 3) -> list[Linear]:
    """labels: n rows, one column for each category in order; fold of a row is its number modulo folds."""
    n, fold = len(labels), np.arange(len(labels)) % folds
    before, chain = np.zeros((n, 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        chain.append(fit_linear(row, feature, y, before))
        if k + 1 < labels.shape[1]:
            odds = np.zeros(n)
            for f in range(folds):
                inside = fold != f
                number = np.cumsum(inside) - 1
                mine = inside[row]
                model = fit_linear(number[row[mine]], feature[mine], y[inside], before[inside])
                odds[~inside] = model.log_odds(row, feature, n, before)[~inside]
            before = np.column_stack([before, np.clip(odds, -8, 8)])
    return chain


def chain_odds(chain: list[Linear], row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    before = np.zeros((n, 0))
    for model in chain:
        before = np.column_stack([before, np.clip(model.log_odds(row, feature, n, before), -8, 8)])
    return before


_SKETCH = "_id long, _t long, _y array<double>, _f binary"
_SKETCH_SCHEMA = pa.schema([("_id", pa.int64()), ("_t", pa.int64()), ("_y", pa.list_(pa.float64())), ("_f", pa.binary())])


def _sketch(categories: int):
    """Labels and packed features of labelled rows; a task gives rows of equal id and text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in c.slices(batches, "_x"):
            keys = list(zip(batch.column("_id").to_pylist(), batch.column("_t").to_pylist(), strict=True))
            fresh = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            row, feature = text_features(batch.column("_x"))
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [feature[a:z].astype("<u4").tobytes() for a, z in zip(edge, edge[1:], strict=False)]
            y = list(zip(*(batch.column(f"_y{k}").to_pylist() for k in range(categories)), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_t"), pa.array(y, pa.list_(pa.float64())), pa.array(packed, pa.binary())], schema=_SKETCH_SCHEMA)

    return run


def _fit(categories: int):
    """The sample is one task's input; it has ``sample`` rows at most, so the task does not grow with the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(batch.column(k).to_pylist() for k in ("_id", "_t", "_y", "_f")), strict=True)
        if not rows:
            return
        rows.sort(key=lambda r: r[:2])
        feature = [np.frombuffer(r[3], "<u4") for r in rows]
        seen = np.zeros(1 << _BITS, np.int32)
        for f in feature:
            seen[f] += 1  # features of a document are distinct
        feature = [f[seen[f] >= LEAST_SEEN].astype(np.int32) for f in feature]
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f in feature])
        chain = fit_chain(row, np.concatenate(feature), np.array([r[2] for r in rows]).reshape(-1, categories))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], names=["chain"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, labelled: DataFrame | None = None, categories: tuple[str, ...] = ("quality", "toxic"), sample: int = 8_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, p_<category> for each in the order of the chain, rejected (the last category is likelier than not), row by row.

    labels: doc_id and a 0/1 column for each category; of several labels of one id each category's largest counts. At most ``sample``
    labelled documents, those of the least hash of their ids, fit the chain, in one task; rows of equal id and text count once.
    labelled: the documents that labels speak of, where that is another table than docs.
    Rows with a null label or doc_id are not fitted on. A null or empty text has no words. Without labels all odds are even less
    than likely and nothing is rejected. Repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.select(F.col("doc_id").cast("bigint").alias("_id"), *(F.col(k).cast("double").alias(f"_y{i}") for i, k in enumerate(categories))).dropna()
    known = known.groupBy("_id").agg(*(F.max(f"_y{i}").alias(f"_y{i}") for i in range(len(categories)))).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    source = docs if labelled is None else labelled
    rows = source.select(F.col(doc_id).cast("bigint").alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_x")).join(F.broadcast(known), "_id")
    drawn = rows.withColumn("_t", F.xxhash64("_x")).mapInArrow(_sketch(len(categories)), _SKETCH).dropDuplicates(["_id", "_t"]).orderBy(F.xxhash64("_id"), "_id", "_t").limit(sample)
    fitted = drawn.mapInArrow(_fit(len(categories)), "chain binary").first()
    chain: list[Linear] = pickle.loads(fitted.chain) if fitted else fit_chain(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((0, len(categories))))
    wanted = np.zeros(1 << _BITS, bool)
    for model in chain:
        wanted[model.feature] = True
    shared = spark.sparkContext.broadcast((chain, np.packbits(wanted)))
    names = [f"p_{k}" for k in categories]
    out = pa.schema([("doc_id", pa.int64()), *((k, pa.float64()) for k in names)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, bits = shared.value
        use = np.unpackbits(bits).astype(bool)
        for batch in c.slices(batches, "_x"):
            odds = chain_odds(models, *text_features(batch.column("_x"), use), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(1 / (1 + np.exp(-odds[:, k]))) for k in range(len(names)))], schema=out)

    scored = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_x")).mapInArrow(score, "doc_id long, " + ", ".join(f"{k} double" for k in names))
    return scored.withColumn("rejected", F.col(names[-1]) > 0.5)
