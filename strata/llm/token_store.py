"""Token ids on disk: one zstandard frame for each document, compressed with a dictionary trained on serialized id arrays.

A stored row is a block of documents of one shard: the frames end to end, the byte offset and id count of every frame, the
doc_ids, and the hash of the dictionary that the frames need; the dictionary is stored once beside the blocks. One document
is read by slicing its frame out of its block. Shards are ranges of doc_id and blocks are in order, so the position of every
document's first id is a prefix sum over shards, blocks and documents. Spark writes and reads the files, so any file system
that it knows will do and the commit protocol covers lost or repeated tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm import columnar as c
from strata.llm.storage import bound_batches

#: entries of a worker's word table, and ids of all entries, above which it starts anew
_ENTRIES, _POOL = 1 << 20, 1 << 23
_SEPARATOR = c.byte_class((0x20, 0x20), (0x0A, 0x0A))
_CONTROL = c.byte_class((0x00, 0x09), (0x0B, 0x1F), (0x7F, 0x7F))
_TAIL = np.isin(np.arange(256), list(b".,;:!?"))
_ASCII_ALNUM = c.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))


class Encoder:
    """Ids of texts by way of their words. A pre-token of the byte-level pattern never reaches over a line feed or a space before
    a word, so texts with single separators are put together from the ids of their words, which a table of bounded size keeps;
    others are encoded whole. Nor does one reach over the end of a word, so marks behind a word are tokens of their own here.
    The table knows a word by a 64-bit hash, its length, and its first eight bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.name, self.mark = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def _learn(self, name: np.ndarray, mark: np.ndarray, words: list[str]) -> None:
        """Appends words that are not known to the table."""
        ids = [got.ids for got in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, np.fromiter((i for x in ids for i in x), self.kind, int(size.sum()))])
        order = np.argsort(np.concatenate([self.name, name]), kind="stable")
        self.name, self.mark, self.at, self.size = (np.concatenate(x)[order] for x in ((self.name, name), (self.mark, mark), (self.at, at), (self.size, size)))

    def _entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token its row in the table, and whether that row is surely its own."""
        length = end - start
        name = c.mix(c.word_hashes(c.Words(data, doc, start, end, np.zeros(1, np.int64))) + spaced.astype(np.uint64))
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        first = np.lib.stride_tricks.sliding_window_view(padded, 8)[start].view("<u8").ravel()
        few = np.minimum(length, 8).astype(np.uint64) * np.uint64(8)
        first &= np.where(few == 64, np.uint64((1 << 64) - 1), (np.uint64(1) << np.minimum(few, np.uint64(63))) - np.uint64(1))
        mark = c.mix(first) ^ (length.astype(np.uint64) << np.uint64(1)) ^ spaced.astype(np.uint64)
        distinct, where, place = np.unique(name, return_index=True, return_inverse=True)
        if len(self.name) > _ENTRIES or len(self.pool) > _POOL:
            self.forget()
        at = np.searchsorted(self.name, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.name)
        known[inside] = self.name[at[inside]] == distinct[inside]
        new = where[~known]
        if len(new):
            body = data.tobytes()
            self._learn(distinct[~known], mark[new], [(" " if s else "") + body[a:z].decode() for a, z, s in zip(start[new].tolist(), end[new].tolist(), spaced[new].tolist(), strict=True)])
            at = np.searchsorted(self.name, distinct)
        row = at[place]
        return row, self.mark[row] == mark

    def encode(self, column: pa.Array) -> list[memoryview]:
        """Serialized ids of each text of the column, with the end id."""
        data, doc = c.text_buffer(column)
        n = len(doc) - 1
        gap = _SEPARATOR[data]
        count = lambda at: np.bincount(np.searchsorted(doc, at, side="right") - 1, minlength=n)[:n] > 0
        hard = count(_odd_places(data, doc, gap))
        use = np.repeat(~hard, np.diff(doc))
        word = ~gap & use
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        edge = doc[(doc > 0) & (doc < len(data))]
        begins[edge] = word[edge]
        ends[edge - 1] = word[edge - 1]
        # marks at the end of a word: behind a letter or digit, and nothing but marks follow
        mark = _TAIL[data] & word
        last = np.flatnonzero(ends)
        last = last[mark[last]]
        if len(last):
            plain = np.flatnonzero(~mark)
            core = plain[np.searchsorted(plain, last) - 1] if len(plain) else np.full(len(last), -1)
            core = core[(core >= 0) & (np.searchsorted(doc, core, side="right") == np.searchsorted(doc, last, side="right"))]
            core = core[_ASCII_ALNUM[data[core]] & word[core]]
            begins[core + 1] = True
            ends[core] = True
        feed = (data == 10) & use
        start, end = np.flatnonzero(begins | feed), np.flatnonzero(ends | feed) + 1
        spaced = np.zeros(len(data) + 1, bool)
        spaced[1:] = data == 32
        spaced[doc] = False
        spaced = spaced[start]
        row, sure = self._entries(data, start, end, doc, spaced)
        hard |= count(start[~sure])
        size = self.size[row]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.at[row] - total[:-1], size) + np.arange(total[-1])]
        off = total[np.searchsorted(start, doc)]
        # one end id behind each document
        ids = np.insert(ids, off[1:], 0).astype(self.kind)
        off = (off + np.arange(n + 1)) * self.kind.itemsize
        body = memoryview(ids.tobytes())
        out = [body[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        for i in np.flatnonzero(hard).tolist():
            text = data[doc[i] : doc[i + 1]].tobytes().decode()
            out[i] = memoryview(np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, 0], self.kind).tobytes())
        return out


def _odd_places(data: np.ndarray, doc: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Bytes that rule out word by word encoding: separators that are not single and between words, other white space, controls, what may be a special token."""
    twice = gap.copy()
    twice[1:] &= gap[:-1]
    twice[:1] = False
    full = np.flatnonzero(np.diff(doc))
    edges = np.concatenate([doc[full], doc[full + 1] - 1])
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    a, b, d = (np.append(data, [0, 0])[lead + k] for k in range(3))
    wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (d == 0x80) | (a == 0xE3) & (b == 0x80) & (d == 0x80)
    wide |= (a == 0xE2) & ((b == 0x80) & ((d <= 0x8A) | (d == 0xA8) | (d == 0xA9) | (d == 0xAF)) | (b == 0x81) & (d == 0x9F))
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    return np.concatenate([np.flatnonzero(twice), edges[gap[edges]], np.flatnonzero(_CONTROL[data]), lead[wide], special])


def _encoder(path: str, _made: dict = {}) -> Encoder:  # noqa: B006  one for each worker
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def train_dictionary(arrays: list[bytes], size: int) -> bytes:
    """A zstandard dictionary for these serialized arrays; their own bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _train(path: str, most: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, arrays, had = _encoder(path), [], 0
        for batch in batches:
            for part in c.slices(iter([batch]), "_x"):
                for ids in encoder.encode(part.column("_x")):
                    if had <= most:
                        arrays.append(bytes(ids))
                        had += len(ids)
        if arrays:
            yield pa.RecordBatch.from_arrays([pa.array([train_dictionary(arrays, size)], pa.binary())], names=["data"])

    return run


_BLOCK = "shard int, block long, doc_id array<long>, at array<long>, n array<long>, dictionary string, body binary"
_BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("at", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("dictionary", pa.string()), ("body", pa.binary())])


def _write(path: str, shared, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        data = shared.value
        name = hashlib.sha256(data).hexdigest()
        words = _dictionary(data)
        if words:
            words.precompute_compress(level=level)
        packer = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=True, write_dict_id=False)
        shard, block = TaskContext.get().partitionId(), 0
        for batch in c.slices(batches, "_x"):
            raw = encoder.encode(batch.column("_x"))
            frames = [packer.compress(x) for x in raw]
            at = np.cumsum([0, *map(len, frames)])[:-1]
            count = [len(x) // encoder.kind.itemsize for x in raw]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(([shard], [block], [batch.column("_id").to_pylist()], [at.tolist()], [count], [name], [b"".join(frames)]), _BLOCK_SCHEMA, strict=True)], schema=_BLOCK_SCHEMA)
            block += 1

    return run


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sample: int = 1024, sample_chars: int = 1 << 16, sample_bytes: int = 2 << 20, dictionary_bytes: int = 64 << 10, level: int = 3) -> None:
    """Encodes every whole text with the tokenizer file, ends it with id 0, and writes blocks in ascending doc_id order.

    Null texts are empty (one id, the end). Null doc_ids come first; rows of one doc_id follow each other in order of their texts. The dictionary is
    trained in one task on the ``sample`` texts of least hash among those of at most ``sample_chars`` characters, up to
    ``sample_bytes`` of ids, so all of the table is drawn from and reruns agree. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_x"))
    kind = _encoder(tokenizer).kind.str
    ranked = rows.filter(F.length("_x") <= sample_chars).withColumn("_r", F.xxhash64("_id", "_x"))
    least = ranked.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).select("_r").orderBy("_r").limit(sample)
    drawn = ranked.join(F.broadcast(least), "_r").groupBy("_r").agg(F.first("_x").alias("_x")).coalesce(1).sortWithinPartitions("_r")
    trained = drawn.mapInArrow(_train(tokenizer, sample_bytes, dictionary_bytes), "data binary").first()
    data = bytes(trained.data) if trained else b""
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_id").asc_nulls_first(), F.col("_x").asc_nulls_first()]
    laid = rows.repartitionByRange(shards, order[0]).sortWithinPartitions(*order)
    laid.mapInArrow(_write(tokenizer, spark.sparkContext.broadcast(data), level), _BLOCK).write.parquet(f"{path}/blocks")
    about = [(hashlib.sha256(data).hexdigest(), bytearray(data), kind)]
    spark.createDataFrame(about, "hash string, data binary, kind string").coalesce(1).write.parquet(f"{path}/dictionary")


def _read(shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, data, kind = shared.value
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError("the frames need another dictionary")
                edge = [*row["at"], len(row["body"])]
                ids = [np.frombuffer(unpacker.decompress(row["body"][a:z]), kind).astype("<u4").tobytes() for a, z in zip(edge, edge[1:], strict=False)]
                count = [len(x) // 4 for x in ids]
                if count != row["n"]:
                    raise ValueError("a frame's ids are not as many as its index says")
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(row["start"] + np.cumsum([0, *count])[:-1]), pa.array(count, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit) of every stored document."""
    about = spark.read.parquet(f"{path}/dictionary").first()
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("ids", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))
    upper = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("ids").alias("_all")).withColumn("_base", F.coalesce(F.sum("_all").over(upper), F.lit(0).cast("long"))).drop("_all")
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = blocks.select("shard", "block", "ids").withColumn("_in", F.coalesce(F.sum("ids").over(inside), F.lit(0).cast("long"))).join(shards, "shard").select("shard", "block", (F.col("_base") + F.col("_in")).alias("start"))
    placed = blocks.drop("ids").join(index, ["shard", "block"]).select("doc_id", "at", "n", "dictionary", "body", "start")
    shared = spark.sparkContext.broadcast((about.hash, bytes(about.data), about.kind))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    return placed.mapInArrow(_read(shared, schema), "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of one document (of each of its rows): only its block's row is read, and only its frames are decompressed."""
    about = spark.read.parquet(f"{path}/dictionary").first()
    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(about.data)))
    found = []
    for row in spark.read.parquet(f"{path}/blocks").filter(F.array_contains("doc_id", doc_id)).orderBy("shard", "block").toLocalIterator():
        edge = [*row["at"], len(row["body"])]
        found += [np.frombuffer(unpacker.decompress(bytes(row["body"][edge[i] : edge[i + 1]])), about.kind).tolist() for i, d in enumerate(row["doc_id"]) if d == doc_id]
    return found
