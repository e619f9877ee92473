"""Chat formatting at token level: segments are encoded one by one, reserved ids are spliced between them.

A turn becomes the ids of ``<|im_start|>``, role and line feed, text, ``<|im_end|>``, line feed. The two marks are ids behind the
tokenizer's vocabulary, which no text can give. Roles and texts are encoded apart from the marks and from each other, so the
ids of a text do not depend on what stands around it, and its place is known without a search: segment lengths are summed up,
the loss mask is the prefix sum of +1 where a learned text begins and -1 where it ends.

Control strings inside a role or text get a backslash behind their ``<`` (those that have backslashes there already, one more),
so the decoded form shows marks only where there are marks, and taking one backslash off gives the text back. In roles
backslashes and line feeds are escaped as well, as a line feed ends the role.

Rows are dealt by ranges of conversation and turn, so a long conversation is spread over tasks; each task sums token counts
up inside its range and writes its turns. The reader adds what a conversation has before a range from a table of one row for
each range at most, which it makes from the counts alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm import columnar as c
from strata.llm.token_store import Encoder

#: The names of the control strings <|name|>, in the order of their ids behind the vocabulary.
CONTROLS = ("im_start", "im_end")
START, END = (f"<|{x}|>" for x in CONTROLS)
_CONTROL = re.compile(r"<(\\*\|(?:im_start|im_end)\|>)")
_ESCAPED = re.compile(r"<\\(\\*\|(?:im_start|im_end)\|>)")
_ROLE = {"\\": "\\", "n": "\n"}


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1", text) if "|>" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1", text) if "|>" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: _ROLE[m[1]], unescape(role))


class Coder:
    """Ids of segments and back; reserved ids lie behind the vocabulary."""

    def __init__(self, path: str) -> None:
        self.encoder = Encoder(path)
        self.tokenizer = self.encoder.tokenizer
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        self.start = self.tokenizer.get_vocab_size()
        self.end = self.start + 1
        self.feed = self._ids("\n")
        self.heads: dict[str, np.ndarray] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def head(self, role: str) -> np.ndarray:
        if role not in self.heads:
            if len(self.heads) >= 256:  # roles are few; where they are not, the table starts anew
                self.heads.clear()
            self.heads[role] = self._ids(escape_role(role) + "\n")
        return self.heads[role]

    def assemble(self, roles: list[str], texts: list[str], learned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all turns end to end, their loss mask, and the offsets of the turns."""
        coded = self.encoder.encode(pa.array([escape(x) for x in texts], pa.string()))
        bodies = [np.frombuffer(x, self.encoder.kind)[:-1] for x in coded]  # without the end id of a document
        heads = [self.head(x) for x in roles]
        size = np.ones((len(texts), 5), np.int64)
        size[:, 1], size[:, 2], size[:, 4] = list(map(len, heads)), list(map(len, bodies)), len(self.feed)
        edge = np.concatenate([[0], np.cumsum(size.ravel())])
        start, end = (np.array([x], np.int32) for x in (self.start, self.end))
        ids = np.concatenate([np.zeros(0, np.int32), *chain.from_iterable((start, h, b, end, self.feed) for h, b in zip(heads, bodies, strict=True))])
        step = np.zeros(len(ids) + 1, np.int8)
        np.add.at(step, edge[2:-1:5][learned], 1)
        np.add.at(step, edge[3:-1:5][learned], -1)
        return ids, np.cumsum(step, dtype=np.int8)[:-1], edge[::5]

    def turns(self, ids: list[np.ndarray], masks: list[np.ndarray]) -> Iterator[tuple[str, str, str | None, int]]:
        """role, text, text under the mask (None where it covers nothing), and characters of the formatted turn, of each turn's ids."""
        inner = []
        for x in ids:
            if x[0] != self.start or np.count_nonzero(x >= self.start) != 2:
                raise ValueError("a turn has two reserved ids, the first at its beginning")
            inner.append(int(np.flatnonzero(x == self.end)[0]))
        decode = lambda rows: self.tokenizer.decode_batch(rows, skip_special_tokens=False)
        shown, tails = decode([x[1:z].tolist() for x, z in zip(ids, inner, strict=True)]), decode([x[z + 1 :].tolist() for x, z in zip(ids, inner, strict=True)])
        taken = iter(decode([x[m].tolist() for x, m in zip(ids, masks, strict=True) if m.any()]))
        for whole, tail, mask in zip(shown, tails, masks, strict=True):
            role, _, text = whole.partition("\n")
            yield unescape_role(role), unescape(text), unescape(next(taken)) if mask.any() else None, len(START) + len(whole) + len(END) + len(tail)


def _coder(path: str, _made: dict = {}) -> Coder:  # noqa: B006  one for each worker
    if path not in _made:
        _made[path] = Coder(path)
    return _made[path]


_TURN = "_null boolean, _id long, turn long, _part int, _in long, n_tokens long, ids array<int>, mask array<byte>"


def _encode(path: str, learn: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = _coder(path), TaskContext.get().partitionId()
        last, had = None, 0  # the conversation of the row before, and its tokens so far
        for batch in c.slices(batches, "_text"):
            roles = [x or "" for x in batch.column("_role").to_pylist()]
            texts = [x or "" for x in batch.column("_text").to_pylist()]
            ids, mask, edge = coder.assemble(roles, texts, np.array([x in learn for x in roles], bool))
            null, name = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("_null", "_id"))
            new = np.ones(len(name), bool)
            new[1:] = (null[1:] != null[:-1]) | (name[1:] != name[:-1])
            first = np.flatnonzero(new)
            at = edge[:-1] - np.repeat(edge[first], np.diff(np.append(first, len(name))))
            if last == (null[0], name[0]):
                at[: first[1] if len(first) > 1 else None] += had
            last, had = (null[-1], name[-1]), int(at[-1] + edge[-1] - edge[-2])
            off = pa.array(edge, pa.int32())
            columns = [batch.column("_null"), batch.column("_id"), batch.column("turn"), pa.array(np.full(len(at), part, np.int32)), pa.array(at), pa.array(np.diff(edge)), pa.ListArray.from_arrays(off, pa.array(ids)), pa.ListArray.from_arrays(off, pa.array(mask))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _TURN.split(", ")])

    return run


def write_chats(conversations: DataFrame, path: str, *, tokenizer: str, learn: tuple[str, ...] = ("assistant",), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> None:
    """Formats all turns and writes them, in order of conversation and turn.

    The loss mask covers the texts whose role is in ``learn``. Turns are in order of turn, role and text, nulls first; repeated
    rows are repeated turns. A null role or text is empty. Rows with a null conv_id are one conversation. Other columns do not
    matter; an empty table gives a store without turns.
    """
    name = F.col(conv_id).cast("bigint")
    rows = conversations.select(name.isNull().alias("_null"), F.coalesce(name, F.lit(0).cast("bigint")).alias("_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("_role"), F.col(text).alias("_text"))
    order = [F.col(x).asc_nulls_first() for x in ("_null", "_id", "turn", "_role", "_text")]
    ranges = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_begin", F.substring("_text", 1, 64)).repartitionByRange(ranges, *order[:4], F.col("_begin").asc_nulls_first()).drop("_begin")
    dealt.sortWithinPartitions(*order).mapInArrow(_encode(tokenizer, learn), _TURN).write.parquet(path)


def stored_chats(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, turn, start, n_tokens, ids, mask: a row for each stored turn; a conversation's ids are those of its turns by start.

    start is the number of ids that the conversation has before the turn; mask is 1 on ids of learned texts and 0 elsewhere.
    """
    turns = spark.read.parquet(path)
    before = Window.partitionBy("_null", "_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.groupBy("_null", "_id", "_part").agg(F.sum("n_tokens").alias("_n"))
    # only the conversation at the beginning of a range can have tokens in ranges before it: a row a range at most
    base = sums.withColumn("_base", F.sum("_n").over(before)).filter("_base > 0").drop("_n")
    placed = turns.join(F.broadcast(base), ["_null", "_id", "_part"], "left")
    return placed.select(F.when(~F.col("_null"), F.col("_id")).alias("conv_id"), "turn", (F.col("_in") + F.coalesce("_base", F.lit(0).cast("bigint"))).alias("start"), "n_tokens", "ids", "mask")


def _lists(column: pa.Array) -> list[np.ndarray]:
    off = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[off[0] : off[-1]], off[1:-1] - off[0]) if len(column) else []


_READ = "conv_id long, start long, role string, text string, learned string, formatted_chars long"
_READ_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())


def read_chats(turns: DataFrame, *, tokenizer: str) -> DataFrame:
    """conv_id, start, role, text, learned, formatted_chars of stored turns, all decoded from their ids and masks.

    learned is the text under the mask, null where the mask covers nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                found = zip(*coder.turns(_lists(batch.column("ids")), [x.astype(bool) for x in _lists(batch.column("mask"))]), strict=True)
                arrays = [batch.column("conv_id"), batch.column("start"), *map(list, found)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) if isinstance(x, list) else x for x, t in zip(arrays, _READ_TYPES, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

    return turns.select("conv_id", "start", "ids", "mask").mapInArrow(run, _READ)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    done: list[tuple] = []
    now, turns, loss, counts = None, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

    def ended() -> tuple:
        return now[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

    def packed() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for conv, role, text, learned, chars in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text", "learned", "formatted_chars")), strict=True):
            if now != (conv,):
                if now is not None:
                    done.append(ended())
                now, turns, loss, counts = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            turns.update(f"{role}\n{text}\n".encode())
            counts[0] += 1
            counts[2] += chars
            if learned is not None:
                loss.update(learned.encode())
                counts[1] += len(learned)
        if done:
            yield packed()
            done.clear()
    if now is not None:
        done.append(ended())
        yield packed()


def chat_digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation of read_chats().

    A hash runs over a whole conversation, so its turns pass through one task, one after another; nothing of them is kept.
    """
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(_digest, _DIGEST)

