"""Splitting documents: greedy folds over sentences, lines, cells and sections. A fold is sequential inside one document, so
each runs in Arrow batches, document by document; what is flat stays in column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata import config

#: Characters of documents whose pieces go on at once.
_CHARS = 1 << 20
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_LOOSE = re.compile(r"(?<=[.!?])\s+|\n\s*")
_MARK = re.compile(r"^(#{1,6})\s+(.+)$")
_NUMBER = re.compile(r"^(\d+(?:\.\d+)*)\.?\s+([A-Z].*)$")
_LIST = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")


def sentences(text: str) -> list[str]:
    return [x.strip() for x in _SENTENCE.split(text) if x.strip()]


def header(line: str) -> tuple[int, str] | None:
    """Level and title of a heading line."""
    if m := _MARK.match(line):
        return len(m[1]), m[2].strip()
    if m := _NUMBER.match(line):
        return m[1].count(".") + 1, m[2].strip()
    bare = line.strip()
    if len(bare) > 3 and bare.isupper() and not bare.endswith("."):
        return 1, bare
    return None


def pack(parts: list[str], most: int, overlap: int = 0, joint: str = " ") -> list[str]:
    """Greedy packing to ``most`` characters; the parts behind a cut that fit ``overlap`` characters start the next chunk."""
    out: list[str] = []
    now: list[str] = []
    size = 0
    for part in parts:
        if now and size + len(part) + len(joint) > most:
            out.append(joint.join(now))
            kept, room = [], overlap
            for old in reversed(now):
                if len(old) <= room:
                    kept.insert(0, old)
                    room -= len(old)
            now, size = kept, sum(len(x) + len(joint) for x in kept)
        now.append(part)
        size += len(part) + len(joint)
    return [*out, joint.join(now)] if now else out


def fixed_sentence_chunks(text: str, most: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> list[str]:
    """Sentences and lines packed; a longer sentence is cut into windows of ``most`` characters that end with it."""
    out: list[str] = []
    pending: list[str] = []
    for part in (x.strip() for x in _LOOSE.split(text)):
        if len(part) > most:
            out += pack(pending, most, overlap)
            pending = []
            step = max(1, most - overlap)
            out += [part[i : i + most] for i in range(0, max(1, len(part) - overlap), step)]
        elif part:
            pending.append(part)
    return out + pack(pending, most, overlap)


def structure(text: str) -> list[tuple[str, int, str, int, int]]:
    """(kind, level, title, start line, end line): headings, lists, fenced code and paragraphs, with true line offsets."""
    out: list[tuple[str, int, str, int, int]] = []
    lines, i = text.split("\n"), 0
    while i < len(lines):
        line, start = lines[i], i
        if head := header(line):
            out.append(("header", head[0], head[1], i, i))
        elif line.startswith("```"):
            i += 1
            while i < len(lines) and not lines[i].startswith("```"):
                i += 1
            out.append(("code", 0, "", start, min(i, len(lines) - 1)))
        elif _LIST.match(line):
            while i + 1 < len(lines) and _LIST.match(lines[i + 1]):
                i += 1
            out.append(("list", 0, "", start, i))
        elif line.strip():
            while i + 1 < len(lines) and lines[i + 1].strip() and not header(lines[i + 1]) and not _LIST.match(lines[i + 1]) and not lines[i + 1].startswith("```"):
                i += 1
            out.append(("paragraph", 0, "", start, i))
        i += 1
    return out


def section_tree(text: str) -> list[tuple[int, int, str, str, int | None]]:
    """(number, level, title, path, parent number) of Markdown headings; a heading's content holds its deeper ones."""
    out: list[tuple[int, int, str, str, int | None]] = []
    stack: list[tuple[int, int, str]] = []
    for line in text.split("\n"):
        if m := _MARK.match(line):
            level = len(m[1])
            while stack and stack[-1][1] >= level:
                stack.pop()
            path = "/".join([*(t for _, _, t in stack), m[2].strip()])
            out.append((len(out), level, m[2].strip(), path, stack[-1][0] if stack else None))
            stack.append((out[-1][0], level, m[2].strip()))
    return out


def semantic_chunks(text: str, most: int = config.SECTION_CHUNK_MAX, keep: int = config.OVERLAP_SENTENCES) -> list[str]:
    """Sections packed to ``most`` characters: a new chunk at headings of level 1 and 2, sentences of a long paragraph split, the last
    ``keep`` sentences of a full chunk's paragraphs repeated."""
    out: list[str] = []
    now: list[str] = []
    tail: list[str] = []
    lines = text.split("\n")

    def flush(repeat: bool) -> None:
        nonlocal now, tail
        if now:
            out.append("\n".join(now))
        now = [" ".join(tail)] if repeat and tail else []
        tail = []

    for kind, level, _, a, z in structure(text):
        body = "\n".join(lines[a : z + 1])
        if kind == "header" and level <= 2:
            flush(False)
        elif sum(len(x) + 1 for x in now) + len(body) > most:
            flush(True)
        if kind == "paragraph":
            found = sentences(body)
            tail = (tail + found)[-keep:] if keep else []
            if len(body) > most:
                flush(False)
                group: list[str] = []
                for s in found:
                    if group and sum(len(x) + 1 for x in group) + len(s) > most:
                        out.append(" ".join(group))
                        group = group[-keep:] if keep else []
                    group.append(s)
                now, tail = [" ".join(group)], group[-keep:] if keep else []
                continue
        now.append(body)
    flush(False)
    return out


def section_chunks(text: str, most: int = config.SECTION_CHUNK_MAX, overlap: int = 0) -> list[str]:
    """The whole text if it fits, else each Markdown section if it fits, else its paragraphs packed."""
    if len(text) <= most:
        return [text] if text.strip() else []
    parts = re.split(r"(?m)^(?=#{1,6}\s)", text)
    return [c for p in parts if p.strip() for c in ([p.strip()] if len(p) <= most else pack([x.strip() for x in re.split(r"\n\s*\n", p) if x.strip()], most, overlap, "\n\n"))]


def line_pack(text: str, most: int = config.ENTITY_PART_CHARS) -> list[str]:
    """Lines packed greedily to ``most`` characters."""
    return pack(text.split("\n"), most, 0, "\n")


def notebook_chunks(cells: list[str], target: int = config.NOTEBOOK_TARGET_TOKENS, most: int = config.NOTEBOOK_MAX_TOKENS) -> list[str]:
    """Cells packed to ``target`` tokens; a cell over ``most`` tokens stands alone."""
    out: list[str] = []
    now: list[str] = []
    size = 0
    for cell in cells:
        tokens = max(1, len(cell) // config.CHARS_PER_TOKEN)
        if now and (tokens > most or size + tokens > target):
            out.append("\n\n".join(now))
            now, size = [], 0
        if tokens > most:
            out.append(cell)
        else:
            now.append(cell)
            size += tokens
    return [*out, "\n\n".join(now)] if now else out


def split_rows(docs: DataFrame, split: Callable[[str], list[str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk_index, text: one row for each piece that split makes; documents stay in their task. Pieces go on after each ``_CHARS`` characters or a document."""
    schema = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for n, (d, t) in enumerate(zip(*batch.columns, strict=True), 1):
                text = t.as_py() or ""
                rows += [(d.as_py(), i, c) for i, c in enumerate(split(text))]
                size += len(text)
                if rows and (size > _CHARS or n == len(batch)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0

    return docs.select(F.col(doc_id).cast("long").alias("_d"), F.col(text).alias("_x")).mapInArrow(run, "doc_id long, chunk_index int, text string")


def structure_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(d, i, *s) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for i, s in enumerate(structure(t or ""))], columns=["doc_id", "n", "kind", "level", "title", "start_line", "end_line"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n int, kind string, level int, title string, start_line int, end_line int")


def section_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *s) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for s in section_tree(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "n", "level", "title", "path", "parent"]).astype({"parent": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n int, level int, title string, path string, parent int")


def flat_sections(docs: DataFrame, is_header: Column) -> DataFrame:
    """Every heading line starts a section; text before the first is section 0. Lines are numbered inside their document."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    running = F.sum(is_header.cast("int")).over(Window.partitionBy("doc_id").orderBy("n"))
    return lines.withColumn("section", running.cast("bigint")).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


def fixed_windows(text: Column, size: int, step: int) -> Column:
    """Windows of ``size`` characters every ``step``."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(step))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


#: What a line of code starts with, by kind of section.
CODE_SECTIONS = (("declarations", "implicit|use|real|integer|logical|character|type"), ("executable", "do|if|select|where|forall|call"), ("io", "open|close|read|write|print"), ("parallel", r"\$omp|\$acc|!dir\$"))


def code_sections(rows: DataFrame, key: str, text: str = "text", longer: int = 5) -> DataFrame:
    """key, kind, first, last (lines from 0): stretches of code of one kind with more than ``longer`` lines, for texts with two or more.

    A section starts where a line's kind differs from the last known one; blank lines, comments and unknown lines belong to it.
    """
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("n", "_l"))
    low = F.lower("_l")
    kind = F.when(low.rlike(r"^\s*contains\s*$"), "contains")
    for name, starts in CODE_SECTIONS:
        kind = F.coalesce(kind, F.when(low.rlike(rf"^\s*(?:{starts})"), name))
    lines = lines.withColumn("_k", F.when((F.trim("_l") != "") & ~F.startswith(F.trim("_l"), F.lit("!")), kind))
    order = Window.partitionBy(key).orderBy("n")
    before = F.last("_k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("_new", (F.col("_k").isNotNull() & (F.col("_k") != F.coalesce(before, F.lit("code")))).cast("int"))
    lines = lines.withColumn("_s", F.sum("_new").over(order))
    sections = lines.groupBy(key, "_s").agg(F.coalesce(F.max(F.when(F.col("_new") == 1, F.col("_k"))), F.lit("code")).alias("kind"), F.min("n").alias("first"), F.max("n").alias("last"))
    kept = sections.filter(F.col("last") - F.col("first") >= longer)
    return kept.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(key))).filter("_c > 1").select(key, "kind", "first", "last")


def paper_chunks(rows: DataFrame, key: str, text: str = "text", least: int = 1) -> DataFrame:
    """key, chunk, level, title, first, last, n_chars: a chunk for each # heading, to the line before the next one of its level or above; those of fewer than ``least`` characters are left out and not numbered."""
    split = rows.select(key, F.split(text, "\r?\n").alias("_lines"))
    marked = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("n"), F.length(F.regexp_extract(x, r"^(#{1,6})\s+\S", 1)).alias("level"), F.trim(F.regexp_extract(x, r"^#{1,6}\s+(.*)$", 1)).alias("title"))), lambda h: h.level > 0)
    heads = split.withColumn("_heads", marked).select(key, "_lines", "_heads", F.explode("_heads").alias("_h"))
    until = F.array_min(F.transform(F.filter("_heads", lambda h: (h.n > F.col("_h.n")) & (h.level <= F.col("_h.level"))), lambda h: h.n))
    out = heads.select(key, F.col("_h.level").alias("level"), F.col("_h.title").alias("title"), F.col("_h.n").alias("first"), (F.coalesce(until, F.size("_lines")) - 1).alias("last"), "_lines")
    out = out.withColumn("n_chars", F.length(F.array_join(F.slice("_lines", F.col("first") + 1, F.col("last") - F.col("first") + 1), "\n"))).filter(F.col("n_chars") >= least)
    return out.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).cast("bigint").alias("chunk"), "level", "title", "first", "last", "n_chars")
