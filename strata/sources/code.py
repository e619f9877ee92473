"""Source code and notebooks to entity tables. A parse keeps a stack of open blocks, so it runs file by file in Arrow batches."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"^\s*(?:(?:recursive|pure|elemental|impure)\s+)*(?:(module|program|subroutine|interface)|(?:[\w()*=, ]+?\s+)?(function)|(type)(?=\s*(?:,[^:]*)?(?:::)?\s*\w+\s*$))\s*(?:,[^:]*)?(?:::)?\s*(\w*)", re.I)
_END = re.compile(r"^\s*end\s*(module|program|subroutine|function|interface|type)?\b", re.I)
_OTHER_END = re.compile(r"^\s*end\s*(?:if|do|select|where|forall|associate|block|enum)\b", re.I)
_USE = re.compile(r"^\s*use\s+(?:,\s*\w+\s*::\s*)?(\w+)", re.I)
_CALL = re.compile(r"\bcall\s+(\w+)", re.I)
_ACCESS = re.compile(r"^\s*(public|private)\s*(?:::\s*(.*))?$", re.I)
_QUOTED = re.compile(r"'[^']*'|\"[^\"]*\"")


def parse_code(text: str) -> Iterator[tuple]:
    """(row kind, name, type, start, end, parent, access, signature, line): entities, uses and calls of a free-form source, lines from 1.

    ``end`` closes the innermost open block; what is open at the end of the file ends there. Access is a name's own list,
    else the module's default, else public. USE and CALL belong to the innermost open entity.
    """
    stack: list[dict] = []
    done: list[dict] = []
    refs: list[tuple] = []
    named: dict[str, str] = {}
    default = "public"
    lines = text.split("\n")
    for n, raw in enumerate(lines, 1):
        line = _QUOTED.sub("''", raw).split("!")[0].rstrip()
        if not line.strip():
            continue
        if _OTHER_END.match(line):
            continue
        if (m := _END.match(line)) and (m[1] or line.strip().lower() == "end"):
            if stack:
                stack[-1]["end"] = n
                done.append(stack.pop())
            continue
        if (m := _ACCESS.match(line)) and stack:
            if m[2]:
                named.update((x.strip().lower(), m[1].lower()) for x in m[2].split(","))
            elif stack[-1]["kind"] == "module":
                default = m[1].lower()
            continue
        if m := _USE.match(line):
            refs.append(("use", m[1], n, stack[-1] if stack else None))
            continue
        m = _OPEN.match(line)
        if m and not re.match(r"^\s*module\s+procedure\b", line, re.I):
            kind = next(x for x in m.group(1, 2, 3) if x).lower()
            stack.append({"kind": "type_definition" if kind == "type" else kind, "name": m[4] or kind, "start": n, "end": None, "parent": stack[-1]["name"] if stack else None, "signature": raw.strip()})
            continue
        refs += [("call", x, n, stack[-1] if stack else None) for x in _CALL.findall(line)]
    for open_ in reversed(stack):
        open_["end"] = len(lines)
        done.append(open_)
    for e in sorted(done, key=lambda e: (e["start"], -e["end"])):
        yield "entity", e["name"], e["kind"], e["start"], e["end"], e["parent"], named.get(e["name"].lower(), default if e["parent"] else "public"), e["signature"], None
    for kind, name, n, owner in refs:
        yield kind, name, None, None, None, owner["name"] if owner else None, None, None, n


def parse_notebook(text: str) -> Iterator[tuple]:
    """The same rows of a notebook: cells, functions and classes of code cells, imports as uses, calls; broken cells stay cells only."""
    for n, cell in enumerate(json.loads(text).get("cells", [])):
        body = cell.get("source", "")
        body = "".join(body) if isinstance(body, list) else body
        name = f"cell_{n}"
        yield "entity", name, f"{cell.get('cell_type', 'raw')}_cell", 1, body.count("\n") + 1, None, "public", body.split("\n")[0][:80], None
        if cell.get("cell_type") != "code":
            continue
        try:
            tree = ast.parse(body)
        except SyntaxError:
            continue
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield "entity", node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno, name, "public", body.split("\n")[node.lineno - 1].strip(), None
            elif isinstance(node, ast.Import):
                for a in node.names:
                    yield "use", a.name, None, None, None, name, None, None, node.lineno
            elif isinstance(node, ast.ImportFrom) and node.module:
                yield "use", node.module, None, None, None, name, None, None, node.lineno
            elif isinstance(node, ast.Call):
                called = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
                if called:
                    yield "call", called, None, None, None, name, None, None, node.lineno


#: Rows that go on at once, of as many files as give them.
_ROWS = 10_000
_TEXT, _INT = pa.string(), pa.int32()
_PARSED = pa.schema([("file", _TEXT), ("kind", _TEXT), ("name", _TEXT), ("etype", _TEXT), ("start_line", _INT), ("end_line", _INT), ("parent", _TEXT), ("access", _TEXT), ("signature", _TEXT), ("line", _INT)])
_MAPPED = pa.schema([("project", _TEXT), ("file", _TEXT), ("flat_line", _INT), ("source", _TEXT), ("line", _INT), ("text", _TEXT)])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, _ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def entity_rows(files: DataFrame, parser: str = "code") -> DataFrame:
    """file and the parse rows of every file (file, text); parser is code or notebook."""
    parse = parse_code if parser == "code" else parse_notebook

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(((f.as_py(), *r) for f, t in zip(*batch.columns, strict=True) for r in parse(t.as_py() or "")), _PARSED)

    return files.select(F.col("file").cast("string"), "text").mapInArrow(run, "file string, kind string, name string, etype string, start_line int, end_line int, parent string, access string, signature string, line int")


_INCLUDE = re.compile(r"^\s*(?:#\s*)?include\s+['\"]([^'\"]+)['\"]", re.I)


def flatten(file: str, texts: dict[str, str]) -> Iterator[tuple[str, int, str]]:
    """(source file, line, text) of a file with its includes in place; an include of an open or unknown file stays a line."""

    def walk(name: str, open_: tuple[str, ...]) -> Iterator[tuple[str, int, str]]:
        for n, line in enumerate(texts[name].split("\n"), 1):
            m = _INCLUDE.match(line)
            if m and m[1] in texts and m[1] not in open_:
                yield from walk(m[1], (*open_, m[1]))
            else:
                yield name, n, line

    return walk(file, (file,))


def source_map(files: DataFrame) -> DataFrame:
    """project, file, flat_line, source, line, text of all files (project, file, text); a project is one row of its files, so a task takes many at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for project, listed in zip(*batch.columns, strict=True):
                texts = {x["file"]: x["text"] or "" for x in listed.as_py()}
                yield from ((project.as_py(), f, i, *r) for f in sorted(texts) for i, r in enumerate(flatten(f, texts), 1))

        for batch in batches:
            yield from _batches(rows(batch), _MAPPED)

    packed = files.groupBy(F.col("project").cast("string").alias("project")).agg(F.collect_list(F.struct("file", "text")).alias("_f"))
    return packed.mapInArrow(run, "project string, file string, flat_line int, source string, line int, text string")
