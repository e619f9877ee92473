"""Turtle text to triples: the subset that ontologies use (prefixes, a, ; and , lists, strings with language or type, comments)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(r'\s*(?:#[^\n]*|("""(?:.|\n)*?"""|"(?:[^"\\]|\\.)*")(?:@[\w-]+|\^\^(?:<[^>]*>|[\w:.-]+))?|(<[^>]*>)|([;,.\[\]()])(?=\s|$|[;,.\[\]()])|([^\s;,\[\]()]+?)(?=[;,\[\]()]|\.?\s|\.?$))')
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def parse(text: str) -> Iterator[tuple[str, str, str]]:
    """(subject, predicate, object) in the order of the text; well-known predicates keep their prefixed names, blank nodes are skipped."""
    subject = predicate = None
    skip, directive = 0, False
    for m in _TOKEN.finditer(text):
        literal, uri, mark, name = m.groups()
        if literal is not None:
            quote = 3 if literal.startswith('"""') else 1
            value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), literal[quote:-quote])
        elif uri is not None:
            value = uri[1:-1]
        elif name is not None:
            value = name
        elif mark is not None:
            if mark in "[(":
                skip += 1
            elif mark in "])":
                skip -= 1
            elif skip == 0 and mark == ".":
                subject = predicate = None
                directive = False
            elif skip == 0 and mark == ";":
                predicate = None
            continue
        else:
            continue
        if skip:
            continue
        if value in ("@prefix", "@base", "PREFIX", "BASE"):
            directive = True
        elif directive:
            directive = value[:1] not in ("h", "u") or value.endswith(":")
            if uri is not None:
                directive = True
        elif subject is None:
            subject = value
        elif predicate is None:
            predicate = "rdf:type" if value == "a" else value
        else:
            yield subject, predicate, value


def triples(files: DataFrame, text: str = "text") -> DataFrame:
    """s, p, o of every file; a file is parsed by one task, files in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([t for x in batch["_x"] for t in parse(x or "")], columns=["s", "p", "o"])

    return files.selectExpr(f"{text} as _x").mapInPandas(run, "s string, p string, o string")
