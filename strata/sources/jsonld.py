"""JSON-LD ontologies to triples: contexts with prefixes and terms, @graph, nested nodes, @type, lists of values."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name spaces that keep their usual prefixes.
SPACES = {"http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf:", "http://www.w3.org/2000/01/rdf-schema#": "rdfs:", "http://www.w3.org/2002/07/owl#": "owl:", "http://www.w3.org/2004/02/skos/core#": "skos:"}


def _known(uri: str) -> str:
    for space, prefix in SPACES.items():
        if uri.startswith(space):
            return prefix + uri[len(space) :]
    return uri


def _context(value: object) -> dict[str, str]:
    out: dict[str, str] = {}
    for part in value if isinstance(value, list) else [value]:
        if isinstance(part, dict):
            out |= {k: v if isinstance(v, str) else v.get("@id", k) for k, v in part.items() if isinstance(v, (str, dict))}
    return out


def _expand(name: str, context: dict[str, str]) -> str:
    for _ in range(len(context) + 1):  # terms may stand for prefixed names, those for others
        head, colon, tail = name.partition(":")
        if name in context and not name.startswith("@") and context[name] != name:
            name = context[name]
        elif colon and head in context and not tail.startswith("//"):
            name = context[head] + tail
        else:
            break
    return _known(name)


def parse(text: str) -> Iterator[tuple[str, str, str]]:
    """(subject, predicate, object) in the order of the text. Nodes without @id are blank and skipped, their named parts are not. Text that is no JSON gives nothing."""
    try:
        whole = json.loads(text)
    except ValueError:
        return

    def node(x: dict, context: dict[str, str]) -> Iterator[tuple[str, str, str]]:
        if "@context" in x:
            context = context | _context(x["@context"])
        subject = _expand(x["@id"], context) if isinstance(x.get("@id"), str) else None
        for key, values in x.items():
            if key in ("@context", "@id"):
                continue
            predicate = "rdf:type" if key == "@type" else _expand(key, context)
            for value in values if isinstance(values, list) else [values]:
                inner = value.get("@list", value.get("@set")) if isinstance(value, dict) else None
                for v in inner if isinstance(inner, list) else [value]:
                    if isinstance(v, dict) and "@value" not in v:
                        if key == "@graph" or len(v) > 1 or "@id" not in v:
                            yield from node(v, context)
                        if key == "@graph" or not isinstance(v.get("@id"), str):
                            continue
                        found = _expand(v["@id"], context)
                    elif key == "@graph" or v is None:
                        continue
                    else:
                        found = v["@value"] if isinstance(v, dict) else v
                        found = _expand(found, context) if key == "@type" else found if isinstance(found, str) else json.dumps(found)
                    if subject is not None:
                        yield subject, predicate, str(found)

    for x in whole if isinstance(whole, list) else [whole]:
        if isinstance(x, dict):
            yield from node(x, {})


def triples(files: DataFrame, text: str = "text") -> DataFrame:
    """s, p, o of every file; a file is parsed by one task, files in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([t for x in batch["_x"] for t in parse(x or "")], columns=["s", "p", "o"])

    return files.selectExpr(f"{text} as _x").mapInPandas(run, "s string, p string, o string")


def merge(*parts: DataFrame) -> DataFrame:
    """One ontology of several: every triple once."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def change_concepts(concepts: DataFrame, changes: DataFrame, key: str = "uri") -> DataFrame:
    """concepts after changes(key, the other columns, removed): removed rows go, others replace the row of their key or come in."""
    rest = concepts.join(changes.select(key), key, "left_anti")
    return rest.unionByName(changes.filter(~F.coalesce("removed", F.lit(False))).select(*concepts.columns))
