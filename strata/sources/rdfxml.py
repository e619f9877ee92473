"""RDF/XML ontologies to triples: striped syntax read as a stream, with bases, languages, parse types, containers and reified statements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from urllib.parse import urljoin
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from strata.sources.jsonld import _known

#: Triples that go on at once, of as many files as give them.
_ROWS = 10_000
#: The name spaces of the syntax itself.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"
_SYNTAX = {_R + x for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType")}


class Blank(str):
    """A blank node's name; a literal that looks like one is none."""


@dataclass
class _Frame:
    """An open element: a node (with its subject) or a property (with subject and predicate)."""

    kind: str
    base: str
    subject: str = ""
    predicate: str = ""
    object: str | None = None
    reified: str | None = None
    items: int = 0
    members: list[str] = field(default_factory=list)
    parse: str | None = None


def _uri(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def _events(text: str) -> Iterator[tuple[str, ET.Element]]:
    """Starts and ends of elements as far as the text is XML; a declared encoding is passed over, as the text is decoded already."""
    parser = ET.XMLPullParser(("start", "end"))
    try:
        for at in range(0, len(text), 1 << 16):
            parser.feed(text[at : at + (1 << 16)])
            yield from parser.read_events()
    except (ET.ParseError, ValueError):
        return


def statements(text: str) -> Iterator[tuple[str, str, str]]:
    """All (subject, predicate, object) with full addresses; blank nodes are named ``_:`` and a number or their nodeID. Stops where the text is no XML."""
    made = 0
    stack: list[_Frame] = []

    def blank() -> str:
        nonlocal made
        made += 1
        return Blank(f"_:b{made}")

    def attributes(at: str, element: ET.Element, base: str) -> Iterator[tuple[str, str, str]]:
        for name, value in element.attrib.items():
            if name not in _SYNTAX and not name.startswith(XML) and name.startswith("{"):
                yield at, _uri(name), urljoin(base, value) if name == _R + "type" else value

    def named(element: ET.Element, base: str, about: str) -> str | None:
        if _R + about in element.attrib:
            return urljoin(base, element.get(_R + about))
        if about == "about" and _R + "ID" in element.attrib:
            return urljoin(base, "#" + element.get(_R + "ID"))
        return Blank("_:n" + element.get(_R + "nodeID")) if _R + "nodeID" in element.attrib else None

    def close(frame: _Frame, element: ET.Element) -> Iterator[tuple[str, str, str]]:
        if frame.parse == "Collection":
            nodes = [blank() for _ in frame.members]
            for i, (node, member) in enumerate(zip(nodes, frame.members, strict=True)):
                yield node, RDF + "first", member
                yield node, RDF + "rest", nodes[i + 1] if i + 1 < len(nodes) else RDF + "nil"
            frame.object = nodes[0] if nodes else RDF + "nil"
        elif frame.parse == "Literal":
            frame.object = (element.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in element)
        elif frame.object is None:
            frame.object = element.text or ""
        yield frame.subject, frame.predicate, frame.object
        if frame.reified:
            yield frame.reified, RDF + "type", RDF + "Statement"
            yield from ((frame.reified, RDF + part, value) for part, value in zip(("subject", "predicate", "object"), (frame.subject, frame.predicate, frame.object), strict=True))

    for event, element in _events(text):
        if event == "end":
            frame = stack.pop()
            if frame.kind == "property":
                yield from close(frame, element)
            if frame.kind != "literal":
                element.clear()
            continue
        above = stack[-1] if stack else None
        base = urljoin(above.base if above else "", element.get(XML + "base", ""))
        if above and (above.kind == "literal" or above.parse == "Literal"):
            stack.append(_Frame("literal", base))
        elif element.tag == _R + "RDF" and above is None:
            stack.append(_Frame("root", base))
        elif above is None or above.kind in ("root", "property") and above.parse != "Resource":
            subject = named(element, base, "about") or blank()
            if element.tag != _R + "Description":
                yield subject, RDF + "type", _uri(element.tag)
            yield from attributes(subject, element, base)
            if above and above.parse == "Collection":
                above.members.append(subject)
            elif above and above.kind == "property":
                above.object = subject
            stack.append(_Frame("node", base, subject))
        else:  # a property of a node, or of the blank node that parseType Resource stands for
            predicate = _uri(element.tag)
            if predicate == RDF + "li":
                above.items += 1
                predicate = f"{RDF}_{above.items}"
            subject = above.object if above.kind == "property" else above.subject
            frame = _Frame("property", base, subject, predicate, parse=element.get(_R + "parseType"))
            frame.reified = urljoin(base, "#" + element.get(_R + "ID")) if _R + "ID" in element.attrib else None
            frame.object = named(element, base, "resource")
            about = list(attributes("", element, base))
            if frame.object is None and (about or frame.parse == "Resource"):
                frame.object = blank()
            yield from ((frame.object, p, o) for _, p, o in about)
            stack.append(frame)


def parse(text: str) -> Iterator[tuple[str, str, str]]:
    """statements with usual prefixes; those with a blank end are left out, as in the other readers.

    A reified statement (rdf:Statement with subject, predicate and object, blank or named) gives ``semantic_`` and the tail of its
    predicate's name between its subject and object, once all parts have been read.
    """
    parts: dict[str, dict[str, str]] = {}
    for s, p, o in statements(text):
        if not isinstance(s, Blank) and not isinstance(o, Blank):
            yield _known(s), _known(p), _known(o)
        role = p[len(RDF) :] if p.startswith(RDF) else ""
        if role in ("subject", "predicate", "object") or role == "type" and o == RDF + "Statement":
            known = parts.setdefault(s, {})
            known[role] = o
            if len(known) == 4:
                ends = known["subject"], known["object"]
                if not any(isinstance(x, Blank) for x in ends):
                    yield _known(ends[0]), "semantic_" + re.split(r"[#/]", known["predicate"])[-1], _known(ends[1])
                del parts[s]


def triples(files: DataFrame, text: str = "text") -> DataFrame:
    """s, p, o of every file; a file is parsed by one task, files in parallel. Null and empty texts and texts that are no XML give nothing; a broken text gives what stands before the break."""
    schema = pa.schema([(c, pa.string()) for c in ("s", "p", "o")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (row for x in batch.column(0) for row in parse(x.as_py() or ""))
            while part := list(islice(found, _ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*part, strict=True)], schema=schema)

    return files.selectExpr(f"{text} as _x").mapInArrow(run, "s string, p string, o string")
