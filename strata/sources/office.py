"""Files to text: a converter for each extension, for Office documents from their zipped XML. Spark lists, reads and splits the files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.sources import files, html

#: Name spaces of Office documents.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _table(rows: list[list[str]]) -> str:
    """A Markdown table whose first row is the head; cells are one line, short rows are filled up."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    flat = [[" ".join(x.split()).replace("|", "\\|") for x in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in flat]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _word_text(paragraph: ET.Element) -> str:
    out = []
    for node in paragraph.iter():
        if node.tag == W + "t":
            out.append(node.text or "")
        elif node.tag in (W + "tab", W + "br", W + "cr"):
            out.append("\t" if node.tag == W + "tab" else "\n")
    return "".join(out)


def docx(content: bytes) -> str:
    """Paragraphs with heading marks and list marks, and tables, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
    out = []
    for block in body if body is not None else ():
        if block.tag == W + "tbl":
            out.append(_table([["\n".join(_word_text(p) for p in cell.iter(W + "p")) for cell in row.findall(W + "tc")] for row in block.findall(W + "tr")]))
        elif block.tag == W + "p":
            style = block.find(f"{W}pPr/{W}pStyle")
            name = style.get(W + "val", "") if style is not None else ""
            level = re.fullmatch(r"(?i)heading\s*([1-6])", name) or re.fullmatch(r"(?i)(title)", name)
            text = _word_text(block).strip()
            listed = block.find(f"{W}pPr/{W}numPr") is not None
            mark = "" if not text else "#" * (1 if level[1].isalpha() else int(level[1])) + " " if level else "* " if listed else ""
            out.append(mark + text)
    return "\n\n".join(x for x in out if x)


def _cell_column(reference: str) -> int:
    at = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def xlsx(content: bytes) -> str:
    """Each sheet as a second-level heading and a table, in the order of the workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(S + "si")] if "xl/sharedStrings.xml" in names else []
        target = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet"):
            path = target.get(sheet.get(R + "id"), "").lstrip("/")
            path = path if path.startswith("xl/") else f"xl/{path}"
            rows = []
            for row in ET.fromstring(z.read(path)).iter(S + "row") if path in names else ():
                cells: list[str] = []
                for k, cell in enumerate(row.findall(S + "c")):
                    at = _cell_column(cell.get("r", "")) if cell.get("r") else k
                    value = cell.findtext(S + "v") or ""
                    kind = cell.get("t")
                    text = shared[int(value)] if kind == "s" and value else "".join(t.text or "" for t in cell.iter(S + "t")) if kind == "inlineStr" else value
                    cells += [""] * (at - len(cells)) + [text]
                rows.append(cells)
            out.append(f"## {sheet.get('name', '')}\n" + _table(rows))
    return "\n\n".join(x.strip() for x in out)


def pptx(content: bytes) -> str:
    """Slides in order: a comment with the number, titles as headings, texts, tables, pictures with their description."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out = []
        for number, (_, name) in enumerate(slides, 1):
            out.append(f"<!-- Slide number: {number} -->")
            for shape in ET.fromstring(z.read(name)).iter():
                if shape.tag == P + "pic":
                    about = shape.find(f"{P}nvPicPr/{P}cNvPr")
                    if about is not None:
                        out.append(f"![{about.get('descr') or about.get('name', '')}]({re.sub(r'[^A-Za-z0-9_]', '', about.get('name', ''))}.jpg)")
                elif shape.tag == A + "tbl":
                    out.append(_table([["".join(t.text or "" for t in cell.iter(A + "t")) for cell in row.findall(A + "tc")] for row in shape.findall(A + "tr")]))
                elif shape.tag == P + "sp":
                    kind = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                    text = "\n".join(x for p in shape.iter(A + "p") if (x := "".join(t.text or "" for t in p.iter(A + "t"))))
                    if text:
                        out.append(("# " if kind is not None and kind.get("type") in ("title", "ctrTitle") else "") + text)
    return "\n".join(x for x in out if x)


def archive(content: bytes) -> str:
    """Each member of a zip file that a converter is known for, under its name; archives in archives included."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(z.namelist()):
            convert = CONVERTERS.get(name.rsplit(".", 1)[-1].lower())
            if convert and not name.endswith("/"):
                out.append(f"## File: {name}\n\n{convert(z.read(name))}")
    return "\n\n".join(out)


def plain(content: bytes) -> str:
    return content.decode("utf-8", "replace")


#: Converters by extension; HTML is left to column expressions.
CONVERTERS: dict[str, Callable[[bytes], str]] = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "zip": archive} | dict.fromkeys("txt md rst json csv xml yaml yml toml py c cpp js f f90 f95 f03 f08 for".split(), plain)


def register(extension: str, convert: Callable[[bytes], str]) -> None:
    """Adds or replaces the converter of an extension, for frames made afterwards."""
    CONVERTERS[extension.lower()] = convert


def _tidy(text: Column) -> Column:
    """No blanks at line ends, at most one blank line in a row."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n")


def to_text(rows: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, converter (extension, 'html', or null where none is known), text, error, for each row.

    A file that can't be read has a null text and the error's name; null contents have a null text. Nothing is shuffled.
    """
    known = dict(CONVERTERS)
    schema = pa.schema([("path", pa.string()), ("converter", pa.string()), ("text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for where, kind, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                text = error = None
                convert = plain if kind in ("html", "htm") else known.get(kind)
                try:
                    text = convert(body) if convert and body is not None else None
                except (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, ValueError, NotImplementedError) as e:
                    error = type(e).__name__
                out.append((where, ("html" if kind == "htm" else kind) if convert else None, text, error))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], schema=schema)

    raw = rows.select(F.col(path).cast("string").alias("_p"), files.extension(path).alias("_e"), F.col(content).cast("binary").alias("_c")).mapInArrow(run, "path string, converter string, text string, error string")
    return raw.withColumn("text", _tidy(F.when(F.col("converter") == "html", html.html_to_text("text")).otherwise(F.col("text"))))
