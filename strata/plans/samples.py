"""Small Office files with known contents, as inputs of queries and tests."""

from __future__ import annotations

import io
import zipfile

_XML = {
    "docx": ('<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>', "word/document.xml"),
    "pptx": ('<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main">{}</p:sld>', "ppt/slides/slide{}.xml"),
}


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def small_docx(title: str, body: str) -> bytes:
    par = lambda text, style="": f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'
    cell = lambda text: f"<w:tc>{par(text)}</w:tc>"
    return _zip({_XML["docx"][1]: _XML["docx"][0].format(par(title, '<w:pStyle w:val="Heading2"/>') + par(body) + par("point", "<w:numPr/>") + f"<w:tbl><w:tr>{cell('key')}{cell('value')}</w:tr><w:tr>{cell(title)}{cell('1')}</w:tr></w:tbl>")})


def small_xlsx(title: str, body: str) -> bytes:
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return _zip(
        {
            "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{link}"><sheets><sheet name="{title}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{space}"><si><t>name</t></si><si><t>{body}</t></si></sst>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
        }
    )


def small_pptx(title: str, body: str) -> bytes:
    shape = lambda text, kind: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    picture = '<p:pic><p:nvPicPr><p:cNvPr name="Picture 1" descr="a map"/></p:nvPicPr></p:pic>'
    return _zip({_XML["pptx"][1].format(k): _XML["pptx"][0].format(x) for k, x in ((1, shape(title, "title") + shape(body, "body")), (2, picture), (10, shape("last", "body")))})


def sample(kind: int, name: str) -> bytes:
    """A file about a name: docx, xlsx, pptx, zip, text, HTML, a broken docx, or bytes of no kind."""
    body = f"about {name}"
    if kind < 3:
        return (small_docx, small_xlsx, small_pptx)[kind](name, body)
    if kind == 3:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("b.docx", small_docx(name, body))
            z.writestr("a.txt", body)
            z.writestr("c.bin", b"\x00")
        return out.getvalue()
    return (f"{name}  \r\n\r\n\r\n\r\n{body}".encode(), f"<html><head><title>t</title></head><body><h1>{name}</h1><p>{body}</p></body></html>".encode(), b"no zip", b"\x00")[kind - 4]
