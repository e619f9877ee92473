"""Converters and JSON-LD on odd inputs."""

import io
import zipfile

from strata.plans import samples as d
from strata.sources import jsonld, office


def test_odd_files(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.txt", "in")
    rows = [("a.TXT", b"\xff ok \t\nnext"), ("b.docx", None), ("c.zip", inner.getvalue()), ("d.xlsx", inner.getvalue()), ("e.pptx", d.small_pptx("t", "b")[:50]), ("plain", b"x"), (None, b"y"), ("f.txt", b"")]
    out = {r.path: r for r in office.to_text(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert out["a.TXT"].text == "� ok\nnext" and out["b.docx"].text is None and out["b.docx"].error is None
    assert out["c.zip"].text == "## File: x.txt\n\nin" and out["d.xlsx"].error == "KeyError" and out["e.pptx"].error == "BadZipFile"
    assert out["plain"].converter is None and out[None].text is None and out["f.txt"].text == ""
    assert office.to_text(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_registered_converters(spark, monkeypatch):
    monkeypatch.setattr(office, "CONVERTERS", dict(office.CONVERTERS))
    office.register("UP", lambda body: body.decode().upper())
    assert office.to_text(spark.createDataFrame([("a.up", b"loud")], "path string, content binary")).first().text == "LOUD"


def test_documents_of_many_parts():
    assert "| key | value |" in office.docx(d.small_docx("T", "B"))
    assert office.pptx(d.small_pptx("T", "B")).count("Slide number") == 3
    assert office.xlsx(d.small_xlsx("T", "B")) == "## T\n| name |  | 7 |\n| --- | --- | --- |\n| B | in |  |"


def test_jsonld():
    text = '[{"@context": {"e": "http://e/", "knows": {"@id": "e:knows"}}, "@id": "e:a", "knows": [{"@id": "e:b", "e:age": 3}, {"@list": [{"@id": "e:c"}, 4]}], "e:n": null}]'
    assert list(jsonld.parse(text)) == [("http://e/b", "http://e/age", "3"), ("http://e/a", "http://e/knows", "http://e/b"), ("http://e/a", "http://e/knows", "http://e/c"), ("http://e/a", "http://e/knows", "4")]
    assert list(jsonld.parse("no json")) == list(jsonld.parse("3")) == []
