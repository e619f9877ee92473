"""Queries on sources: file types and ids, incremental loads, pages to text, parsed code and notebooks, exports."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.plans.derived import frame, with_sql
from strata.plans.registry import query, table
from strata.sources import code, files, html
from strata.storage import spread

SOURCE = """module shapes
  use kinds, only: dp
  private
  public :: area
contains
  function area(r) result(a)
    real(dp) :: r, a
    a = r * r ! call fake(r)
    call log_it('call not_this')
  end function area
  subroutine hidden(n)
    do i = 1, n
      call area_twice(i)
    end do
  end subroutine hidden
end module shapes
program main
  use shapes
  call run()
end program main"""
NOTEBOOK = {"cells": [{"cell_type": "markdown", "source": ["# Title\n", "text"]}, {"cell_type": "code", "source": ["import math\n", "def half(x):\n", "    return math.floor(x / 2)\n", "half(4)"]}, {"cell_type": "code", "source": ["def broken(:"]}]}


def _projects(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """A file for each part: the text with the part's key behind each of the names."""
    key = F.col("p_partkey").cast("string")
    own = reduce(lambda x, n: F.replace(x, F.lit(n), F.concat(F.lit(n), key)), names, F.lit(text))
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("f"), key).alias("file"), own.alias("text"))


@query("SELECT page_id, CASE regexp_extract(url, '\\.([^./\\\\]+)$', 1) WHEN 'html' THEN 'document' WHEN 'json' THEN 'config' ELSE 'text' END AS file_type, regexp_replace(url, '[/\\\\: ]', '_', 'g') AS document_id FROM pages")
def file_type_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.file_type("url").alias("file_type"), files.document_id("url").alias("document_id"))


@query("""WITH c AS (SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0) SELECT d.doc_id::VARCHAR AS document_id, md5(text) AS file_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = d.doc_id AND c.h = md5(d.text))""")
def skip_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog lacks every fourth document and holds other contents of every third."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.md5("text").alias("file_hash"), "doc_id", "text")
    stored = d.filter("doc_id % 4 != 0").select("document_id", F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("file_hash"))
    return files.changed(d.select("document_id", "file_hash"), stored)


@query()
def scan_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet files of the input folder, listed as any files are."""
    rows = files.scan(spark, sf_dir, extensions=("parquet",), exclude=("lineitem", "orders"), project="tables")
    return rows.drop("content", "modified", "filepath")


@query("SELECT page_id, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS title FROM pages WHERE trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) <> ''")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.html_title("html").alias("title")).filter("title is not null")


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.html_to_text("html").alias("text"))


@query("""SELECT 'f' || p_partkey AS file, name || CASE WHEN name IN ('shapes', 'hidden') THEN p_partkey::VARCHAR ELSE '' END AS name, etype, start_line, end_line, parent || p_partkey AS parent, access FROM part, (VALUES ('shapes', 'module', 1, 16, NULL, 'public'), ('area', 'function', 6, 10, 'shapes', 'public'), ('hidden', 'subroutine', 11, 15, 'shapes', 'private'), ('main', 'program', 17, 20, NULL, 'public')) v(name, etype, start_line, end_line, parent, access)""")
def parse_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code.entity_rows(_projects(spark, sf_dir, SOURCE, "shapes", "hidden"))
    return rows.filter("kind = 'entity'").select("file", "name", "etype", "start_line", "end_line", "parent", "access")


@query("""SELECT 'f' || p_partkey AS file, kind, name || CASE WHEN name = 'shapes' THEN p_partkey::VARCHAR ELSE '' END AS name, parent || CASE WHEN parent IN ('shapes', 'hidden') THEN p_partkey::VARCHAR ELSE '' END AS parent, line FROM part, (VALUES ('use', 'kinds', 'shapes', 2), ('call', 'log_it', 'area', 9), ('call', 'area_twice', 'hidden', 13), ('use', 'shapes', 'main', 18), ('call', 'run', 'main', 19)) v(kind, name, parent, line)""")
def parse_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code.entity_rows(_projects(spark, sf_dir, SOURCE, "shapes", "hidden"))
    return rows.filter("kind != 'entity'").select("file", "kind", "name", "parent", "line")


@query("""SELECT 'f' || p_partkey AS file, kind, name || CASE WHEN name = 'half' THEN p_partkey::VARCHAR ELSE '' END AS name, etype, parent FROM part, (VALUES ('entity', 'cell_0', 'markdown_cell', NULL), ('entity', 'cell_1', 'code_cell', NULL), ('use', 'math', NULL, 'cell_1'), ('entity', 'half', 'function', 'cell_1'), ('call', 'floor', NULL, 'cell_1'), ('call', 'half', NULL, 'cell_1'), ('entity', 'cell_2', 'code_cell', NULL)) v(kind, name, etype, parent)""")
def parse_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code.entity_rows(_projects(spark, sf_dir, json.dumps(NOTEBOOK), "half"), "notebook")
    return rows.select("file", "kind", "name", "etype", "parent")


@query(with_sql("axioms") + " SELECT '<' || source || '> ' || CASE type WHEN 'subsumption' THEN 'rdfs:subClassOf' ELSE 'ex:' || type END || ' <' || target || '> .' AS value FROM axioms")
def ontology_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.export_turtle(frame(spark, "axioms", sf_dir))


@query(with_sql("entities") + ", t AS (SELECT 'entity/' || entity_id AS s, unnest(['rdf:type', 'hasName', 'lineBegin', 'lineEnd', 'filePath']) AS p, unnest([etype, name, start_line::VARCHAR, end_line::VARCHAR, file]) AS o FROM entities) SELECT s, p, o FROM t")
def entity_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.entity_triples(frame(spark, "entities", sf_dir))


@query("""SELECT 'p' || p_partkey AS project, file, flat_line, source, line, CASE text WHEN 'x' THEN 'x' || p_partkey ELSE text END AS text FROM part, (VALUES ('a.f90', 1, 'a.f90', 1, 'x'), ('a.f90', 2, 'b.inc', 1, 'y'), ('a.f90', 3, 'b.inc', 2, 'include ' || chr(39) || 'a.f90' || chr(39)), ('a.f90', 4, 'a.f90', 3, 'z'), ('b.inc', 1, 'b.inc', 1, 'y'), ('b.inc', 2, 'a.f90', 1, 'x'), ('b.inc', 3, 'a.f90', 2, 'include "b.inc"'), ('b.inc', 4, 'a.f90', 3, 'z')) v(file, flat_line, source, line, text)""")
def include_flattening(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    pair = F.array(F.struct(F.lit("a.f90").alias("file"), F.concat(F.lit("x"), key, F.lit('\ninclude "b.inc"\nz')).alias("text")), F.struct(F.lit("b.inc").alias("file"), F.lit("y\ninclude 'a.f90'").alias("text")))
    return code.source_map(spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("p"), key).alias("project"), F.inline(pair)))
