"""Files as tables: recursive listing, types, ids, hashes, incremental loads, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type of a file by its extension.
FILE_TYPES = {
    "f90": "fortran", "f95": "fortran", "f03": "fortran", "f08": "fortran", "f": "fortran", "for": "fortran", "md": "markdown", "txt": "text", "rst": "text", "pdf": "pdf", "docx": "document", "doc": "document", "html": "document",
    "py": "code", "c": "code", "cpp": "code", "js": "code", "ipynb": "jupyter", "json": "config", "yaml": "config", "yml": "config", "toml": "config",
}


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_type(path: Column | str) -> Column:
    """Type by extension; unknown ones are text."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FILE_TYPES.items() for x in kv)), extension(path)), F.lit("text"))


def document_id(path: Column | str) -> Column:
    return F.regexp_replace(path, r"[/\\: ]", "_")


def scan(spark: SparkSession, folder: str, *, extensions: tuple[str, ...] = ("f90", "f95"), exclude: tuple[str, ...] = (), project: str | None = None, version: str | None = None) -> DataFrame:
    """filepath, relative_path, depth, parent, size, modified, content of all files below a folder with these extensions whose path holds no excluded part."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = rows.filter(extension("path").isin(*extensions))
    for part in exclude:
        rows = rows.filter(~F.contains("path", F.lit(part)))
    relative = F.regexp_replace("path", r"^(?:file:)?/*" + folder.strip("/").replace(".", r"\.") + "/*", "")
    return rows.select(
        F.col("path").alias("filepath"), relative.alias("relative_path"), (F.size(F.split(relative, "/")) - 1).alias("depth"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), F.lit(project or "Unknown").alias("project"), F.lit(version or "").alias("version"), "content",
    )


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("document_id", document_id("filepath")).withColumn("file_type", file_type("filepath")).withColumn("file_hash", F.md5("content"))


def changed(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files that the catalog does not have with this hash."""
    return files.join(catalog.select("document_id", "file_hash"), ["document_id", "file_hash"], "left_anti")


def upsert(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """The catalog with new or changed documents in place of their old rows."""
    return catalog.join(new.select("document_id"), "document_id", "left_anti").unionByName(new)


def remove(tables: dict[str, DataFrame], document: str) -> dict[str, DataFrame]:
    """All tables without one document."""
    return {name: rows.filter(F.col("document_id") != document) for name, rows in tables.items()}


def write_table(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def export_turtle(axioms: DataFrame) -> DataFrame:
    """One line of Turtle for each axiom, to be written as text."""
    predicate = F.when(F.col("type") == "subsumption", "rdfs:subClassOf").when(F.col("type").isin("domain", "range"), F.concat(F.lit("rdfs:"), "type")).otherwise(F.concat(F.lit("ex:"), "type"))
    return axioms.select(F.format_string("<%s> %s <%s> .", "source", predicate, "target").alias("value"))


def entity_triples(entities: DataFrame) -> DataFrame:
    """s, p, o: type, name, lines and file of each entity."""
    s = F.concat(F.lit("entity/"), F.col("entity_id").cast("string"))
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for p, c in (("rdf:type", "etype"), ("hasName", "name"), ("lineBegin", "start_line"), ("lineEnd", "end_line"), ("filePath", "file"))))
    return entities.select(s.alias("s"), F.inline(pairs))
