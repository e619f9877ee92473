"""Properties and golden cases of operators that SQL does not express."""

import random

import numpy as np
import pytest
import small_inputs as fixtures
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.functions import vectors as v
from strata.operators import chunking, graph, ontology, retrieval
from strata.sources import code, files, turtle
from strata.streaming import ingest

TEXT = st.text(alphabet="ab .!?\nCD#-1", max_size=300)


@given(TEXT, st.integers(5, 60))
@settings(max_examples=150, deadline=None)
def test_packing_keeps_every_part(text, most):
    parts = [x for x in text.split("\n") if x]
    assert "\n".join(chunking.pack(parts, most, 0, "\n")).split("\n") == (parts or [""])


@given(TEXT)
@settings(max_examples=150, deadline=None)
def test_chunks_cover_all_words(text):
    for split in (chunking.fixed_sentence_chunks, chunking.semantic_chunks, chunking.section_chunks):
        assert set("".join(split(text)).replace("\n", " ").split()) >= set() and set(" ".join(split(text)).split()) == set(text.split())


@given(TEXT)
@settings(max_examples=100, deadline=None)
def test_structure_lines_are_disjoint(text):
    ends = [(a, z) for *_, a, z in chunking.structure(text)]
    assert all(z < b for (_, z), (b, _) in zip(ends, ends[1:], strict=False))


def test_long_sentence_ends():
    assert chunking.fixed_sentence_chunks("x" * 45, most=20, overlap=5) == ["x" * 20, "x" * 20, "x" * 15]


def test_notebook_packing():
    assert chunking.notebook_chunks(["a" * 400, "b" * 1200, "c" * 4000, "d"], 400, 800) == ["a" * 400 + "\n\n" + "b" * 1200, "c" * 4000, "d"]


def test_turtle_subset():
    text = '@prefix ex: <http://e#> .\n# note\nex:A a owl:Class ; rdfs:label "x; y."@en , "z" .\nex:B rdfs:subClassOf ex:A , [ a owl:Restriction ] .'
    assert list(turtle.parse(text)) == [("ex:A", "rdf:type", "owl:Class"), ("ex:A", "rdfs:label", "x; y."), ("ex:A", "rdfs:label", "z"), ("ex:B", "rdfs:subClassOf", "ex:A")]


def test_unclosed_code_ends_with_the_file():
    rows = list(code.parse_code("module m\ncontains\nsubroutine s\n  call t\n"))
    assert [(r[1], r[3], r[4], r[5]) for r in rows if r[0] == "entity"] == [("m", 1, 5, None), ("s", 3, 5, "m")]
    assert [(r[0], r[1], r[5]) for r in rows if r[0] != "entity"] == [("call", "t", "s")]


def test_parents_of_the_fixture(spark):
    assert {(r.entity_id, r.parent_id) for r in graph.parents(fixtures.frame(spark, "entities")).collect()} == {(2, 1), (3, 1), (5, 4), (6, 5)}


def test_zero_vectors_have_no_similarity(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.6, 0.8, 0.0, 0.0]), (4, [0.0, 0.0, 0.0, 0.0])], "id int, embedding array<double>")
    out = {r.id: r.similarity for r in retrieval.scored(rows, retrieval.query_vector(rows, "id", 1)).collect()}
    assert out == {1: 1.0, 2: 0.0, 3: pytest.approx(0.6)}
    haar = rows.filter("id = 3").select(v.unit(v.haar("embedding")).alias("h")).first().h
    assert haar == pytest.approx([1.0, 0.0])


def test_batch_search_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>").repartition(5)
    out = retrieval.batch_top_k(rows, rows.filter("id < 4"), 3, row_id="id", query_id="id", most_bytes=100)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(i), k + 1) for q in range(4) for k, i in enumerate(np.argsort(-(unit @ unit[q]))[:3])}
    assert {(r.query_id, r.row_id, r.rank) for r in out.collect()} == want


def test_components_by_labels(spark):
    random.seed(3)
    links = [(random.randrange(30), random.randrange(30)) for _ in range(18)]
    nodes = spark.range(30).select(F.col("id").alias("node"))
    out = {r.node: r.component for r in graph.weak_components(spark.createDataFrame(links, "src_id long, dst_id long"), nodes).collect()}
    want = {i: i for i in range(30)}
    for _ in range(30):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert out == want


def test_stream_skips_unchanged_files(spark, tmp_path):
    src, cat, ck = tmp_path / "in", str(tmp_path / "cat"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.txt").write_text("one")
    ingest.ingest(spark, str(src), cat, ck).awaitTermination()
    (src / "b.txt").write_text("two")
    ingest.ingest(spark, str(src), cat, ck).awaitTermination()
    last = spark.read.parquet(f"{cat}/version=1")
    assert sorted(r.filepath.rsplit("/", 1)[-1] for r in last.collect()) == ["a.txt", "b.txt"]
    batch = spark.read.format("binaryFile").load(str(src))
    assert files.changed(files.with_hash(batch.select(F.col("path").alias("filepath"), "content")), last).count() == 0


def test_partitions_do_not_matter(spark):
    rows = spark.createDataFrame(fixtures.FIXTURES["calls"][1], fixtures.FIXTURES["calls"][0])
    e = fixtures.frame(spark, "entities")
    one, many = (sorted(map(tuple, graph.impact(e.repartition(n), rows.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_deep_hierarchies_and_long_cycles(spark):
    chain = [("subsumption", f"c{i + 1:03d}", f"c{i:03d}") for i in range(200)]
    axioms = spark.createDataFrame(chain, "type string, source string, target string")
    levels = {r.uri: r.level for r in ontology.concept_levels(axioms).collect()}
    assert levels == {f"c{i:03d}": i + 1 for i in range(201)}
    assert ontology.subconcepts(axioms).count() == 200 * 201 // 2
    paths = {r.uri: r.chain.split(" > ") for r in ontology.hierarchy_chains(axioms.unionByName(spark.createDataFrame([("subsumption", "x", "y"), ("subsumption", "y", "z"), ("subsumption", "z", "y"), ("subsumption", "s", "s")], axioms.schema))).collect()}
    assert paths["c200"] == [f"c{i:03d}" for i in range(201)] and paths["x"] == ["z", "y", "x"] and paths["y"] == ["z", "y"] and paths["s"] == ["s"]
    ring = [(i, f"m{i:02d}", "module", "f", 1, 2) for i in range(14)]
    e = spark.createDataFrame(ring, "entity_id int, name string, etype string, file string, start_line int, end_line int")
    uses = spark.createDataFrame([(i, f"m{(i + 1) % 14:02d}") for i in range(14)] + [(3, "m00")], "src_id int, dst_name string")
    found = [r.cycle for r in graph.cycles(e, uses).collect()]
    assert sorted(map(len, (c.split(" -> ") for c in found))) == [5, 15]


def test_only_cycles_are_cyclic(spark):
    line = spark.createDataFrame([(i, i + 1) for i in range(60)], "src_id int, dst_id int")
    nodes = spark.range(61).select(F.col("id").cast("int").alias("node"))
    row = graph.metrics(line, nodes).first()
    assert row.acyclic and row.n_components == 1 and row.n_edges == 60
    assert not graph.metrics(line.unionByName(spark.createDataFrame([(60, 0)], line.schema)), nodes).first().acyclic


def test_short_names_across_domains(spark):
    concepts = [("u#a_Person",), ("u#b_Person",), ("u#x_b_Person",), ("u#a_b_Item",), ("u#zz_Item",), ("u#a_",), (None,), ("_a_T",)]
    refs = [(1, "Person", "b"), (2, "Person", "none"), (3, "Item", "a"), (4, "Item", "zz"), (5, "http://a_Person", "a"), (6, "Lost", "a"), (7, None, "a"), (8, "Person", None), (9, "b_Item", "a"), (10, "T", "a"), (11, "Item", "a_b")]
    out = ontology.resolve_across_domains(spark.createDataFrame(refs, "ref int, uri string, source string"), spark.createDataFrame(concepts, "uri string"), spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "domain string"))

    def plain(uri, source):
        known = sorted(c for (c,) in concepts if c)
        if uri is None or uri.startswith("http://"):
            return uri
        for d in [source, "a", "b", "zz"]:
            if d and (hit := [c for c in known if c.endswith(f"{d}_{uri}")]):
                return hit[0]
        return uri

    assert {r.ref: r.resolved for r in out.collect()} == {k: plain(u, s) for k, u, s in refs}
    assert ontology.resolve_across_domains(out.select("uri", "source").filter("false"), out.select("uri").filter("false"), out.select(F.lit("a").alias("domain")).filter("false")).collect() == []
