"""What keeps queries in proportion to their input: batches instead of a frame a row, values computed once, rows dealt to tasks."""

import pyarrow as pa
from pyspark.sql import functions as F

from strata.operators import contexts, graph, paths
from strata.plans import registry
from strata.sources import code, rdfxml
from strata.storage import spread

SF = "/root/testdata/sf0.001"


def _batches(rows, n):
    """What mapInArrow's function gives for batches of n rows: the frames are only asked for it."""
    seen = []

    class Frame:
        def select(self, *_):
            return self

        selectExpr = select

        def mapInArrow(self, run, _):
            seen.extend(run(iter([pa.RecordBatch.from_pylist(rows[i : i + n]) for i in range(0, len(rows), n)])))

    return Frame(), seen


def test_rdfxml_gives_few_batches_for_many_files():
    text = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e.org/"><rdf:Description rdf:about="http://e.org/a"><e:p>1</e:p></rdf:Description></rdf:RDF>'
    files, seen = _batches([{"_x": text}] * 50 + [{"_x": None}], 51)
    rdfxml.triples(files)
    assert [len(b) for b in seen] == [50]


def test_parsed_files_go_on_in_bounded_batches(spark):
    text = "program a\n" + "call b\n" * 30_000
    rows = spark.createDataFrame([("f", text), ("g", None)], "file string, text string")
    assert code.entity_rows(rows).filter("kind = 'call'").count() == 30_000
    assert spark.createDataFrame([(x,) for x in range(4)], "x int").repartition(1).transform(spread, "x").rdd.getNumPartitions() == 4


def test_rdf_texts_and_sources_reach_several_tasks(spark):
    from strata.plans import documents, files

    assert documents._rdf_texts(spark, SF).rdd.getNumPartitions() > 1
    assert files._projects(spark, SF, "x").rdd.getNumPartitions() > 1


def test_axioms_parse_their_texts_once(spark):
    plan = registry.QUERIES["rdfxml_axioms"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan


def test_source_map_makes_no_frame_a_project(spark):
    rows = spark.createDataFrame([("p", "a", 'x\ninclude "b"'), ("p", "b", None), ("q", "a", "y")], "project string, file string, text string")
    out = code.source_map(rows)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("p", "a", 1, "a", 1, "x"), ("p", "a", 2, "b", 1, ""), ("p", "b", 1, "b", 1, ""), ("q", "a", 1, "a", 1, "y")]


def test_internal_function_looks_for_its_start_once(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("real function outer(x)\ncontains\n pure function inner(z)\n end function inner",), (None,), ("x",)], "t string")
    out = rows.select(contexts.internal_function(F.col("t"), "inner").alias("a"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("elemental") == 1
    assert [r.a is None for r in out.collect()] == [False, True, True]


def test_texts_are_read_once_for_many_words_and_links(spark):
    from pyspark.sql import functions as F

    from strata.operators import selection

    names = spark.range(150_000).select(F.concat(F.lit("en#w"), "id").alias("uri"), F.concat(F.lit("w"), "id").alias("label"))
    docs = spark.createDataFrame([(1, "w1 w7 w7")], "doc_id long, text string")
    found = selection.dominant_words(docs, names)
    links = names.select(F.lit("semantic_related").alias("type"), F.lit("en#w1").alias("source"), F.col("uri").alias("target"))
    near = selection.words_nearby(docs.select("doc_id", F.lit(0).alias("section"), "text"), found.filter("uri = 'en#w1'"), names, links)
    assert [x._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for x in (found, near)] == [1, 2]
    assert sorted((r.uri, r.path_distance) for r in near.collect()) == [("en#w1", 0), ("en#w7", 1)]


def test_top_k_of_a_task_is_exact_and_its_meetings_are_bounded():
    import numpy as np

    from strata.operators import retrieval

    g = np.random.default_rng(1)
    x, q, ids = np.round(g.normal(size=(500, 3)), 1), np.round(g.normal(size=(90, 3)), 1), g.permutation(500)
    sizes = []

    def measure(some, _, rows):
        sizes.append((len(q[some]), len(rows)))
        return np.round(np.einsum("ij,kj->ik", q[some], rows), 2)

    out = [t for part in retrieval.task_top_k(iter([(ids[:333], x[:333]), (ids[333:], x[333:])]), 90, measure, 7, meeting=(50, 20)) for t in zip(*part, strict=True)]
    score = np.round(np.einsum("ij,kj->ik", q, x), 2)
    wanted = [(i, ids[j], score[i, j]) for i in range(90) for j in np.lexsort((ids, -score[i]))[:7]]
    assert [t[:3] for t in out] == wanted and max(sizes) <= (20, 50) and max(n for _, n in sizes) <= 50


def test_equal_vectors_are_ties_by_id(spark):
    from strata.operators import retrieval

    rows = spark.createDataFrame([(i, [0.1 * (1 + j % 3) for j in range(7)]) for i in range(3000)], "vec_id long, embedding array<double>")
    out = retrieval.batch_top_k(rows, rows.filter("vec_id % 100 = 0"), 3, row_id="vec_id", query_id="vec_id").collect()
    assert {(r.rank, r.row_id) for r in out} == {(1, 0), (2, 1), (3, 2)}


def test_prediction_makes_no_rows_of_blocks(spark):
    from strata.operators import relations

    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, vec array<double>")
    maps = spark.createDataFrame([("r", [1.0, 0.0, 0.0, 1.0])], "relation string, matrix array<double>")
    out = relations.predict(e.filter("id = 0"), maps, e, 3, 0.1, size=2)
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.object, r.rank) for r in sorted(out.collect(), key=lambda r: r.rank)] == [(1, 1), (2, 2), (3, 3)]


def test_pieces_and_words_go_on_before_a_batch_is_done():
    from strata.functions import text
    from strata.operators import chunking

    class Frame:
        def __init__(self, rows):
            self.rows, self.out = rows, None

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.out = list(run(iter([pa.RecordBatch.from_pylist(self.rows)])))

    docs = Frame([{"_d": i, "_x": "x" * 300_000} for i in range(8)] + [{"_d": 9, "_x": None}])
    chunking.split_rows(docs, lambda x: [x] if x else [])
    assert [b.num_rows for b in docs.out] == [4, 4]
    words = Frame([{"id": i, "w": ["a", "b", "a"]} for i in range(600)])
    text.top_words(words, "id", "w", 10)
    assert [b.num_rows for b in words.out] == [512, 512, 176]


def test_neighbors_by_frequent_labels_make_no_pairs_and_equal_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from strata.operators import graph as g

    rnd = random.Random(3)
    e = spark.createDataFrame([(i, f"n{i}", rnd.choice("xyz"), rnd.choice("pq"), 3 * i % 40, 3 * i % 40 + rnd.randint(1, 30)) for i in range(60)], "entity_id int, name string, etype string, file string, start_line int, end_line int")
    labels = [f"c{j}" for j in range(8)]
    concepts = spark.createDataFrame([(i, x) for i in range(60) for x in (labels if i == 7 else rnd.sample(labels, rnd.randint(1, 3)))], "entity_id int, label string")
    uses = spark.createDataFrame([(rnd.randrange(60), rnd.choice(["U", "u", "v", "w", None])) for _ in range(70)], "src_id int, dst_name string")
    wanted = g.semantic_neighbors(e, concepts, uses, 3, most=10**6)
    found = g.semantic_neighbors(e, concepts, uses, 3, most=4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) != []
    overlap = g.concept_overlap(concepts)
    plain = g.shared_labels(concepts).join(concepts.groupBy("entity_id").agg(F.countDistinct("label").alias("n")).toDF("a", "na"), "a").join(concepts.groupBy("entity_id").agg(F.countDistinct("label").alias("n")).toDF("b", "nb"), "b")
    assert sorted(map(tuple, overlap.collect())) == sorted((r.a, r.b, r.shared / max(r.na, r.nb)) for r in plain.collect())
    # pairs are written out after the last shuffle, so no stage groups them
    tree = overlap._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in tree


def test_rounds_of_components_know_their_size(spark):
    # a checkpoint of joins is taken for their product, which the next round squares
    size = lambda out: out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    line = spark.range(2000).selectExpr("cast(id as int) as src_id", "cast(id + 1 as int) as dst_id").repartition(2)
    nodes = spark.range(2001).selectExpr("cast(id as int) as node")
    found = graph._roots(line.toDF("a", "b"))
    assert found.select("root").distinct().count() == 1 and size(found) < 1 << 30
    assert graph.weak_components(line, nodes).groupBy("component").count().collect() == [(0, 2001)]
    ends = paths._ends(line.toDF("node", "next"))
    assert size(ends) < 1 << 30
    assert size(paths._spread(line.toDF("a", "b").filter("a < 20"), nodes.select("node", F.col("node").alias("colour")))) < 1 << 30


def test_links_that_lead_round_take_few_rounds(spark, monkeypatch):
    rounds, keep = [], paths.stored
    monkeypatch.setattr(paths, "stored", lambda rows: rounds.append(1) or keep(rows))
    # two nodes back and forth and a long way to them: nothing more ends after the first round of doubling
    ring = spark.createDataFrame([(i, max(i - 1, 0) or 1) for i in range(200)], "node int, next int")
    assert {r.end for r in paths._ends(ring).collect()} == {None}
    assert len(rounds) <= 3
