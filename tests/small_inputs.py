"""Small inputs with known results, written for the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIXTURES: dict[str, tuple[str, list[tuple]]] = {
    "entities": (
        "entity_id int, name string, etype string, file string, start_line int, end_line int, confidence double, is_complete boolean, is_grouped boolean, signature string",
        [
            (1, "grid_mod", "module", "grid.f90", 1, 60, 1.0, True, False, ""),
            (2, "build_grid", "subroutine", "grid.f90", 10, 30, 1.0, True, True, "subroutine build_grid(n)"),
            (3, "cell_area", "function", "grid.f90", 32, 50, 0.9, True, False, "function cell_area(i)"),
            (4, "solver_mod", "module", "solver.f90", 1, 90, 1.0, True, False, ""),
            (5, "run_solver", "subroutine", "solver.f90", 5, 70, 0.9, False, True, "subroutine run_solver(tol)"),
            (6, "residual_norm", "function", "solver.f90", 40, 60, 0.7, True, False, ""),
            (7, "main_driver", "program", "main.f90", 1, 20, 1.0, True, False, ""),
        ],
    ),
    "uses": ("src_id int, dst_name string, line int", [(1, "solver_mod", 3), (4, "grid_mod", 2), (7, "grid_mod", 2), (7, "solver_mod", 3)]),
    "calls": ("src_id int, dst_name string, line int", [(7, "BUILD_GRID", 8), (7, "run_solver", 9), (5, "residual_norm", 45), (5, "cell_area", 50), (2, "cell_area", 20), (6, "sqrt", 44), (5, "missing_proc", 52)]),
    "entity_concepts": ("entity_id int, label string, confidence double, category string", [(1, "grid", 0.9, "structure"), (2, "grid", 0.8, "structure"), (2, "mesh", 0.6, "structure"), (3, "grid", 0.7, "structure"), (3, "area", 0.5, "math"), (4, "solver", 0.9, "math"), (5, "solver", 0.8, "math"), (5, "iteration", 0.7, "math"), (6, "norm", 0.9, "math"), (6, "solver", 0.6, "math")]),
    "axioms": (
        "type string, source string, target string",
        [("subsumption", f"ex#{a}", f"ex#{b}") for a, b in (("B", "A"), ("C", "B"), ("D", "B"), ("E", "A"), ("E", "C"), ("F", "F2"), ("F2", "F"))] + [("semantic_equivalent", "ex#C", "ex#E"), ("semantic_opposite", "ex#D", "ex#E")],
    ),
    "chunk_concepts": ("chunk_id int, uri string, label string, confidence double", [(1, "ex#C", "c", 0.9), (1, "ex#D", "d", 0.5), (2, "ex#E", "e", 0.6)]),
    "query_concepts": ("uri string, label string, confidence double", [("ex#C", "c", 0.8)]),
    "triples_detected": ("sub string, rel string, obj string", [("Ann Lee", "bornIn", "Oslo"), ("Ann", "worksFor", "Acme"), ("Bob", "bornIn", "Rome")]),
    "triples_gold": ("sub string, rel string, obj string", [("ann_lee", "bornin", "oslo"), ("Ann", "worksFor", "Acme Corp (US)"), ("Cid", "bornIn", "Rome")]),
    "relation_edges": ("s string, o string", [("a", "b"), ("b", "c"), ("c", "d")]),
    "notes": ("doc_id int, text string", [(1, '# Alpha\nIntro one. Intro two.\n## Beta\n- item\n- item two\n### Gamma\nSee [7] and https://example.org/x now.\n## Delta\nShe said "short phrase" here.\nSUMMARY\n1.2. Numbered\nEnd.')]),
    "code": ("file string, text string", [("demo.f90", "subroutine demo(x)\n  character(4) :: s = 'a!b' ! note\n!$omp parallel\n  call step_one(x) ! call fake(x)\n  y = step_two(x) + step_three(x)\nend subroutine demo")]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = FIXTURES[name]
    return spark.createDataFrame(rows, schema)
