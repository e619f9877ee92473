"""Contexts of entities and queries: what a query names, which chunks define it, and what surrounds an entity."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import vectors as v
from strata.operators import classes, overlap
from strata.operators import graph as g
from strata.operators import ontology as o
from strata.operators.containment import contained_names
from strata.storage import cut

#: Order and specificity of entity types, words of names and what they stand for, keyword families of code.
PRIORITY = {"module": 1, "program": 1, "type_definition": 2, "parameter": 3, "interface": 4, "subroutine": 5, "function": 5, "block": 6, "internal_function": 7, "variable_declaration": 8, "variable": 8}
ALWAYS_SHOWN = ("module", "program", "subroutine", "function", "type_definition", "interface", "block", "parameter")
SPECIFICITY = {"module": 1, "program": 1, "type_definition": 2, "interface": 3, "subroutine": 4, "function": 4, "variable_declaration": 5, "parameter": 5}
NAME_PARTS = {
    "initialization": ("init", "initialize", "setup"),
    "calculation": ("calc", "compute", "evaluate"),
    "solver": ("solve", "solver", "solution"),
    "output": ("output", "write", "print", "save"),
    "input": ("input", "read", "load"),
    "utility": ("util", "helper", "tool"),
    "test": ("test", "check", "verify"),
    "main": ("main", "driver", "control"),
}
TYPE_RULES = ((("module",), "constants", "physical_constants", 0.9, "data"), (("module",), "util", "utility_functions", 0.8, "functional"), (("subroutine", "function"), "force", "force_calculation", 0.8, "physics"), (("subroutine", "function"), "energy", "energy_calculation", 0.8, "physics"))
CODE_FAMILIES = {
    "loops": ("do ", "while", "for"),
    "conditionals": ("if ", "select case", "where"),
    "math_operations": ("sqrt", "sin", "cos", "exp", "log"),
    "array_operations": ("sum(", "product(", "maxval", "minval"),
    "io_operations": ("read", "write", "print", "open", "close"),
}
CODE_WORDS = ("function", "subroutine", "module", "program", "call", "use", "interface", "type", ".f90", ".f95", "fortran")
TEXT_WORDS = ("section", "paragraphe", "chapitre", "document", "résumé", "introduction", "conclusion")
DOI = r"10\.\d{4,9}/[A-Za-z0-9_\-.;()/:]+"


def _lookup(table: dict[str, int], key: Column, other: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(other))


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def by_priority(fan: DataFrame, *, internal: bool = False, variables: bool = False) -> DataFrame:
    """Entities of the shown types with their priority, in order: by type, then most uses, most calls, name, id."""
    shown = [*ALWAYS_SHOWN, *(["internal_function"] if internal else []), *(["variable_declaration", "variable"] if variables else [])]
    return fan.filter(F.col("etype").isin(*shown)).withColumn("priority", _lookup(PRIORITY, F.col("etype"), 999)).orderBy("priority", F.desc("deps"), F.desc("outgoing"), "name", "entity_id")


def main_entity(e: DataFrame) -> DataFrame:
    """file, name: module, else program, subroutine, function, else the first by id."""
    order = F.when(F.col("etype") == "module", 1).when(F.col("etype") == "program", 2).when(F.col("etype") == "subroutine", 3).when(F.col("etype") == "function", 4).otherwise(999)
    return e.groupBy("file").agg(F.min_by("name", F.struct(order, "entity_id")).alias("name"))


def similar_names(names: DataFrame, wanted: list[str], key: str, name: str, k: int = 5) -> DataFrame:
    """wanted, name, rank: names that hold a wanted one or stand in it, in any case, the first k by key. wanted is a short list."""
    rows = names.select(key, name, F.explode(F.array(*map(F.lit, wanted))).alias("wanted"))
    near = rows.filter(F.contains(F.lower(name), F.lower("wanted")) | F.contains(F.lower("wanted"), F.lower(name)))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("wanted").orderBy(key)).cast("bigint")).filter(F.col("rank") <= k).select("wanted", F.col(name).alias("name"), "rank")


def sequence_similarity(a: str, b: str) -> Column:
    """Ratio of matching blocks of two strings (2 * matched / total length); null counts as empty. Whole texts, one pair a row."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def name_concepts(e: DataFrame) -> DataFrame:
    """entity_id, label, keywords: functions that parts of a name suggest."""
    low = F.lower("name")
    found = [F.struct(F.lit(label).alias("label"), F.filter(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower("name"), p)).alias("keywords")) for label, parts in NAME_PARTS.items()]
    return e.filter(low.isNotNull()).select("entity_id", F.explode(F.array(*found)).alias("_c")).filter(F.size("_c.keywords") > 0).select("entity_id", F.col("_c.label").alias("label"), F.array_join("_c.keywords", ",").alias("keywords"))


def type_concepts(e: DataFrame) -> DataFrame:
    """entity_id, label, confidence, category: what type and name together suggest; the first rule of a type counts."""
    case = lambda value: reduce(lambda w, r: w.when(F.col("etype").isin(*r[0]) & F.contains(F.lower("name"), F.lit(r[1])), F.lit(value(r))), TYPE_RULES, F)
    return e.select("entity_id", case(lambda r: r[2]).alias("label"), case(lambda r: r[3]).alias("confidence"), case(lambda r: r[4]).alias("category")).filter("label is not null")


def detected_concepts(e: DataFrame, others: DataFrame) -> DataFrame:
    """entity_id, label, confidence: others (patterns, ontology) with those of names (0.8); a label keeps its best confidence."""
    named = name_concepts(e).select("entity_id", "label", F.lit(0.8).alias("confidence"))
    return others.select("entity_id", "label", "confidence").unionByName(named).groupBy("entity_id", "label").agg(F.max("confidence").alias("confidence"))


def common_patterns(a: Column, b: Column) -> Column:
    """Keyword families that both codes have, in order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(_any_of(F.lower(a), words) & _any_of(F.lower(b), words), F.lit(name)) for name, words in CODE_FAMILIES.items()))), ",")


def optimisations(code: Column) -> Column:
    """Array of hints: loops without directives, allocations, calls inside loops."""
    loop = code.rlike(r"(?is)do\s+\w+\s*=.*\n.*?\n\s*end\s*do") & ~code.rlike(r"!\$OMP|!\$ACC|!DIR\$")
    rules = ((loop, "vectorization_opportunity"), (code.rlike(r"(?i)allocate\s*\([^)]+\)"), "memory_optimization_opportunity"), (code.rlike(r"(?is)do\s+.*?call\s+\w+.*?end\s*do"), "function_inlining_opportunity"))
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in rules)))


def decision_tag(labels: Column, rules: list[tuple[str, str]], other: str = "general") -> Column:
    """Tag of the first rule whose label is in the array."""
    return F.coalesce(*(F.when(F.array_contains(labels, label), F.lit(tag)) for label, tag in rules), F.lit(other))


def relevant_lines(rows: DataFrame, key: str, text: str, patterns: list[str], width: int = 80, comment: str = "!") -> DataFrame:
    """key, line: lines that hold a pattern in any case and are no comment, as ``L<n>: <line>``, cut to ``width``."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("_n", "_l")).withColumn("_l", F.trim("_l"))
    hit = lines.filter((F.col("_l") != "") & ~F.startswith("_l", F.lit(comment)) & _any_of(F.lower("_l"), tuple(p.lower() for p in patterns)))
    short = F.when(F.length("_l") > width, F.concat(F.substring("_l", 1, width - 3), F.lit("..."))).otherwise(F.col("_l"))
    return hit.select(key, F.concat(F.lit("L"), (F.col("_n") + 1).cast("string"), F.lit(": "), short).alias("line"))


def mentions(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, target, level: entity names (name, etype, is_internal) that stand in a query, and its DOI at level 5.

    Names stand in automata, block by block; queries stream past them.
    """
    level = F.when(F.col("is_internal"), 5).otherwise(_lookup(SPECIFICITY, F.col("etype"), 3))
    found = contained_names(queries, names, text_id="query_id", text="query").select(F.col("text_id").alias("query_id"), F.col("name").alias("target"))
    named = found.join(names.select(F.lower("name").alias("target"), level.alias("level")), "target").select("query_id", "target", "level")
    cited = queries.select("query_id", F.lower(F.regexp_extract("query", f"(?i){DOI}", 0)).alias("target"), F.lit(5).alias("level")).filter("target != ''")
    return named.unionByName(cited).groupBy("query_id", "target").agg(F.max("level").alias("level"))


def filter_by_targets(chunks: DataFrame, targets: DataFrame, *, wide: int = 20, least: int = 5) -> DataFrame:
    """query_id, chunk_id, how of ranked chunks(query_id, chunk_id, rank, name, text, part_of) that concern a query's targets.

    'direct': the text defines a target or the name is one or ends with ``_target``; 'part': other chunks of the same part_of;
    only for queries without such, 'text': chunks among the ``wide`` first that hold a target; only without those, 'top': the ``least`` first.
    """
    pair = chunks.join(targets.select("query_id", F.lower("target").alias("target")), "query_id")
    low, name = (F.lower(F.coalesce(x, F.lit(""))) for x in ("text", "name"))
    defines = reduce(lambda a, b: a | b, (F.contains(low, F.concat(F.lit(w + " "), "target")) for w in ("function", "subroutine")))
    flags = pair.groupBy("query_id", "chunk_id", "rank", "part_of").agg(F.max(defines | (name == F.col("target")) | F.endswith(name, F.concat(F.lit("_"), "target"))).alias("direct"), F.max(F.contains(low, F.col("target"))).alias("holds"))
    by_query, by_part = Window.partitionBy("query_id"), Window.partitionBy("query_id", "part_of")
    flags = flags.withColumn("part", F.col("part_of").isNotNull() & F.max("direct").over(by_part)).withColumn("any_direct", F.max("direct").over(by_query)).withColumn("any_text", F.max(F.col("holds") & (F.col("rank") <= wide)).over(by_query))
    how = F.when(F.col("direct"), "direct").when(F.col("part"), "part").when(~F.col("any_direct") & F.col("holds") & (F.col("rank") <= wide), "text").when(~F.col("any_direct") & ~F.col("any_text") & (F.col("rank") <= least), "top")
    return flags.select("query_id", "chunk_id", how.alias("how")).filter("how is not null")


def internal_function(text: Column, name: str, most: int = 50, before: int = 10) -> Column:
    """The lines of a function inside a chunk, to its ``end function`` or ``most`` lines, after up to ``before`` lines of the parent; null if there is none."""
    opening = rf"(?i)(?:pure\s+|elemental\s+|recursive\s+)*(?:real|integer|logical|character|type)?\s*(?:\([^)]*\))?\s*function\s+{name}"

    def found(lines: Column, at: Column) -> Column:
        rest = F.slice(lines, at + 1, F.size(lines))
        end = F.array_position(F.transform(rest, lambda x: x.rlike(r"(?i)^\s*end\s+function")), True).cast("int")
        body = v.let(end, lambda e: F.slice(lines, at, F.when(e > 0, e + 1).otherwise(most + 1)))
        first = F.greatest(at - before, F.lit(1))
        lead = F.filter(F.slice(lines, first, at - first), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("!")))
        none = F.array().cast("array<string>")
        head = v.let(lead, lambda x: F.when(F.size(x) > 0, F.concat(F.array(F.lit("    ! ... [Context from parent function] ...")), x, F.array(F.lit("")))).otherwise(none))
        return F.when(at > 0, F.array_join(F.concat(head, body), "\n"))

    # lines and places are computed once: each is named several times
    return v.let(F.split(text, "\n"), lambda lines: v.let(F.array_position(F.transform(lines, lambda x: x.rlike(opening)), True).cast("int"), lambda at: found(lines, at)))


def _children(e: DataFrame) -> DataFrame:
    return g.parents(e).groupBy(F.col("parent_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("children"))


def module_statistics(fan: DataFrame) -> DataFrame:
    """One row: modules, mean uses, mean children, and the modules without uses."""
    m = fan.filter("etype = 'module'").join(_children(fan), "entity_id", "left").na.fill(0, ["children"])
    return m.agg(F.count(F.lit(1)).alias("n_modules"), F.coalesce(F.avg("deps"), F.lit(0.0)).alias("mean_deps"), F.coalesce(F.avg("children"), F.lit(0.0)).alias("mean_children"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("deps") == 0, F.col("name")))), ",").alias("independent"))


def related_modules(e: DataFrame, concepts: DataFrame, k: int = 8, least: float = 0.2) -> DataFrame:
    """entity_id, module, similarity, rank: modules whose concepts overlap with an entity's by more than ``least``; pairs come from overlap.candidates."""
    modules = e.filter("etype = 'module'").select(F.col("entity_id").alias("b"), F.col("name").alias("module"))
    sets = cut(g.label_sets(concepts))
    found = overlap.candidates(sets, k, partners=sets.join(modules.select(F.col("b").alias("id")), "id", "left_semi"), least=least)
    rows = overlap.overlaps(found, sets).join(modules, "b").filter(F.col("overlap") > least)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("overlap"), "b")).cast("bigint")).filter(F.col("rank") <= k).select(F.col("a").alias("entity_id"), "module", F.col("overlap").alias("similarity"), "rank")


def context_levels(fan: DataFrame) -> DataFrame:
    """entity_id, deps, outgoing, children, complexity (by each count), local (by their sum)."""
    f = fan.join(_children(fan), "entity_id", "left").na.fill(0, ["children"])
    total = F.col("deps") + F.col("outgoing") + F.col("children")
    level = F.when((F.col("deps") > 5) | (F.col("outgoing") > 8) | (F.col("children") > 5), "high").when((F.col("deps") > 2) | (F.col("outgoing") > 4) | (F.col("children") > 2), "medium").otherwise("low")
    return f.select("entity_id", "name", "deps", "outgoing", "children", level.alias("complexity"), F.when(total > 10, "high").when(total > 5, "medium").otherwise("low").alias("local"))


def insights(levels: DataFrame, impact: DataFrame, patterns: DataFrame) -> DataFrame:
    """entity_id, insights: what local level, risk and patterns(entity_id, n) say together, joined by '; '."""
    rows = levels.join(impact.select("entity_id", "risk"), "entity_id", "left").join(patterns.select("entity_id", F.col("n").alias("_p")), "entity_id", "left").na.fill(0, ["_p"])
    said = (((F.col("local") == "high") & (F.col("risk") == "high"), "critical complexity"), ((F.col("local") == "low") & (F.col("risk") == "high"), "hidden importance"), ((F.col("_p") > 0) & (F.col("outgoing") > 5), "complex algorithmic implementation"))
    return rows.select("entity_id", F.array_join(F.array_compact(F.array(*(F.when(test, F.lit(text)) for test, text in said))), "; ").alias("insights"))


def local_context(e: DataFrame, uses: DataFrame, calls: DataFrame) -> DataFrame:
    """entity_id, definition, uses, calls, parent, children: names in order, joined by commas."""
    listed = lambda refs, n: refs.groupBy(F.col("src_id").alias("entity_id")).agg(F.array_join(F.array_sort(F.collect_set(F.lower("dst_name"))), ",").alias(n))
    p = g.parents(e).join(e.select(F.col("entity_id").alias("parent_id"), F.col("name").alias("parent")), "parent_id").select("entity_id", "parent", "parent_id")
    children = g.parents(e).join(e.select("entity_id", "name"), "entity_id").groupBy(F.col("parent_id").alias("entity_id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("children"))
    base = e.select("entity_id", F.concat_ws(" ", "etype", "name", F.concat(F.lit("("), "file", F.lit(":"), F.col("start_line").cast("string"), F.lit(")"))).alias("definition"))
    out = reduce(lambda a, b: a.join(b, "entity_id", "left"), [listed(uses, "uses"), listed(calls, "calls"), p.drop("parent_id"), children], base)
    return out.na.fill("", ["uses", "calls", "parent", "children"])


def within_budget(sections: DataFrame, key: str, order: str, text: str, tokens: int) -> DataFrame:
    """Sections of each key in order while their estimated tokens (a quarter of the characters, rounded up) fit the budget together."""
    spent = F.sum(F.ceil(F.length(text) / 4)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sections.withColumn("spent", spent.cast("bigint")).filter(F.col("spent") <= tokens)


def content_statistics(chunks: DataFrame) -> DataFrame:
    """One row of counts of chunks(content_type, level, conceptual): all, code, text and conceptual ones, and the number of types."""
    code = F.col("content_type") == "fortran"
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.count_if(code).alias("code"), F.count_if(~code & F.col("level").isin("document", "section", "paragraph")).alias("texts"), F.count_if("conceptual").alias("conceptual"), F.countDistinct("content_type").alias("types"))


def best_mode(queries: DataFrame, statistics: DataFrame) -> DataFrame:
    """query_id, mode: code or text search if the query's words lean to it and over 0.3 of the chunks are such, else unified. statistics is one row."""
    score = lambda words: reduce(lambda a, b: a + b, (F.contains(F.lower("query"), F.lit(w)).cast("int") for w in words))
    rows = queries.crossJoin(statistics).withColumn("_c", score(CODE_WORDS)).withColumn("_t", score(TEXT_WORDS)).withColumn("_n", F.greatest("n", F.lit(1)))
    return rows.select("query_id", F.when((F.col("_c") > F.col("_t")) & (F.col("code") / F.col("_n") > 0.3), "fortran").when((F.col("_t") > F.col("_c")) & (F.col("texts") / F.col("_n") > 0.3), "text").otherwise("unified").alias("mode"))


def merge_similar(found: DataFrame, group: str, k: int = 8, reasons: int = 4) -> DataFrame:
    """group, name, similarity, reasons, method, rank of found(group, name, similarity, method, reason): one row a name with its best similarity."""
    rows = found.groupBy(group, "name").agg(F.max("similarity").alias("similarity"), F.array_join(F.slice(F.array_sort(F.collect_set("reason")), 1, reasons), ",").alias("reasons"), F.when(F.countDistinct("method") > 1, "hybrid").otherwise(F.min("method")).alias("method"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("similarity"), "name")).cast("bigint")).filter(F.col("rank") <= k)


def focus(edges: DataFrame, start: int, hops: int) -> DataFrame:
    """node, level: what is within ``hops`` links of an entity, whichever way they point."""
    both = edges.select("src_id", "dst_id").union(edges.select("dst_id", "src_id")).toDF("src_id", "dst_id").withColumn("kind", F.lit("uses"))
    return g.subgraph(both, start, hops, 1 << 30)


def search_space(inherited: DataFrame, axioms: DataFrame) -> DataFrame:
    """context, uri: inherited(context, uri) concepts, their neighbours, and those of the neighbours.

    Contexts that inherit the same concepts have one space, which is found once for their class; rows leave the task that makes them.
    """
    near = o.neighbors(axioms)
    own = cut(inherited.select("context", "uri").distinct())
    known = cut(classes.of_sets(own, "context", "uri"))
    first = known.groupBy("class").agg(F.min("context").alias("context"))
    start = own.join(first, own["context"].eqNullSafe(first["context"])).select("class", "uri")
    one = start.join(near, "uri").select("class", F.col("neighbor").alias("uri")).distinct()
    two = one.join(near, "uri").select("class", F.col("neighbor").alias("uri"))
    space = cut(start.unionByName(one).unionByName(two).distinct())
    return classes.crossed(known, space, "class", "context", "uri")


def explicit_hierarchy(axioms: DataFrame, links: DataFrame) -> DataFrame:
    """axioms with the subsumptions of links(child, parent) that are missing, each row once."""
    added = links.filter("child != parent").select(F.lit("subsumption").alias("type"), F.col("child").alias("source"), F.col("parent").alias("target"))
    return axioms.unionByName(added).distinct()


def concept_text(semantics: DataFrame, axioms: DataFrame) -> DataFrame:
    """uri, text: label, description after a colon, labels of parents in brackets."""
    up = o.parents(axioms).join(semantics.select(F.col("uri").alias("parent"), F.col("label").alias("_l")), "parent").groupBy(F.col("child").alias("uri")).agg(F.array_join(F.array_sort(F.collect_set("_l")), ", ").alias("_up"))
    text = F.concat("label", F.when(F.col("description") != "", F.concat(F.lit(": "), "description")).otherwise(""), F.when(F.col("_up").isNotNull(), F.concat(F.lit(" (type de: "), "_up", F.lit(")"))).otherwise(""))
    return semantics.join(up, "uri", "left").select("uri", text.alias("text"))


def ontology_report(axioms: DataFrame) -> DataFrame:
    """One row: concepts, roots, deepest level, subsumptions, other axioms."""
    levels = o.concept_levels(axioms).agg(F.count_if(F.col("level") == 1).alias("roots"), F.max("level").alias("deepest"))
    counts = axioms.agg(F.count_if(F.col("type") == "subsumption").alias("subsumptions"), F.count_if(F.col("type") != "subsumption").alias("others"))
    return o.concepts(axioms).agg(F.count(F.lit(1)).alias("concepts")).crossJoin(levels).crossJoin(counts)


def implied(edges: DataFrame, depth: int = 2) -> DataFrame:
    """s, o, score of pairs that chains of up to ``depth`` + 1 stated links imply: 0.8 to the power of the links."""
    far = o.closure(edges.select(F.col("s").alias("src"), F.col("o").alias("dst")), depth + 1)
    return far.filter("distance > 1 and start != node").select(F.col("start").alias("s"), F.col("node").alias("o"), F.pow(F.lit(0.8), F.col("distance")).alias("score"))
