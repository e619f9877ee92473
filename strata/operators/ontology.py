"""Ontology operators on one triple table axioms(type, source, target): levels, closures, neighbours, distances, compatibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators import classes, paths
from strata.storage import cut

#: Compatibility of related concepts by relation.
RELATION_SCORES = {"semantic_equivalent": 0.9, "semantic_similar": 0.7, "semantic_related": 0.5, "semantic_opposite": -0.5, "semantic_exclusive": -0.9}


def concepts(axioms: DataFrame) -> DataFrame:
    return axioms.filter("type in ('subsumption') or type like 'semantic_%'").select(F.explode(F.array("source", "target")).alias("uri")).distinct()


def parents(axioms: DataFrame) -> DataFrame:
    return axioms.filter("type = 'subsumption'").select(F.col("source").alias("child"), F.col("target").alias("parent")).distinct()


def load_axioms(triples: DataFrame) -> DataFrame:
    """axioms of triples(s, p, o): subclass links whose ends are both classes, domains and ranges of properties, other relations by name."""
    classes = triples.filter("p = 'rdf:type' and o in ('owl:Class', 'rdfs:Class')").select(F.col("s").alias("c")).distinct()
    properties = triples.filter("p = 'rdf:type' and o = 'owl:ObjectProperty'").select(F.col("s").alias("c")).distinct()
    sub = triples.filter("p = 'rdfs:subClassOf'").join(classes, F.col("s") == F.col("c"), "left_semi").join(classes, F.col("o") == F.col("c"), "left_semi")
    about = triples.filter("p in ('rdfs:domain', 'rdfs:range')").join(properties, F.col("s") == F.col("c"), "left_semi")
    return sub.select(F.lit("subsumption").alias("type"), F.col("s").alias("source"), F.col("o").alias("target")).unionByName(about.select(F.substring_index("p", ":", -1).alias("type"), F.col("s").alias("source"), F.col("o").alias("target")))


def concept_semantics(triples: DataFrame) -> DataFrame:
    """uri, label (preferred label, label, tail of the uri), description (definition, comment)."""
    classes = triples.filter("p = 'rdf:type' and o in ('owl:Class', 'rdfs:Class')").select("s").distinct()
    wide = triples.groupBy("s").agg(*(F.max(F.when(F.col("p") == p, F.col("o"))).alias(n) for p, n in (("skos:prefLabel", "pref"), ("rdfs:label", "label"), ("skos:definition", "definition"), ("rdfs:comment", "comment"))))
    tail = F.regexp_extract("s", r"([^#/:]*)$", 1)
    return classes.join(wide, "s").select(F.col("s").alias("uri"), F.coalesce("pref", "label", tail).alias("label"), F.coalesce("comment", "definition", F.lit("")).alias("description"))


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """start, node, distance: shortest distances over edges(src, dst), up to ``depth`` if it is given. For results that are pairs.

    A round joins the pairs at just the distance that is reached with all pairs, so distances double, a pair is made from few
    others, and a chain of n links takes log2(n) rounds. Each round is checkpointed; without a pair at that distance it is the
    last. Cycles end, as pairs that are known do not come again.
    """
    reach = cut(edges.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("distance")).distinct())
    far = 1
    while depth is None or far < depth:
        outer = reach.filter(F.col("distance") == far)
        if outer.isEmpty():
            break
        on = reach.select(F.col("start").alias("node"), F.col("node").alias("next"), F.col("distance").alias("more"))
        made = outer.join(on, "node").select("start", F.col("next").alias("node"), (F.col("distance") + F.col("more")).alias("distance"))
        if depth is not None:
            made = made.filter(F.col("distance") <= depth)
        new = made.groupBy("start", "node").agg(F.min("distance").alias("distance")).join(reach, ["start", "node"], "left_anti")
        reach, far = cut(reach.unionByName(new)), 2 * far
    return reach


def concept_levels(axioms: DataFrame) -> DataFrame:
    """1 for roots, else one more than the least level of a parent. Concepts of cycles that no root reaches are at level 3."""
    return paths.levels(parents(axioms)).select(F.col("node").alias("uri"), F.coalesce(F.col("level") + 1, F.lit(3)).cast("int").alias("level"))


def subconcepts(axioms: DataFrame) -> DataFrame:
    """ancestor, uri: every concept below another, itself left out."""
    up = parents(axioms)
    return closure(up.select(F.col("parent").alias("src"), F.col("child").alias("dst"))).filter("start != node").select(F.col("start").alias("ancestor"), F.col("node").alias("uri"))


def hierarchy_chains(axioms: DataFrame) -> DataFrame:
    """uri and the path from its root, over the first parent of each concept; in a cycle a path ends before it meets itself.

    A round puts the path of a path's top before it, so paths double.
    """
    first = parents(axioms).groupBy("child").agg(F.min("parent").alias("parent"))
    nodes = parents(axioms).select(F.explode(F.array("child", "parent")).alias("uri")).distinct()
    chain = nodes.join(first, F.col("uri") == F.col("child"), "left").select("uri", F.when(F.col("parent").isNull() | (F.col("parent") == F.col("uri")), F.array("uri")).otherwise(F.array("parent", "uri")).alias("path"), F.coalesce(F.col("parent") == F.col("uri"), F.lit(True)).alias("done"))
    while True:
        chain = cut(chain)
        if chain.filter("not done").isEmpty():
            return chain.select("uri", F.array_join("path", " > ").alias("chain"))
        above = chain.select(F.col("uri").alias("top"), F.col("path").alias("_above"), F.col("done").alias("_ended"))
        met = F.transform(F.reverse(F.slice("_above", F.lit(1), F.size("_above") - 1)), lambda x: F.array_contains("path", x))
        rows = chain.withColumn("top", F.col("path")[0]).join(above, "top").withColumn("_met", met)
        met = F.col("_met")
        new = F.when(F.col("done"), 0).when(F.array_contains(met, True), F.array_position(met, True) - 1).otherwise(F.size(met)).cast("int")
        chain = rows.select("uri", F.concat(F.slice("_above", F.size("_above") - new, new), "path").alias("path"), (F.col("done") | F.col("_ended") | F.array_contains(met, True)).alias("done"))


def validate(axioms: DataFrame, relations: DataFrame) -> DataFrame:
    """kind, uri: concepts that are their own ancestors; relations without domain or range."""
    up = parents(axioms)
    cycles = paths.on_cycles(up.select(F.col("child").alias("src"), F.col("parent").alias("dst"))).select(F.lit("cycle").alias("kind"), F.col("node").alias("uri"))

    def without(kind: str) -> DataFrame:
        return relations.join(axioms.filter(F.col("type") == kind).select(F.col("source").alias("uri")), "uri", "left_anti").select(F.lit(f"no_{kind}").alias("kind"), "uri")

    return reduce(DataFrame.unionByName, [cycles, without("domain"), without("range")])


def neighbors(axioms: DataFrame) -> DataFrame:
    """uri, neighbor: parents, children and partners in any axiom, both ways."""
    return axioms.select(F.col("source").alias("uri"), F.col("target").alias("neighbor")).unionByName(axioms.select(F.col("target").alias("uri"), F.col("source").alias("neighbor"))).filter("uri != neighbor").distinct()


def _classes(names: DataFrame, links: DataFrame, *items: str) -> tuple[DataFrame, DataFrame]:
    """(members: uri, class, space of names and whatever links start from; links between classes: a, b and the items but the first).

    links are distinct rows (uri, *items), the first item the other end, and no name is linked with itself; they go both ways. Names of one namespace with the
    same links are one class: what holds between two names then holds between all members of their classes.
    """
    links = cut(links)
    sets = classes.of_sets(links, "uri", *items)
    members = cut(names.join(sets, "uri", "full").select("uri", "space", F.concat_ws("/", F.coalesce("class", F.lit("0")), "space").alias("class")))
    first = members.groupBy(F.col("class").alias("a")).agg(F.min("uri").alias("uri"))
    ends = members.select(F.col("uri").alias(items[0]), F.col("class").alias("b"))
    return members, cut(links.join(first, "uri").join(ends, items[0]).select("a", "b", *items[1:]).distinct())


def _by_space(members: DataFrame) -> DataFrame:
    """a, b: classes of one namespace."""
    known = members.filter("space is not null").select("class", "space").distinct()
    return known.select(F.col("class").alias("a"), "space").join(known.select(F.col("class").alias("b"), "space"), "space").select("a", "b")


def _written_out(pairs: DataFrame, members: DataFrame, value: str) -> DataFrame:
    sides = ((members.select(F.col("class").alias(f"class_{k}"), F.col("uri").alias(k)), f"class_{k}", k) for k in "ab")
    return classes.members_of(pairs.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), value), *sides, value).filter("a != b")


def distances(axioms: DataFrame) -> DataFrame:
    """a, b, distance for pairs of concepts: 0 same, 1 neighbours, 2 a common neighbour, 3 one namespace; farther pairs (999) are left out.

    Found between classes of concepts with the same neighbours, then written out, so pairs of concepts are neither shuffled nor grouped.
    """
    names = concepts(axioms).filter("uri is not null").withColumn("space", F.regexp_extract("uri", r"^(.*[#/])[^#/]*$", 1))
    members, one = _classes(names, neighbors(axioms), "neighbor")
    two = one.alias("x").join(one.alias("y"), F.col("x.b") == F.col("y.b")).select(F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.lit(2).alias("d")).distinct()
    best = reduce(DataFrame.unionByName, [one.withColumn("d", F.lit(1)), two, _by_space(members).withColumn("d", F.lit(3))]).groupBy("a", "b").agg(F.min("d").alias("distance"))
    same = members.filter("space is not null").select(F.col("uri").alias("a"), F.col("uri").alias("b"), F.lit(0).alias("distance"))
    return _written_out(best, members, "distance").unionByName(same)


def compatibility(axioms: DataFrame) -> DataFrame:
    """a, b, score: 1 for the same, 0.8 parent and child, the relation's score (0.3 if it is not listed), 0.4 for one namespace.

    Found between classes of concepts with the same relations, as distances are.
    """
    up = parents(axioms)
    table = F.create_map(*(x for k, v in RELATION_SCORES.items() for x in (F.lit(k), F.lit(v))))
    hier = up.select(F.col("child").alias("a"), F.col("parent").alias("b"), F.lit(0.8).alias("score"), F.lit(1).alias("rank"))
    related = axioms.filter("type like 'semantic_%'").select(F.col("source").alias("a"), F.col("target").alias("b"), F.coalesce(F.element_at(table, F.col("type")), F.lit(0.3)).alias("score"), F.lit(2).alias("rank"))
    both = hier.unionByName(related)
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "score", "rank"))
    best = F.min_by(F.struct("rank", "score"), F.struct("rank", -F.col("score")))
    linked = cut(both.groupBy("a", "b").agg(best.alias("_s")).select("a", "b", "_s.rank", "_s.score"))
    names = concepts(axioms).filter("uri is not null").withColumn("space", F.regexp_extract("uri", r"^(.*[#/])[^#/]*$", 1))
    members, links = _classes(names, linked.filter("a != b").withColumnsRenamed({"a": "uri", "b": "other"}), "other", "rank", "score")
    flat = _by_space(members).select("a", "b", F.lit(3).alias("rank"), F.lit(0.4).alias("score"))
    pairs = links.unionByName(flat).groupBy("a", "b").agg(F.min_by("score", "rank").alias("score"))
    same = names.select(F.col("uri").alias("a"), F.col("uri").alias("b"), F.lit(1.0).alias("score"))
    return _written_out(pairs, members, "score").unionByName(same).unionByName(linked.filter("a is null or b is null").select("a", "b", "score"))


def domain_context_weights(found: DataFrame, axioms: DataFrame) -> DataFrame:
    """Weight of each namespace: confidence of its concepts, half of it for each parent's, 0.3 for each axiom partner's, normalised."""
    space = F.regexp_extract("uri", r"^(.*[#/])[^#/]*$", 1).alias("domain")
    own = found.select(space, F.col("confidence").alias("w"))
    up = found.join(parents(axioms), F.col("uri") == F.col("child")).select(F.col("parent").alias("uri"), "confidence").select(space, (F.col("confidence") * 0.5).alias("w"))
    partner = found.join(axioms.filter("type like 'semantic_%'"), F.col("uri") == F.col("source")).select(F.col("target").alias("uri"), "confidence").select(space, (F.col("confidence") * 0.3).alias("w"))
    sums = reduce(DataFrame.unionByName, [own, up, partner]).groupBy("domain").agg(F.sum("w").alias("w"))
    return sums.select("domain", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("weight"))


def domain_compatibility(axioms: DataFrame) -> DataFrame:
    """a, b, score for pairs of namespaces: 0.6 * share of hierarchic pairs + 0.4 * share of related ones - 0.2 if opposites occur."""
    space = lambda x: F.regexp_extract(x, r"^(.*[#/])[^#/]*$", 1)
    size = concepts(axioms).groupBy(space("uri").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    pairs = size.select(F.col("domain").alias("a"), F.col("n").alias("na")).join(size.select(F.col("domain").alias("b"), F.col("n").alias("nb")), F.col("a") <= F.col("b"))
    links = axioms.select(F.least(space("source"), space("target")).alias("a"), F.greatest(space("source"), space("target")).alias("b"), "type").groupBy("a", "b").agg(F.count_if(F.col("type") == "subsumption").alias("h"), F.count_if(F.col("type") != "subsumption").alias("r"), F.max((F.col("type") == "semantic_opposite").cast("int")).alias("o"))
    every = F.col("na") * F.col("nb")
    return pairs.join(links, ["a", "b"], "left").na.fill(0, ["h", "r", "o"]).select("a", "b", (0.6 * F.col("h") / every + 0.4 * F.col("r") / every - 0.2 * F.col("o")).alias("score"))


def resolve_ambiguities(found: DataFrame, context: DataFrame, group: str) -> DataFrame:
    """One concept per label: alone it gains 0.3 of its context score, among several the best by confidence + 0.7 of the context."""
    scored = found.join(context, "uri", "left").withColumn("context", F.coalesce("context", F.lit(0.0)))
    w = Window.partitionBy(group, F.lower("label"))
    many = scored.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("score", F.col("confidence") + F.when(F.col("_n") == 1, 0.3).otherwise(0.7) * F.col("context"))
    return many.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "uri"))).filter("_r = 1").drop("_n", "_r", "context")


def dominance(text: Column, label: Column, confidence: Column, generic: Column) -> Column:
    """confidence + 0.1 an occurrence (0.3 at most) + 0.1 within the first 200 characters - 0.1 for generic concepts."""
    low, name = F.lower(text), F.lower(label)
    times = F.when(F.length(name) > 0, (F.length(low) - F.length(F.replace(low, name))) / F.length(name)).otherwise(0)
    return dominance_of(times, F.contains(F.substring(low, 1, 200), name), confidence, generic)


def dominance_of(times: Column, early: Column, confidence: Column, generic: Column) -> Column:
    """Dominance of a concept whose occurrences are counted already."""
    return confidence + F.least(F.lit(0.3), 0.1 * times) + F.when(early, 0.1).otherwise(0.0) - F.when(generic, 0.1).otherwise(0.0)


def resolve_across_domains(refs: DataFrame, concepts_of: DataFrame, domains: DataFrame) -> DataFrame:
    """All columns of refs(uri, source) and resolved: the concept that a short name means.

    Whole addresses (http, https) mean themselves. Else it is the least uri of concepts_of(uri) that ends with
    ``<source>_<uri>``, else the least that ends with ``<domain>_<uri>`` for the first of domains(domain) by name that has one, else
    the name itself. No name is compared with all concepts: each underscore of a concept's uri parts a tail from a head whose
    end must be a domain's name, which a join on just the lengths that names have finds; tails then meet names by an equi-join,
    one row for each tail and domain. A null uri or source resolves as if no concept had it. Names and sources are few beside the
    concepts; nothing is broadcast but by Spark's own choice.
    """
    listed = domains.select("domain").filter("domain is not null").distinct()
    names = listed.withColumn("_known", F.lit(True)).unionByName(refs.select(F.col("source").alias("domain")).filter("source is not null").distinct().join(listed, "domain", "left_anti").withColumn("_known", F.lit(False)))
    names = cut(names)
    lengths = [r[0] for r in names.select(F.length("domain")).distinct().collect()]  # as many as names differ in length
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length("uri"), F.lit(1))), lambda i: F.substring(F.col("uri"), i, F.lit(1)) == "_")
    parts = concepts_of.select("uri").filter("uri is not null").distinct().select("uri", F.explode(at).alias("_at")).select("uri", "_at", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("_n")).filter("_at > _n")
    heads = parts.select("uri", F.expr("substring(uri, _at - _n, _n)").alias("domain"), F.expr("substring(uri, _at + 1)").alias("_tail"))
    ends = cut(heads.join(names, "domain").groupBy("_tail", "domain", "_known").agg(F.min("uri").alias("_uri")))
    own = ends.select(F.col("_tail").alias("_t1"), F.col("domain").alias("_d1"), F.col("_uri").alias("_own"))
    best = ends.filter("_known").groupBy(F.col("_tail").alias("_t2")).agg(F.min_by("_uri", "domain").alias("_best"))
    joined = refs.join(own, (F.col("uri") == F.col("_t1")) & (F.col("source") == F.col("_d1")), "left").join(best, F.col("uri") == F.col("_t2"), "left")
    whole = F.col("uri").startswith("http://") | F.col("uri").startswith("https://")
    return joined.select(*refs.columns, F.when(whole, F.col("uri")).otherwise(F.coalesce("_own", "_best", "uri")).alias("resolved"))
