"""Shortest paths, levels and strongly connected components of link tables, level by level on DataFrames; no table of all pairs.

State is one row a node (a row a source and node of a bounded batch of sources for betweenness), and every round is a
checkpoint or a stored table. Single links are followed by pointer doubling, so chains and trees of any depth take the logarithm of it in rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.storage import cut, stored


def betweenness(edges: DataFrame, nodes: DataFrame, *, most_states: int = 1 << 26) -> DataFrame:
    """node, centrality: share of shortest paths between other nodes that lead through the node, over directed edges(src, dst).

    Path counts go forward from level to level, dependencies come back the same way. Sources are dealt to batches by hash, so
    that a batch has about ``most_states`` rows of source and node at most; all nodes are sources. Values are divided by
    (n - 1)(n - 2); with fewer than three nodes they are 0. Repeated links and links of a node to itself do not count, and
    nodes without links have 0. Null ends are left out.
    """
    every = cut(nodes.select("node").filter("node is not null").distinct())
    links = cut(edges.select("src", "dst").filter("src != dst").distinct())
    n = every.count()
    batches = max(1, -(-n * n // most_states))
    parts = []
    for batch in range(batches):
        sources = every.filter(F.pmod(F.xxhash64("node"), F.lit(batches)) == batch)
        levels = [cut(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")))]
        seen = levels[0].select("s", "v")
        while True:
            ahead = levels[-1].join(links, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
            new = cut(ahead.join(seen, ["s", "v"], "left_anti"))
            if new.isEmpty():
                break
            levels.append(new)
            seen = cut(seen.unionByName(new.select("s", "v")))
        # dependencies of the last level are 0
        below = levels[-1].withColumn("share", F.lit(0.0))
        for level in levels[-2:0:-1]:
            back = below.select("s", F.col("v").alias("dst"), ((1 + F.col("share")) / F.col("paths")).alias("part")).join(links, "dst").groupBy("s", F.col("src").alias("v")).agg(F.sum("part").alias("part"))
            parts.append(below)
            below = cut(level.join(back, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share")))
        if len(levels) > 1:
            parts.append(below)
    of = every.select("node", F.lit(0.0).alias("share"))
    every_part = reduce(DataFrame.unionByName, [x.select(F.col("v").alias("node"), "share") for x in parts], of)
    scale = float((n - 1) * (n - 2)) if n > 2 else 1.0
    return every_part.groupBy("node").agg((F.sum("share") / scale).alias("centrality"))


def _ends(next_of: DataFrame) -> DataFrame:
    """next_of(node, next), next null where the way ends: node, end, steps. end is null for nodes whose way never ends.

    Doubling: in a round each node takes its next one's next. Once a round ends no further way, those left go round a cycle.
    """
    now = stored(next_of.select("node", F.coalesce("next", "node").alias("end"), F.col("next").isNotNull().cast("long").alias("steps"), F.col("next").isNull().alias("done")))
    left = now.filter("not done").count()
    before = None
    while left and left != before:
        on = now.select(F.col("node").alias("end"), F.col("end").alias("_e"), F.col("steps").alias("_s"), F.col("done").alias("_d"))
        now = stored(now.join(on, "end").select("node", F.col("_e").alias("end"), (F.col("steps") + F.col("_s")).alias("steps"), F.col("_d").alias("done")))
        left, before = now.filter("not done").count(), left
    return now.select("node", F.when(F.col("done"), F.col("end")).alias("end"), "steps")


def levels(edges: DataFrame) -> DataFrame:
    """node, level of edges(parent, child): 0 for roots, else one more than the least level of a parent; null where no root leads.

    Nodes with one parent find the next node above that has none or several by doubling; only the latter are relaxed, round by
    round from the roots, over links that are as long as the ways between them.
    """
    links = stored(edges.select("parent", "child").distinct())
    nodes = links.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    up = links.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"))
    above = _ends(nodes.join(up, "node", "left").select("node", F.when(F.col("n") == 1, F.col("parent")).alias("next")))
    roots = nodes.join(up, "node", "left_anti")
    several = links.join(up.filter("n > 1").select(F.col("node").alias("child")), "child", "left_semi")
    long = several.join(above.select(F.col("node").alias("parent"), "end", "steps"), "parent").filter("end is not null").groupBy(F.col("end").alias("src"), F.col("child").alias("dst")).agg((F.min("steps") + 1).alias("length"))
    long = stored(long)
    best = now = stored(roots.select("node", F.lit(0).cast("long").alias("level")))
    while not now.isEmpty():
        reached = now.join(long, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("level") + F.col("length")).alias("level"))
        old = best.select("node", F.col("level").alias("_old"))
        now = stored(reached.join(old, "node", "left").filter("_old is null or level < _old").drop("_old"))
        best = stored(best.unionByName(now).groupBy("node").agg(F.min("level").alias("level")))
    return above.join(best.select(F.col("node").alias("end"), "level"), "end", "left").select("node", (F.col("level") + F.col("steps")).alias("level"))


def peeled(links: DataFrame, *, trims: int = 6) -> DataFrame:
    """links(a, b) without nodes that cannot be in a cycle.

    A round drops nodes without a link in or out; after ``trims`` rounds that were not enough, nodes whose only way ends go at
    once, so that long chains and deep trees take a few rounds. A round that drops nothing is the last.
    """
    links = cut(links.select("a", "b").distinct())
    n = links.count()
    while n:
        for _ in range(trims):
            links = cut(links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            n, before = links.count(), n
            if n in (0, before):
                return links
        for a, b in (("a", "b"), ("b", "a")):
            out = links.groupBy(F.col(a).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min(b).alias("to"))
            nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            joined = cut(nodes.join(out, "node", "left"))
            stop = joined.filter("n is null").select(F.col("node").alias("end"))
            ends = _ends(joined.select("node", F.when(F.col("n") == 1, F.col("to")).alias("next")))
            gone = cut(ends.join(stop, "end", "left_semi").select("node"))
            links = cut(links.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"))
        n = links.count()
    return links


def cyclic(links: DataFrame, *, trims: int = 3) -> bool:
    """Whether links(a, b) hold a cycle.

    A round drops nodes without a link in or out. After ``trims`` of them, links to nodes with a single way on go at once to where
    the way parts, or are dropped where it ends. That keeps all cycles but leaves only nodes with several links out; then links
    are turned round, so that the next time the same is done for links in. A closed way, a link of a node to itself and a table
    in which every node has links in and out tell of a cycle, so its nodes are never looked for.
    """
    links = stored(links.select("a", "b").distinct())
    n = links.count()
    while n:
        for _ in range(trims):
            links = stored(links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            n, before = links.count(), n
            if n in (0, before):
                return n > 0
        out = links.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("to"))
        nodes = stored(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(out, "node", "left"))
        ends = _ends(nodes.select("node", F.when(F.col("n") == 1, F.col("to")).alias("next")))
        if not ends.filter("end is null").isEmpty():
            return True
        parting = stored(nodes.filter("n > 1").select("node"))
        on = ends.join(parting.toDF("end"), "end", "left_semi").select(F.col("node").alias("b"), "end")
        links = stored(links.join(parting.toDF("a"), "a", "left_semi").join(on, "b").select(F.col("end").alias("a"), F.col("a").alias("b")).distinct())
        if not links.filter("a = b").isEmpty():
            return True
        n = links.count()
    return False


def _spread(links: DataFrame, label: DataFrame) -> DataFrame:
    """label(node, colour): the least colour that reaches each node over links(a, b); only nodes that changed send theirs on."""
    now = label
    while not now.isEmpty():
        sent = now.join(links, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("_new"))
        label = stored(label.join(sent, "node", "left").select("node", F.least("colour", F.coalesce("_new", "colour")).alias("colour"), (F.col("_new") < F.col("colour")).alias("_less")))
        now = label.filter("_less").drop("_less")
        label = label.drop("_less")
    return label


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component: the least node of the largest set around it in which all reach each other, for all nodes of edges(src, dst).

    Trees and chains at the rim are peeled off. In what is left each node gets the least node that reaches it as its colour;
    what reaches a colour's own node within the colour is a component. Components go, and the rest is coloured anew. Rounds
    are as many as a core's longest shortest path has links.
    """
    links = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a is not null and b is not null").distinct())
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    core, found = peeled(links.filter("a != b")), []
    while not core.isEmpty():
        own = core.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        colour = _spread(core, cut(own.select("node", F.col("node").alias("colour"))))
        inside = core.join(colour.toDF("a", "ca"), "a").join(colour.toDF("b", "cb"), "b").filter("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b"))
        # back from each colour's own node
        back = now = cut(colour.filter("node = colour"))
        inside = cut(inside)
        while True:
            now = cut(now.join(inside, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "colour").distinct().join(back.select("node"), "node", "left_anti"))
            if now.isEmpty():
                break
            back = cut(back.unionByName(now))
        found.append(back)
        rest = core.join(back.select(F.col("node").alias("a")), "a", "left_anti").join(back.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")
        core = peeled(rest)
    if not found:
        return nodes.select("node", F.col("node").alias("component"))
    large = reduce(DataFrame.unionByName, found)
    return nodes.join(large, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """node: nodes that a way leads back to, over edges(src, dst)."""
    part = strong_components(edges)
    large = part.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    return part.join(large, "component", "left_semi").select("node").unionByName(edges.filter("src = dst").select(F.col("src").alias("node"))).distinct()
