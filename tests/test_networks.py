"""Centrality, levels, components, nesting, containment and threshold joins against plain Python on small and odd inputs."""

import random
from collections import defaultdict, deque
from fractions import Fraction

import numpy as np
import pytest

from strata.operators import containment, nesting, paths, threshold_join
from strata.operators import graph as graph_of


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def graph(n, m, seed):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def brandes(nodes, links):
    out = defaultdict(set)
    for a, b in links:
        if a != b:
            out[a].add(b)
    score = dict.fromkeys(nodes, Fraction(0))
    for s in nodes:
        far, ways, order, before, queue = {s: 0}, defaultdict(int, {s: 1}), [], defaultdict(list), deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        gain = defaultdict(Fraction)
        for w in reversed(order):
            for v in before[w]:
                gain[v] += Fraction(ways[v], ways[w]) * (1 + gain[w])
            if w != s:
                score[w] += gain[w]
    n = len(nodes)
    return {v: float(x / max(1, (n - 1) * (n - 2))) for v, x in score.items()}


@pytest.mark.parametrize("links, states", [(graph(14, 40, 1), 1 << 20), (graph(12, 18, 2), 50), ([(i, i + 1) for i in range(6)], 1 << 20), ([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (3, 3)], 1 << 20)])
def test_betweenness(spark, links, states):
    nodes = sorted({x for link in links for x in link} | {99})
    got = paths.betweenness(frame(spark, [*links, links[0]], "src long, dst long"), frame(spark, [(x,) for x in [*nodes, None, 99]], "node long"), most_states=states)
    assert {r.node: round(r.centrality, 9) for r in got.collect()} == {k: round(v, 9) for k, v in brandes(nodes, links).items()}


def test_betweenness_of_nothing(spark):
    assert paths.betweenness(frame(spark, [], "src long, dst long"), frame(spark, [], "node long")).collect() == []


def plain_levels(links):
    nodes, down, child = {x for p in links for x in p}, defaultdict(set), set()
    for p, c in links:
        down[p].add(c)
        child.add(c)
    level, now = dict.fromkeys(nodes), {x for x in nodes if x not in child}
    k = 0
    while now:
        for x in now:
            level[x] = k
        now, k = {c for x in now for c in down[x] if level[c] is None}, k + 1
    return level


CHAIN = [(i, i + 1) for i in range(10_000)]


@pytest.mark.parametrize("links", [graph(30, 40, 3), graph(40, 45, 4), [(0, 1), (1, 2), (2, 0), (5, 6), (6, 7), (7, 6), (7, 7)], CHAIN, [*CHAIN, (0, 9000), (20_000, 5000)], [(1, 1)]], ids=["a", "b", "cycles", "chain", "shortcuts", "loop"])
def test_levels(spark, links):
    got = {r.node: r.level for r in paths.levels(frame(spark, links, "parent long, child long")).collect()}
    assert got == plain_levels(links)


def plain_components(links):
    nodes, out = sorted({x for p in links for x in p}), defaultdict(set)
    for a, b in links:
        out[a].add(b)

    def reach(v):
        seen, stack = {v}, [v]
        while stack:
            for w in out[stack.pop()] - seen:
                seen.add(w)
                stack.append(w)
        return seen

    far = {v: reach(v) for v in nodes}
    return {v: min(w for w in far[v] if v in far[w]) for v in nodes}


RINGS = [(i, (i + 1) % 7) for i in range(7)] + [(10 + i, 10 + (i + 1) % 5) for i in range(5)] + [(3, 12), (6, 20), (20, 21), (21, 22)]
CORE = [(a, b) for a in range(12) for b in range(12) if a != b]


@pytest.mark.parametrize("links", [graph(25, 35, 5), RINGS, CORE, [(1, 1), (1, 2)], CHAIN[:300]], ids=["random", "rings", "core", "loop", "chain"])
def test_strong_components(spark, links):
    rows = frame(spark, [*links, (None, 1)], "src long, dst long")
    want = plain_components(links)
    assert {r.node: r.component for r in paths.strong_components(rows).collect()} == want
    loops = {a for a, b in links if a == b}
    assert {r.node for r in paths.on_cycles(rows.dropna()).collect()} == {v for v in want if v in loops or list(want.values()).count(want[v]) > 1}


def test_a_long_chain_is_peeled_at_once(spark):
    assert {r.n for r in paths.strong_components(frame(spark, CHAIN, "src long, dst long")).groupBy("component").count().toDF("component", "n").collect()} == {1}


DENSE = [(a, b) for a in range(9) for b in range(9) if a < b]


@pytest.mark.parametrize("links", [graph(40, 30, 6), graph(40, 30, 8), graph(60, 50, 7), graph(25, 35, 5), RINGS, CORE, DENSE, [*DENSE, (8, 0)], [*DENSE, (4, 4)], [(1, 1)], [(0, 1), (1, 0)], CHAIN[:300], [*CHAIN[:300], (200, 100)], []], ids=str)
def test_cyclic(spark, links):
    want = plain_components(links)
    cyclic = any(a == b for a, b in links) or len(set(want.values())) < len(want)
    assert paths.cyclic(frame(spark, [*links, (None, 1), (1, None)], "a long, b long")) == cyclic


@pytest.mark.parametrize("n, m, seed", [(60, 30, 1), (60, 60, 2), (200, 150, 3), (12, 0, 4)])
def test_weak_components(spark, n, m, seed):
    links = graph(n, m, seed)
    want = {i: i for i in range(n)}
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    # ends that are no nodes connect nodes, but are no components
    links, nodes = [*links, (n, 0), (n, n - 1), (n + 1, n + 2), (None, 3)], [*range(n), 5, None]
    want = {i: want[0] if c == want[n - 1] else c for i, c in want.items()}
    got = graph_of.weak_components(frame(spark, links, "src_id long, dst_id long"), frame(spark, [(x,) for x in nodes], "node long"))
    assert sorted(map(tuple, got.collect())) == sorted(want.items())


def plain_parents(ranges, queries=()):
    def around(row, query):
        f, i, s, e = row
        fits = [(t - r, j) for g, j, r, t in ranges if g == f and r <= s and t >= e and (query or t - r > e - s)]
        return min(fits)[1] if fits else None

    return sorted([(f, i, s, e, q, around((f, i, s, e), q)) for rows, q in ((ranges, False), (queries, True)) for f, i, s, e in rows])


def nested(n, seed, files=2):
    r, rows = random.Random(seed), []
    for i in range(n):
        a, b = sorted((r.randrange(60), r.randrange(60)))
        rows.append((f"f{r.randrange(files)}", i, a, b))
    return rows


def deep(n):
    return [("f", i, i, 4 * n - i) for i in range(n)] + [("f", n + i, n + 3 * i, n + 3 * i + 1) for i in range(n // 3)]


@pytest.mark.parametrize("ranges", [nested(60, 1), nested(200, 2, 1), deep(90), [("a", 1, 1, 5), ("a", 2, 1, 5), ("a", 3, 1, 9), ("a", 4, 5, 5), ("a", 4, 5, 5)]], ids=["two", "one", "deep", "equal"])
def test_smallest_enclosing(spark, ranges):
    queries = [(f, 1000 + k, line, line) for k, (f, line) in enumerate(sorted({(r[0], x) for r in ranges for x in r[2:]}))]
    got = nesting.smallest_enclosing(frame(spark, ranges, "file string, id long, start long, end long"), queries=frame(spark, queries, "file string, id long, start long, end long"))
    assert sorted((r.file, r.id, r.start, r.end, r.query, r.parent_id) for r in got.collect()) == plain_parents(ranges, queries)


def test_odd_ranges(spark):
    rows = [(None, 1, 1, 2), ("a", 2, None, 3), ("a", 3, 9, 1), ("a", 4, 1, 9), ("a", None, 2, 3), ("a", 6, 3, 4)]
    got = nesting.smallest_enclosing(frame(spark, rows, "file string, id long, start long, end long"))
    assert {(r.id, r.parent_id) for r in got.collect()} == {(1, None), (2, None), (3, None), (4, None), (None, None), (6, 4)}
    assert nesting.smallest_enclosing(frame(spark, [], "file string, id long, start long, end long")).collect() == []


@pytest.mark.parametrize("block_chars", [3, 1 << 20])
def test_contained_names(spark, block_chars):
    names = ["ring", "Ring", "in", "é", "x_y", "", None, "nowhere", "aa"]
    texts = [(1, "A ring, RINGING; in"), (2, None), (3, ""), (None, "É x_y x_yz"), (3, "aaaa"), (3, "ring")]
    rows, known = frame(spark, texts, "text_id long, text string"), frame(spark, [(n,) for n in names], "name string")
    got = sorted(((r.text_id or 0, r.name, r.n) for r in containment.contained_names(rows, known, block_chars=block_chars).collect()))
    count = lambda text, name: sum(text.startswith(name, i) for i in range(len(text)))
    assert got == sorted((i or 0, n, count(t.lower(), n)) for i, t in texts if t for n in {x.lower() for x in names if x} if n in t.lower())
    whole = {(r.text_id, r.name, r.n) for r in containment.contained_names(rows, known, whole_words=True, block_chars=block_chars).collect()}
    assert whole == {(1, "ring", 1), (1, "in", 1), (None, "é", 1), (None, "x_y", 1), (3, "ring", 1)}
    assert containment.contained_names(rows, known.filter("false")).collect() == []


def test_threshold_join(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(9, 6))
    x = (centres[r.integers(0, 9, 400)] + 0.15 * r.normal(size=(400, 6))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, x[0].tolist()), (None, x[1].tolist()), (500, None), (501, [0.0] * 6), (502, [float("nan")] * 6), (503, [1.0] * 5)]
    data = frame(spark, rows, "vec_id long, embedding array<float>")
    index = threshold_join.build_index(data, pivots=12, block_rows=16)
    found, counts = threshold_join.search(index, data.filter("vec_id % 5 = 0"), least=0.9, query_block=30)
    unit = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v in rows[:402]]
    want = sorted((i, -1 if j is None else j) for i, a in unit if i is not None and i % 5 == 0 for j, b in unit if a @ b >= 0.9)
    assert sorted((r.query_id, -1 if r.vec_id is None else r.vec_id) for r in found.collect()) == want
    total = counts.groupBy().sum("n_pairs", "n_compared").first()
    assert total[1] < 0.5 * total[0]
    none = threshold_join.build_index(data.filter("false"))
    assert threshold_join.search(none, data)[0].collect() == []
