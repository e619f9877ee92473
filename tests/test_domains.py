"""Packed memories of domains against NumPy: nearest patterns, energies by domain, the cascade; nulls, zero vectors, ties, nothing."""

import numpy as np
import pytest

from strata.operators import domains as d


def unit(x):
    x = np.asarray(x, float)
    return x / np.linalg.norm(x)


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(8)
    states = [(i, r.normal(size=5).tolist()) for i in range(40)] + [(100, None), (101, [0.0] * 5), (102, [1.0, 0.0, 0.0, 0.0, 0.0])]
    members = [(int(r.integers(6)) if i % 2 else 1, r.normal(size=5).tolist()) for i in range(300)] + [(3, [0.0] * 5), (4, None), (5, [2.0, 0.0, 0.0, 0.0, 0.0])]
    return states, members, spark.createDataFrame(states, "vec_id long, embedding array<double>").repartition(3), spark.createDataFrame(members, "label int, embedding array<double>").repartition(4)


def energy(state, members, label=None):
    cos = [unit(state) @ unit(x) for k, x in members if x and any(x) and label in (None, k)]
    e = -np.log(np.exp(22.0 * np.array(cos)).sum()) / 22.0
    return e, np.exp(-e) / (1 + np.exp(-e))


def test_nearest(spark, made):
    states, members, s, _ = made
    patterns = [(i, members[i][1]) for i in range(50)] + [(60, members[7][1])]
    p = spark.createDataFrame(patterns, "pattern int, embedding array<double>").repartition(2)
    got = {(r.vec_id, r["rank"]): r.pattern for r in d.nearest(s, p, 4, state="vec_id", pattern="pattern").collect()}
    for i, x in states:
        order = sorted(((-round(unit(x) @ unit(y), 12), k) for k, y in patterns)) if x and any(x) else []
        assert [got.get((i, k + 1)) for k in range(4)] == [k for _, k in order[:4]] + [None] * (4 - len(order[:4]))
    close = d.nearest(s, p, 4, state="vec_id", pattern="pattern", least=0.8).collect()
    assert close and all(r.similarity >= 0.8 for r in close)


def test_energies(spark, made):
    states, members, s, m = made
    whole = {r.vec_id: (r.energy, r.confidence) for r in d.energies(s, m, state="vec_id").collect()}
    known = {i: x for i, x in states if x and any(x)}
    assert whole.keys() == known.keys()
    assert all(np.allclose(whole[i], energy(x, members)) for i, x in known.items())
    asked = s.withColumn("label", (s.vec_id % 6).cast("int"))
    by = {(r.vec_id, r.label): r.energy for r in d.energies(asked, m, state="vec_id", domain="label").collect()}
    assert by.keys() == {(i, i % 6) for i in known} and all(np.isclose(by[i, i % 6], energy(x, members, i % 6)[0]) for i, x in known.items())


def test_cascade(spark, made):
    states, members, s, m = made
    tree = [(0, None), (1, None), (2, 0), (3, 0), (4, 1), (5, 4), (2, 1), (7, 8), (8, 7)]
    hierarchy = spark.createDataFrame(tree, "label int, parent int")
    want = []

    def down(i, x, parent, level, path):
        found = sorted((-c, k) for k, p in tree if p == parent and any(a == k for a, _ in members) and (c := energy(x, members, k)[1]) >= 0.6)[:2]
        for c, k in found:
            want.append((i, k, level, round(-c, 6), path + str(k)))
            down(i, x, k, level + 1, f"{path}{k}/")

    for i, x in states:
        if x and any(x):
            down(i, x, None, 1, "")
    got = d.domain_cascade(s, hierarchy, m, state="vec_id", domain="label", k=2, least=0.6)
    assert sorted((r.vec_id, r.label, r.level, round(r.confidence, 6), r.path) for r in got.collect()) == sorted(want)
    assert {r[2] for r in want} == {1, 2, 3}
    assert d.domain_cascade(s.filter("false"), hierarchy, m, state="vec_id", domain="label", k=2).collect() == []
    assert d.domain_cascade(s, hierarchy.filter("false"), m, state="vec_id", domain="label", k=2).collect() == []
