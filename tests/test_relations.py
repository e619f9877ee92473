"""Maps of relations are fitted on all examples, and all concepts can be predicted."""

import numpy as np
import pytest

from strata.operators import relations as r
from strata.plans import registry

SF = "/root/testdata/sf0.001"


def fitted(s, o, decay=1e-2):
    return np.linalg.solve(s.T @ s + decay * np.eye(s.shape[1]), s.T @ o)


def test_maps_use_all_examples(spark):
    rng = np.random.default_rng(1)
    s, o = rng.normal(size=(9000, 3)), rng.normal(size=(9000, 3))
    rows = [("few" if k % 90 == 0 else "many", s[k].tolist(), o[k].tolist()) for k in range(9000)]
    frame = spark.createDataFrame([*rows, ("few", None, [1.0, 2.0, 3.0])], "relation string, s array<double>, o array<double>")
    found = {x.relation: np.array(x.matrix).reshape(3, 3) for x in r.fit_maps(frame.repartition(5), 3).collect()}
    few = np.arange(9000) % 90 == 0
    assert sorted(found) == ["few", "many"]
    assert np.allclose(found["few"], fitted(s[few], o[few])) and np.allclose(found["many"], fitted(s[~few], o[~few]))


def brute(subjects, maps, concepts, k, least):
    out = []
    for i, x in subjects:
        for relation, m in maps.items():
            y = x @ m
            scored = [(-(y @ z) / np.linalg.norm(y) / np.linalg.norm(z), j) for j, z in concepts if j != i and np.any(z) and np.any(y)]
            out += [(i, relation, j, n + 1, round(-c, 5)) for n, (c, j) in enumerate(sorted((round(c, 12), j) for c, j in scored if -c >= least)[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_predict(spark, seed, monkeypatch):
    monkeypatch.setattr(r, "_IMAGES", 7)
    monkeypatch.setattr(r, "_CONCEPTS", 11)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(90, 3))
    vectors[5], vectors[40:60] = 0, vectors[61]  # a zero vector, and ties
    rows = [(k, vectors[k].tolist()) for k in range(90)]
    maps = {"a": rng.normal(size=(3, 3)), "b": rng.normal(size=(3, 3))}
    concepts = spark.createDataFrame([*rows, (90, None)], "id long, vec array<double>").repartition(3)
    frame = spark.createDataFrame([(x, m.ravel().tolist()) for x, m in maps.items()], "relation string, matrix array<double>")
    found = r.predict(concepts.filter("id % 3 = 2"), frame, concepts, 4, 0.1, 3).collect()
    assert sorted((x.subject, x.relation, x.object, x.rank, round(x.similarity, 5)) for x in found) == brute([(k, vectors[k]) for k in range(2, 90, 3)], maps, list(enumerate(vectors)), 4, 0.1)


def test_query_predicts_all_concepts(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    vectors, label = {x.vec_id: np.array(x.embedding, float) for x in e}, {x.vec_id: x.label for x in e}
    maps = {}
    for relation in (0, 1):
        at = [i for i in vectors if i + 1 in vectors and label[i] % 2 == relation]
        maps[f"r{relation}"] = fitted(np.array([vectors[i] for i in at]), np.array([vectors[i + 1] for i in at]))
    found = registry.QUERIES["relation_predict"](spark, SF).collect()
    wanted = brute([(i, x) for i, x in vectors.items() if i % 50 == 0], maps, list(vectors.items()), 3, 0.1)
    assert max(x.object for x in found) >= 40
    assert sorted((x.subject, x.relation, x.object, x.rank) for x in found) == [x[:4] for x in wanted]
    assert np.allclose([x.similarity for x in sorted(found)], [x[4] for x in wanted], atol=2e-5)
