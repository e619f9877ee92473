"""Sources far smaller than a slot give their target, too, and every document what the layout says."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strata.llm.mixing import mix_sources


def laid_out(rows):
    """(doc_id, place): taken, where each source gives round(target) words of its endless row of words."""
    taken, sources = {}, defaultdict(list)
    for r in rows:
        sources[r.source].append(r)
    for docs in sources.values():
        wanted, start = int(docs[0].target + 0.5), 0
        turns, rest = divmod(wanted, max(1, docs[0].source_size))
        for r in sorted(docs, key=lambda r: (r.place, r.doc_id)):
            taken[r.doc_id] = turns * r["size"] + max(0, min(r["size"], rest - start))
            start += r["size"]
    return taken


@pytest.mark.parametrize("slots", [8, 64, 1000, 1 << 16])
def test_small_sources_give_their_target(spark, slots):
    sizes = [("huge", 400)] * 300 + [(f"tiny{k:02}", n) for k, n in enumerate([1, 2, 5, 7, 100, 300, 700, 1, 3, 50])] + [("mid", 90)] * 30 + [("zz", 40), ("zz", 1), ("none", 0)]
    docs = spark.createDataFrame([(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate(sizes)], "doc_id long, text string, source string")
    place = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("place"))
    rows = mix_sources(docs, slots=slots).join(place, "doc_id").collect()
    assert len(rows) == len(sizes)
    total = defaultdict(int)
    for r in rows:
        total[r.source] += r.taken
        assert r.taken <= 3 * r["size"]
    assert dict(total) == {r.source: int(r.target + 0.5) for r in rows}
    assert all(total[s] > 0 for s, n in sizes if n)
    assert {r.doc_id: r.taken for r in rows} == laid_out(rows)
