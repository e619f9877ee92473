"""Stages of the pipeline against plain Python, row by row, with null ids, ids of several rows, and equal rows."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

from strata.llm.mixing import mix_sources
from strata.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


CLASHES = "_row row _once _times _number _copy _check _least _id _x component_id taken".split()


def wide(frame):
    """The frame with columns of names that stages use themselves."""
    return frame.withColumns({c: F.coalesce(F.length("text"), F.lit(-1)) % (i + 2) for i, c in enumerate(CLASHES)})


def as_rows(frame):
    return Counter(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def made(spark):
    """Rows with planted fates, and a folder whose benchmark has items of which some texts hold windows."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words(r.text)) >= 13]
    rng = random.Random(3)
    toxic = [r.text for r in given.join(labels.filter("toxic = 1"), "doc_id").orderBy("doc_id").limit(4).collect()]
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, other = fresh(60), fresh(60)
    near = [*base[:59], "changed"]
    window = " ".join(words(items[0])[:13])
    texts = [
        (None, toxic[0]), (None, " ".join(fresh(30))), (7, toxic[1]), (7, " ".join(fresh(30))), (8, toxic[2]),
        (None, window), (None, " ".join(fresh(40))), (9, window + " " + " ".join(fresh(20))), (9, " ".join(fresh(20))), (10, window + " " + " ".join(fresh(300))),
        (None, " ".join(base)), (None, " ".join(near)), (3, " ".join(base)), (3, " ".join(base)), (3, " ".join(near)), (5, " ".join(base).upper()),
        (None, " ".join(other)), (None, " ".join(other)), (11, "One"), (12, "one "), (13, None), (13, None), (None, ""), (14, "  "),
    ]
    rows = [(i, t, "en", "abc"[k % 3], len(t or "")) for k, (i, t) in enumerate(texts)]
    return wide(spark.createDataFrame([*rows, rows[12], rows[21]], given.schema)).repartition(3), items


def test_toxic_rows(spark, made):
    docs, _ = made
    labels, given = spark.read.parquet(f"{SF}/labels.parquet"), wide(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = docs.union(given).collect()
    texts = spark.createDataFrame([(k, r.text) for k, r in enumerate(rows)], "doc_id long, text string")
    labelled = docs.union(given)
    bad = {r.doc_id for r in toxicity(texts, labels, labelled=labelled).filter("rejected").collect()}
    assert any(rows[k].doc_id is None for k in bad) and any(r.doc_id is None for k, r in enumerate(rows) if k not in bad)
    assert as_rows(p.drop_toxic(spark, labelled, SF)) == Counter(tuple(r) for k, r in enumerate(rows) if k not in bad)


def test_one_row_of_each_group(spark, made):
    docs, _ = made
    rows = [tuple(r) for r in docs.collect()]
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    kept = as_rows(p.keep_one_of_each_group(spark, docs, SF))
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[group[k]].append(r)
    assert max(map(len, groups.values())) >= 6
    assert sum(kept.values()) == len(groups)
    for members in groups.values():
        best = min((r[0] is None, r[0] or 0) for r in members)
        assert sum(kept[r] for r in set(members) if (r[0] is None, r[0] or 0) == best) >= 1
    for r in rows:
        if not words(r[1]):
            assert kept[r] == rows.count(r)


def test_contaminated_rows(spark, made):
    docs, _ = made
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + n]) for w in items if w for n in [min(13, len(w))] for i in range(len(w) - n + 1)}
    lengths = {len(x) for x in windows}

    def dirty(text):
        w = words(text)
        hit = {k for n in lengths for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        return bool(hit) and 20 * len(hit) >= len(w)

    both = docs.union(wide(spark.read.parquet(f"{SF}/documents.parquet")))
    rows = [tuple(r) for r in both.collect()]
    wanted = Counter(r for r in rows if not dirty(r[1]))
    assert any(r[0] is None and dirty(r[1]) for r in rows) and any(r[0] == 10 for r in wanted)
    assert as_rows(p.drop_contaminated(spark, both, SF)) == wanted


def test_mixed_rows(spark, made):
    docs, _ = made
    keyed = p._keyed(docs)
    row = {r["_row"]: tuple(r.row) for r in keyed.collect()}
    assert len(row) == len({tuple(r) for r in docs.collect()})
    wanted = Counter()
    for r in mix_sources(p._texts(keyed)).collect():
        wanted[row[r.doc_id]] += int(r.taken / max(1, r["size"]) + 0.5)
    assert as_rows(p.mix(spark, docs, SF)) == +wanted and sum(wanted.values()) > 0


def test_stages_keep_columns_of_any_name_and_empty_tables(spark, made):
    docs, _ = made
    for name, stage in p.STAGES[:-1]:
        none = stage(spark, docs.filter("false"), SF)
        assert none.columns == docs.columns and none.collect() == [], name
    assert p.STAGES[-1][1](spark, docs.filter("false"), SF).collect() == []


def test_rows_whose_hashes_meet_have_keys_of_their_own(spark, made, monkeypatch):
    docs, _ = made
    whole = F.xxhash64
    narrow = lambda *x: whole(*x) if len(x) == 2 or str(x[0]._jc) == "1" else whole(*x) % 3
    monkeypatch.setattr(F, "xxhash64", narrow)
    keyed = p._keyed(docs).collect()
    assert len({r["_row"] for r in keyed}) == len({tuple(r.row) for r in keyed})
