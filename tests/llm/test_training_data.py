"""Each operator against brute force on small inputs with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.llm import mpeg_audio as audio
from strata.llm import queries
from strata.llm.components import components
from strata.llm.decontaminate import WuManber, contaminated_words
from strata.llm.html_layout import html_text, visible_text
from strata.llm.jaccard_join import jaccard_classes
from strata.llm.mixing import mix_sources
from strata.llm.substring_dedup import SuffixAutomaton, substring_dedup
from strata.llm.suffix_dedup import RunLengthIndex, suffix_dedup
from strata.llm.token_counts import token_counts, unigram_vocabulary
from strata.llm.token_store import read_document, read_tokens, write_tokens
from strata.llm.toxicity import fit_chain, chain_odds, toxicity

SCHEMA = "doc_id long, text string, source string, _x string, node long, _id string, token int, size int, start int"
VOCABULARY = "red blue green stone river cloud tree house light dark".split()


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Texts with shared passages, copies, near copies, odd white space, nulls, and a row that is there twice."""
    rng = random.Random(seed)
    word = lambda: rng.choice(VOCABULARY) + str(rng.randrange(40))
    passage = [word() for _ in range(25)]
    base = [word() for _ in range(120)]
    texts: list[str | None] = [None, "", "  ", "One", "one ", "É é x\ty\x0bz  ", "solo word"]
    for k in range(n):
        w = [word() for _ in range(rng.randrange(5, 90))]
        if k % 3 == 0:
            w[3:3] = passage
        if k % 5 == 0:
            w = base[:]
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = word()
        texts.append(("\n" if k % 7 == 0 else " ").join(w))
    texts += [texts[9], " ".join(VOCABULARY * 3) * 2, "x" * 3000 + " " + "x" * 3000]
    rows = [(i * 3, t, (None, "a", "b")[i % 3], "clash", 1, "clash", 2, 3, 4) for i, t in enumerate(texts)]
    return [*rows, rows[12]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def repeated(tokens: list, length: int) -> list[list[bool]]:
    seen = Counter(tuple(w[i : i + length]) for w in tokens for i in range(len(w) - length + 1))
    out = []
    for w in tokens:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("frequent", [2, 1024])
def test_substring_dedup(docs, frequent):
    rows = docs.collect()
    tokens = [words(r.text) for r in rows]
    want = sorted((r.doc_id, len(w), sum(g), b" ".join(x for x, y in zip(w, g, strict=True) if not y)) for r, w, g in zip(rows, tokens, repeated(tokens, 12), strict=True))
    out = substring_dedup(docs, length=12, frequent=frequent).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in out) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)


@pytest.mark.parametrize("frequent", [2, 1024])
def test_suffix_dedup(docs, frequent):
    rows = docs.collect()
    tokens = [list((r.text or "").encode()) for r in rows]
    want = sorted((r.doc_id, len(w), sum(g), len(re.findall(b"\1+", bytes(g))), bytes(x for x, y in zip(w, g, strict=True) if not y)) for r, w, g in zip(rows, tokens, repeated(tokens, 60), strict=True))
    out = suffix_dedup(docs, length=60, frequent=frequent).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out) == want


@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=25), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_automaton_and_index_give_longest_repeats(seqs):
    automaton = SuffixAutomaton()
    for s in seqs:
        automaton.add(s)
    automaton.close()
    places = Counter(tuple(s[a:z]) for s in seqs for a in range(len(s)) for z in range(a + 1, len(s) + 1))
    for s in seqs:
        want = [max((z - a for a in range(z) if places[tuple(s[a:z])] > 1), default=0) for z in range(1, len(s) + 1)]
        assert automaton.matching_statistics(s) == want
    text = np.array([x for i, s in enumerate(seqs) for x in (*s, 100 + i)])
    found = RunLengthIndex.build(text).matching_statistics()
    at = 0
    for s in seqs:
        want = [max((z - a for z in range(a + 1, len(s) + 1) if places[tuple(s[a:z])] > 1), default=0) for a in range(len(s))]
        assert found[at : at + len(s)].tolist() == want
        at += len(s) + 1


def test_decontamination(spark, docs):
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = docs.collect()
    long = next(r.text for r in rows if r.text and len(words(r.text)) > 60)
    items = [(2, " ".join(alnum(long)[5:30])), (10, "Solo, WORD"), (11, ""), (12, None), (13, "nowhere to be found"), (2, " ".join(alnum(long)[40:52]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[k : k + size])].add(i)
    want = []
    for r in rows:
        w, hit, found = alnum(r.text), set(), set()
        for k in range(len(w)):
            for size in {len(x) for x in windows}:
                if tuple(w[k : k + size]) in windows and k + size <= len(w):
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        want.append((r.doc_id, len(w), len(hit), sorted(found)))
    for most in (4 << 20, 40):  # at once, and in blocks
        out = contaminated_words(docs, bench, most_bytes=most).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out) == sorted(want)
    assert contaminated_words(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(0, 3), min_size=3, max_size=3), min_size=1, max_size=6, unique_by=tuple))
@settings(max_examples=150, deadline=None)
def test_wu_manber_finds_all(text, patterns):
    value = np.array(text, np.uint64)
    first, window = WuManber(np.array(patterns, np.uint64)).find(value, np.full(len(text), len(text)))
    want = sorted((i, p) for i in range(len(text) - 2) for p, x in enumerate(patterns) if text[i : i + 3] == x)
    assert sorted(zip(first.tolist(), window.tolist(), strict=True)) == want


@pytest.mark.parametrize("frequent,block", [(64, 1024), (2, 3)])
def test_jaccard_classes(docs, frequent, block):
    rows = docs.collect()
    sets = []
    for r in rows:
        w = [x.lower() if x.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in words(r.text)]
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    root = {r.doc_id: r.doc_id for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and 10 * len(x & y) >= 8 * len(x | y):
                a, b = find(rows[i].doc_id), find(rows[j].doc_id)
                root[max(a, b)] = min(a, b)
    out = jaccard_classes(docs, words=3, threshold=(8, 10), frequent=frequent, block=block).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted((r.doc_id, len(s), find(r.doc_id)) for r, s in zip(rows, sets, strict=True))
    assert any(find(r.doc_id) != r.doc_id for r in rows)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)]
    root = {}
    for a, b in links:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()} == root


def test_mixing(spark, docs):
    rows = docs.collect()
    out = mix_sources(docs, slots=4096).collect()
    again = mix_sources(docs.repartition(7), slots=4096).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    assert Counter((r.doc_id, r["size"], r.source) for r in out) == Counter((r.doc_id, len(words(r.text)), r.source) for r in rows)
    total = sum(r["size"] for r in out)
    order = ["a", "b", None]
    size = {s: sum(r["size"] for r in out if r.source == s) for s in order}
    weight, target, open_ = dict(zip(order, (5, 2, 1), strict=True)), {}, set(order)
    while open_:  # share by weight; those above three times their size stop there
        left = total - sum(target.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * size[s]]
        for s in over or list(open_):
            target[s] = 3 * size[s] if over else left * weight[s] / sum(weight[x] for x in open_)
        open_ -= set(target)
        if not over:
            break
    for r in out:
        assert r.taken <= 3 * r["size"]
        assert r.target == pytest.approx(target[r.source])
        assert r.source_size == size[r.source]
    for s in order:
        assert sum(r.taken for r in out if r.source == s) == pytest.approx(target[s], rel=0.02)


def test_token_store(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-5, "it's  two   spaces\n\nand lines\n"), (-4, "<|endoftext|> mark"), (-3, "a.b, (c) word... can't!? 日本語。text")], "doc_id long, text string"))
    write_tokens(more, str(tmp_path / "t"), tokenizer=path)
    out = sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in read_tokens(spark, str(tmp_path / "t")).collect())
    start, want = 0, []
    for r in sorted(more.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert out == sorted(want)
    assert read_document(spark, str(tmp_path / "t"), -5) == [[*tokenizer.encode("it's  two   spaces\n\nand lines\n", add_special_tokens=False).ids, 0]]


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    exact = Tokenizer(models.Unigram(unigram_vocabulary(path), unk_id=0, byte_fallback=False))
    exact.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-5, "\U00012000\U00012001 ab\U00012000\x1cq <unk> 　x y"), (-4, "aaaaaaaaaaaaaaaaaaaaaaa")], "doc_id long, text string"))
    want = sorted((r.doc_id, len(exact.encode(r.text or "").ids)) for r in more.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(more, vocabulary=path).collect()) == want


def test_chain_learns_and_uses_earlier_categories():
    rng = np.random.default_rng(2)
    n = 600
    a = rng.random(n) < 0.4
    row = np.repeat(np.arange(n), 3)
    feature = np.stack([np.where(a, 10, 20), rng.integers(100, 200, n), rng.integers(200, 300, n)], axis=1).ravel()
    y = np.stack([a, a], axis=1)
    odds = chain_odds(fit_chain(row, feature, y), row, feature, n)
    assert ((odds > 0) == y).mean() > 0.99


def test_toxicity(spark, none):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        w = [rng.choice(VOCABULARY) for _ in range(30)]
        if bad:
            w[rng.randrange(30)] = rng.choice(["scum", "idiot", "moron"])
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([*rows, (900, None, 0), (901, "", 0)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows if i % 2 == 0 or i % 4 == 1] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.rejected for r in toxicity(docs, labels).collect()}
    assert {i for i, bad in out.items() if bad} == {i for i, _, t in rows if t}
    assert not any(r.rejected for r in toxicity(docs, labels.limit(0)).collect())


@given(st.binary(max_size=2000))
@settings(max_examples=60, deadline=None)
def test_audio_round_trip(data):
    payload = audio.pad_payload(data)
    media = audio.write_audio(payload)
    read = audio.read_audio(media)
    assert audio.read_payload(read) == payload and not read.damaged and not read.skipped
    assert read.duration * 16000 == 576 * len(read.frames) and read.table_frames == len(read.frames)


def test_audio_resynchronises():
    media = audio.write_audio(bytes(range(256)) * 9)
    at = audio.read_audio(media).frames[2]
    noisy = media[:at] + b"\xff\xfbnoise\xff" + media[at:]
    read = audio.read_audio(noisy)
    assert len(read.frames) == 4 and read.skipped == 8 and audio.read_payload(read) == bytes(range(256)) * 9
    broken = bytearray(media)
    broken[at + 8] ^= 1
    assert audio.read_audio(bytes(broken)).damaged == 1
    assert audio.read_audio(b"").frames == [] and audio.read_audio(b"nothing here").skipped == 12
    assert audio.parse_header(b"\xff\xfb\x90\x64").size == 417 and audio.parse_header(b"\xff\xfb\x92\x64").size == 418


def test_audio_column(docs):
    for r in audio.audio_column(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        payload = audio.pad_payload((r.text or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((r.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and len(r.frame_offsets) == r.n_frames == r.verified


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>a<p>b", "a\n\nb"),
        ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>", "- one\n- two\n  3. x\n  4. y"),
        ("<table><tr><td>1<td>22<tr><th>333<td>4</table>", "1    22\n333  4"),
        ("a <b> b</b>c<!-- no --><script>x<1</script> d", "a bc d"),
        ("<div hidden>no</div><div style='display:none'>no</div><p style='color:red'>yes", "yes"),
        ("<title>t</title><body>x &amp; &lt;y&gt;", "x & <y>"),
        ("<pre>a\n  b\n\nc</pre>z", "a\n  b\n\nc\n\nz"),
        ("x<br>y<br><br>z", "x\ny\n\nz"),
        ("", ""),
        (None, ""),
        ("<", "<"),
        ("1 < 2 <3", "1 < 2 <3"),
    ],
)
def test_html_layout(page, text):
    assert visible_text(page) == text


def test_html_keeps_all_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text(pages).join(pages, "page_id").limit(40).collect():
        body = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", "", r.html)
        import html

        loose = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        assert sorted("".join(loose)) == sorted("".join(re.sub(r"(?m)^ *(?:- |\d+\. )", "", r.text).split())) or len("".join(r.text.split())) >= len("".join(loose))


def test_deep_pages():
    assert visible_text("<div>" * 5000 + "x").strip() == "x"


def test_empty_tables(spark, none, tmp_path):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (substring_dedup(none), suffix_dedup(none), contaminated_words(none, bench), jaccard_classes(none), mix_sources(none), toxicity(none, labels), token_counts(none, vocabulary=public_tokenizers.path("piece_bpe_32k.model")), audio.audio_column(none)):
        assert out.count() == 0
    write_tokens(none, str(tmp_path / "e"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0
    assert html_text(spark.createDataFrame([], "page_id long, html string, text string")).count() == 0


def test_every_query_is_registered():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES] == list(range(1, 14))
