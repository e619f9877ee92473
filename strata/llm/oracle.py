"""DuckDB SQL for the operators that SQL can express fast enough over the whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"


def _words(source: str, key: str, pattern: str, lower: bool) -> str:
    text = _LOWER.format("text") if lower else "coalesce(text, '')"
    return f"SELECT {key}, regexp_extract_all({text}, {pattern}) AS w FROM {source}"


def _windows(source: str, key: str, size: str) -> str:
    """key, h (hash of a window's words), i (its first word, from 1)."""
    hashes = f"list_transform(range(1, len(w) - {size} + 2), lambda i: md5(array_to_string(w[i:i + {size} - 1], ' ')))"
    return f"SELECT {key}, unnest({hashes}) AS h, generate_subscripts({hashes}, 1) AS i FROM {source}"


#: A document word is hit if one of the windows that starts at it or at the 12 before occurs in an item; the items of these tables have 13 words or more, shorter ones are matched at their own length.
DECONTAMINATE = f"""WITH d AS ({_words("documents", "doc_id", _ALNUM, True)}), b AS ({_words("benchmark", "item_id", _ALNUM, True)}),
p AS ({_windows("(SELECT item_id, w FROM b WHERE len(w) >= 13)", "item_id", "13")}), s AS (SELECT item_id, len(w) AS m, md5(array_to_string(w, ' ')) AS h FROM b WHERE len(w) BETWEEN 1 AND 12),
x AS ({_windows("d", "doc_id", "13")}), y AS (SELECT m, doc_id, unnest(list_transform(range(1, len(w) - m + 2), lambda i: md5(array_to_string(w[i:i + m - 1], ' ')))) AS h, generate_subscripts(list_transform(range(1, len(w) - m + 2), lambda i: i), 1) AS i FROM d, (SELECT DISTINCT m FROM s)),
f AS (SELECT x.doc_id, p.item_id, x.i, x.i + 12 AS j FROM x JOIN p USING (h) UNION SELECT y.doc_id, s.item_id, y.i, y.i + s.m - 1 FROM y JOIN s USING (m, h)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, j + 1)) AS k FROM f) GROUP BY doc_id), it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

SUBSTRING = f"""WITH d AS ({_words("documents", "doc_id", _SPACED, False)}), x AS ({_windows("d", "doc_id", "35")}), c AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1), hit AS (SELECT doc_id, i FROM x SEMI JOIN c USING (h)),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d), m AS (SELECT t.doc_id, t.word, t.i, max(hit.i) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS last FROM t LEFT JOIN hit ON hit.doc_id = t.doc_id AND hit.i = t.i),
k AS (SELECT doc_id, count(*) AS n, count(last) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (WHERE last IS NULL) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE d AS ({_words("documents", "doc_id", _SPACED, True)}), g AS (SELECT DISTINCT doc_id, h FROM ({_windows("(SELECT * FROM d WHERE len(w) >= 3)", "doc_id", "3")}) UNION SELECT doc_id, 'short ' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)), r(doc_id, root) AS (SELECT a, a FROM (SELECT DISTINCT a FROM l) UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id), m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

_TURN = "ORDER BY turn NULLS FIRST, role, text"
_ESCAPE = r"regexp_replace({0}, '<(\\*\|(?:im_start|im_end)\|>)', '<\\\1', 'g')"
_ROLE = r"replace(replace(role, '\', '\\'), chr(10), '\n')"

#: A turn is written as two marks (12 and 10 characters), a line feed behind the role, and one behind the turn.
CHATS = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_TURN})) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' {_TURN}) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(24 + length({_ESCAPE.format(_ROLE)}) + length({_ESCAPE.format("text")}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_DOWN = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"


def _centroids(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    steps = [
        f"v AS (SELECT vec_id, unnest(range({dims})) AS d, unnest(list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dims} AND {_FINITE})",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v) QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, d, x FROM v JOIN s USING (vec_id))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, arg_min(c, (q, c)) AS c, min(q) AS q FROM (SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS q FROM v JOIN c{i} c USING (d) GROUP BY ALL) GROUP BY vec_id)")
        if i < rounds:
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, d, coalesce(n.x, o.x) AS x FROM c{i} o LEFT JOIN (SELECT a.c, v.d, {_DOWN} AS x FROM v JOIN a{i} a USING (vec_id) GROUP BY a.c, v.d) n USING (c, d))")
    steps.append(f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, c::INTEGER AS cluster, q AS distance, (sum(q) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(q) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (c)"


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4, dims: int = 64, scale: int = 1024) -> str:
    width = dims // parts
    steps = [
        f"v AS (SELECT vec_id, label, d // {width} AS p, d % {width} AS d, x FROM (SELECT vec_id, label, unnest(range({dims})) AS d, unnest(list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT)) AS x FROM embeddings WHERE {_FINITE}))",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT vec_id FROM v) QUALIFY e < {entries})",
        "c0 AS MATERIALIZED (SELECT p, e, d, x FROM v JOIN s USING (vec_id))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, (q, e)) AS e, min(q) AS q FROM (SELECT v.vec_id, p, c.e, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS q FROM v JOIN c{i} c USING (p, d) GROUP BY ALL) GROUP BY vec_id, p)")
        if i < rounds:
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT p, e, d, coalesce(n.x, o.x) AS x FROM c{i} o LEFT JOIN (SELECT p, a.e, v.d, {_DOWN} AS x FROM v JOIN a{i} a USING (vec_id, p) GROUP BY ALL) n USING (p, e, d))")
    steps.append(f"h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, d)) AS codebooks_sha256 FROM c{rounds})")
    steps.append(f"t AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(q)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    return "WITH " + ",\n".join(steps) + "\nSELECT t.vec_id, code, error, (sum(error) OVER (PARTITION BY m.label))::BIGINT AS label_error, codebooks_sha256 FROM t JOIN (SELECT vec_id, label FROM embeddings) m ON m.vec_id = t.vec_id CROSS JOIN h"


CENTROIDS, CODES = _centroids(), _codes()

ORACLE: dict[str, str] = {
    "op2_decontaminate": DECONTAMINATE,
    "op3_substring_dedup": SUBSTRING,
    "op10_jaccard_join": JACCARD,
    "op11_chat_format": CHATS,
    "op12_centroid_clusters": CENTROIDS,
    "op13_vector_codes": CODES,
}
