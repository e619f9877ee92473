"""Queries on text scalars, over documents, pages and conversations, and over code that parts give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata import config
from strata.functions import text as t
from strata.plans.derived import frame, with_sql
from strata.plans.registry import query, table

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
WORDS3 = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}')"


def _sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


FR, EN, STOPS = map(_sql_list, (config.FRENCH_WORDS, config.ENGLISH_WORDS, config.KEYWORD_STOPS))
BOTH_STOPS = _sql_list(sorted({*config.KEYWORD_STOPS, *config.ENGLISH_WORDS}))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), n AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains({EN}, x))) AS en, len(list_filter(w, lambda x: list_contains({FR}, x))) AS fr FROM w)
SELECT doc_id, CASE WHEN en > fr THEN 'en' ELSE 'fr' END AS language FROM n""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.detect_language("text").alias("language"))


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS3}) AS word, generate_subscripts({WORDS3}, 1) AS pos FROM documents),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE NOT list_contains({STOPS}, word) GROUP BY ALL),
r AS (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) SELECT doc_id, word, n, rank FROM r WHERE rank <= 10""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent words of three characters or more, ties by first place."""
    rows = _docs(spark, sf_dir).select("doc_id", F.filter(t.words("text", 3), lambda x: ~x.isin(*config.KEYWORD_STOPS)).alias("words"))
    return t.top_words(rows, "doc_id", "words", 10)


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{4,}}') AS w FROM documents), f AS (SELECT doc_id, list_filter(w, lambda x: NOT list_contains({BOTH_STOPS}, x)) AS f FROM w),
p AS (SELECT doc_id, unnest(f) AS word, generate_subscripts(f, 1) AS pos FROM f), d AS (SELECT doc_id, word, min(pos) AS pos FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM d)
SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS keywords FROM r WHERE rn <= 10 GROUP BY doc_id""")
def unique_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(t.unique_keywords("text"), " ").alias("keywords")).filter("keywords != ''")


@query(f"""WITH w AS (SELECT doc_id, text, {WORDS} AS w, {WORDS3} AS w3 FROM documents), n AS (SELECT doc_id, text, greatest(len(w), 1) AS n, least(len(list_filter(list_distinct(w3), lambda x: NOT list_contains({STOPS}, x))), 100) AS terms, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::DOUBLE AS chars FROM w)
SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE least(greatest(terms / n * 0.5::DOUBLE + least((chars / n - 3) / 3, 1.0::DOUBLE) * 0.2::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END, 6) AS density FROM n""")
def info_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(t.info_density("text"), 6).alias("density"))


@query("""WITH q AS (SELECT doc_id, 'citation' AS type, unnest(regexp_extract_all(text, '[«"]([^«"]+)[»"]', 1)) AS text FROM documents UNION ALL SELECT doc_id, 'reference', unnest(regexp_extract_all(text, '\\[([^\\]]+)\\]', 1)) FROM documents
UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(text, 'https?://[^\\s)>]+')) FROM documents) SELECT doc_id, type, text FROM q""")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.inline(t.references("text")))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, length(regexp_replace(url, '[#?].*$', '')) AS n_path, greatest(1, length(html) // 4)::INTEGER AS tokens FROM pages")
def url_and_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"), F.length(F.regexp_replace("url", "[#?].*$", "")).cast("bigint").alias("n_path"), t.token_estimate("html").alias("tokens"))


@query("""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM documents), e AS (SELECT doc_id, unnest(s) AS sentence FROM s), n AS (SELECT doc_id, regexp_replace(sentence, '^\\s+|\\s+$', '', 'g') AS sentence FROM e)
SELECT doc_id, count(*) AS n_sentences, max(length(sentence)) AS longest, sum(length(sentence))::BIGINT AS chars FROM n WHERE sentence <> '' GROUP BY doc_id""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(t.sentences("text")).alias("sentence"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("sentence")).cast("bigint").alias("longest"), F.sum(F.length("sentence")).alias("chars"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS paragraph, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, (n - 1)::INTEGER AS n, md5(paragraph) AS hash FROM p WHERE trim(paragraph) <> ''""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "paragraph")).filter("trim(paragraph) != ''").select("doc_id", "n", F.md5("paragraph").alias("hash"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '# Title ' || doc_id ELSE text END AS text FROM documents), l AS (SELECT *, string_split(text, chr(10)) AS lines FROM d)
SELECT doc_id, length(substr(text, 1, 500)) - length(replace(substr(text, 1, 500), chr(10), '')) + 1 AS line, coalesce(trim(substr(list_filter(lines, lambda x: starts_with(x, '# '))[1], 3)), trim(list_filter(lines, lambda x: length(trim(x)) > 0)[1])) AS title FROM l""")
def title_and_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third text ends with a heading of its own; where a text has headings, the first is its title."""
    headed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n# Title "), F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    rows = _docs(spark, sf_dir).withColumn("text", headed)
    return rows.select("doc_id", t.line_number("text", F.lit(500)).cast("bigint").alias("line"), t.title("text").alias("title"))


def _pronoun_sql(language: str) -> str:
    listed = "|".join(t.PRONOUNS[language].split())
    return f"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}]+'), lambda x: regexp_full_match(x, '{listed}'))) AS n_pronouns FROM documents WHERE lang = '{language}'"""


@query(_pronoun_sql("fr") + " UNION ALL " + _pronoun_sql("en") + " UNION ALL " + _pronoun_sql("es"))
def pronoun_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.coalesce(*(F.when(F.col("lang") == k, F.size(t.pronouns("text", k))) for k in t.PRONOUNS))
    return _docs(spark, sf_dir).filter(F.col("lang").isin(*t.PRONOUNS)).select("doc_id", found.cast("bigint").alias("n_pronouns"))


@query("SELECT doc_id, md5(text) AS file_hash, length(text) AS size FROM documents")
def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("file_hash"), F.length("text").cast("bigint").alias("size"))


@query("""WITH w AS (SELECT p_partkey, p_name, list_distinct(string_split(lower(p_brand || '_' || p_type), '_')) AS a, list_distinct(string_split(lower(p_type || '_' || p_brand), '_')) AS b, lower(p_brand || '_' || p_type) AS x, lower(p_type || '_' || p_brand) AS y FROM part)
SELECT p_partkey, round(CASE WHEN x = y THEN 1.0::DOUBLE WHEN contains(x, y) OR contains(y, x) THEN 0.7::DOUBLE ELSE least(0.6::DOUBLE, len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE) END, 6) AS similarity FROM w""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.concat_ws("_", "p_brand", "p_type"), F.concat_ws("_", "p_type", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(t.name_similarity(a, b), 6).alias("similarity"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_brand || ' (' || p_type || ') ' || p_name), '\\([^)]*\\)', '', 'g'), '[_-]', ' ', 'g'), '[^\\p{L}\\p{N} ]', '', 'g'), ' +', ' ', 'g')) AS name FROM part")
def normalise_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", t.normalise_name(F.concat("p_brand", F.lit(" ("), "p_type", F.lit(") "), "p_name")).alias("name"))


@query("""WITH s(n, text) AS (SELECT doc_id, text FROM documents), c AS (SELECT n, text, regexp_split_to_array(text, '\\s+') AS w FROM s), k AS (SELECT n, text, w, array_to_string(w[1:60], ' ') AS cut FROM c),
p AS (SELECT *, length(cut) - instr(reverse(cut), '.') + 1 AS stop FROM k)
SELECT n AS doc_id, md5(CASE WHEN len(w) <= 60 THEN text WHEN instr(cut, '.') > 0 AND stop > 0.8 * length(cut) THEN substr(cut, 1, stop) ELSE cut || '...' END) AS summary FROM p""")
def summary_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.truncate_summary("text", 20)).alias("summary"))


@query("SELECT page_id, regexp_extract(url, '([^#/]*)[#/]?$', 1) AS label, regexp_extract(url, '^(.*[#/])[^#/]*$', 1) AS domain FROM pages")
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.uri_label("url").alias("label"), t.uri_domain("url").alias("domain"))


@query(with_sql("phrases") + """ SELECT conv_id, turn, original, replacement, CASE WHEN replace(upper(original), 'ẞ', 'SS') = original AND lower(original) <> original AND length(original) > 1 THEN replace(upper(replacement), 'ẞ', 'SS') WHEN replace(upper(substr(original, 1, 1)), 'ẞ', 'SS') = substr(original, 1, 1) AND lower(substr(original, 1, 1)) <> substr(original, 1, 1) THEN replace(upper(substr(replacement, 1, 1)), 'ẞ', 'SS') || substr(replacement, 2) ELSE replacement END AS adjusted FROM phrases""")
def adjust_casing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each turn, as they are and in capitals."""
    return frame(spark, "phrases", sf_dir).withColumn("adjusted", t.adjust_casing(F.col("original"), F.col("replacement")))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "code", sf_dir)


@query("""SELECT p_partkey || '.f90' AS file, 'step_' || split_part(p_name, ' ', 1) || ',step_two' AS calls, array_to_string(list_sort(['step_' || split_part(p_name, ' ', 1), 'step_three', 'step_two']), ',') AS calls_with_operators, 'subroutine demo' || p_partkey || '(x)' AS signature, 'f90' AS standard, 'demo' || p_partkey AS interface FROM part""")
def extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark, sf_dir).select(
        "file", F.array_join(t.extract_calls("text"), ",").alias("calls"), F.array_join(t.extract_calls("text", operators=True), ",").alias("calls_with_operators"),
        t.extract_signature("text").alias("signature"), t.language_standard("text").alias("standard"), F.array_join(t.public_interface("text"), ",").alias("interface"),
    )


@query("""SELECT p_partkey || '.f90' AS file, 'subroutine demo' || p_partkey || '(x)' || chr(10) || '  character(4) :: s = ''a!b''' || chr(10) || chr(10) || '  call step_' || split_part(p_name, ' ', 1) || '(x)' || chr(10) || '  y = step_two(x) + step_three(x)' || chr(10) || 'end subroutine demo' || p_partkey AS bare,
'subroutine demo' || p_partkey || '(x)' || chr(10) || '  character(4) :: s = ''a!b''' || chr(10) || '!$omp parallel' || chr(10) || '  call step_' || split_part(p_name, ' ', 1) || '(x)' || chr(10) || '  y = step_two(x) + step_three(x)' || chr(10) || 'end subroutine demo' || p_partkey AS cleaned FROM part""")
def remove_code_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark, sf_dir).select("file", t.remove_comments("text").alias("bare"), t.clean_code("text").alias("cleaned"))


def _pattern(label: str, concept: tuple) -> str:
    category, base, keys = concept
    score = " + ".join(f"contains(lower(name || ' ' || signature), '{k}')::INT + 2 * contains(lower(name), '{k}')::INT" for k in keys)
    return f"SELECT name, '{label}' AS label, '{category}' AS category, least(1.0::DOUBLE, ({score}) / {len(keys) + 2}.0::DOUBLE * {base}) AS confidence FROM patterned"


@query(with_sql("patterned") + " SELECT * FROM (" + " UNION ALL ".join(_pattern(*kv) for kv in t.CONCEPTS.items()) + ") WHERE confidence >= 0.3")
def pattern_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, "patterned", sf_dir)
    return rows.select("name", F.inline(t.pattern_concepts(F.concat_ws(" ", "name", "signature"), F.col("name"))))


@query("""WITH d AS (SELECT doc_id, lower(text) AS x FROM documents), s AS (SELECT doc_id, 'short_words' AS label, 2 * (contains(x, 'the'))::INT + 2 * (contains(x, 'and'))::INT AS s FROM d) SELECT doc_id, s::INTEGER AS score FROM s WHERE s >= 3""")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring of dictionary patterns, with a dictionary that fits the documents."""
    low = F.lower("text")
    score = 2 * F.contains(low, F.lit("the")).cast("int") + 2 * F.contains(low, F.lit("and")).cast("int")
    return _docs(spark, sf_dir).select("doc_id", score.alias("score")).filter("score >= 3")


@query("""SELECT p_partkey AS entity_id, label, confidence FROM part JOIN (VALUES (0, 'iterative_solver', 1.0::DOUBLE), (1, 'iterative_solver', 0.5::DOUBLE)) v(k, label, confidence) ON k = p_partkey % 3""")
def algorithmic_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By turns code that iterates and says so, code that names a residual, and code without a pattern, each with a part's name."""
    case = lambda a, b, c: F.when(F.col("p_partkey") % 3 == 0, a).when(F.col("p_partkey") % 3 == 1, b).otherwise(c)
    code = F.concat("p_name", case(F.lit(": do iteration until residual < tolerance; converge"), F.lit(": residual of grid"), F.lit(": print")))
    found = case(F.array(F.lit("iteration")), F.array(F.lit("residual_norm")), F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.inline(t.algorithmic_patterns(code, found)))


@query("""SELECT doc_id, doc_id || '-' || (doc_id + 3) || ',' || (doc_id + 5) || '-' || (doc_id + 8) || '|' || (doc_id + 20) || '-' || (doc_id + 22) || '|' || (doc_id + 60) || '-' || (doc_id + 63) AS groups FROM documents""")
def pronoun_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that lie as far into a text as its id says."""
    place = lambda a, z: F.struct((F.col("doc_id") + a).cast("int").alias("start"), (F.col("doc_id") + z).cast("int").alias("end"))
    groups = t.group_positions(F.array(place(0, 3), place(5, 8), place(20, 22), place(60, 63)), 3, 15)
    text = F.array_join(F.transform(groups, lambda g: F.array_join(F.transform(g, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")), "|")
    return _docs(spark, sf_dir).select("doc_id", text.alias("groups"))
