"""Text scalars as column expressions: language, keywords, density, references, code cleaning, calls, names, concepts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import config

WORD = r"[\p{L}\p{N}_]+"

#: Names that look like calls in code but are not, signature and standard patterns, concept dictionaries.
CODE_KEYWORDS = "if then else elseif endif do while end call return stop write read print open close allocate deallocate select case where forall module program subroutine function contains use implicit none integer real logical character complex type class interface public private intent in out inout parameter dimension pointer target optional save data common".split()
SIGNATURES = (r"(?im)^\s*((?:recursive |pure |elemental )*subroutine\s+\w+\s*\([^)]*\))", r"(?im)^\s*((?:[\w()*= ]+ )?function\s+\w+\s*\([^)]*\)(?:\s*result\s*\(\w+\))?)", r"(?im)^\s*(module\s+\w+)\s*$")
STANDARDS = (("f2008", r"(?i)\b(?:submodule|coarray|do\s+concurrent)\b"), ("f2003", r"(?i)\b(?:class\s*\(|extends\s*\(|abstract\s+interface|procedure\s*\()"), ("f95", r"(?i)\b(?:forall|pure|elemental)\b"), ("f77", r"(?im)^\s*(?:common\s*/|goto\s+\d+|[cC]\s)"))
CONCEPTS = {
    "molecular_dynamics": ("dynamics", 0.9, ("velocity", "position", "trajectory", "timestep", "integrator")),
    "linear_algebra": ("mathematics", 0.8, ("matrix", "vector", "eigenvalue", "norm", "solver")),
    "grid": ("structure", 0.7, ("grid", "mesh", "cell", "domain")),
    "io": ("system", 0.6, ("read", "write", "open", "file")),
}
ALGORITHMS = {
    "iterative_solver": ("iteration", "residual", "tolerance", "converge"),
    "monte_carlo": ("random", "sample", "accept", "metropolis"),
    "finite_difference": ("stencil", "laplacian", "grid", "derivative"),
}
PRONOUNS = {"fr": "il elle ils elles lui leur celui celle ceux celles", "en": "he she it they him her them his hers its their", "es": "él ella ellos ellas le les lo la los las"}

#: Rows whose words are counted at once.
_LISTS = 256


def words(text: Column | str, least: int = 1) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(f"[\\p{{L}}\\p{{N}}_]{{{least},}}"), 0)
    return F.coalesce(found, F.array().cast("array<string>"))


def _among(tokens: Column, listed: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(*listed)))


def detect_language(text: Column | str) -> Column:
    """fr or en, whichever list of frequent words has more hits; a tie is fr."""
    w = words(text)
    return F.when(_among(w, config.ENGLISH_WORDS) > _among(w, config.FRENCH_WORDS), "en").otherwise("fr")


def info_density(text: Column | str) -> Column:
    """Half the share of distinct content words (100 at most) plus up to 0.2 for word length over three; 0 for empty texts."""

    def score(tokens: Column) -> Column:
        content = F.filter(tokens, lambda x: (F.length(x) > 2) & ~x.isin(*config.KEYWORD_STOPS))
        n = F.greatest(F.size(tokens), F.lit(1))
        mean = F.aggregate(tokens, F.lit(0), lambda a, x: a + F.length(x)) / n
        return F.least(F.size(F.array_distinct(content)), F.lit(100)) / n * 0.5 + F.least((mean - 3) / 3, F.lit(1.0)) * 0.2

    # a lambda's argument is computed once, so the text is split once
    value = F.transform(F.array(words(text)), score)[0]
    return F.when(F.length(text) == 0, 0.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def top_words(rows: DataFrame, key: str, tokens: str, k: int) -> DataFrame:
    """key (long), word, n, rank: the k most frequent strings of each row's array, ties by first place. Counted inside Arrow batches: nothing is shuffled."""
    schema = pa.schema([(key, pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("rank", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, _LISTS) for b in batches for at in range(0, len(b), _LISTS)):
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            row, code = np.repeat(np.arange(len(size)), size), coded.indices.to_numpy()
            pair, first, n = np.unique(row * len(coded.dictionary) + code, return_index=True, return_counts=True)
            row = row[first]
            order = np.lexsort((first, -n, row))
            row, first, n = row[order], first[order], n[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            use = rank <= k
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[use])), coded.dictionary.take(pa.array(code[first[use]])), pa.array(n[use]), pa.array(rank[use])], schema=schema)

    return rows.select(F.col(key).cast("long").alias(key), tokens).mapInArrow(count, f"{key} long, word string, n long, rank long")


def unique_keywords(text: Column | str, most: int = 10) -> Column:
    """First distinct words of four characters or more that are no stop words, in order."""
    stops = sorted({*config.KEYWORD_STOPS, *config.ENGLISH_WORDS})
    return F.slice(F.array_distinct(F.filter(words(text, 4), lambda x: ~x.isin(*stops))), 1, most)


def references(text: Column | str) -> Column:
    """Quoted phrases, bracketed references and links, each with its kind."""
    kinds = (("citation", "[«\"]([^«\"]+)[»\"]", 1), ("reference", r"\[([^\]]+)\]", 1), ("url", r"https?://[^\s)>]+", 0))
    col = F.col(text) if isinstance(text, str) else text

    def named(kind: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(col, F.lit(pattern), group), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("text")))

    return F.concat(*(named(*k) for k in kinds))


def title(text: Column | str) -> Column:
    """First first-level heading, else the first line that is not blank."""
    lines = F.split(text, "\n")
    heads = F.filter(lines, lambda x: x.startswith("# "))
    return F.coalesce(F.trim(F.substring(F.get(heads, F.lit(0)), 3, 1 << 30)), F.trim(F.get(F.filter(lines, lambda x: F.length(F.trim(x)) > 0), F.lit(0))))


def header_level(line: Column | str) -> Column:
    """Level of a heading line: # marks, the depth of a number, 1 for capitals; null if it is none."""
    marks = F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)\.?\s+[A-Z]", 1)
    capital = F.trim(line).rlike(r"^[A-Z][A-Z0-9 ]{3,}$")
    return F.when(marks > 0, marks).when(number != "", F.size(F.split(number, r"\."))).when(capital, 1)


def line_number(text: Column | str, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def normalise_name(text: Column | str) -> Column:
    """For comparing entities: no parenthesised part, lower case, _ and - as spaces, no other punctuation."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), r"\([^)]*\)", ""), "[_-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N} ]", ""), " +", " "))


def remove_comments(code: Column | str) -> Column:
    """Cuts every line at the first ! outside quotes."""
    body = F.regexp_replace(code, r"(?m)^((?:[^!'\"\n]|'[^'\n]*'|\"[^\"\n]*\")*)!.*$", "$1")
    return F.regexp_replace(body, r"(?m)[ \t]+$", "")


def clean_code(code: Column | str) -> Column:
    """Drops comments but keeps directives (!$omp, !DIR$, ...) and preprocessor lines; at most two blank lines stay together."""
    kept = F.transform(F.split(code, "\n"), lambda x: F.when(x.rlike(r"^\s*(?:!\$|![A-Za-z]+\$|#)"), x).otherwise(F.regexp_replace(x, r"^((?:[^!'\"]|'[^']*'|\"[^\"]*\")*)!.*$", "$1")))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: F.rtrim(x)), "\n"), "\n{4,}", "\n\n\n")


def _names(code: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(code, F.lit(pattern), 1), lambda x: F.lower(x))


def extract_calls(code: Column | str, operators: bool = False) -> Column:
    """Sorted names in ``call x`` and ``= x(``, with operators also ``+ x(`` and the like; no keywords, three characters or more."""
    body = remove_comments(code)
    found = F.array_union(_names(body, r"(?i)\bcall\s+(\w+)"), _names(body, r"=\s*(\w+)\s*\("))
    if operators:
        found = F.array_union(found, _names(body, r"[-+*/,(]\s*([A-Za-z]\w*)\s*\("))
    return F.array_sort(F.filter(found, lambda x: (F.length(x) > 2) & ~x.isin(*CODE_KEYWORDS)))


def extract_signature(code: Column | str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(code, p, 1)), F.lit("")) for p in SIGNATURES))


def public_interface(code: Column | str, most: int = 10) -> Column:
    """Names listed after ``public ::``, else all subroutines and functions; the first ten."""
    listed = F.filter(F.transform(F.split(F.array_join(F.regexp_extract_all(F.lower(code), F.lit(r"(?m)^\s*public\s*::\s*(.*)$"), 1), ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    found = _names(F.lower(code), r"(?m)^\s*(?!end)(?:[\w()*= ]+ )?(?:subroutine|function)\s+(\w+)")
    return F.slice(F.when(F.size(listed) > 0, listed).otherwise(F.array_distinct(found)), 1, most)


def language_standard(code: Column | str) -> Column:
    """Newest standard one of whose constructs occurs; f90 if none."""
    col = F.col(code) if isinstance(code, str) else code
    return reduce(lambda rest, s: F.when(col.rlike(s[1]), s[0]).otherwise(rest), reversed(STANDARDS), F.lit("f90"))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.7 if one holds the other, else the share of common _ parts, at most 0.6."""
    x, y = F.lower(a), F.lower(b)
    p, q = F.array_distinct(F.split(x, "_")), F.array_distinct(F.split(y, "_"))
    common = F.size(F.array_intersect(p, q)) / F.greatest(F.size(p), F.size(q))
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.7).otherwise(F.least(F.lit(0.6), common))


def pattern_concepts(text: Column, name: Column) -> Column:
    """Concepts by dictionary: a keyword in the text counts 1, in the name 2; confidence 0.3 or more stays."""
    rows = []
    for label, (category, base, keys) in CONCEPTS.items():
        score = reduce(lambda s, k: s + F.contains(F.lower(text), F.lit(k)).cast("int") + 2 * F.contains(F.lower(name), F.lit(k)).cast("int"), keys, F.lit(0))
        rows.append(F.struct(F.lit(label).alias("label"), F.lit(category).alias("category"), F.least(F.lit(1.0), score / (len(keys) + 2) * base).alias("confidence")))
    return F.filter(F.array(*rows), lambda r: r["confidence"] >= 0.3)


def _names_any(labels: Column, key: str) -> Column:
    return F.exists(labels, lambda c: F.contains(F.lower(c), F.lit(key)))


def algorithmic_patterns(text: Column, concepts: Column) -> Column:
    """Patterns by dictionary: a keyword in the code counts 2, in a concept label 3; a score of 3 counts; the five best."""
    rows = []
    for label, keys in ALGORITHMS.items():
        score = reduce(lambda s, k: s + 2 * F.contains(F.lower(text), F.lit(k)).cast("int") + 3 * _names_any(concepts, k).cast("int"), keys, F.lit(0))
        rows.append(F.struct((-score).alias("order"), F.lit(label).alias("label"), F.least(F.lit(1.0), score / 10).alias("confidence")))
    ranked = F.array_sort(F.filter(F.array(*rows), lambda r: r["order"] <= -3))
    return F.transform(F.slice(ranked, 1, 5), lambda r: F.struct(r["label"].alias("label"), r["confidence"].alias("confidence")))


def pronouns(text: Column | str, language: str) -> Column:
    """All pronouns of a language in order of their place, in lower case."""
    listed = "|".join(PRONOUNS[language].split())
    return F.transform(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(rf"(?iU)(?<![\p{{L}}])({listed})(?![\p{{L}}])"), 1), lambda x: F.lower(x))


def adjust_casing(original: Column, replacement: Column) -> Column:
    """The replacement in the original's casing: all capitals, or a capital first letter, or as it is."""
    upper = (F.upper(original) == original) & (F.lower(original) != original) & (F.length(original) > 1)
    first = F.substring(original, 1, 1)
    titled = (F.upper(first) == first) & (F.lower(first) != first)
    capital = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, 1 << 30))
    return F.when(upper, F.upper(replacement)).when(titled, capital).otherwise(replacement)


def uri_label(uri: Column | str) -> Column:
    return F.regexp_extract(uri, r"([^#/]*)[#/]?$", 1)


def uri_domain(uri: Column | str) -> Column:
    return F.regexp_extract(uri, r"^(.*[#/])[^#/]*$", 1)


def token_estimate(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / config.CHARS_PER_TOKEN).cast("int"))


def truncate_summary(text: Column | str, tokens: int) -> Column:
    """At most 3 * tokens words; cut after the last full stop if that lies beyond 80 %."""
    w = F.split(text, r"\s+")
    cut = F.array_join(F.slice(w, 1, 3 * tokens), " ")
    stop = F.length(cut) - F.instr(F.reverse(cut), ".") + 1
    short = F.when((F.instr(cut, ".") > 0) & (stop > 0.8 * F.length(cut)), F.substring(cut, F.lit(1), stop)).otherwise(F.concat(cut, F.lit("...")))
    return F.when(F.size(w) <= 3 * tokens, F.col(text) if isinstance(text, str) else text).otherwise(short)


def sentences(text: Column | str) -> Column:
    """Split behind . ! ? before white space and a capital letter; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def doi(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(text, r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)", 1), F.lit(""))


def group_positions(found: Column, most: int, span: int) -> Column:
    """Items (structs with start and end, in order) folded into groups of at most ``most`` items and ``span`` characters."""

    def step(groups: Column, x: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        fits = (F.size(groups) > 0) & (F.size(last) < most) & (x["end"] - last[0]["start"] <= span)
        return F.when(fits, F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(F.concat(last, F.array(x))))).otherwise(F.concat(groups, F.array(F.array(x))))

    return F.aggregate(found, F.array().cast("array<array<struct<start:int,end:int>>>"), step)
