"""Pages to Markdown-like text with column expressions: scripts out, headings and lists marked, tags dropped, entities decoded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities that are decoded.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def html_title(html: Column | str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_to_text(html: Column | str) -> Column:
    """Body text: no scripts, styles or comments; # headings, - items, blank lines between blocks, at most one in a row."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<head\b.*?</head\s*>", "")
    for level in range(1, 7):
        x = F.regexp_replace(x, rf"(?i)<h{level}\b[^>]*>", "\n\n" + "#" * level + " ")
    x = F.regexp_replace(x, r"(?i)<li\b[^>]*>", "\n- ")
    x = F.regexp_replace(x, r"(?i)<br\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"(?i)</?(?:p|div|ul|ol|table|tr|article|section|nav|h[1-6])\b[^>]*>", "\n\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    x = reduce(lambda s, e: F.replace(s, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), x)
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t\r]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))
