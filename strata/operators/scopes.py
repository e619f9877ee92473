"""Scopes of a search: all, a project, a file type, or any part of a project's name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_scope(rows: DataFrame, scope: str, *, project: str = "project", kind: str = "file_type") -> DataFrame:
    low = scope.strip().lower()
    if low in ("", "all"):
        return rows
    head, _, rest = low.partition(":")
    if head == "project":
        return rows.filter(F.lower(project) == rest)
    if head == "type":
        return rows.filter(F.lower(kind) == rest)
    return rows.filter(F.contains(F.lower(project), F.lit(low)))
