"""All queries by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql gives the same rows over the same tables."""

    def register(run: Query) -> Query:
        key = name or run.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Modules of queries; each registers its own.
MODULES: tuple[str, ...] = ("retrieval", "memory", "text", "ontology", "graph", "ranking", "corpus", "splitting", "files", "relations", "contexts", "documents", "networks", "selection")

for _module in MODULES:
    import_module(f"strata.plans.{_module}")
