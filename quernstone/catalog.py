"""Every core query by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import snapshots
from .plans import answer_queries, lifecycle_queries, more_queries, search_queries, source_queries
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(snapshots.CHANGES_SQL)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.changes(table(spark, sf, "board_listings"), table(spark, sf, "board_crawls"))


for _part in (search_queries, lifecycle_queries, answer_queries, source_queries, more_queries):
    _part.register(query)
