"""Answers to a question someone put to the rows of a search, held beside the index.

``held``: id, distribution, one row a posting (see ``asking.merged``).  Facets of the index stay as
they are: the filter works on what the index query gave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import likeliest, probability_of

#: Rows a question may be put to at once.
ASKABLE = 500


def askable(matches: DataFrame, most: int = ASKABLE) -> DataFrame:
    """total, askable: whether there are rows to ask and no more than ``most``; no row beyond these is counted."""
    return matches.limit(most + 1).agg(F.count("*").alias("total")).select("total", ((F.col("total") > 0) & (F.col("total") <= most)).alias("askable"))


def passing(matches: DataFrame, held: DataFrame, options: tuple[str, ...], wanted: tuple[str, ...], at_least: int) -> DataFrame:
    """The rows whose answer is one of ``wanted`` with that share; no row without an answer passes, at any share."""
    at = [options.index(o) for o in wanted if o in options]
    if not at:
        return matches.where(F.lit(False))
    ok = held.where(F.col("distribution").isNotNull() & (probability_of(F.col("distribution"), at) >= at_least)).select("id")
    return matches.join(ok, "id", "left_semi")


def answered_among(shown: DataFrame, held: DataFrame) -> DataFrame:
    """answered: how many of the shown rows have an answer."""
    return shown.join(held.where("distribution IS NOT NULL").select("id"), "id", "left_semi").agg(F.count("*").alias("answered"))


def facet(shown: DataFrame, held: DataFrame, options: tuple[str, ...]) -> DataFrame:
    """option, n: the likeliest answer of each shown row that has one."""
    option = F.get(F.array(*map(F.lit, options)), likeliest(F.col("distribution")))
    return shown.select("id").join(held.where("distribution IS NOT NULL"), "id").groupBy(option.alias("option")).agg(F.count("*").alias("n"))
