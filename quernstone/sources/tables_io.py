"""Other sources and sinks: gazetteer dumps, seeds, recorded answers, sheets and ledgers."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical

_CITY = "id bigint, name string, ascii string, alternates string, lat string, lon string, class string, code string, country string, cc2 string, division string, a2 string, a3 string, a4 string, population bigint, elevation string, dem string, zone string, modified string"


def gazetteer(spark: SparkSession, cities: str, divisions: str, countries: str) -> DataFrame:
    """A gazetteer from three tab-separated dumps, in the shape the readers take.

    Withdrawn countries (those the country file doesn't name) go, divisions that aren't defined are
    cleared, and alternates keep Latin names other than the city's own.
    """
    read = lambda path, schema: spark.read.csv(path, schema=schema, sep="\t", comment="#", quote="")
    own = read(countries, "country string, iso3 string, num string, fips string, country_name string").select("country", "country_name")
    parts = read(divisions, "code string, division_name string, ascii string, id bigint").select("code", "division_name")
    rows = read(cities, _CITY).join(own, "country")
    rows = rows.withColumn("code", F.concat_ws(".", "country", "division")).join(parts, "code", "left")
    latin = F.filter(F.array_distinct(F.split(F.coalesce("alternates", F.lit("")), ",")), lambda a: a.rlike(r"^[\p{IsLatin}\p{M}' .-]+$") & (F.lower(a) != F.lower(F.col("name"))))
    label = F.concat_ws(", ", "name", "division_name", "country_name")
    return rows.select(
        F.col("id").alias("city_id"), F.col("name").alias("city_name"), label.alias("canonical_label"), "country", "country_name",
        F.when(F.col("division_name").isNotNull(), F.col("division")).alias("division"), "division_name", "population", latin.alias("alternates"),
    )


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """source, slug, company, country of a JSON-lines seed list; a line that can't be read fails the read."""
    return spark.read.schema("source string, slug string, company string, country string").json(path, mode="FAILFAST")


def duplicate_seeds(rows: DataFrame) -> DataFrame:
    """id, n of boards that are listed more than once."""
    named = rows.select(F.concat_ws(":", "source", F.lower("slug")).alias("id"))
    return named.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def request_key(method: str, path: str, body: object) -> str:
    """The key under which an answer is recorded: a hash of the request in canonical form."""
    return hashlib.sha256(canonical([method.upper(), path, body]).encode()).hexdigest()


def replay(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests (key) with the recorded answer, null where none is."""
    return requests.join(recorded.dropDuplicates(["key"]), "key", "left")


def labelling_sheet(sample: DataFrame, questions: list[str], path: str) -> None:
    """A CSV with every field quoted and an empty column a question."""
    sample.withColumns({q: F.lit("") for q in questions}).coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True, emptyValue="")  # a sheet is for a reader


def append_ledger(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").json(path)
