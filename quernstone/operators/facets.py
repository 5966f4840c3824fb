"""Structured facets of postings as the source readers give them, and rows of the search index made of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import annual
from ..functions.places import locate
from ..functions.text import employment_types, is_placeholder


def derive(postings: DataFrame, homes: DataFrame, gazetteer: DataFrame, regions: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """id and facets of postings (columns of the source readers, and ``id``); ``homes``: board_id, home, one row a board.

    places, basis, countries, anywhere, workplace (the stated one before that of a label), employment_types,
    pay (yearly, with the stated interval), department, published_at, unmatched labels.
    """
    own = postings.where("id IS NOT NULL").join(homes.select("board_id", "home").dropDuplicates(["board_id"]), "board_id", "left")
    read = locate(own.select("id", F.col("locations").alias("labels"), F.col("places").alias("stated"), "country", "home"), gazetteer, regions)
    read = read.withColumnRenamed("workplace", "label_workplace")
    low, high = (annual(F.col(f"salary.{c}"), F.col("salary.interval")) for c in ("min", "max"))
    pay = F.when(F.col("salary").isNotNull(), F.struct(low.alias("pay_min"), high.alias("pay_max"), F.col("salary.currency").alias("currency"), F.col("salary.interval").alias("stated_per")))
    stated = own.select("id", "title", "board_id", "url", F.col("locations"), "workplace", employment_types(F.col("employment_type")).alias("employment_types"), pay.alias("pay"), "department", "published_at")
    both = stated.join(read, "id")
    countries = F.array_distinct(F.transform("places", lambda p: p["country"]))
    return both.select(
        "id", "title", "board_id", "url", "locations", "places", "basis", countries.alias("countries"), "anywhere", F.coalesce("workplace", "label_workplace").alias("workplace"), "employment_types", "pay", "department", "published_at", "unmatched",
    )


def index_rows(facets: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of the search index: ``seen`` (id, first_seen_at) dates postings without a publish time; placeholders are left out."""
    own = facets.join(seen.groupBy("id").agg(F.min("first_seen_at").alias("first_seen_at")), "id", "left")
    own = own.where(~is_placeholder(F.col("title"), F.col("locations")))
    return own.withColumns({"posted_at": F.coalesce("published_at", "first_seen_at"), "inferred": F.col("basis") == "home"}).drop("published_at", "first_seen_at")


def build_report(facets: DataFrame) -> DataFrame:
    """One row: postings, placeholders, how many by each basis, with a city, open to anywhere."""
    return facets.agg(
        F.count("*").alias("postings"), F.count_if(is_placeholder(F.col("title"), F.col("locations"))).alias("placeholders"), *[F.count_if(F.col("basis") == b).alias(f"by_{b}") for b in ("label", "stated", "home", "none")],
        F.count_if(F.exists("places", lambda p: p["city"].isNotNull())).alias("with_city"), F.count_if("anywhere").alias("anywhere"),
    )
