"""Job listings of three systems, as JSON documents, to one row per posting.

Each reader takes a DataFrame with ``board_id`` and ``body`` (the JSON text of one listing) and
gives one row per job: first of equal external ids, kind posting, invalid or unlisted.  Unknown
fields are ignored; a listing that cannot be read, or a job without a readable id, fails the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import salary_range
from ..functions.text import clean_list, clean_text, escape_html, html_to_text, place_text

HOSTS = {
    "greenhouse": ("boards-api.greenhouse.io", "/v1/boards/{}/jobs?content=true"),
    "lever": ("api.lever.co", "/v0/postings/{}?mode=json"),
    "lever-eu": ("api.eu.lever.co", "/v0/postings/{}?mode=json"),
    "ashby": ("api.ashbyhq.com", "/posting-api/job-board/{}?includeCompensation=true"),
}

_GREENHOUSE = "jobs array<struct<id: string, title: string, absolute_url: string, location: struct<name: string>, offices: array<struct<name: string, location: string>>, departments: array<struct<name: string>>, language: string, first_published: string, content: string>>"
_LEVER = "array<struct<id: string, text: string, hostedUrl: string, applyUrl: string, categories: struct<location: string, allLocations: array<string>, commitment: string, department: string, team: string>, country: string, workplaceType: string, createdAt: bigint, salaryRange: struct<min: double, max: double, currency: string, interval: string>, description: string, lists: array<struct<text: string, content: string>>, additional: string>>"
_POSTAL = "struct<postalAddress: struct<addressLocality: string, addressRegion: string, addressCountry: string>>"
_ASHBY = f"jobs array<struct<id: string, title: string, jobUrl: string, applyUrl: string, location: string, address: {_POSTAL}, secondaryLocations: array<struct<location: string, address: {_POSTAL}>>, isListed: boolean, isRemote: boolean, workplaceType: string, employmentType: string, department: string, team: string, publishedAt: string, compensation: struct<summaryComponents: array<struct<compensationType: string, minValue: double, maxValue: double, currencyCode: string, interval: string>>>, descriptionHtml: string>>"

#: Intervals as each system writes them (fixed values).
_LEVER_PER = {"per-year-salary": "year", "per-month-salary": "month", "per-week-salary": "week", "per-day-wage": "day", "per-hour-wage": "hour"}
_ASHBY_PER = {"1 YEAR": "year", "1 MONTH": "month", "1 WEEK": "week", "1 DAY": "day", "1 HOUR": "hour"}
_WORKPLACES = {"onsite": "onsite", "on-site": "onsite", "hybrid": "hybrid", "remote": "remote"}


def url(source: str, slug: str) -> str:
    from urllib.parse import quote

    host, path = HOSTS[source]
    return f"https://{host}{path.format(quote(slug, safe=''))}"


def _lookup(c: Column, known: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.coalesce(c, F.lit("")))


def _jobs(df: DataFrame, read: Column) -> DataFrame:
    """One row a job: the first of each external id."""
    jobs = df.withColumn("jobs", read)
    bad = F.raise_error(F.concat(F.lit("no listing: "), F.coalesce("board_id", F.lit("?"))))
    jobs = jobs.select("board_id", F.posexplode(F.when(F.col("jobs").isNull(), bad.cast(dict(jobs.dtypes)["jobs"])).otherwise(F.col("jobs"))).alias("pos", "j"))
    jobs = jobs.withColumn("external_id", F.coalesce(F.nullif(F.col("j.id"), F.lit("")), F.raise_error(F.lit("a job without an id")).cast("string")))
    first = jobs.groupBy("board_id", "external_id").agg(F.min_by("j", "pos").alias("j"), F.count("*").alias("copies"))
    return first


def _with_kind(rows: DataFrame, url_: Column, unlisted: Column | None = None) -> DataFrame:
    ok = F.col("title").isNotNull() & F.coalesce(url_.rlike(r"^https?://[^\s]+$"), F.lit(False))
    kind = F.when(ok, "posting").otherwise("invalid")
    if unlisted is not None:
        kind = F.when(F.coalesce(unlisted, F.lit(False)), "unlisted").otherwise(kind)
    return rows.withColumn("kind", kind)


_COLUMNS = ["board_id", "external_id", "kind", "title", "url", "apply_url", "locations", "places", "country", "workplace", "employment_type", "department", "team", "language", "published_at", "salary", "description_html"]


def _place(label: Column, text: Column) -> Column:
    return F.struct(label.alias("label"), text.alias("text"))


def greenhouse(df: DataFrame) -> DataFrame:
    rows = _jobs(df, F.from_json("body", _GREENHOUSE)["jobs"])
    offices = F.transform("j.offices", lambda o: F.coalesce(clean_text(o["location"]), clean_text(o["name"])))
    places = F.transform(F.array_distinct(F.array_compact(F.coalesce(offices, F.array().cast("array<string>")))), lambda t: _place(F.lit(None).cast("string"), t))
    # escaped once unless the content already has tags
    content = F.when(F.col("j.content").rlike("<[A-Za-z/]"), F.col("j.content")).otherwise(_unescaped(F.col("j.content")))
    rows = rows.withColumns({
        "title": clean_text(F.col("j.title")), "url": F.col("j.absolute_url"), "apply_url": F.lit(None).cast("string"), "locations": clean_list(F.array("j.location.name")), "places": places,
        "country": F.lit(None).cast("string"), "workplace": F.lit(None).cast("string"), "employment_type": F.lit(None).cast("string"), "department": clean_text(F.get("j.departments", F.lit(0))["name"]), "team": F.lit(None).cast("string"),
        "language": clean_text(F.col("j.language")), "published_at": _millis("j.first_published"), "salary": salary_range(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("string")), "description_html": content,
    })
    return _with_kind(rows, F.col("url")).select(_COLUMNS)


def _unescaped(c: Column) -> Column:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def _millis(name: str) -> Column:
    return F.unix_millis(F.try_to_timestamp(F.col(name)))


def lever(df: DataFrame) -> DataFrame:
    rows = _jobs(df, F.from_json("body", _LEVER))
    stated = F.when(F.size("j.categories.allLocations") > 0, F.col("j.categories.allLocations")).otherwise(F.array("j.categories.location"))
    lists = F.transform("j.lists", lambda x: F.concat(F.lit("<h3>"), escape_html(x["text"]), F.lit("</h3><ul>"), x["content"], F.lit("</ul>")))
    html = F.concat(F.coalesce("j.description", F.lit("")), F.array_join(F.coalesce(lists, F.array().cast("array<string>")), ""), F.coalesce("j.additional", F.lit("")))
    pay = "j.salaryRange"
    country = F.upper(F.trim("j.country"))
    rows = rows.withColumns({
        "title": clean_text(F.col("j.text")), "url": F.col("j.hostedUrl"), "apply_url": F.col("j.applyUrl"), "locations": clean_list(stated), "places": F.array().cast("array<struct<label:string,text:string>>"),
        "country": F.when(country.rlike("^[A-Z]{2}$"), country), "workplace": _lookup(F.lower(F.trim("j.workplaceType")), _WORKPLACES), "employment_type": clean_text(F.col("j.categories.commitment")),
        "department": clean_text(F.col("j.categories.department")), "team": clean_text(F.col("j.categories.team")), "language": F.lit(None).cast("string"), "published_at": F.col("j.createdAt"),
        "salary": salary_range(F.col(f"{pay}.min"), F.col(f"{pay}.max"), F.col(f"{pay}.currency"), _lookup(F.col(f"{pay}.interval"), _LEVER_PER)), "description_html": html,
    })
    return _with_kind(rows, F.col("url")).select(_COLUMNS)


def ashby(df: DataFrame) -> DataFrame:
    rows = _jobs(df, F.from_json("body", _ASHBY)["jobs"])
    none = F.array().cast(f"array<struct<location:string,address:{_POSTAL.replace(': ', ':')}>>")
    all_ = F.concat(F.array(F.struct(F.col("j.location").alias("location"), F.col("j.address").alias("address"))), F.coalesce("j.secondaryLocations", none))
    postal = lambda e: place_text(F.array(*[e["address"]["postalAddress"][x] for x in ("addressLocality", "addressRegion", "addressCountry")]))
    places = F.filter(F.array_distinct(F.transform(all_, lambda e: _place(clean_text(e["location"]), postal(e)))), lambda p: p["text"].isNotNull())
    pay = F.get(F.filter("j.compensation.summaryComponents", lambda c: c["compensationType"] == "Salary"), F.lit(0))
    declared = _lookup(F.lower(F.regexp_replace("j.workplaceType", "[^A-Za-z]", "")), _WORKPLACES)
    rows = rows.withColumns({
        "title": clean_text(F.col("j.title")), "url": F.col("j.jobUrl"), "apply_url": F.col("j.applyUrl"), "locations": clean_list(F.transform(all_, lambda e: e["location"])), "places": places,
        "country": F.lit(None).cast("string"), "workplace": F.coalesce(declared, F.when(F.col("j.isRemote"), "remote")), "employment_type": clean_text(F.col("j.employmentType")), "department": clean_text(F.col("j.department")),
        "team": clean_text(F.col("j.team")), "language": F.lit(None).cast("string"), "published_at": _millis("j.publishedAt"),
        "salary": salary_range(pay["minValue"], pay["maxValue"], pay["currencyCode"], _lookup(pay["interval"], _ASHBY_PER)), "description_html": F.col("j.descriptionHtml"),
    })
    return _with_kind(rows, F.col("url"), F.col("j.isListed") == F.lit(False)).select(_COLUMNS)


READERS = {"greenhouse": greenhouse, "lever": lever, "lever-eu": lever, "ashby": ashby}


def counts(df: DataFrame) -> DataFrame:
    """board_id, kind, n of what a reader gave."""
    return df.groupBy("board_id", "kind").agg(F.count("*").alias("n"))


def exported(rows: DataFrame) -> DataFrame:
    """The table of texts that criteria are asked about: plain-text descriptions of postings."""
    own = rows.where("kind = 'posting'")
    return own.select("board_id", "external_id", "title", F.to_json("locations").alias("locations_json"), html_to_text("description_html").alias("description"))
