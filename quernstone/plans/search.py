"""Faceted search over open postings: a query object compiled to one plan.

Each filter that has a facet is a group; a facet counts the rows that fail no group or only its
own.  Recency, pay and text restrict every facet.  All facets come from one scan: flags, then rows
that fail at most one group, one explode, one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from urllib.parse import parse_qs, quote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import likeliest, pay_reach, probability_of
from ..functions.text import fold, fold_text
from ..operators.asking import criterion
from ..tables import cut, exists, latest

WORKPLACES = ("onsite", "hybrid", "remote")
EMPLOYMENT = ("full-time", "part-time", "contract", "internship", "temporary")
#: The options of each question, in the order of its stored shares.
QUESTIONS = {"arrangement": ("remote", "hybrid", "onsite", "not_stated"), "on_call": ("no", "yes")}
THRESHOLD = 50
PAGE = 50
WITHIN_DAYS = (1, 3, 7, 14, 30, 90)
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Criterion:
    """Rows whose answer to ``question`` is one of ``options`` with at least this share."""

    question: str
    options: tuple[str, ...]
    at_least: int = THRESHOLD


@dataclass(frozen=True)
class SearchQuery:
    """None is no filter; an empty tuple matches nothing.  Places are one filter in three parts."""

    countries: tuple[str, ...] | None = None
    divisions: tuple[str, ...] | None = None
    cities: tuple[int, ...] | None = None
    include_anywhere: bool = True
    workplaces: tuple[str, ...] | None = None
    employment: tuple[str, ...] | None = None
    companies: tuple[str, ...] | None = None
    within_days: int | None = None
    minimum_pay: tuple[float, str] | None = None
    text: str = ""
    answers: tuple[Criterion, ...] = ()
    sort_pay: str | None = None
    offset: int = 0
    limit: int = PAGE
    now_ms: int = 0
    region: str = ""

    #: A question someone wrote (kind, wording, choices), and which of its options a row must have with what share.
    asked: tuple[str, str, tuple[str, ...]] | None = None
    asked_filter: Criterion | None = None

    def __post_init__(self) -> None:
        for given, known in ((self.workplaces, WORKPLACES), (self.employment, EMPLOYMENT)):
            if unknown := set(given or ()) - set(known):
                raise ValueError(f"unknown values {sorted(unknown)}")
        if len({c.question for c in self.answers}) < len(self.answers):
            raise ValueError("one criterion a question")

    def toggled(self, name: str, value: str) -> SearchQuery:
        """With ``value`` put into the list filter, or taken out; an emptied list is no filter."""
        now = getattr(self, name) or ()
        after = tuple(x for x in now if x != value) if value in now else (*now, value)
        return replace(self, **{name: after or None}, offset=0)

    def cleared(self) -> SearchQuery:
        return SearchQuery(region=self.region, now_ms=self.now_ms)

    def active(self) -> list[str]:
        """The names of the filters that are set."""
        names = ("countries", "divisions", "cities", "workplaces", "employment", "companies", "within_days", "minimum_pay")
        return [n for n in names if getattr(self, n) is not None] + ["text"] * bool(self.text.strip()) + [f"answers:{c.question}" for c in self.answers]

    @classmethod
    def from_url(cls, query: str, now_ms: int = 0) -> SearchQuery:
        """From a query string; what isn't understood is left out."""
        given = {k: v[0] for k, v in parse_qs(query.lstrip("?"), keep_blank_values=True).items()}
        several = lambda name: tuple(dict.fromkeys(x.strip() for x in given.get(name, "").split(",") if x.strip()))
        known = lambda name, values: tuple(x for x in several(name) if x in values) or None
        days = given.get("within", "")
        currency = given.get("currency", "").upper()
        try:
            amount = float(given.get("pay", ""))
        except ValueError:
            amount = 0.0
        pay = (amount, currency) if 0 < amount < float("inf") and len(currency) == 3 and currency.isascii() and currency.isalpha() else None
        return cls(
            countries=tuple(dict.fromkeys(c.upper() for c in several("country"))) or None,
            workplaces=known("workplace", WORKPLACES), employment=known("type", EMPLOYMENT), companies=several("company") or None,
            within_days=int(days) if days.isdigit() and int(days) in WITHIN_DAYS else None, minimum_pay=pay, include_anywhere=given.get("anywhere") != "0",
            asked=(asked := _asked(given)), asked_filter=_asked_filter(given.get("cf", "")) if asked else None,
            text=given.get("q", "").strip(), answers=_criteria(given.get("a", "")), sort_pay=(pay[1] if pay else "USD") if given.get("sort") == "pay" else None, region=given.get("region", ""), now_ms=now_ms,
        )

    def to_url(self) -> str:
        """The query string, without defaults; where in the list one is isn't part of it."""
        amount = f"{self.minimum_pay[0]:g}" if self.minimum_pay else ""
        parts = {
            "region": self.region, "q": self.text.strip(), "country": ",".join(self.countries or ()), "workplace": ",".join(self.workplaces or ()), "type": ",".join(self.employment or ()), "company": ",".join(self.companies or ()),
            "within": str(self.within_days or ""), "pay": amount, "currency": self.minimum_pay[1] if self.minimum_pay else "", "anywhere": "" if self.include_anywhere else "0", "sort": "pay" if self.sort_pay else "",
            "a": ",".join(f"{c.question}:{'|'.join(c.options)}" + (f"@{c.at_least}" if c.at_least != THRESHOLD else "") for c in self.answers),
        }
        if self.asked:
            parts |= {"ck": self.asked[0], "cq": self.asked[1], "cc": "|".join(self.asked[2])}
            if f := self.asked_filter:
                parts["cf"] = "|".join(f.options) + (f"@{f.at_least}" if f.at_least != THRESHOLD else "")
        text = "&".join(f"{k}={quote(v, safe='')}" for k, v in parts.items() if v)
        return f"?{text}" if text else ""


def _asked(given: dict[str, str]) -> tuple[str, str, tuple[str, ...]] | None:
    """The question in a URL, if it is one that could be put."""
    choices = tuple(c.strip() for c in given.get("cc", "").split("|") if c.strip())
    try:
        q = criterion(given.get("ck", ""), given.get("cq", ""), choices)
    except ValueError:
        return None
    return q.kind, q.text, choices


def _asked_filter(text: str) -> Criterion | None:
    joined, at, share = text.strip().partition("@")
    options = tuple(dict.fromkeys(o for o in joined.split("|") if o))
    at_least = int(share) if share.isdigit() else THRESHOLD
    return Criterion("asked", options, at_least) if options and (not at or share.isdigit()) and 1 <= at_least <= 100 else None


def _criteria(text: str) -> tuple[Criterion, ...]:
    """``question:option|option@share`` parts separated by commas; the first of a question counts."""
    found: dict[str, Criterion] = {}
    for part in text.split(","):
        question, colon, rest = part.strip().partition(":")
        joined, at, share = rest.partition("@")
        options = tuple(dict.fromkeys(o for o in joined.split("|") if o))
        if not (colon and question.replace("_", "").isalnum() and options and question not in found) or at and not share.isdigit():
            continue
        at_least = int(share) if at else THRESHOLD
        if 1 <= at_least <= 100:
            found[question] = Criterion(question, options, at_least)
    return tuple(found.values())


def index_table(rows: DataFrame) -> DataFrame:
    """Each posting once, with the columns filters work on; answers of a wrong width are no answers.

    Of several rows of a posting the one posted last counts, of equally late ones that of the greatest hash.
    """
    one = latest(rows, ["id"], ["posted_at"])
    cols = {
        "countries": F.array_distinct(F.transform("places", lambda p: p["country"])),
        "divisions": F.array_distinct(F.array_compact(F.transform("places", lambda p: F.when(p["division"].isNotNull(), F.concat_ws(".", p["country"], p["division"]))))),
        "cities": F.array_distinct(F.array_compact(F.transform("places", lambda p: p["city"]))),
        "posted_day": F.floor(F.col("posted_at") / DAY_MS).cast("int"),
        "currency": F.col("pay.currency"),
        "reach": pay_reach(F.col("pay.pay_min"), F.col("pay.pay_max")),
        "search_text": fold(F.concat_ws(" ", "title", "company")),
    }
    for question, options in QUESTIONS.items():
        given = F.try_element_at("answers", F.lit(question))
        cols[f"q_{question}"] = F.when(F.size(given) == len(options), given)
    return one.withColumns(cols)


#: Rows of a file of the served index; small indexes are split further, so that all cores read.
FILE_ROWS, LEAST_FILE_ROWS = 250_000, 5_000
_served: dict[tuple[str, str], DataFrame] = {}


def serve(rows: DataFrame, path: str) -> DataFrame:
    """The index as files at ``path``, newest day first, written once: queries on it shuffle and fold nothing.

    A folder without its success mark is written anew; the name has to change with the rows (see ``tables.stamp``).
    """
    spark = rows.sparkSession
    key = (spark.sparkContext.applicationId, path)
    if key not in _served or not exists(spark, f"{path}/_SUCCESS"):
        if not exists(spark, f"{path}/_SUCCESS"):
            table = cut(index_table(rows))
            n = table.count()
            files = max(-(-n // FILE_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_FILE_ROWS)), 1)
            order = [F.col("posted_day").desc_nulls_last(), F.col("id")]
            table.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
        _served[key] = spark.read.parquet(path)
    return _served[key]


def _overlap(column: str, values: tuple | None, kind: str = "string") -> Column:
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, values)).cast(f"array<{kind}>")) if values else F.lit(False)


class Search:
    """The plan of one query over an index table."""

    def __init__(self, rows: DataFrame, query: SearchQuery):
        self.query = query
        if query.within_days is not None:
            rows = rows.where(F.col("posted_day") >= query.now_ms // DAY_MS - query.within_days)
        if query.minimum_pay:
            rows = rows.where((F.col("currency") == query.minimum_pay[1]) & (F.col("reach") >= query.minimum_pay[0]))
        for term in fold_text(query.text).split():
            rows = rows.where(F.contains("search_text", F.lit(term)))
        self.rows = rows
        self.groups: dict[str, Column] = {}
        if any(x is not None for x in (query.countries, query.divisions, query.cities)):
            anywhere = F.col("anywhere") if query.include_anywhere else F.lit(False)
            self.groups["country"] = anywhere | _overlap("countries", query.countries) | _overlap("divisions", query.divisions) | _overlap("cities", query.cities, "bigint")
        if query.workplaces is not None:
            self.groups["workplace"] = F.col("workplace").isin(*query.workplaces) if query.workplaces else F.lit(False)
        if query.employment is not None:
            self.groups["employment"] = _overlap("employment_types", query.employment)
        if query.companies is not None:
            self.groups["company"] = F.col("company").isin(*query.companies) if query.companies else F.lit(False)
        self.thresholds = dict.fromkeys(QUESTIONS, THRESHOLD)
        for c in query.answers:
            places = [QUESTIONS[c.question].index(o) for o in c.options if o in QUESTIONS.get(c.question, ())]
            if places:  # a question or options that don't exist are no filter
                self.thresholds[c.question] = c.at_least
                given = F.col(f"q_{c.question}")
                self.groups[f"answer:{c.question}"] = given.isNotNull() & (probability_of(given, places) >= c.at_least)
        self.filters = list(self.groups.values())  # a null is no match: as they are, they reach the files
        self.groups = {k: F.coalesce(v, F.lit(False)) for k, v in self.groups.items()}

    def matches(self) -> DataFrame:
        out = self.rows
        for f in self.filters:
            out = out.where(f)
        return out

    def total(self) -> DataFrame:
        return self.matches().agg(F.count("*").alias("total"))

    def page(self) -> DataFrame:
        """The asked-for rows with their place: newest day first (no day last), then id; or by pay first."""
        q, order = self.query, [F.col("posted_day").desc_nulls_last(), F.col("id")]
        if q.sort_pay:
            order.insert(0, F.when(F.col("currency") == q.sort_pay, F.col("reach")).desc_nulls_last())
        top = self.matches().orderBy(*order).limit(q.offset + q.limit)
        # the page is at most offset + limit rows in one task already: numbering them moves nothing
        place = F.row_number().over(Window.orderBy(*order))
        numbered = top.withColumn("place", place).where(F.col("place") > q.offset)
        return numbered.select("place", "id", "title", "company", "workplace", "posted_day", F.array_join("countries", ",").alias("countries"), F.array_join("employment_types", ",").alias("employment"), "currency", "reach")

    def facets(self) -> DataFrame:
        """facet, value, n of every facet.  ``answered:q`` has how many rows hold an answer to q."""
        failed = sum(((~g).cast("int") for g in self.groups.values()), F.lit(0))
        own = {name: (~g) for name, g in self.groups.items()}
        flagged = self.rows.withColumn("failed", failed)
        for i, (name, out) in enumerate(own.items()):
            flagged = flagged.withColumn(f"out_{i}", out)
        at = {name: i for i, name in enumerate(own)}
        flagged = flagged.where("failed <= 1")
        keep = lambda name: (F.col("failed") == 0) | (F.col(f"out_{at[name]}") if name in at else F.lit(False))
        one = lambda facet, value, any_=F.lit(False): F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value"), any_.alias("anywhere"))
        anywhere = F.col("anywhere") if self.query.include_anywhere else F.lit(False)
        lists = [
            F.when(keep("country"), F.transform("countries", lambda c: one("country", c, anywhere))),
            F.when(keep("country") & anywhere, F.array(one("country", F.lit(None), anywhere))),
            F.when(keep("workplace") & F.col("workplace").isNotNull(), F.array(one("workplace", F.col("workplace")))),
            F.when(keep("employment"), F.transform(F.array_distinct("employment_types"), lambda t: one("employment", t))),
            F.when(keep("company") & F.col("company").isNotNull(), F.array(one("company", F.col("company")))),
        ]
        for question, options in QUESTIONS.items():
            given = F.col(f"q_{question}")
            named = F.array(*map(F.lit, options))
            def option(p: Column, i: Column) -> Column:  # called at once, so it may use the loop's names
                return F.when(p >= self.thresholds[question], one(f"answer:{question}", F.get(named, i)))

            reached = F.array_compact(F.transform(given, option))
            lists += [F.when(keep(f"answer:{question}"), reached), F.when(keep(f"answer:{question}") & given.isNotNull(), F.array(one(f"answered:{question}", F.lit(question))))]
        empty = F.array().cast("array<struct<facet:string,value:string,anywhere:boolean>>")
        values = flagged.select(F.explode(F.flatten(F.array(*[F.coalesce(x, empty) for x in lists]))).alias("v")).select("v.*")
        counts = values.groupBy("facet", "value").agg(F.count("*").alias("n"), F.count_if("anywhere").alias("n_any"))
        # a row open to anywhere would show for each country: those not counted for it are added
        all_any = F.max(F.when(F.col("value").isNull(), F.col("n"))).over(Window.partitionBy("facet"))
        fixed = counts.withColumn("all", F.coalesce(all_any, F.lit(0))).where("value IS NOT NULL")
        return fixed.select("facet", "value", F.when(F.col("facet") == "country", F.col("n") + F.col("all") - F.col("n_any")).otherwise(F.col("n")).alias("n"))

    def ranked_facets(self, most: int = 12) -> DataFrame:
        """The ``most`` largest values of each facet, ties by name as a reader would sort them."""
        order = Window.partitionBy("facet").orderBy(F.col("n").desc(), F.collate("value", "UNICODE"), "value")
        return self.facets().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    def row_answers(self) -> DataFrame:
        """id, question, option, share: the likeliest answer of each matching row."""
        parts = []
        for question, options in QUESTIONS.items():
            best = likeliest(F.col(f"q_{question}"))
            parts.append(F.when(F.col(f"q_{question}").isNotNull(), F.struct(F.lit(question).alias("question"), F.get(F.array(*map(F.lit, options)), best).alias("option"), F.get(F.col(f"q_{question}"), best).alias("share"))))
        return self.matches().select("id", F.explode(F.array_compact(F.array(*parts))).alias("a")).select("id", "a.*")
