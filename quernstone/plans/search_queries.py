"""Search queries over index_rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import held as H
from ..tables import shared, stamp, table
from .search import QUESTIONS, Criterion, Search, SearchQuery, serve

NOW = 1_783_641_600_000
_Q = SearchQuery(now_ms=NOW)


def _search(spark: SparkSession, sf: str, query: SearchQuery) -> Search:
    return Search(served(spark, sf), query)


def served(spark: SparkSession, sf: str) -> DataFrame:
    """The search index of index_rows, written at the first query on a state of that table."""
    return serve(table(spark, sf, "index_rows"), shared(spark, f"index-{stamp(spark, f'{sf}/index_rows.parquet')}"))


#: The table as SQL sees it: each posting once, wrong widths left out.
ROWS = """WITH t AS (
  SELECT id, any_value(title) AS title, any_value(company) AS company, any_value(workplace) AS workplace, any_value(department) AS department, any_value(anywhere) AS anywhere, any_value(employment_types) AS types,
    list_distinct(any_value([p.country FOR p IN places])) AS countries,
    any_value([p.country || '.' || p.division FOR p IN places IF p.division IS NOT NULL]) AS divisions, any_value([p.city FOR p IN places]) AS cities,
    any_value(pay.currency) AS currency, any_value(greatest(pay.pay_min, pay.pay_max)) AS reach, CAST(floor(any_value(posted_at) / 86400000) AS INT) AS day,
    any_value(CASE WHEN len(answers['arrangement']) = 4 THEN answers['arrangement'] END) AS q1, any_value(CASE WHEN len(answers['on_call']) = 2 THEN answers['on_call'] END) AS q2
  FROM index_rows GROUP BY id
)"""


def _page_sql(where: str, order: str, limit: int = 50, offset: int = 0) -> str:
    return f"""{ROWS}, m AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM t WHERE {where})
SELECT m.place, m.id, m.title, m.company, m.workplace, m.day AS posted_day, coalesce((SELECT string_agg(c, ',' ORDER BY k) FROM (SELECT s.country AS c, min(s.k) AS k FROM (SELECT unnest(r.places).country AS country, unnest(range(len(r.places))) AS k FROM (SELECT any_value(places) AS places FROM index_rows WHERE id = m.id) r) s GROUP BY 1)), '') AS countries,
  array_to_string(m.types, ',') AS employment, m.currency, m.reach FROM m WHERE place > {offset} AND place <= {offset + limit}"""


_NEWEST = "day DESC NULLS LAST, id"
_IN = lambda column, *values: f"list_has_any({column}, [{', '.join(map(repr, values))}])"

#: name -> (query, hard filter, {group: condition}) of the facet queries.
FACETS = {
    "facets_unfiltered": (_Q, "true", {}),
    "facets_countries_anywhere": (SearchQuery(countries=("AA", "XJ"), workplaces=("remote",)), "true", {"country": f"(anywhere OR {_IN('countries', 'AA', 'XJ')})", "workplace": "coalesce(workplace = 'remote', false)"}),
    "facets_no_anywhere": (SearchQuery(countries=("AA",), include_anywhere=False, employment=("full-time", "contract")), "true", {"country": _IN("countries", "AA"), "employment": _IN("types", "full-time", "contract")}),
    "facets_recent_paid": (SearchQuery(within_days=30, minimum_pay=(50000.0, "EUR"), now_ms=NOW), f"day >= {NOW // 86400000 - 30} AND currency = 'EUR' AND reach >= 50000", {}),
    "facets_answers": (
        SearchQuery(answers=(Criterion("arrangement", ("remote", "hybrid"), 60), Criterion("on_call", ("no",), 70)), workplaces=("hybrid", "remote")), "true",
        {"workplace": "coalesce(workplace IN ('hybrid', 'remote'), false)", "answer:arrangement": "coalesce(q1[1] + q1[2] >= 60, false)", "answer:on_call": "coalesce(q2[1] >= 70, false)"},
    ),
    "facets_company": (SearchQuery(companies=("Quorvane Systems", "Kirkorka Health")), "true", {"company": "company IN ('Quorvane Systems', 'Kirkorka Health')"}),
}


def _facets_sql(query: SearchQuery, hard: str, groups: dict[str, str]) -> str:
    def keep(own: str) -> str:
        return " AND ".join(c for g, c in groups.items() if g != own) or "true"

    share = {"arrangement": 50, "on_call": 50} | {c.question: c.at_least for c in query.answers}
    any_ = "true" if query.include_anywhere else "false"
    parts = [
        f"SELECT 'country' AS facet, c AS value, count(*) + (SELECT count(*) FROM t WHERE {any_} AND anywhere AND {hard} AND {keep('country')}) - count(*) FILTER ({any_} AND anywhere) AS n FROM (SELECT unnest(countries) AS c, anywhere FROM t WHERE {hard} AND {keep('country')}) GROUP BY c",
        f"SELECT 'workplace', workplace, count(*) FROM t WHERE workplace IS NOT NULL AND {hard} AND {keep('workplace')} GROUP BY 2",
        f"SELECT 'employment', c, count(*) FROM (SELECT unnest(list_distinct(types)) AS c FROM t WHERE {hard} AND {keep('employment')}) GROUP BY 2",
        f"SELECT 'company', company, count(*) FROM t WHERE company IS NOT NULL AND {hard} AND {keep('company')} GROUP BY 2",
    ]
    for column, question, options in (("q1", "arrangement", ("remote", "hybrid", "onsite", "not_stated")), ("q2", "on_call", ("no", "yes"))):
        rows = f"FROM t WHERE {column} IS NOT NULL AND {hard} AND {keep('answer:' + question)}"
        parts.append(f"SELECT 'answered:{question}', '{question}', count(*) {rows} HAVING count(*) > 0")
        parts += [f"SELECT 'answer:{question}', '{o}', count(*) {rows} AND {column}[{i}] >= {share[question]} HAVING count(*) > 0" for i, o in enumerate(options, 1)]
    return f"{ROWS} " + " UNION ALL ".join(parts)


PAGES = {
    "search_page_newest": (_Q, _page_sql("true", _NEWEST)),
    "search_page_by_pay": (SearchQuery(sort_pay="USD", offset=5, limit=20), _page_sql("true", f"CASE WHEN currency = 'USD' THEN reach END DESC NULLS LAST, {_NEWEST}", 20, 5)),
    "search_page_places": (SearchQuery(countries=("QM",), divisions=("AA.C3",), cities=(3294364, 3357339)), _page_sql(f"anywhere OR {_IN('countries', 'QM')} OR {_IN('divisions', 'AA.C3')} OR list_has_any(cities, [3294364, 3357339])", _NEWEST)),
    "search_page_text": (SearchQuery(text="  ENGINEER labs "), _page_sql("contains(strip_accents(lower(title || ' ' || company)), 'engineer') AND contains(strip_accents(lower(title || ' ' || company)), 'labs')", _NEWEST)),
    "search_page_paid_recent": (SearchQuery(within_days=30, minimum_pay=(100000.0, "GBP"), now_ms=NOW), _page_sql(f"day >= {NOW // 86400000 - 30} AND currency = 'GBP' AND reach >= 100000", _NEWEST)),
    "search_page_url": (SearchQuery.from_url("?country=aa,zz&workplace=remote,nowhere&type=full-time&a=arrangement:remote|hybrid@40&anywhere=0", NOW), _page_sql(f"{_IN('countries', 'AA', 'ZZ')} AND workplace = 'remote' AND {_IN('types', 'full-time')} AND q1[1] + q1[2] >= 40", _NEWEST)),
}

TOTALS = {
    "search_total_all_filters": (SearchQuery(countries=("AA", "ZZ"), workplaces=("onsite", "hybrid"), employment=("full-time",), companies=("Quorvane Systems",), answers=(Criterion("on_call", ("no", "yes")),)), f"(anywhere OR {_IN('countries', 'AA', 'ZZ')}) AND workplace IN ('onsite', 'hybrid') AND {_IN('types', 'full-time')} AND company = 'Quorvane Systems' AND q2[1] + q2[2] >= 50"),
    "search_empty_list_matches_nothing": (SearchQuery(companies=()), "false"),
    "search_empty_places_leave_anywhere": (SearchQuery(countries=()), "anywhere"),
    "search_unasked_never_matches": (SearchQuery(answers=(Criterion("arrangement", ("remote", "hybrid", "onsite", "not_stated"), 0),)), "q1 IS NOT NULL"),
    "search_unknown_question_ignored": (SearchQuery(answers=(Criterion("nothing", ("x",)), Criterion("on_call", ("maybe",)))), "true"),
}


def register(query) -> None:
    def named(name, f, sql):
        f.__name__ = name
        query(sql)(f)

    for name, (q, sql) in PAGES.items():
        named(name, lambda spark, sf, q=q: _search(spark, sf, q).page(), sql)
    for name, (q, where) in TOTALS.items():
        named(name, lambda spark, sf, q=q: _search(spark, sf, q).total(), f"{ROWS} SELECT count(*) AS total FROM t WHERE {where}")
    for name, (q, hard, groups) in FACETS.items():
        named(name, lambda spark, sf, q=q: _search(spark, sf, q).facets(), _facets_sql(q, hard, groups))

    def held(spark: SparkSession, sf: str) -> DataFrame:
        """Answers to a question someone put to the rows of a page: here those on being on call, of the paid rows."""
        return served(spark, sf).where("pay IS NOT NULL AND q_on_call IS NOT NULL").select("id", F.col("q_on_call").alias("distribution"))

    on_call = QUESTIONS["on_call"]
    shown = SearchQuery(countries=("AA", "XJ"), include_anywhere=False)
    _held = f"{ROWS}, m AS (SELECT * FROM t WHERE {_IN('countries', 'AA', 'XJ')}), h AS (SELECT r.id, q2 AS d FROM t JOIN (SELECT DISTINCT id FROM index_rows WHERE pay IS NOT NULL) r ON r.id = t.id WHERE q2 IS NOT NULL)"

    @query(f"{_held} SELECT m.id, h.d[2] AS yes FROM m JOIN h ON h.id = m.id WHERE h.d[2] >= 40")
    def held_filter(spark: SparkSession, sf: str):
        """Rows of a search whose held answer passes; the rest, and those without an answer, don't."""
        own = held(spark, sf)
        return H.passing(_search(spark, sf, shown).matches(), own, on_call, ("yes", "never"), 40).select("id", F.get("q_on_call", F.lit(1)).alias("yes"))

    @query(f"{_held} SELECT count(*) AS answered FROM m JOIN h ON h.id = m.id")
    def held_answered(spark: SparkSession, sf: str):
        return H.answered_among(_search(spark, sf, shown).matches(), held(spark, sf))

    @query(f"{_held} SELECT CASE WHEN d[1] >= d[2] THEN 'no' ELSE 'yes' END AS option, count(*) AS n FROM m JOIN h ON h.id = m.id GROUP BY 1")
    def held_facet(spark: SparkSession, sf: str):
        return H.facet(_search(spark, sf, shown).matches(), held(spark, sf), on_call)

    @query(f"{ROWS}, n AS (SELECT 'some' AS search, count(*) AS k FROM t WHERE {_IN('countries', 'XJ')} UNION ALL SELECT 'none', 0 UNION ALL SELECT 'all', count(*) FROM t) SELECT search, least(k, 301) AS total, k BETWEEN 1 AND 300 AS askable FROM n")
    def held_askable(spark: SparkSession, sf: str):
        """Which searches are small enough to put a question to all their rows."""
        kinds = {"some": SearchQuery(countries=("XJ",), include_anywhere=False), "none": SearchQuery(companies=()), "all": _Q}
        parts = [H.askable(_search(spark, sf, q).matches(), 300).select(F.lit(name).alias("search"), "total", "askable") for name, q in kinds.items()]
        return parts[0].unionAll(parts[1]).unionAll(parts[2])

    def facets_ranked(spark: SparkSession, sf: str) -> DataFrame:
        return _search(spark, sf, _Q).ranked_facets()

    query(f"SELECT facet, value, n, rank FROM (SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY n DESC, lower(strip_accents(value)), value) AS rank FROM ({_facets_sql(_Q, 'true', {})})) WHERE rank <= 12")(facets_ranked)

    def row_answers(spark: SparkSession, sf: str) -> DataFrame:
        return _search(spark, sf, SearchQuery(workplaces=("remote",))).row_answers()

    query(f"""{ROWS}, a AS (SELECT id, 'arrangement' AS question, q1 AS q, ['remote', 'hybrid', 'onsite', 'not_stated'] AS o FROM t WHERE workplace = 'remote' AND q1 IS NOT NULL UNION ALL SELECT id, 'on_call', q2, ['no', 'yes'] FROM t WHERE workplace = 'remote' AND q2 IS NOT NULL)
SELECT id, question, o[list_position(q, list_max(q))] AS option, list_max(q) AS share FROM a""")(row_answers)
