from dataclasses import replace

import pytest

from quernstone.plans.search import DAY_MS, Criterion, Search, SearchQuery, index_table, serve

SCHEMA = "id string, title string, company string, places array<struct<country:string,division:string,city:bigint>>, anywhere boolean, workplace string, employment_types array<string>, pay struct<pay_min:double,pay_max:double,currency:string,stated_per:string>, posted_at bigint, answers map<string,array<int>>"
DE = ("DE", "16", 2950159)
NOW = 20100 * DAY_MS


def row(id, title="Engineer", company="Acme", places=(DE,), anywhere=False, workplace="onsite", employment=("full-time",), pay=None, day=20099, answers=None):
    return (id, title, company, list(places), anywhere, workplace, list(employment), pay, None if day is None else day * DAY_MS, answers)


ROWS = [
    row("berlin", "Senior Backend Engineer", workplace="hybrid", day=20098),
    row("zurich", "Data Scientist, Zürich", "Beta", [("CH", "ZH", None)], day=20060),
    row("sf", "Staff Engineer", "Gamma", [("US", "CA", 5391959)], pay=(180000.0, 220000.0, "USD", "year")),
    row("both", "Solutions Engineer", "Gamma", [("US", "CA", None), DE], workplace="remote", employment=("full-time", "contract"), pay=(150000.0, None, "USD", "year"), day=20100),
    row("london", "Product Designer", "Delta", [("GB", "ENG", 2643743)], workplace="remote", employment=("contract",), pay=(70000.0, 90000.0, "GBP", "year")),
    row("anywhere", "Support Engineer", "Epsilon", [], True, "remote", (), day=None),
    row("unplaced", "Recruiter", "Zeta", []),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([*ROWS, ROWS[0]], SCHEMA)  # one is delivered twice
    return index_table(df).cache()


def ids(rows, **kw):
    return [r.id for r in Search(rows, SearchQuery(now_ms=NOW, **kw)).page().orderBy("place").collect()]


def facets(rows, **kw):
    return {(r.facet, r.value): r.n for r in Search(rows, SearchQuery(now_ms=NOW, **kw)).facets().collect()}


def test_order_and_filters(rows):
    assert ids(rows) == ["both", "london", "sf", "unplaced", "berlin", "zurich", "anywhere"]
    assert ids(rows, countries=("DE",)) == ["both", "berlin", "anywhere"]
    assert ids(rows, countries=("DE",), include_anywhere=False) == ["both", "berlin"]
    assert ids(rows, divisions=("US.CA",), include_anywhere=False) == ["both", "sf"]
    assert ids(rows, cities=(2643743,), include_anywhere=False) == ["london"]
    assert ids(rows, workplaces=("remote",)) == ["both", "london", "anywhere"]
    assert ids(rows, employment=("contract",)) == ["both", "london"]
    assert ids(rows, companies=("Gamma",)) == ["both", "sf"]
    assert ids(rows, within_days=1) == ["both", "london", "sf", "unplaced"]
    assert ids(rows, minimum_pay=(200000.0, "USD")) == ["sf"]
    assert ids(rows, minimum_pay=(150000.0, "USD")) == ["both", "sf"]
    assert ids(rows, text="engineer gamma") == ["both", "sf"]
    assert ids(rows, text="zurich") == ["zurich"]
    assert len(ids(rows, text="  ENGINEER  ")) == 4
    assert ids(rows, sort_pay="USD", limit=3) == ["sf", "both", "london"]
    assert ids(rows, sort_pay="USD", offset=1, limit=2) == ["both", "london"]
    assert ids(rows, companies=()) == [] and ids(rows, countries=()) == ["anywhere"]


def test_facets_count_all_filters_but_their_own(rows):
    found = facets(rows, countries=("DE",), workplaces=("remote",), include_anywhere=False)
    assert {k: v for k, v in found.items() if not k[0].startswith("answer")} == {
        ("country", "DE"): 1, ("country", "GB"): 1, ("country", "US"): 1, ("workplace", "hybrid"): 1, ("workplace", "remote"): 1,
        ("employment", "contract"): 1, ("employment", "full-time"): 1, ("company", "Gamma"): 1,
    }


@pytest.mark.parametrize("name,facet", [("countries", "country"), ("workplaces", "workplace"), ("employment", "employment"), ("companies", "company")])
def test_a_facet_promises_the_total_of_choosing_it(rows, name, facet):
    base = SearchQuery(now_ms=NOW, workplaces=("remote", "onsite"), text="e")
    for (f, value), n in facets(rows, workplaces=base.workplaces, text=base.text).items():
        if f == facet:
            assert Search(rows, replace(base, **{name: (value,)})).total().first().total == n


def test_answers(spark):
    held = {"certain": ([100, 0, 0, 0], [100, 0]), "split": ([35, 40, 25, 0], [50, 50]), "leaning": ([60, 20, 20, 0], [20, 80]), "unasked": None, "narrow": ([100], [100, 0])}
    rows = index_table(spark.createDataFrame([row(k, answers=v and {"arrangement": v[0], "on_call": v[1]}) for k, v in held.items() if k != "narrow"], SCHEMA))
    pick = lambda *c: sorted(ids(rows, answers=c))
    assert pick(Criterion("arrangement", ("remote",))) == ["certain", "leaning"]
    assert pick(Criterion("arrangement", ("remote",), 80)) == ["certain"]
    assert pick(Criterion("arrangement", ("remote", "hybrid"), 70)) == ["certain", "leaning", "split"]
    assert pick(Criterion("arrangement", ("remote",), 0)) == ["certain", "leaning", "split"]
    assert len(pick(Criterion("nothing", ("x",)))) == 4 and len(pick(Criterion("arrangement", ("x",)))) == 4
    assert facets(rows)["answered:arrangement", "arrangement"] == 3
    assert facets(rows, answers=(Criterion("arrangement", ("remote",), 80),))["answered:arrangement", "arrangement"] == 3
    assert facets(rows, answers=(Criterion("on_call", ("yes",), 70),))["answered:arrangement", "arrangement"] == 1
    low = facets(rows, answers=(Criterion("arrangement", ("remote",), 20),))
    assert (low["answer:arrangement", "remote"], low["answer:arrangement", "hybrid"]) == (3, 2)


def test_urls_round_trip():
    q = SearchQuery.from_url("?region=europe&q=zürich%20lab&country=de,fr,de&workplace=remote,bogus&type=contract&company=A%26B&within=7&pay=50000&currency=eur&anywhere=0&sort=pay&a=arrangement:remote|hybrid@80,on_call:no,on_call:yes,bad")
    assert q.countries == ("DE", "FR") and q.workplaces == ("remote",) and q.companies == ("A&B",) and q.minimum_pay == (50000.0, "EUR") and q.sort_pay == "EUR"
    assert q.answers == (Criterion("arrangement", ("remote", "hybrid"), 80), Criterion("on_call", ("no",)))
    assert SearchQuery.from_url(q.to_url()) == q and SearchQuery().to_url() == ""
    assert q.toggled("countries", "DE").countries == ("FR",) and q.cleared() == SearchQuery(region="europe")
    assert "answers:on_call" in q.active()


def test_unknown_values_are_refused():
    with pytest.raises(ValueError):
        SearchQuery(workplaces=("moon",))
    with pytest.raises(ValueError):
        SearchQuery(answers=(Criterion("on_call", ("no",)), Criterion("on_call", ("yes",))))


def test_a_written_question_in_the_url():
    url = "?ck=choice&cq=Is%20it%20%3Fa%20%26%20b&cc=x%7Cy&cf=x%4070"
    q = SearchQuery.from_url(url)
    assert q.asked == ("choice", "Is it ?a & b", ("x", "y")) and q.asked_filter == Criterion("asked", ("x",), 70) and q.to_url() == url
    assert SearchQuery.from_url("?ck=other&cq=x&cf=a").asked is None and SearchQuery.from_url("?ck=yes-no&cq=x&cf=@7").asked_filter is None
    assert SearchQuery.from_url("?cf=yes").asked_filter is None


def test_a_search_shuffles_nothing_and_pushes_its_filters(spark, tmp_path):
    own = serve(spark.createDataFrame([row("a"), row("b")], SCHEMA), str(tmp_path / "index"))
    q = SearchQuery(within_days=5, minimum_pay=(1.0, "EUR"), text="x", companies=("c",), now_ms=DAY_MS * 30)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = Search(own, q).page()._jdf.queryExecution().explainString(mode)
    assert "Exchange" not in plan and all(f"{f}" in plan for f in ("GreaterThanOrEqual(posted_day", "EqualTo(currency,EUR)", "StringContains(search_text,x)", "EqualTo(company,c)"))
