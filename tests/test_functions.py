import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone import catalog
from quernstone.functions import ids, numbers, places, text
from quernstone.functions.html_blocks import text_of_html
from quernstone.functions.places import Lexicon, LabelReader
from quernstone.functions.regions import regions


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "bigint"}
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) and v and isinstance(v[0], str) else 'array<double>' if isinstance(v, list) else kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_ids(spark):
    assert one(spark, ids.board_id(F.col("a"), F.col("b")), a="greenhouse", b="Stripe") == "greenhouse:stripe"
    assert one(spark, ids.posting_id(F.col("a"), F.col("b")), a="greenhouse:stripe", b="7850544003") == "p4mmby6s62axi4o7"
    assert one(spark, ids.shuffle_key(F.col("a")), a="p4mmby6s62axi4o7") == "8168cfbf"
    assert one(spark, ids.parse_board_id(F.col("a")), a="lever:acme-1").asDict() == {"source": "lever", "slug": "acme-1"}


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**50), 2**50) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x) | st.dictionaries(st.text("abcéz"), x), max_leaves=8))
def test_canonical_json_is_stable(value):
    try:
        text_ = ids.canonical(value)
    except ValueError:
        return  # keys that compose to one
    assert ids.canonical(json.loads(text_)) == text_


def test_canonical_json():
    assert ids.canonical({"b": 1.0, "a": [1e21, 0.1, -0.0, 1e-7], "é": None}) == '{"a":[1e+21,0.1,0,1e-7],"b":1,"é":null}'


@pytest.mark.parametrize("values,expected", [([0.33, 0.33, 0.33], [34, 33, 33]), ([0.35, 0.4, 0.25, 0.0], [35, 40, 25, 0]), ([0.33, 0.33, 0.33, 0.0], [34, 33, 33, 0])])
def test_hundredths(spark, values, expected):
    assert one(spark, numbers.hundredths(F.col("a")), a=values) == expected


def test_reading_answers(spark):
    options = ["remote", "hybrid", "onsite", "not_stated"]
    read = lambda a: one(spark, numbers.read_choice(F.col("a"), options), a=a)
    p = lambda d: json.dumps({"type": "choice", "probabilities": d})
    assert read(p({"hybrid": 0.2, "remote": 0.7, "onsite": 0.1, "not_stated": 0.0})) == [70, 20, 10, 0]
    for bad in ("no json", p({"remote": 1.0}), p({"hybrid": 0.9, "remote": 0.7, "onsite": 0.1, "not_stated": 0.0}), p({"x": 0.2, "remote": 0.7, "onsite": 0.1, "not_stated": 0.0}), '{"type":"score"}', "[]", p({"hybrid": -0.2, "remote": 1.1, "onsite": 0.1, "not_stated": 0.0})):
        assert read(bad) is None
    assert one(spark, numbers.read_yes_no(F.col("a")), a='{"type":"noul","noul":0.25}') == [75, 25]
    assert one(spark, numbers.read_yes_no(F.col("a")), a='{"type":"noul","noul":2}') is None


def test_pay(spark):
    assert one(spark, numbers.annual(F.col("a"), F.lit("month")), a=5000.0) == 60000
    assert one(spark, numbers.annual(F.col("a"), F.lit("hour")), a=45.5) == 94640
    assert one(spark, numbers.annual(F.col("a"), F.lit("decade")), a=45.5) is None
    assert one(spark, numbers.salary_range(F.col("a"), F.lit(None).cast("double"), F.lit("usd"), F.lit("year")), a=1.0) is None


@pytest.mark.parametrize("label,expected", [("FullTime", ["full-time"]), ("Part Time Employee", ["part-time"]), ("Permanent", ["full-time"]), ("Full-time: Contract", ["full-time", "contract"]), ("Stage", ["internship"]), ("Fixed term", ["temporary"]), ("CDI", ["full-time"]), ("Other", [])])
def test_employment(spark, label, expected):
    assert one(spark, text.employment_types(F.col("a")), a=label) == expected


@pytest.mark.parametrize("html,expected", [
    ("<p>One</p><p>Two</p>", "One\n\nTwo"), ("<ul><li>a</li><li><p>b</p></li></ul>c", "- a\n- b\n\nc"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("x &amp;lt; y &lt; z", "x &lt; y < z"),
    ("a<script>1<2</script>b<!-- c -->d", "abd"), ("1 < 2 and <b>b</b>", "1 < 2 and b"), ('<a title="x>y">z</a>', "z"), ("cut <a href", "cut"), ("<td>a</td><td>b</td>", "a b"), ("é", "é"), ("", ""),
])
def test_html_to_text(html, expected):
    assert text_of_html(html) == expected


def test_html_to_text_takes_every_row(spark, tmp_path):
    rows = [("a", "<p>x</p>"), ("b", "&lt;p&gt;x&lt;/p&gt;"), ("c", "R&amp;D"), ("d", "plain  text"), ("e", " "), ("f", ""), ("g", None), ("d", "plain  text")]
    spark.createDataFrame(rows, "id string, description string").write.parquet(f"{tmp_path}/criterion_postings.parquet")
    got = [(r.id, r.text) for r in catalog.QUERIES["html_to_text"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [("a", "x"), ("b", "<p>x</p>"), ("c", "R&D"), ("d", "plain text"), ("e", ""), ("f", ""), ("g", "")]


def test_long_broken_markup_is_linear():
    assert text_of_html("<" * 300_000).startswith("<<")
    assert text_of_html("<a " * 100_000) == ""


def test_cleaning(spark):
    assert one(spark, text.clean_list(F.col("a")), a=[" a  b ", "a b", "", "c"]) == ["a b", "c"]
    assert one(spark, text.place_text(F.col("a")), a=["Berlin", "berlin ", "Germany"]) == "Berlin, Germany"
    assert one(spark, text.fold(F.col("a")), a="ZÜRICH ﬁ ß") == "zurich fi ß"
    assert one(spark, text.fold_name(F.col("a")), a="St. John’s-Town") == "st johns town"
    assert one(spark, text.is_placeholder(F.col("a"), F.array(F.lit("z-Test only"))), a="x") and one(spark, text.is_placeholder(F.col("a"), F.array(F.lit("Test Valley"))), a="EXTERNAL TEMPLATE - Hybrid")
    assert not one(spark, text.is_placeholder(F.col("a"), F.array(F.lit("Test Valley"))), a="Template Technician")


CITIES = [
    (1, "Arlo", "AA", "Aland", "10", "Northshire", 900_000, ["ARL"]), (2, "Bexley", "AA", "Aland", "11", "Southshire", 60_000, []), (3, "Bexley", "BB", "Borland", "CA", "Coast", 3_000_000, ["Bex"]),
    (4, "Coast", "BB", "Borland", "CA", "Coast", 500_000, []), (5, "Dorn", "CA", "Cadia", "7", "Midland", 20_000, []),
]
REGIONS = {"nordland": ("AA", "BB")}
GAZETTEER = "city_id bigint, city_name string, country string, country_name string, division string, division_name string, population bigint, alternates array<string>"


@pytest.fixture(scope="module")
def gazetteer(spark):
    return spark.createDataFrame(CITIES, GAZETTEER)


@pytest.fixture(scope="module")
def reader(gazetteer):
    return LabelReader(Lexicon([tuple(r) for r in places.names_of(gazetteer).collect()], REGIONS))


@pytest.mark.parametrize("label,expected,workplace,anywhere", [
    ("Arlo", [("AA", "10", 1)], None, False), ("Bexley, Aland", [("AA", "11", 2)], None, False), ("Bexley", [("BB", "CA", 3)], None, False), ("Bexley, CA", [("BB", "CA", 3)], None, False), ("Dorn, CA", [("CA", "7", 5)], None, False),
    ("Remote - AA", [("AA", None, None)], "remote", False), ("Borland (Hybrid)", [("BB", None, None)], "hybrid", False), ("Coast", [("BB", "CA", 4)], None, False), ("ARL; Dorn", [("AA", "10", 1), ("CA", "7", 5)], None, False),
    ("Nordland", [("AA", None, None), ("BB", None, None)], None, False), ("Anywhere", [], None, True), ("Arlo or Dorn", [("AA", "10", 1), ("CA", "7", 5)], None, False), ("Northshire", [("AA", "10", None)], None, False), ("", [], None, False),
    ("Arlo AA", [("AA", "10", 1)], None, False), ("Remote (PST timezone)", [], "remote", False), ("N/A", [], None, False), ("Office Based - Arlo, Aland", [("AA", "10", 1)], "onsite", False), ("Home based - Worldwide", [], "remote", True),
    ("Remote-Dorn", [("CA", "7", 5)], "remote", False), ("Arlo City", [("AA", "10", 1)], None, False), ("Acme Arlo", [("AA", "10", 1)], None, False), ("Arlo-Dorn, CA", [("AA", "10", 1), ("CA", "7", 5)], None, False), ("Province of Northshire", [("AA", "10", None)], None, False),
    ("Arlo: (260 Burwood Rd)", [("AA", "10", 1)], None, False), ("Remote in the AA or BB", [("AA", None, None), ("BB", None, None)], "remote", False), ("Arlo \U0001f1e6\U0001f1e6", [("AA", "10", 1)], None, False),
])
def test_location_labels(reader, label, expected, workplace, anywhere):
    read = reader.read(label)
    assert (read.places, read.workplace, read.anywhere) == (expected, workplace, anywhere)


def test_what_is_no_place(reader):
    assert reader.read("Jobs.cz").unmatched == ["Jobs.cz"]
    assert reader.read("Bexley", ["AA"]).places == [("AA", "11", 2)] or reader.read("Bexley", ["AA"], "AA").places


@given(st.text(max_size=60))
def test_any_label_is_read(reader, label):
    assert set(reader.read(label).places) <= {("AA", "10", 1), ("AA", "11", 2), ("BB", "CA", 3), ("BB", "CA", 4), ("CA", "7", 5), *((c, d, None) for c in ("AA", "BB", "CA") for d in (None, "10", "11", "CA", "7"))}


def test_named_regions():
    found = regions({"AT": "EU", "DE": "EU", "EG": "AF", "AE": "AS", "JP": "AS", "AU": "OC", "US": "NA"})
    assert found["dach"] == ("AT", "DE") and found["emea"] == ("AT", "DE", "EG", "AE") and found["apac"] == ("JP", "AU") and found["mena"] == ("AE", "EG") and found["namer"] == ("US",)


def test_names_of_countries_in_other_languages(spark, gazetteer):
    more = places.country_names(spark, ["DE", "MM"], ["en", "fr"])
    named = {(r.name, r.country) for r in more.collect()}
    assert {("Germany", "DE"), ("Allemagne", "DE")} <= named
    label = spark.createDataFrame([("Allemagne",)], "label string")
    assert places.read_labels(label, "label", gazetteer, more=more).first().places[0].country == "DE"


def test_a_longer_list_is_read_in_blocks(spark, gazetteer):
    labels = spark.createDataFrame([(x,) for x in ("Arlo", "Bexley, CA", "ARL; Dorn", "Remote - AA", "Province of Northshire", "Nowhere", "Arlo-Dorn, CA", "", None, "Arlo")], "label string")
    whole, blocks = (sorted(map(str, places.read_labels(labels, "label", gazetteer, REGIONS, most=n).collect())) for n in (1000, 6))
    assert whole == blocks and len(whole) == 8


def test_locating_postings(spark, gazetteer):
    rows = [
        ("a", ["Nowhere"], [("Nowhere", "Arlo, Aland")], None, None), ("b", ["Nowhere"], [], None, "BB"), ("c", [], [(None, "Dorn")], None, None), ("d", ["Remote"], [], "CA", "BB"), ("e", ["Dornhub Works"], [(None, "Dornhub, Arlo"), (None, "Bexley")], None, None),
        ("f", ["Anywhere", "Remote"], [], None, "AA"), ("g", ["x"], [], None, None), ("h", ["Arlo", "Arlo", "Dorn (Hybrid)"], [], None, None), (None, ["Arlo"], [], None, None), ("i", None, None, None, "AA"), ("a", ["Nowhere"], [("Nowhere", "Arlo, Aland")], None, None),
    ]
    found = places.locate(spark.createDataFrame(rows, "id string, labels array<string>, stated array<struct<label: string, text: string>>, country string, home string"), gazetteer)
    got = {r.id: ([tuple(p) for p in r.places], r.workplace, r.anywhere, r.basis, r.unmatched) for r in found.collect()}
    assert found.count() == len(got) == 9
    arlo, dorn = ("AA", "10", 1), ("CA", "7", 5)
    assert got["a"] == ([arlo], None, False, "label", []) and got["b"] == ([("BB", None, None)], None, False, "home", ["Nowhere"]) and got["c"] == ([dorn], None, False, "stated", [])
    assert got["d"] == ([("CA", None, None)], "remote", False, "stated", []) and got["e"][0] == [arlo] and got["e"][3] == "label" and got["f"] == ([], "remote", True, "label", [])
    assert got["g"] == ([], None, False, "none", ["x"]) and got["h"] == ([arlo, dorn], "hybrid", False, "label", []) and got["i"][3] == "home"
