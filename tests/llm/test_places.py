import itertools
import random

import pytest

from quernstone.llm import places


def distance(a, b):
    """Letters wrong, missing, extra or swapped."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_dynamic_programming():
    r = random.Random(1)
    names = {"".join(r.choices("abc", k=r.randint(1, 9))) for _ in range(200)}
    trie = places.Trie((n, i) for i, n in enumerate(sorted(names)))
    for _ in range(150):
        typed = "".join(r.choices("abcd", k=r.randint(1, 10)))
        assert trie.within(typed) == {n: d for n in names if (d := distance(typed, n)) <= places.allowed(len(n))}


GAZETTEER = "city_id bigint, city_name string, canonical_label string, country string, country_name string, division string, division_name string, population bigint, alternates array<string>"
CITIES = [
    (1, "Nova Arlon", "Nova Arlon, North, Aland", "AA", "Aland", "N1", "North", 500, ["ARL", "Bremen"]), (2, "Bexleyville", "Bexleyville, South, Aland", "AA", "Aland", "S1", "South", 900, None),
    (3, "Bexleyville", "Bexleyville, Coast, Borland", "BB", "Borland", "C1", "Coast", 400, []), (4, "Ñandu", "Ñandu, Coast, Borland", "BB", "Borland", "C1", "Coast", None, []),
]


def read(spark, labels, known=()):
    df = spark.createDataFrame([(*x, "c") for x in labels], "id string, labels array<string>, countries string")
    own = places.read_labels(df, spark.createDataFrame(CITIES, GAZETTEER), spark.createDataFrame(list(known), "id string, country string"))
    return {tuple(r) for r in own.collect()}


@pytest.mark.parametrize("label,cities", [
    ("nova arlon", [1]), ("NovaArlon", [1]), ("Office: Nova-Arlon, Floor 12", [1]), ("Noav Arlon (Hybrid)", [1]), ("Nvoa Alron HQ", [1]), ("Nova Arloooon", []), ("arl", [1]), ("ARX", []), ("bremen", [1]), ("Bexleyville", [2]), ("Bexleyville, BB", [3]),
    ("Borland, Bexleyvile", [3]), ("Bexleyville, Coast", [3]), ("BB-C1-Bexleyville", [3]), ("Nova Arlon & Bexleyville", [1, 2]), ("Nova Arlon / Nova Arlon", [1]), ("Nandu", [4]), ("ñándú | onsite", [4]), ("Nandx", [4]), ("Remote (AA)", []),
    ("Aland", []), ("South, Aland", []), ("Anywhere in Borland", []), ("", []), (None, []), ("Europe", []), ("Greater Bexleyville Area", [2]), ("  Bexleyville ,AA ", [2]), ("x" * 5000, []), ("Nova Arlon, North, Aland", None),
])
def test_labels(spark, label, cities):
    assert read(spark, [("a", [label])]) == (set() if cities is None else {("a", 0, c) for c in cities or [0]})


def test_known_places_decide_what_the_label_does_not(spark):
    labels = [("a", ["Bexleyville", "Bexleyville, AA"]), ("b", ["Bexleyville"]), ("a", ["Bexleyville", "Bexleyville, AA"]), (None, ["Bexleyville"]), ("c", None), ("d", [])]
    assert read(spark, labels, [("a", "BB"), ("a", "BB"), ("b", "ZZ"), ("b", None)]) == {("a", 0, 3), ("a", 1, 2), ("b", 0, 2)}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_a_longer_reference_list_goes_in_blocks(spark, monkeypatch, most):
    labels = ["nova arlon", "Noav Arlon (Hybrid)", "Borland, Bexleyvile", "BB-C1-Bexleyville", "Nova Arlon & Bexleyville", "ARX", "", None, "Nova Arlon, North, Aland", "Aland", "Bexleyville", "Nandx", "Bexleyville, Coast"]
    rows, known = [("a", labels), ("b", labels[::-1]), ("b", labels[::-1]), (None, labels), ("c", None)], [("a", "BB")]
    whole = read(spark, rows, known)
    monkeypatch.setattr(places, "MAX_REFERENCE", most)
    assert read(spark, rows, known) == whole and len(whole) > 24


def test_nothing(spark):
    assert read(spark, []) == set()


def test_five_letter_names_may_have_two_errors():
    reader = places.Reader([(1, "Kanel", "AA", "Aland", "d", "Division", 5, []), (2, "Toronta", "AA", "Aland", "d", "Division", 9, ["KGX"])])
    assert [reader.read(t) for t in ("Kxnxl", "Knale", "Kaneles", "Kan", "Kxxxl", "KGY")] == [[[0]]] * 4 + [[]] * 2
