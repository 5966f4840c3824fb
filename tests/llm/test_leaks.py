import itertools
import random
import re

import numpy as np
import pytest

from quernstone.llm import leaks


def words(t):
    return [w.lower() for w in re.findall(r"[^\W_]+", t)]


def brute(docs, items, least=12):
    out = set()
    for i, t in items:
        w = words(t or "")
        grams = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
        for d, x in docs:
            v = words(x or "")
            if d is not None and any(tuple(v[k : k + least]) in grams for k in range(len(v) - least + 1)):
                out.add((d, i))
    return out


def find(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "clash", "i") for x in docs], "doc_id bigint, text string, item_id string, run string")
    i = spark.createDataFrame([(*x, "p") for x in items], "item_id bigint, item_text string, prompt string")
    return {(r.doc_id, r.item_id): (r.run, r.overlap) for r in leaks.find(d, i, **kw).collect()}


@pytest.fixture(scope="module")
def case():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "straße", "x1"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(3, 40)))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for d in range(120):
        w = words(r.choice(items[:25])[1])
        cut = w[r.randint(0, max(0, len(w) - 12)) :][: r.randint(9, 20)]
        docs.append((d, " ".join(r.choices(vocabulary, k=r.randint(0, 60))) + " " + r.choice([" ", ", ", "<b>", "--\n"]).join(x.upper() for x in cut) + "! " + " ".join(r.choices(vocabulary, k=5))))
    return docs + [(200, None), (201, ""), (None, items[3][1]), docs[0], (202, " ".join(t or "" for _, t in items) * 30)], items


def test_runs_equal_brute_force(spark, case):
    docs, items = case
    got = find(spark, docs, items)
    assert {k for k, (run, _) in got.items() if run >= 12} == brute(docs, items)


def test_items_go_in_blocks(spark, case, monkeypatch):
    docs, items = case
    whole = find(spark, docs, items)
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 150)
    assert find(spark, docs, items) == whole


def test_substitutions(spark):
    item = [f"a{i}" for i in range(20)]
    doc = [*item[:9], "other", *item[10:]]
    got = find(spark, [(1, " ".join(doc)), (2, " ".join(item)), (3, "nothing here")], [(7, " ".join(item))])
    assert got == {(1, 7): (10, 19), (2, 7): (20, 20)}


def test_substitutions_anywhere(spark):
    item = [f"a{i}" for i in range(14)]
    places = [set(p) for k in (1, 2) for p in itertools.combinations(range(14), k)] + [{i, 13} for i in range(13)]
    docs = [(d, " ".join("other" if i in p else w for i, w in enumerate(item))) for d, p in enumerate(places)]
    docs += [(1000 + i, " ".join("other" if k == i else w for k, w in enumerate(item[:13]))) for i in range(13)]
    got = find(spark, docs, [(7, " ".join(item))])
    assert {d for d, _ in got} == {d for d, _ in docs} and all(overlap >= 12 for _, overlap in got.values())


def test_nothing(spark):
    assert find(spark, [], [(1, "a")]) == {} and find(spark, [(1, "a")], []) == {}


def test_overlaps():
    e = np.array([1, 1, 0, 1, 1, 1, 0, 0, 1], bool)
    assert leaks.overlaps(e, 0) == (3, 3) and leaks.overlaps(e, 1) == (3, 5) and leaks.overlaps(e, 9) == (3, 6)
    with pytest.raises(ValueError):
        leaks.find(None, None, least=5)
