import random

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import spans
from quernstone.llm.codepoints import block_of


def text(r, n, letters="abcdefghij klmnopé日\n"):
    return "".join(r.choices(letters, k=n))


def brute(rows, span):
    grams = {}
    for k, t in set(rows):
        if k is not None and t is not None:
            for i in range(len(t) - span + 1):
                grams.setdefault(t[i : i + span], set()).add(k)
    return {(a, b) for g in grams.values() for a in g for b in g if a < b}


def found(spark, rows, span=320, reach=64):
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "doc_id bigint, text string, h string, digest int")
    return {tuple(r) for r in spans.Shared(df, span=span, reach=reach).pairs().collect()}


def test_pairs_equal_brute_force(spark):
    r = random.Random(3)
    passage = [text(r, n) for n in (320, 319, 321, 500, 2000)]
    rows = [(i, text(r, r.randint(0, 900)) + p[: r.choice([len(p), 320])] + text(r, r.randint(0, 900))) for i in range(40) for p in [r.choice(passage)]]
    rows += [(50, "ab" * 400), (51, "x" + "ab" * 300), (52, "a" * 1000), (53, "-" * 319), (54, "-" * 319), (55, "-" * 320), (56, "-" * 321 + "."), (57, None), (None, "-" * 400), (58, ""), (50, "ab" * 400)]
    rows += [(60, passage[0]), (61, passage[0]), (62, passage[1]), (63, passage[1])]
    assert found(spark, rows) == brute(rows, 320)


def test_every_insertion_is_survived(spark):
    r = random.Random(5)
    passage = text(r, 320)
    rows = [(i, text(r, i) + passage + text(r, 40 - i)) for i in range(40)]
    assert found(spark, rows) == {(i, j) for i in range(40) for j in range(i + 1, 40)}


@pytest.mark.parametrize("group", [1, 3, 500])
def test_chunks_of_many_texts(spark, monkeypatch, group):
    """A line that many texts have is shorter than a span: no pair of texts comes of it, and no true pair is lost."""
    monkeypatch.setattr(spans, "GROUP", group)
    r = random.Random(11)
    line, passage = text(r, 300), text(r, 330)
    rows = [(i, text(r, r.randint(0, 400)) + line + text(r, r.randint(0, 400))) for i in range(30)]
    rows += [(30 + i, text(r, r.randint(0, 400)) + passage[i % 3 : 322 + i % 5] + line + text(r, r.randint(0, 400))) for i in range(12)] + [(50, line + "x" * 19), (51, line + "x" * 20), (52, line + "x" * 21), (53, line + "x" * 20)]
    assert found(spark, rows) == brute(rows, 320)
    shared = spans.Shared(spark.createDataFrame(rows, "doc_id bigint, text string"))
    of = {x.doc_id: x.h for x in shared.classes().collect()}
    links = {tuple(x) for x in shared.links().collect()}
    assert {(a, b) for a in of for b in of if a < b and (of[a] == of[b] or (min(of[a], of[b]), max(of[a], of[b])) in links)} == brute(rows, 320)


def test_a_digest_of_two_spans_costs_no_other_run():
    r = random.Random(12)
    a = text(r, 400) + "-" * 5 + text(r, 400)
    b = text(r, 50) + a[:400] + "=" * 7 + a[405:]
    (ca, ga), (cb, gb) = (spans._grams(t, 320) for t in (a, b))
    known = spans.common(ca, cb, ga, gb, 320)
    ga, gb = ga.copy(), gb.copy()
    ga[82], gb[20] = 7, 7  # two different spans of one digest
    assert all((x == y).all() for x, y in zip(spans.common(ca, cb, ga, gb, 320), known))
    ga[0] = 7  # and one in a run
    assert len(spans.common(ca, cb, ga, gb, 320)[0]) == len(known[0]) - 1


def test_nothing(spark):
    assert found(spark, []) == set() and found(spark, [(1, "a"), (2, None)]) == set()


def test_report(spark):
    r = random.Random(6)
    p = text(r, 400)
    rows = [(1, "x" * 100 + p), (2, p + "y" * 50), (3, text(r, 500)), (4, p[:350]), (5, p[:350]), (6, "q" * 90 + p[:330] + "q" * 7 + p[-320:])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: (x.n_chars, x.shared_chars) for x in spans.Shared(df).report().collect()}
    assert got == {1: (500, 400), 2: (450, 400), 4: (350, 350), 5: (350, 350), 6: (747, 650)}


def test_gear_forgets_after_32():
    r = random.Random(7)
    tail = text(r, 50)
    a, b = (block_of(pa.array([text(r, 30) + tail])).cps for _ in range(2))
    assert (spans.gear(a)[30 + 31 :] == spans.gear(b)[30 + 31 :]).all() and spans.gear(a)[30] != spans.gear(b)[30]


def test_digests_of_equal_slices_are_equal():
    block = block_of(pa.array(["abcdefabcdef", "xabcdef"]))
    d = spans.digests(block, np.array([0, 6, 13, 1]), np.array([6, 12, 19, 7]))
    assert d[0] == d[1] == d[2] != d[3]


def test_a_span_too_short_for_the_reach_is_refused():
    with pytest.raises(ValueError):
        spans.chunks(block_of(pa.array(["x" * 500])), 100, 64)
