import pytest
from pyspark.sql import functions as F

from quernstone.operators import asking
from quernstone.sources import tables_io


def test_criteria_are_checked_and_named_by_what_they_say():
    q = asking.criterion("choice", " Which  tools? ", ("A", "B "))
    assert q.options == ("A", "B") and q.id == asking.criterion("choice", "Which tools?", ("A", "B")).id != asking.criterion("choice", "Which tools?", ("B", "A")).id
    assert asking.criterion("scale", "How?", ("low", "high")).options == ("0", "1")
    for bad in (("maybe", "x", ()), ("yes-no", "", ()), ("yes-no", "x" * 501, ()), ("yes-no", "x", ("a", "b")), ("choice", "x", ("a",)), ("choice", "x", ("a", "A")), ("scale", "x", tuple("abcdefghijk"))):
        with pytest.raises(ValueError):
            asking.criterion(*bad)


def test_plans_stay_within_the_allowance(spark):
    units = spark.createDataFrame([("a", 2, 5), ("b", 2, 5), ("c", 1, 5), ("d", None, 1)], "id string, day int, cost bigint")
    plan = lambda n: {r.id: r.spent for r in asking.planned(units, "cost", ["day", "id"], n).collect()}
    assert plan(16) == {"a": 0, "b": 5, "c": 10, "d": 15} and plan(11) == {"a": 0, "b": 5} and plan(4) == {}


def test_unreadable_answers_are_null(spark):
    texts = spark.createDataFrame([("h", "x"), ("h", "x"), ("i", "y"), (None, "z"), ("j", None)], "content_hash string, text string")
    got = asking.asked(texts, asking.STANDARD[1], lambda ts: [[30, 70] if t == "x" else [1] for t in ts]).collect()
    assert sorted((r.content_hash, r.distribution) for r in got) == [("h", [30, 70]), ("i", None)]


def test_newer_answers_win_and_reasons_rank(spark):
    t = lambda *x: spark.createDataFrame(list(x), "id string, distribution array<int>, at bigint")
    assert [(r.id, r.distribution) for r in asking.merged(t(("a", [1], 1)), t(("a", [2], 2))).collect()] == [("a", [2])]
    runs = spark.createDataFrame([("r", "finished"), ("r", "deadline"), ("s", "finished")], "run_id string, reason string")
    assert {tuple(r) for r in asking.stop_reason(runs).collect()} == {("r", "deadline"), ("s", "finished")}


def test_gazetteer_from_dumps(spark, tmp_path):
    row = lambda id, name, alternates, country, division, population: "\t".join([str(id), name, name, alternates, "", "", "P", "PPL", country, "", division, "", "", "", str(population), "", "", "", ""])
    (tmp_path / "c.txt").write_text("\n".join([row(1, "Arlo", "ARL,arlo,Àrló,Арло", "AA", "01", 5), row(2, "Gone", "", "XX", "01", 5), row(3, "Dorn", "", "AA", "99", 7)]))
    (tmp_path / "d.txt").write_text("AA.01\tNorth\tNorth\t9\n")
    (tmp_path / "k.txt").write_text("# comment\nAA\tAAA\t1\tA\tAland\n")
    got = {r.city_id: r for r in tables_io.gazetteer(spark, *(str(tmp_path / f) for f in ("c.txt", "d.txt", "k.txt"))).collect()}
    assert set(got) == {1, 3} and got[1].alternates == ["ARL", "Àrló"] and got[1].canonical_label == "Arlo, North, Aland" and got[3].division is None


def test_seeds_sheets_ledgers_and_recordings(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"source": "lever", "slug": "A"}\n{"source": "lever", "slug": "a"}\n')
    assert [tuple(r) for r in tables_io.duplicate_seeds(tables_io.seeds(spark, str(tmp_path / "s.json"))).collect()] == [("lever:a", 2)]
    tables_io.labelling_sheet(spark.createDataFrame([('say "x"',)], "title string"), ["q"], str(tmp_path / "sheet"))
    text = next((tmp_path / "sheet").glob("*.csv")).read_text()
    assert text.splitlines()[0] == '"title","q"' and spark.read.csv(str(tmp_path / "sheet"), header=True, escape="\\").first().title == 'say "x"'
    for n in (1, 2):
        tables_io.append_ledger(spark.createDataFrame([(n,)], "cost bigint"), str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).agg(F.sum("cost")).first()[0] == 3
    key = tables_io.request_key("post", "/x", {"b": 1, "a": 2.0})
    assert key == tables_io.request_key("POST", "/x", {"a": 2, "b": 1})
    got = tables_io.replay(spark.createDataFrame([(key,), ("k",)], "key string"), spark.createDataFrame([(key, "yes")], "key string, answer string"))
    assert {r.key: r.answer for r in got.collect()} == {key: "yes", "k": None}


def test_a_worker_stops_after_failures_in_a_row(spark):
    def scorer(text, questions):
        if text.startswith("bad"):
            raise RuntimeError("no answer")
        return {q: [40, 60] for q in questions}

    rows = [("a", "good", ["on_call"]), *((f"b{i}", "bad", ["on_call"]) for i in range(6)), ("c", "good", ["on_call", "other"]), ("d", None, ["on_call"]), ("e", "good", [])]
    units = spark.createDataFrame(rows, "content_hash string, text string, missing array<string>").coalesce(1)
    got = {r.content_hash: (r.distribution, r.stopped) for r in asking.asked_together(units, asking.STANDARD, scorer).collect()}
    assert got == {"a": ([40, 60], False), **{f"b{i}": (None, i == 5) for i in range(6)}, "c": (None, True)}
