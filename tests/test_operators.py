import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import answers as A
from quernstone.operators import lifecycle as L
from quernstone.operators.snapshots import changes

ITEM = "crawl_id bigint, board_id string, company string, posting_id string, external_id string, kind string, content_hash string, title string, recorded_at bigint, digest string"
CRAWL = "id bigint, board_id string, run_id string, started_at bigint, finished_at bigint, outcome string, http_status bigint, error_code string, listed_count bigint, invalid_count bigint, new_count bigint, changed_count bigint, attempts bigint, bytes bigint"


def item(crawl, posting, content, kind="posting", at=1):
    return (crawl, "b", "c", posting, None, kind, content, None, at, "clash")


def crawl(id, outcome="listed", board="b", at=None):
    return (id, board, f"r{id}", at if at is not None else 100 - id, None, outcome, None, None, None, 0, 0, 0, 1, 0)


def brute(items, crawls):
    """Listing by listing, with the contents last known."""
    out, known = set(), {}
    listed = sorted({c[0] for c in crawls if c[5] == "listed"})
    before = None
    for c in listed:
        now = {}
        for i in items:
            if i[0] == c and i[3] is not None:
                now[i[3]] = max(filter(None, [now.get(i[3]), i[6] if i[5] == "posting" else None]), default=None)
        if before is not None:
            out |= {("b", c, p, "added") for p in now.keys() - before} | {("b", c, p, "removed") for p in before - now.keys()}
        for p, h in now.items():
            if h is not None:
                if before is not None and p in before and known.get(p) not in (None, h):
                    out.add(("b", c, p, "changed"))
                known[p] = h
        before = set(now)
    return out


def run(spark, items, crawls, **kw):
    got = changes(spark.createDataFrame(items, ITEM), spark.createDataFrame(crawls, CRAWL), **kw).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_snapshot_changes(spark):
    items = [item(1, "p", "x"), item(1, "q", "y"), item(3, "p", None, "invalid"), item(3, "r", "z"), item(3, "r", "z"), item(6, "p", "x2"), item(None, "p", "w"), item(3, None, "w"), item(2, "p", "not listed")]
    crawls = [crawl(6), crawl(1), crawl(1), crawl(2, "failed"), crawl(3), crawl(7)]
    assert run(spark, items, crawls) == {("b", 3, "q", "removed"), ("b", 3, "r", "added"), ("b", 6, "r", "removed"), ("b", 6, "p", "changed"), ("b", 7, "p", "removed")} == brute(items, crawls)


@pytest.mark.parametrize("seed", range(3))
def test_snapshot_changes_against_brute_force(spark, seed):
    r = random.Random(seed)
    items = [item(c, f"{chr(97 + p % 26)}{p}", r.choice("xyz"), r.choice(["posting"] * 9 + ["invalid"])) for c in range(1, 9) for p in range(120) if r.random() < 0.8]
    items = [(*i[:6], i[6] if i[5] == "posting" else None, *i[7:]) for i in items]
    crawls = [crawl(c) for c in range(1, 10)]
    for chunk, split in ((1, 500_000), (4, 90), (16, 500_000)):
        assert run(spark, items + items[:20], crawls, chunk_rows=chunk, split_rows=split) == brute(items, crawls)


def test_snapshot_changes_of_nothing(spark):
    assert run(spark, [], []) == set() and run(spark, [], [crawl(1), crawl(2)]) == set() and run(spark, [item(1, "p", "x")], [crawl(1)]) == set()


def test_presence(spark):
    crawls = spark.createDataFrame([crawl(1), crawl(2), crawl(3, "not-modified"), crawl(4, "failed"), crawl(5)], CRAWL)
    items = spark.createDataFrame([item(1, "x", "a"), item(1, "y", "a"), item(2, "x", None, "invalid"), item(5, "x", "b"), item(5, "y", "a"), item(2, "new", None, "invalid")], ITEM)
    assert {tuple(r)[1:] for r in L.presence_runs(items, crawls).collect()} == {("x", 1, 5), ("y", 1, 1), ("y", 5, 5)}
    assert [tuple(r)[1:] for r in L.content_changes(items, crawls).collect()] == [("x", 5, "b")]
    boards = spark.createDataFrame([("b", "active", "lever", 2), ("z", "gone", "lever", 2)], "id string, status string, source string, last_listed_count bigint")
    assert {r.posting_id for r in L.open_postings(items, crawls, boards).collect()} == {"x", "y"}
    assert {tuple(r)[1:] for r in L.first_sightings(items, crawls).collect()} == set()


def test_gone_after_three_missing_over_two_days(spark):
    hour = 3_600_000
    rows = [crawl(1, at=0)] + [crawl(i, "not-found", at=i * 24 * hour) for i in (2, 3)] + [crawl(4, "failed", at=0)] + [crawl(5, "not-found", at=96 * hour)]
    crawls = spark.createDataFrame(rows, CRAWL)
    assert [tuple(r) for r in L.gone_boards(crawls).collect()] == [("b", 5)]
    state = L.failure_state(crawls).first()
    assert (state.consecutive_failures, state.not_found_count, state.not_found_since, state.gone) == (4, 3, 48 * hour, True)
    assert not L.failure_state(spark.createDataFrame([*rows, crawl(6)], CRAWL)).first().gone


def test_calibration(spark):
    options = ["remote", "hybrid", "onsite"]

    def judged(labels, predictions):
        return A.judged(spark.createDataFrame(labels, "posting string, option string"), spark.createDataFrame(predictions, "posting string, distribution array<int>"), options)

    s = A.scores(judged([("a", "remote"), ("b", "onsite"), ("c", ""), ("d", "moon"), ("e", "remote"), ("f", "remote")], [("a", [80, 15, 5]), ("b", [10, 20, 70]), ("f", [1])])).first()
    assert (s.compared, s.unlabelled, s.invalid, s.unanswered, s.accuracy, s.mean_truth) == (2, 1, 1, 2, 1.0, 0.75)
    assert A.scores(judged([("a", "onsite")], [("a", [100, 0, 0])])).first().brier == 2
    rows = judged([(str(i), "remote" if i < 9 else "hybrid") for i in range(10)] + [("x", "onsite")], [(str(i), [90, 10, 0]) for i in range(10)] + [("x", [50, 40, 10])])
    assert A.calibration_error(rows).first()[0] == pytest.approx(0.5 / 11)
    sweep = {r.threshold: (r.coverage, r.accuracy) for r in A.threshold_sweep(judged([("a", "remote"), ("b", "remote"), ("c", "remote"), ("d", "hybrid")], [("a", [95, 5, 0]), ("b", [85, 15, 0]), ("c", [52, 48, 0]), ("d", [55, 45, 0])])).collect()}
    assert sweep[50] == (1, 0.75) and sweep[80] == (0.5, 1) and sweep[90] == (0.25, 1)


def test_prefixes(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    length = lambda *x: A.shortest_prefix(ids(*x)).first().length
    assert length("abcdefghij12", "zbcdefghij12") == 10 and length("abcdefghij12", "abcdefghij34") == 11 and length("abcdefghijkl1", "abcdefghijkl2") == 13 and length() == 10
    asked = spark.createDataFrame([("abcdefghij",), ("abcdefghijk",), ("zzzzzzzzzz",)], "prefix string")
    assert [tuple(r) for r in A.resolve_prefixes(asked, ids("abcdefghijk1", "abcdefghij22")).collect()] == [("abcdefghijk", "abcdefghijk1")]


def test_grants_never_exceed_the_cap(spark):
    rows = spark.createDataFrame([("d", i, w) for i, w in enumerate([3, 4, 5, 1])], "day string, at int, want bigint")
    assert [r.granted for r in A.grants(rows, "day", "at", "want", 9).orderBy("at").collect()] == [3, 4, 2, 0]


def test_upserts(spark):
    t = lambda *x: spark.createDataFrame(list(x), "id string, version int, v string")
    assert sorted(r.v for r in A.upsert_newer(t(("a", 1, "old"), ("b", 1, "old")), t(("a", 1, "new"), ("b", 2, "new")), ["id"], "version").collect()) == ["new", "old"]
    assert [r.v for r in A.upsert_latest(t(("a", 1, "old")), t(("a", 1, "new")), ["id"], ["version"]).collect()] == ["new"]


def test_freshness_is_nearest_rank(spark):
    h = 3_600_000
    rows = [(i, "s", v) for i, v in enumerate([2 * h, int(30.04 * h), None, 10 * h, int(47.96 * h)])] + [(0, "s", 2 * h)]
    got = {r.source: r for r in L.freshness(spark.createDataFrame(rows, "sample_id bigint, source string, latency_ms bigint")).collect()}["All"]
    assert (got.postings, got.timed, got.p50_hours, got.p95_hours) == (5, 4, 10.0, 48.0)


def test_retention_keeps_newest_and_one_a_week(spark):
    day = 86_400_000
    kept = L.retained(spark.createDataFrame([(f"s{i}", i, i * day) for i in range(60)], "name string, seq int, created_at bigint"), 3, 4).select(F.collect_set("seq")).first()[0]
    assert set(kept) == {59, 58, 57, 55, 48, 41} | {max(i for i in range(60) if i * day // 604_800_000 == w) for w in (8, 7, 6, 5)}
