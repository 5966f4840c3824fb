import math
import random

import pytest

from quernstone.llm import percentiles as P

SCHEMA = "g string, day int, v bigint, n string"


def exact(values, q):
    values = sorted(max(0, v) for v in values if v is not None)
    return values[max(1, math.ceil(q * len(values))) - 1] if values else None


def rows():
    r = random.Random(1)
    out = [("wide", r.randint(0, 3), r.randint(-5, 10**13), "x") for _ in range(300)]
    out += [("ties", 0, r.choice([5, 5, 5, 7]), "x") for _ in range(50)] + [("one", 0, 42, "x"), ("none", 0, None, "x"), ("zero", 0, 0, "x"), ("zero", 1, -9, "x"), (None, 0, 3, "x"), (None, 0, 4, "x")]
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_percentiles_are_exact(spark, shuffled, monkeypatch):
    if shuffled:
        monkeypatch.setattr(P, "BROADCAST_INTERVALS", 0)
    df = spark.createDataFrame(rows(), SCHEMA)
    qs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: tuple(r)[1:] for r in P.percentiles(P.summarise(df, ["g"], "v"), ["g"], qs).collect()}
    values = {}
    for g, _, v, _ in rows():
        values.setdefault(g, []).append(v)
    assert got == {g: (sum(v is not None for v in vs), *(exact(vs, q) for q in qs.values())) for g, vs in values.items() if g != "none"}
    all_ = P.percentiles(P.summarise(df, [], "v"), [], qs).first()
    assert tuple(all_)[1:] == tuple(exact([v for _, _, v, _ in rows()], q) for q in qs.values())


def test_summaries_of_days_combine_within_the_resolution(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    daily = [P.summarise(df.where(f"day = {d}"), ["g"], "v", 1000) for d in range(4)]
    whole = daily[0].unionAll(daily[1]).unionAll(daily[2]).unionAll(daily[3])
    for r in P.percentiles(whole, ["g"], {"p50": 0.5}).collect():
        true = exact([v for g, _, v, _ in rows() if g == r.g], 0.5)
        assert r.p50 <= true < r.p50 + 1000


def test_samples_count_once(spark):
    s = "sample_id bigint, run_id string, source string, company string, first_seen_at timestamp_ntz, latency_ms bigint"
    from datetime import datetime

    at = datetime(2026, 1, 2, 3)
    df = spark.createDataFrame([(1, "r", "s", "c", at, 7200000), (1, "r", "s", "c", at, 7200000), (2, "r", "s", "c", at, None), (None, "r", "s", "c", at, 5)], s)
    assert [tuple(r) for r in P.by(df, ["run_id"]).collect()] == [("r", 1, 2.0, 2.0)]
    assert [tuple(r) for r in P.windows(df).collect()] == [("s", "2026-01-02", 1, 2.0, 2.0)]


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert P.percentiles(P.summarise(df, ["g"], "v"), ["g"], {"p50": 0.5}).collect() == []
