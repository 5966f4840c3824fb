import random
import re

import pytest

from quernstone.llm.similar import Similar


def brute(rows, size, threshold, least):
    sets = {}
    for k, t in set(rows):
        if k is not None and t is not None:
            w = [x.lower() for x in re.findall(r"[^\W_]+", t)]
            if len(w) >= max(size, least):
                sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    keys = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def near(r, words, vocabulary):
    out = list(words)
    for _ in range(r.randint(0, 6)):
        i = r.randrange(len(out))
        out[i : i + r.randint(0, 1)] = r.choices(vocabulary, k=r.randint(0, 2))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ü", "é"]
    out, n = [], 0
    for _ in range(12):
        base = r.choices(vocabulary, k=r.randint(8, 80))
        for _ in range(r.randint(1, 9)):
            out.append((f"id{n:03}", " ".join(near(r, base, vocabulary))))
            n += 1
    copies = [(f"c{i}", out[0][1].upper()) for i in range(6)]
    return out + copies + [("n", None), (None, out[0][1]), ("e", ""), ("t", "w1"), out[3], ("big", " ".join(r.choices(vocabulary, k=20_000)))]


@pytest.mark.parametrize("size,threshold,least", [(3, 0.6, 0), (5, 0.8, 0), (1, 0.5, 10), (3, 0.6, 50)])
def test_pairs_equal_brute_force(spark, rows, size, threshold, least, monkeypatch):
    monkeypatch.setattr("quernstone.llm.similar.BLOCK", 3)  # many blocks a list
    df = spark.createDataFrame([(*x, "h", 1) for x in rows], "id string, text string, h string, n int")
    got = [tuple(x) for x in Similar(df, "id", "text", size, threshold, least).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == set(brute(rows, size, threshold, least))


def test_groups_are_connected_components(spark, rows):
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.id: r.group_id for r in Similar(df, "id", "text", 3, 0.6).groups().collect()}
    parent = {k: k for k in got}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in brute(rows, 3, 0.6, 0):
        parent[root(a)] = root(b)
    assert {(a, b) for a in got for b in got if got[a] == got[b]} == {(a, b) for a in got for b in got if root(a) == root(b)}


def test_every_row_has_a_group(spark, rows):
    got = Similar(spark.createDataFrame(rows, "id string, text string"), "id", "text", 3, 0.6, 50).groups().collect()
    assert sorted(r.id for r in got) == sorted({k for k, _ in rows if k is not None})
    alone = {k for k, t in rows if k is not None and len(re.findall(r"[^\W_]+", t or "")) < 50}
    assert {"n", "e", "t"} <= alone and all(r.n_links == 0 for r in got if r.id in alone)
    assert not {r.group_id for r in got if r.id in alone} & {r.group_id for r in got if r.id not in alone} and len({r.group_id for r in got if r.id in alone}) == len(alone)


def test_nothing(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert Similar(df, "id", "text").pairs().collect() == [] and Similar(df, "id", "text").groups().collect() == []
