import random
from collections import defaultdict

import numpy as np

from almanac.llm import near_dedup as N


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for i, s in sets.items():
        near = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j > i:
                    near[j] += 1
        for j, n in near.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(n=250, seed=1):
    """Texts, exact copies, and a family of variants of one text around the threshold."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(r.randint(1, 120)))) for i in range(n)]
    base = [word() for _ in range(200)]
    for i in range(n, 2 * n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(2 * n + i, rows[i][1].upper()) for i in range(0, n, 7)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    got = {r["doc_id"]: r for r in N.near_duplicates(df).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert len({c for _, c in want.values()}) < len(rows)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = corpus(120, seed=3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(N, "BLOCK", 16)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(4, "a b c", 1), (2, "A  b\tc", 2), (9, None, 3), (8, "", 4), (7, " \n", 5), (None, "a b c", 6), (4, "a b c", 1), (5, "x " * 50_000, 7), (6, "é b c d e", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    out = N.near_duplicates(df).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(tuple(r)[1:])
    assert by[4] == [(1, 2, False)] * 2 and by[2] == [(1, 2, True)] and by[None] == [(1, 2, False)]
    assert by[9] == [(0, 9, True)] and by[8] == [(0, 8, True)] and by[7] == [(0, 7, True)] and by[5] == [(1, 5, True)]
    assert N.near_duplicates(df.limit(0)).count() == 0
    left = N.near_dedup(df)
    assert left.columns == df.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 2, 5, 6, 7, 8, 9]


def test_odd_sketches_estimate():
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 1 << 63, 1000, dtype=np.uint64))
    for keep in (950, 900, 800):
        b = np.unique(np.concatenate([a[:keep], r.integers(0, 1 << 63, 1000 - keep, dtype=np.uint64)]))
        x, y = (N.odd_sketch(N.signature(s)) for s in (a, b))
        d = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        real = keep / (2000 - keep)
        estimate = 1 + N.SKETCH_BITS / (4 * N.SAMPLES) * np.log(1 - 2 * d / N.SKETCH_BITS)
        assert abs(estimate - real) < 0.15
        assert real < 0.85 or d <= N.most_flips(0.85)


def test_narrow_ids_and_ids_that_are_no_numbers(spark):
    import pytest

    text = "one two three four five six seven eight nine ten"
    out = N.near_duplicates(spark.createDataFrame([(3, text), (1, text), (2, "other words here")], "doc_id int, text string"))
    assert dict(out.dtypes)["component_id"] == "int" and {(r["doc_id"], r["component_id"]) for r in out.collect()} == {(3, 1), (1, 1), (2, 2)}
    with pytest.raises(TypeError):
        N.near_duplicates(spark.createDataFrame([("a", text)], "doc_id string, text string"))
