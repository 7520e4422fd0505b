"""Joins within blocks make each pair once, and shuffle rows, not pairs."""

import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import joins


def above(df, join):
    """The nodes of the plan over its first join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return lines[: next(i for i, x in enumerate(lines) if join in x)]


@pytest.fixture
def ladder(spark):
    left = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, None, "x"), (3, "q", None), (4, "q", "y"), (5, "a", "y")], "id int, k1 string, k2 string")
    right = spark.createDataFrame([(10, "a", "x"), (10, "b", "y"), (11, "b", "x"), (11, "b", "x"), (None, "a", None)], "v int, k1 string, k2 string")
    return left, right


@pytest.mark.parametrize("rows", [0, 200_000])
def test_ladder_takes_each_lowest_rung_once(ladder, monkeypatch, rows):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(joins, "TASK_PAIRS", 2)
    got = sorted(joins.ladder_join(*ladder, "id", ["k1", "k2"], "v").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(1, 10, 0), (1, 11, 0), (1, None, 0), (2, 10, 1), (2, 11, 1), (4, 10, 1), (5, 10, 0), (5, None, 0)], key=str)


def test_hits_of_a_ladder_are_not_shuffled(ladder):
    assert not any("Exchange" in x for x in above(joins.ladder_join(*ladder, "id", ["k1", "k2"], "v"), "HashJoin"))


@pytest.mark.parametrize("rows", [0, 200_000])
def test_ladder_from_arrays_has_each_hit_once(spark, monkeypatch, rows):
    for k, v in (("BROADCAST_ROWS", rows), ("TASK_PAIRS", 40), ("CHUNK", 3)):
        monkeypatch.setattr(joins, k, v)
    draw = random.Random(7)
    some = lambda x: draw.choice(x) if draw.random() < 0.8 else None
    left = [(i if i else None, some("abcdef"), some("xyz")) for i in range(40)] + [(3, "a", "x"), (3, "b", "x"), (None, "c", "y")]
    right = [(draw.choice([None, *range(30)]), some("abcghi"), some("xxyw")) for _ in range(50)]
    met = {(a[0], b[0], k) for a in left for b in right for k in (0, 1) if a[1 + k] is not None and a[1 + k] == b[1 + k]}
    want = [x for x in met if x[2] == min(y[2] for y in met if y[0] == x[0])]
    got = joins.ladder_join(spark.createDataFrame(left, "id int, k1 string, k2 string"), spark.createDataFrame(right, "v int, k1 string, k2 string"), "id", ["k1", "k2"], "v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_hits_of_a_ladder_are_written_in_few_bytes(spark, tmp_path):
    left = spark.range(60).select("id", F.lit("a").alias("k"))
    right = spark.range(30_000).select(F.col("id").alias("v"), F.lit("a").alias("k"))
    joins.ladder_join(left, right, "id", ["k"], "v").write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 1_800_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 1_800_000


@pytest.mark.parametrize("task", [5, 20_000_000])
def test_pairs_of_several_rules_come_once_without_a_shuffle(spark, monkeypatch, task):
    monkeypatch.setattr(joins, "TASK_PAIRS", task)
    draw = random.Random(5)
    rows = [(i, draw.choice("ab") if draw.random() < 0.9 else None, draw.choice("xyz"), draw.randrange(3)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, p string, q string, y int").repartition(3)
    out = joins.multi_rule_pairs(df, "id", [["p", "q"], ["q", "y"], ["p"]])
    hit = lambda a, b: a[1] is not None and a[1] == b[1] or a[2:] == b[2:]
    assert sorted(map(tuple, out.collect())) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and hit(a, b))
    assert not any("Exchange" in x for x in above(out, "Join"))


def test_records_whose_ids_repeat_still_give_a_pair_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "id int, p string")
    assert list(map(tuple, joins.multi_rule_pairs(df, "id", [["p"]]).collect())) == [(1, 2)]
