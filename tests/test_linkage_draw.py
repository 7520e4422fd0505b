import inspect
import random

import pytest

from almanac.operators import linkage
from almanac.plans import catalog


@pytest.mark.parametrize(("step", "total"), [(3, 700), (1, 2_000_100)])
def test_draw_is_one_from_the_sorted_ids(spark, step, total):
    """Also over two million spells."""
    spell = spark.range(0, total * step, step).selectExpr("id as spell_id", "concat('s', id % 2) as school")
    got = sorted(map(tuple, linkage.random_pairs(spell, 40).collect()))
    draw, ids = random.Random(1848), range(0, total * step, step)
    left, right = draw.sample(ids, 40), draw.sample(ids, 40)
    assert got == sorted((a, b) for a in left for b in right if a < b and a % 2 != b % 2) and got


def test_query_draws_as_many_as_the_operator(spark, monkeypatch):
    seen, sign = [], inspect.signature(linkage.link)
    monkeypatch.setattr(linkage, "link", lambda *a, **b: seen.append(sign.bind(*a, **b)))
    catalog.record_linkage(spark, "/root/testdata/sf0.001")
    seen[0].apply_defaults()
    assert seen[0].arguments["sample"] == 3000
