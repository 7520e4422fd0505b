"""Pairs compared by kinds equal those compared one by one, and no pair is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import joins, linkage

COLUMNS = "spell_id long, school string, first_seen int, last_seen int, ln_norm string, ln_phon string, ln_particle string, gn_set array<string>, gn_init string, gn_init_set string, gn_i1 string, gn_has_full boolean, location_id long"


@pytest.fixture(scope="module")
def spell(spark):
    draw, out = random.Random(3), []
    for i in range(150):
        name, given = draw.choice([("maier", "67"), ("meier", "67"), ("webers", "3178"), ("weber", "317"), (None, None)]), draw.choice([(["karl"], "k", "k"), (["friedrich", "johann"], "jf", "fj"), ([], "k", "k"), (None, None, None)])
        year = draw.randrange(1800, 1812)
        out.append((i, draw.choice(["berlin", "jena", "kiel"]), year, year + draw.randrange(3), *name, draw.choice([None, "von"]), given[0], given[1], given[2], given[1] and given[1][0], bool(given[0]), draw.choice([None, 1, 2, 3])))
    return spark.createDataFrame(out, COLUMNS)


def one_by_one(spell):
    l, r = spell.alias("l"), spell.alias("r")
    on = (F.col("l.spell_id") < F.col("r.spell_id")) & (F.col("l.spell_id") % 2 == F.col("r.spell_id") % 2) & (F.col("l.school") != F.col("r.school"))
    return linkage.compare(l.join(r, on).select(F.col("l.spell_id").alias("lid"), F.col("r.spell_id").alias("rid")), spell, ["berlin"])


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize(("kinds", "task"), [(500, 300), (2, 20_000_000)])
def test_blocks_equal_pairs_one_by_one(spell, monkeypatch, kinds, task):
    monkeypatch.setattr(linkage, "KINDS", kinds)
    monkeypatch.setattr(joins, "TASK_PAIRS", task)
    m, u = ({s: {f: [(k - i) ** p for i in range(k)] for f, k in linkage.LEVELS.items()} for s in ("both_full", "mixed", "both_abbrev")} for p in (2, -1))
    blocks, plainly = linkage.Blocks(spell, ["spell_id % 2"], ["berlin"], F.col("l.school") != F.col("r.school")), one_by_one(spell)
    assert plain(blocks.compared().collect()) == plain(plainly.collect())
    order = ["stratum", *linkage.LEVELS, "count"]
    assert sorted(tuple(r[c] for c in order) for r in blocks.patterns()) == sorted(tuple(r[c] for c in order) for r in linkage.patterns(plainly))
    mine, theirs = blocks.scored(m, u, 1e-3).collect(), linkage.score(plainly, m, u, 1e-3).collect()
    assert plain(mine) == plain(theirs) and 0 < len(theirs) < plainly.count()


def test_pairs_compared_in_blocks_are_not_shuffled(spell):
    df = linkage.Blocks(spell, ["spell_id % 2"], ["berlin"]).compared()
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(lines) if "spell_id" in x and "Join" in x and "<" in x)
    assert not any("Exchange hash" in x for x in lines[:join])


def test_bound_on_years_leaves_the_blocks_as_they_are(spell):
    """Also where a year isn't known."""
    k = F.col("spell_id")
    spell = spell.withColumns({"first_seen": F.when(k % 9 != 0, F.col("first_seen")), "last_seen": F.when(k % 11 != 0, F.col("last_seen"))})
    wide = linkage.block(spell, 0.9)
    years = spell.select("spell_id", "first_seen", "last_seen")
    a, b = years.toDF("lid", "f1", "l1"), years.toDF("rid", "f2", "l2")
    expected = wide.join(a, "lid").join(b, "rid").where(F.greatest(F.col("f2") - F.col("l1"), F.col("f1") - F.col("l2")) <= 1).select("lid", "rid")
    assert sorted(map(tuple, linkage.block(spell, 0.9, True, 1).collect())) == sorted(map(tuple, expected.collect())) != []
