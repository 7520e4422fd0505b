import random

import pytest
from pyspark.sql import functions as F

from almanac.functions import text
from almanac.operators import linkage

ANNUAL = ["a", "b"]


@pytest.fixture(scope="module")
def records(spark):
    r = random.Random(9)
    last = ["Maier", "Meier", "von Schmidt", "Schmit", "Weber", "Webers", "Krauss", None]
    first = ["Karl", "Johann Friedrich", "Friedrich Johann", "J. F.", "Georg", "G.", None]
    rows = [(i, r.choice(last), r.choice(first), r.choice([None, *range(1800, 1816)]), r.choice("abcd"), r.choice([*range(8), *range(700)]) if r.random() < 0.85 else None) for i in range(1500)]
    return spark.createDataFrame(rows, "record_id long, last_name string, first_names string, first_year long, school string, location_id long")


@pytest.fixture(scope="module")
def spell(records):
    return linkage.cut(linkage.spell_table(linkage.spells(linkage.prepare(records), ANNUAL)))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain(spell, threshold, rare=2e-4):
    """The chain with a row for each pair: patterns, shares, edges."""
    compared = linkage.compare(linkage.block(spell), spell, ANNUAL).withColumn("is_rare", F.col("rare") < rare).persist()
    rows = sorted(linkage.patterns(compared, F.col("is_rare")))
    u = linkage.by_stratum(linkage.patterns(linkage.compare(linkage.random_pairs(spell, 200), spell, ANNUAL)), list(linkage.LEVELS))
    lam = linkage.match_share(spell.count(), sum(r["count"] for r in rows))
    m = linkage.em(rows, linkage.seeds(rows, rare), u, lam)
    return rows, m, u, lam, linkage.score(compared, m, u, lam)


@pytest.mark.parametrize("threshold", [0.9, 0.3])
def test_counts_and_clusters_are_those_of_all_pairs(spell, threshold):
    rows, m, u, lam, scored = plain(spell, threshold)
    met = linkage.Met(spell, ANNUAL)
    assert met.patterns(2e-4) == rows and {r["geo"] for r in rows} == {0, 2, 3}
    assert linkage.by_stratum(linkage.random_patterns(spell, ANNUAL, 200), list(linkage.LEVELS)) == u
    got = met.edges(m, u, lam, threshold)
    years = spell.select("spell_id", F.struct("school", "first_seen", "last_seen").alias("s"))
    may = scored.where(F.col("probability") >= threshold).join(years.toDF("lid", "_l"), "lid").join(years.toDF("rid", "_r"), "rid").where(linkage._together("_l", "_r"))
    assert rows_of(got.select("lid", "rid", F.round("weight", 9))) == rows_of(may.select("lid", "rid", F.round("weight", 9))) and got.count()
    assert rows_of(linkage.merged(got, spell)) == rows_of(linkage.cluster(scored, spell, threshold))


def test_names_alike_one_way_round_only(spell, monkeypatch):
    """Their pairs keep the order of their ids."""
    monkeypatch.setattr(text, "alike", lambda a, b, least: F.length(a) < F.length(b))
    compared = linkage.compare(linkage.block(spell), spell, ANNUAL).withColumn("is_rare", F.col("rare") < 2e-4)
    assert linkage.Met(spell, ANNUAL).patterns(2e-4) == sorted(linkage.patterns(compared, F.col("is_rare")))


def test_link_makes_no_row_for_each_pair(records, monkeypatch):
    def no(*a, **b):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(linkage, "compare", no)
    monkeypatch.setattr(linkage, "block", no)
    assert linkage.link(records, ANNUAL, sample=200).count() == 1500


def test_letters_tell_no_pair_away_that_is_alike(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcäß") for _ in range(r.randint(0, 7))) for _ in range(60)] + [None]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").withColumn("j", text.jaro_winkler(F.col("a"), F.col("b")))
    for least in (0.0, 0.6, 0.75, 0.92):
        got = pairs.where(text.alike(F.col("a"), F.col("b"), least))
        assert rows_of(got) == rows_of(pairs.where(F.col("j") >= least))
