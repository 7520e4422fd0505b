"""Strings meet terms on one rung only, whatever the number of places with a name."""

from pyspark.sql import functions as F

from almanac.functions import text
from almanac.operators import geocode


def test_terms_are_met_on_the_lowest_rung_alone(spark, monkeypatch):
    terms = spark.createDataFrame([(n, 10 * i, i, 1.0) for i, n in enumerate(["Neustadt"] * 40 + ["Kassel"] * 40 + ["Meiningen"] * 40)], "TERM string, TERM_ID long, SUBJECT_ID long, term_quality double")
    index = terms.join(text.ladder(terms.select("TERM"), "TERM"), "TERM").persist()
    strings = ["Neustadt", "KASSEL", "Majningen", "Xyz", None]
    tries = spark.createDataFrame([(s, 0, s) for s in strings], "src_raw string, try int, src string")
    written, cut = [], geocode.cut
    monkeypatch.setattr(geocode, "cut", lambda df: written.append(out := cut(df)) or out)
    got = geocode.rung_hits(tries, index, geocode.Settings()).groupBy("src_raw", "match_method").agg(F.count(F.lit(1)), F.count_distinct("SUBJECT_ID")).collect()
    assert sorted(map(tuple, got)) == [("KASSEL", "fold", 40, 40), ("Majningen", "phonetic", 40, 40), ("Neustadt", "exact", 40, 40)]
    assert max(df.count() for df in written) <= len(strings)
