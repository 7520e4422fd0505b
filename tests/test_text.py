import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from almanac.functions import dates, text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("r")).collect()]


def test_name_codes(spark):
    want = {
        "Mueller": "657", "Müller": "657", "Miller": "657", "Schmidt": "862", "Schmitt": "862", "Schmid": "862", "Meyer": "67", "Meier": "67",
        "Maier": "67", "Mayr": "67", "Wikipedia": "3412", "Breschnew": "17863",
    }
    assert column(spark, list(want), text.phonetic_name) == list(want.values())
    assert column(spark, ["", None, "123", "xaver", "hh"], text.phonetic_name) == [None, None, None, "4837", None]


def test_place_codes_differ_at_the_ends(spark):
    assert column(spark, ["stadt", "xanten"], text.phonetic_word) == ["8228", "8626"]
    assert column(spark, ["bad  homburg", "", None], text.phonetic_key) == ["18-06174", "", None]


def test_fold(spark):
    assert column(spark, ["  Köln-Deutz ", "St. Gallen/CH", "Łódź", "Großenhain", "Ångström", "a  b\t c", None], text.fold) == [
        "koeln deutz", "st gallen ch", "łodz", "grossenhain", "aangstroem", "a b c", None,
    ]


def test_accents_against_unicode(spark):
    letters = [chr(c) for c in range(0xC0, 0x180) if unicodedata.normalize("NFKD", chr(c)) != chr(c)]
    want = ["".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in letters]
    got = column(spark, letters, text.drop_accents)
    assert [g for g, w in zip(got, want, strict=True) if len(w) == 1] == [w for w in want if len(w) == 1]


def test_abbreviations_and_spelling(spark):
    assert column(spark, ["frankfurt a m", "frankfurt a d o", "st gallen", "freiburg i b"], text.expand_abbreviations) == ["frankfurt am main", "frankfurt an der oder", "sankt gallen", "freiburg im breisgau"]
    assert column(spark, ["cassel", "herzogthum", "zweybruecken", "stuttgardt", "heidelbergensis", "im badischen", "maynz", "coeln", "hessen"], text.modernize) == [
        "kasel", "herzogtum", "zweibrueken", "stutgart", "heidelberg", "im baden", "mainz", "koeln", "hesen",
    ]
    assert column(spark, ["meckl"], text.modernize) == [text.modern_word("meckl")] == ["mekl"]


def test_qualifiers(spark):
    got = column(spark, ["herzogtum bremen", "greifenberg in schlesien", "in pomern", "celle", "neustadt, bei coburg", None], text.strip_qualifiers)
    assert [tuple(g) if g else None for g in got] == [("bremen", "herzogtum"), ("greifenberg", "schlesien"), ("pomern", None), ("celle", None), ("neustadt", "bei coburg"), None]


def test_ladder_is_one_row_for_each_string(spark):
    df = spark.createDataFrame([("Cassel",), ("Cassel",), (None,), ("!!",)], "v string")
    rows = {r["v"]: r for r in text.ladder(df, "v").collect()}
    assert set(rows) == {"Cassel", "!!"} and rows["!!"]["k_fold"] is None and rows["Cassel"]["k_modern"] == "kasel"


def test_jaro_winkler_against_duckdb(spark):
    words = ["", "a", "ab", "martha", "marhta", "dixon", "dicksonx", "müller", "mueller", "jones", "johnson", "aaaa", "aaa", "abcdef", "fedcba", "größe", "grösse", "dwayne", "duane"]
    c = duckdb.connect()
    want = {(a, b): c.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0] for a in words for b in words}
    df = spark.createDataFrame(list(want), "a string, b string")
    for r in df.select("a", "b", text.jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect():
        assert r["s"] == pytest.approx(want[r["a"], r["b"]], abs=1e-12), (r["a"], r["b"])
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(text.jaro_winkler(F.col("a"), F.col("b"))).first()[0] is None


def test_surnames(spark):
    got = column(spark, ["von Müller", "Schmidt", "Schmitt", "Zur Mühlen", "de la Croix", "von der Tann", "O'Neill", "", None], text.surname)
    assert [tuple(g) if g else None for g in got] == [("von", "mueler"), (None, "schmidt"), (None, "schmit"), ("zur", "muehlen"), ("de la", "croix"), ("von der", "tan"), (None, "o'neil"), (None, None), None]


def test_given_names(spark):
    names = ["Johann Friedrich", "Joh. Frdr.", "J. F.", "Carolus Fridericus", "K. F.", "F.", "Guilielmus", "Joannes Baptista", None]
    assert column(spark, names, text.given_names) == [["johann", "friedrich"], None, None, ["karl", "friedrich"], None, None, ["wilhelm"], ["johann", "baptista"], None]
    assert column(spark, names, text.initials) == ["jf", "jf", "jf", "kf", "kf", "f", "w", "jb", None]
    assert column(spark, ["Carl Ivo"], lambda c: text.initials(c, loose=False)) == ["ki"]
    assert column(spark, names[:3], text.has_abbreviation) == [False, True, True]
    assert column(spark, ["fj"], text.sorted_letters) == ["fj"]


def test_nobility(spark):
    rows = [("Karl Graf", "Arnim"), ("Louis v.", "Thümen"), ("Otto", "von Berg"), ("V. Otto", "Berg"), ("Erbprinzessin", "X"), ("Anna", "Vonhoff"), (None, "Zedler")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, l string")
    kind, noble = text.nobility(F.col("f"), F.col("l"), noble=["Zedler"], common=["Berg"])
    got = [tuple(r) for r in df.orderBy("i").select(kind, noble).collect()]
    assert [g[0].split("_")[0] for g in got] == ["titled", "particle", "particle", "known", "titled", "no", "known"]
    assert [g[1] for g in got] == [True, True, True, False, True, False, True]


def test_places_and_lookups(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "b"), (3, "a", None), (4, None, None)], "i int, h string, r string")
    assert [r[0] for r in df.orderBy("i").select(text.place(F.col("h"), F.col("r"))).collect()] == ["a, b", "b", "a", None]
    assert column(spark, ["x", "y", None], lambda c: text.mapped(c, {"x": "1"})) == ["1", None, None]
    assert column(spark, ["x", "y", None], lambda c: text.lenient(c, {"x": "1"})) == ["1", "y", None]
    assert column(spark, [" a , b", "c"], text.first_part) == ["a", "c"]
    assert column(spark, ["old city", "shire"], lambda c: text.contains_case(c, [("city", "s"), ("shire", "d")])) == ["s", "d"]


def test_resolver(spark):
    free = spark.createDataFrame([("Göttingen u. Berlin",), ("Heidelb.",), ("ex ac. Jenensi",), ("Bonn, Kiel",), ("Mar",)], "v string")
    known = spark.createDataFrame([("goettingen",), ("berlin",), ("heidelberg",), ("jena",), ("bonn",), ("kiel",), ("marburg",)], "school string")
    got = {(r["v"], r["school"]) for r in text.resolve_names(free, "v", known, "school").collect()}
    assert got == {("Göttingen u. Berlin", "goettingen"), ("Göttingen u. Berlin", "berlin"), ("Heidelb.", "heidelberg"), ("Bonn, Kiel", "bonn"), ("Bonn, Kiel", "kiel")}


def test_years(spark):
    assert column(spark, ["berlin_21", "x", None], dates.volume_year) == [1821, None, None]
    assert column(spark, ["am 3. Mai 1834", "n.d."], dates.year_in) == [1834, None]
    assert column(spark, ["1834-02-30", "1834-02-03", ""], dates.lenient_year) == [None, 1834, None]
    assert column(spark, [1800, 1809, 1810, 1848], dates.era, "int") == [1, 1, 2, 5]
    assert column(spark, [1790, 1800, 1818, 1819, 1850, None], lambda c: dates.step_year(c, [1806, 1819, 1848]), "int") == [1806, 1806, 1806, 1819, 1848, None]
