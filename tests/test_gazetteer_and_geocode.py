import pytest
from pyspark.sql import functions as F

from almanac.operators import gazetteer, geocode
from almanac.sources import contracts

#: (id, parent, name, kind, lat, lon, languages)
PLACES = [
    (1, None, "Europe", "continent", None, None, 5), (10, 1, "Deutschland", "nation", 51.0, 10.0, 5), (20, 10, "Hessen", "state", 50.6, 9.0, 3), (21, 10, "Schlesien", "region", 51.0, 17.0, 3),
    (30, 10, "Baden", "duchy", 48.5, 8.5, 2), (100, 20, "Kassel", "city", 51.31, 9.48, 5), (101, 20, "Marburg", "city", 50.81, 8.77, 5), (102, 21, "Greifenberg", "town", 51.03, 15.4, 1),
    (103, 10, "Greifenberg", "town", 53.9, 15.2, 1), (104, 10, "Frankfurt am Main", "city", 50.11, 8.68, 5), (105, 10, "Frankfurt an der Oder", "city", 52.34, 14.55, 3), (106, 20, "Neustadt", "village", 50.85, 9.11, 1),
    (107, 30, "Neustadt", "village", 47.9, 8.2, 1), (108, 10, "Berlin", "city", 52.52, 13.4, 5), (109, 108, "Moabit", "suburb", 52.53, 13.34, 1), (110, 1, "Timbuktu", "city", 16.77, -3.0, 1),
]


@pytest.fixture(scope="module")
def index(spark):
    terms = [(n, i * 10, i, "P ", "V ", None, None) for i, _, n, *_ in PLACES]
    terms += [("Cassel", 1001, 100, None, None, "H", None), ("DEU", 2, 10, None, None, None, "ISO3L "), ("Merged", 3, 200, "P", None, None, None), ("River", 4, 300, "P", None, None, None)]
    tables = {
        "terms": spark.createDataFrame(terms, "TERM string, TERM_ID long, SUBJECT_ID long, PREFERRED string, VERNACULAR string, HISTORIC_FLAG string, OTHER_FLAGS string"),
        "subjects": spark.createDataFrame([(i, "A ", "N") for i, *_ in PLACES] + [(200, "A", "M"), (300, "P", "N")], "SUBJECT_ID long, RECORD_TYPE string, MERGED_STAT string"),
        "placetypes": spark.createDataFrame([(i, 1, "P ", k) for i, _, _, k, *_ in PLACES] + [(100, 2, "N", "state")], "SUBJECT_ID long, PTYPE_ROLE_ID long, PREFERRED string, PLACETYPE string"),
        "rels": spark.createDataFrame([(p, i, "P ") for i, p, *_ in PLACES if p], "PARENT_ID long, CHILD_ID long, PREFERRED string"),
        "coords": spark.createDataFrame([(i, float(a), float(o), None, None, None, None) for i, _, _, _, a, o, _ in PLACES if a is not None], "SUBJECT_ID long, LAT double, LON double, LAT_MIN_BOX double, LAT_MAX_BOX double, LON_MIN_BOX double, LON_MAX_BOX double"),
        "languages": spark.createDataFrame([(i, f"l{k}") for i, *_, n in PLACES for k in range(n)], "SUBJECT_ID long, LANGUAGE_CODE string"),
    }
    return gazetteer.build_index(tables).persist()


def test_index(index):
    rows = {r["TERM"]: r for r in index.collect()}
    assert {"DEU", "Merged", "River"} & set(rows) == set()
    assert rows["Cassel"]["term_quality"] == 0.80 and rows["Kassel"]["term_quality"] == 1.00 and rows["Kassel"]["geo_precision"] == "settlement"
    assert rows["Moabit"]["is_sub_settlement"] and not rows["Berlin"]["is_sub_settlement"] and rows["Moabit"]["ancestors"] == [108, 10, 1]
    assert rows["Deutschland"]["n_children"] == 7 and rows["Berlin"]["prominence"] > rows["Moabit"]["prominence"]


def test_missing_tables_switch_features_off(spark):
    t = spark.createDataFrame([("A", 1, 1, "P", None, None, None)], "TERM string, TERM_ID long, SUBJECT_ID long, PREFERRED string, VERNACULAR string, HISTORIC_FLAG string, OTHER_FLAGS string")
    s = spark.createDataFrame([(1, "A", "N")], "SUBJECT_ID long, RECORD_TYPE string, MERGED_STAT string")
    r = gazetteer.build_index({"terms": t, "subjects": s}).first()
    assert r["geo_precision"] == "unknown" and r["LAT"] is None and not r["is_settlement"]


CASES = [
    ("Hessen", "Kassel", 100), (None, "Cassel", 100), (None, "Kasel", 100), ("Schlesien", "Greifenberg", 102), (None, "Greifenberg in Schlesien", 102), (None, "Frankfurt a. M.", 104), (None, "Frankfurt a. d. O.", 105),
    ("Hessen", "Neustadt", 106), ("Baden", "Neustadt", 107), ("Herzogthum Hessen", None, 20), (None, "Marpurg", 101), ("Hessen", "Unbekanntia", 20), (None, None, None), (None, "Nirgendwo", None), (None, "Spandow", 108), (None, "nicht lesbar", None),
]


@pytest.fixture(scope="module")
def resolved(spark, index):
    students = spark.createDataFrame([(i, r, h, "marburg") for i, (r, h, _) in enumerate(CASES)], "i int, region string, hometown string, school string")
    seats = spark.createDataFrame([("marburg", 50.81, 8.77)], "school string, LAT0 double, LON0 double")
    corrections = spark.createDataFrame([("spandow", "Berlin", None, "x"), ("Nicht lesbar", None, None, "x")], "raw string, canonical string, context string, category string")
    return students, geocode.geocode(students, index, seats, corrections).persist()


def test_cases(resolved):
    students, out = resolved
    got = {r["i"]: r["location_id"] for r in out.collect()}
    assert {i: got[i] for i in range(len(CASES))} == {i: want for i, (*_, want) in enumerate(CASES)}


def test_output_contracts(resolved, index):
    students, out = resolved
    contracts.same_rows(students, out, ["i", "region", "hometown", "school"])
    contracts.refers(out, "location_id", index, "SUBJECT_ID")
    contracts.unique(out, ["i"])
    with pytest.raises(contracts.ContractError):
        contracts.same_rows(students, out.limit(3), ["i"])


def test_seat_exception_and_override(spark, index):
    seats = spark.createDataFrame([("berlin", 52.52, 13.4)], "school string, LAT0 double, LON0 double")
    students = spark.createDataFrame([(1, "Schlesien", "Berlin", "berlin"), (2, "Hessen", "Kassel", "berlin")], "i int, region string, hometown string, school string")
    forced = spark.createDataFrame([("kassel ", 101, "x")], "raw string, subject_id long, reason string")
    got = {r["i"]: (r["location_id"], r["match_method"]) for r in geocode.geocode(students, index, seats, overrides=forced).collect()}
    assert got[1][0] == 21 and got[2] == (101, "override")


def test_collapse():
    rows = [(1, 50.0, 9.0, set()), (2, 50.01, 9.0, set()), (3, 52.0, 9.0, {1}), (4, None, None, set()), (5, 53.0, 9.0, set())]
    assert geocode.collapse(rows, 25.0) == [0, 0, 0, 3, 4]


def test_difference(spark):
    a = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, 8)], "i int, location_id long")
    b = spark.createDataFrame([(1, 5), (2, 6), (3, None), (4, 9)], "i int, location_id long")
    assert {r["change"]: r["count"] for r in geocode.difference(a, b, "i").collect()} == {"same": 1, "lost": 1, "new": 1, "moved": 1}


def test_checks(spark):
    df = spark.createDataFrame([(str(i) if i else "T1", "12" if i % 4 else "x", "P ") for i in range(10)], "id string, name string, flag string")
    report = {r["column"]: r["ok"] for r in contracts.structure(df, ["id"], ["name"]).collect()}
    assert report == {"id": False, "name": False}
    assert contracts.domains(df, {"flag": ["P"]}).first()["ok"] and not contracts.domains(df, {"flag": ["N"]}).first()["ok"]
    with pytest.raises(contracts.ContractError):
        contracts.require(contracts.structure(df, ["id"], []), "ids")
    contracts.holds(df, F.length("flag") == 2, "flags have two letters")
    with pytest.raises(contracts.ContractError):
        contracts.together(spark.createDataFrame([(1, None)], "a int, b int"), ["a", "b"])
