"""The index and the closure are made in small plans, and pools are collapsed in several tasks."""

import re

import pytest
from pyspark.sql import functions as F

from almanac.operators import gazetteer, geocode, joins

TERMS = "TERM string, TERM_ID long, SUBJECT_ID long, PREFERRED string, VERNACULAR string, HISTORIC_FLAG string, OTHER_FLAGS string"


def n_joins(df) -> int:
    return len(re.findall(r"\bJoin\b", df._jdf.queryExecution().optimizedPlan().toString()))


def test_closure_writes_its_doublings_and_ends_where_nothing_grows(spark, monkeypatch):
    import almanac

    written, cut = [], almanac.cut
    monkeypatch.setattr(almanac, "cut", lambda df: written.append(out := cut(df)) or out)
    tree = spark.createDataFrame([(i, i // 2) for i in range(2, 8)], "c long, p long")
    out = joins.closure(tree, "c", "p")
    assert n_joins(out) == 0 and 1 < len(written) <= 4  # five doublings would make 20 levels
    assert {r["c"]: (r["ancestors"], r["depth"]) for r in out.collect()} == {2: ([1], 1), 3: ([1], 1), 4: ([2, 1], 2), 5: ([2, 1], 2), 6: ([3, 1], 2), 7: ([3, 1], 2)}


def test_features_of_places_meet_in_one_union(spark):
    tables = {
        "terms": spark.createDataFrame([("Aa", 10, 1, "P", None, None, None), ("Ab", 11, 1, None, None, "H", None), ("Bb", 20, 2, "P", None, None, None), ("Cc", 30, 3, "P", None, None, None), ("Dd", 40, 4, "P", None, None, None)], TERMS),
        "subjects": spark.createDataFrame([(i, "A", "N") for i in (1, 2, 2, 3)] + [(4, "A", "M")], "SUBJECT_ID long, RECORD_TYPE string, MERGED_STAT string"),
        "placetypes": spark.createDataFrame([(1, 2, "N", "city"), (1, 1, "P ", "duchy"), (2, 1, None, "city"), (3, 1, "P", "bridge"), (9, 1, "P", "city")], "SUBJECT_ID long, PTYPE_ROLE_ID long, PREFERRED string, PLACETYPE string"),
        "rels": spark.createDataFrame([(2, 1, "P"), (4, 2, "P"), (3, 3, "P"), (1, 2, "N")], "PARENT_ID long, CHILD_ID long, PREFERRED string"),
        "coords": spark.createDataFrame([(1, 50.0, 9.0, None, None, None, None), (2, None, 8.0, 50.0, 51.0, 8.0, 9.0)], "SUBJECT_ID long, LAT double, LON double, LAT_MIN_BOX double, LAT_MAX_BOX double, LON_MIN_BOX double, LON_MAX_BOX double"),
        "languages": spark.createDataFrame([(1, "de"), (1, "de"), (1, "la"), (2, None)], "SUBJECT_ID long, LANGUAGE_CODE string"),
        "notes": spark.createDataFrame([(1, 2), (1, None), (3, None)], "SUBJECT_ID long, n_notes long"),
    }
    out = gazetteer.build_index(tables)
    assert n_joins(out) <= 3
    rows = {r["TERM"]: r for r in out.collect()}
    told = lambda t, *c: tuple(rows[t][x] for x in c)
    assert set(rows) == {"Aa", "Ab", "Bb", "Cc"}
    assert told("Aa", "n_terms", "geo_precision", "placetype", "n_placetypes", "is_settlement", "is_sub_settlement", "parent_id", "ancestors", "depth", "n_children", "n_languages", "n_notes", "n_sources", "LAT") == (2, "territory", "duchy", 2, True, True, 2, [2, 4], 2, None, 2, 2, None, 50.0)
    assert told("Bb", "n_terms", "geo_precision", "is_settlement", "is_sub_settlement", "parent_id", "parent_is_settlement", "n_children", "n_languages", "n_notes", "LAT", "LON") == (1, "settlement", True, False, 4, None, 1, 0, None, None, 8.0)
    assert rows["Bb"]["bbox_area"] == pytest.approx(0.6364 * 111**2, rel=1e-3)
    assert told("Cc", "geo_precision", "placetype", "n_placetypes", "is_settlement", "parent_id", "ancestors", "n_languages", "n_notes") == ("unknown", None, 1, False, None, None, None, None)


def test_pools_are_dealt_to_several_tasks(spark, monkeypatch):
    index = gazetteer.build_index({
        "terms": spark.createDataFrame([(f"Ort {chr(97 + i % 26)}{chr(97 + i // 26)}", i, i, "P", None, None, None) for i in range(200)], TERMS),
        "subjects": spark.createDataFrame([(i, "A", "N") for i in range(200)], "SUBJECT_ID long, RECORD_TYPE string, MERGED_STAT string"),
    })
    seen, cut, released = [], geocode.cut, []
    monkeypatch.setattr(geocode, "release", released.append)
    monkeypatch.setattr(geocode, "cut", lambda df: seen.append(df) or cut(df))
    names = index.select("TERM").withColumnRenamed("TERM", "src_raw").distinct()
    strings = names.withColumns({"src": F.col("src_raw"), "corrected": F.lit(False), "not_a_place": F.lit(False), "context": F.lit(None).cast("string")})
    seats = spark.createDataFrame([("x", 50.0, 9.0)], "school string, LAT0 double, LON0 double")
    assert geocode.candidates(strings, index, seats).count() == 200
    dealt = [x for df in seen for x in re.findall(r"RepartitionByExpression \[src_raw[^\]]*\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())]
    assert len(released) >= 2  # the driver gives memory back between long steps
    assert dealt and min(map(int, dealt)) >= 2 * spark.sparkContext.defaultParallelism
