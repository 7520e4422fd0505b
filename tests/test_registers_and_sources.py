import json
import struct

import pytest
from pyspark.sql import functions as F

from almanac.operators import registers
from almanac.sources import readers, sinks


def test_field_flags(spark):
    cases = {
        "berlin": ("Theol.", 1), "bonn": ("Jura; Kam", 0), "erlangen": ("Chirurgie", 2), "freiburg": ("math", 3), "giessen": ("Philologie", 4), "goettingen": ("Cam. et jur.", 0),
        "heidelberg": ("Pl.", 4), "jena": ("J.u.C.", 0), "kiel": ("Chemie", 3), "marburg": ("Tierheilkunde", 2), "muenchen": ("Archit.", 3), "tuebingen": ("Staats-Wiss.", 0), "wuerzburg": ("Oeconomie", 0),
    }
    assert set(cases) == set(registers.SPECS)
    for school, (value, group) in cases.items():
        df = spark.createDataFrame([(value,)], "field string")
        got = df.select(*[c.alias(n) for n, c in registers.field_flags(F.col("field"), registers.SPECS[school]).items()]).first()
        assert [bool(x) for x in got] == [i == group for i in range(5)], school


def test_volumes_keep_their_order(spark, tmp_path):
    (tmp_path / "berlin_21").mkdir()
    (tmp_path / "berlin_20").mkdir()
    (tmp_path / "berlin_21/a.csv").write_text('volume_id,last_name,first_name,field,hometown,region,street,house_number\nberlin_21,A,X,Theol,Köln,Pr,S,1\nberlin_21,B,Y,"""",=,,"""",2\n')
    (tmp_path / "berlin_20/b.csv").write_text("volume_id,last_name,first_name,field,hometown,region,street,house_number\nberlin_20,C,Z,-,—,Pr,T,3\n")
    manifest = ["berlin_21/a.csv", "bonn_20/x.csv", "berlin_20/b.csv"]
    raw = readers.volumes(spark, str(tmp_path), manifest, "berlin")
    rows = registers.clean(raw, "berlin").orderBy("file_rank", "line_no").collect()
    assert [(r["last_name"], r["first_year"], r["field"], r["hometown"], r["location_full"], r["theology"]) for r in rows] == [
        ("A", 1821, "Theol", "Köln", "Köln, Pr", True), ("B", 1821, "Theol", "Köln", "Köln, Pr", True), ("C", 1820, "Theol", "Köln", "Köln, Pr", True),
    ]
    assert rows[1]["address"] == "S 2"
    ids = registers.stack([registers.clean(raw, "berlin")]).orderBy("record_id").collect()
    assert [r["last_name"] for r in ids] == ["A", "B", "C"]


def with_order(spark, rows, schema):
    return spark.createDataFrame([(*r, 0, i) for i, r in enumerate(rows)], schema + ", file_rank int, line_no long")


def test_year_rules(spark):
    m = with_order(spark, [("a", "1801", "1", "", ""), ("b", "ibid", "2", "", ""), ("c", "1850", "3", "", "'von' read"), ("d", "1803", "261", "", "")], "last_name string, academic_year string, source_page string, field_expanded string, extraction_notes string").withColumn("first_names", F.lit("X"))
    helper = spark.createDataFrame([(1, 1801), (3, 1802)], "source_page long, year_helper long")
    got = {r["last_name"]: (r["first_year"], r["first_names"]) for r in registers.clean(m, "muenchen", helper=helper).collect()}
    assert got == {"a": (1801, "X"), "c": (1802, "Xvon")}
    h = with_order(spark, [("a", "heidelberg_1846", "10", "1846"), ("b", "heidelberg_1846", "11", "1846"), ("c", "heidelberg_1807", "10", "1812"), ("d", "heidelberg_1807", "12", "1807")], "last_name string, volume_id string, source_page string, date_iso string")
    pages = spark.createDataFrame([("heidelberg_1846", 10, 1846), ("heidelberg_1846", 11, 1847), ("heidelberg_1807", 10, 1808), ("heidelberg_1807", 12, 1809)], "volume_id string, source_page long, year_helper long")
    assert {r["last_name"]: r["first_year"] for r in registers.clean(h, "heidelberg", helper=pages).collect()} == {"a": 1846, "b": 1847, "c": 1808, "d": 1809}
    g = with_order(spark, [("a", "x", "5", "Ostern 1734"), ("b", "y", "5", "d."), ("c", "z", "6", None)], "last_name string, first_names string, source_page string, date string")
    anchors = spark.createDataFrame([("c", "z", 6, 1735)], "last_name string, first_names string, source_page long, year_helper long")
    assert {r["last_name"]: r["first_year"] for r in registers.clean(g, "goettingen", anchors=anchors).collect()} == {"a": 1734, "b": 1734, "c": 1735}
    j = with_order(spark, [("a", "jena_10", "Gera.", None), ("b", "jena_10", "Daher", None)], "last_name string, volume_id string, hometown string, region string")
    assert {r["last_name"]: r["location_full"] for r in registers.clean(j, "jena").collect()} == {"a": "Gera", "b": "Gera"}


def test_page_years(spark):
    heads = spark.createDataFrame([("heidelberg_1807", p, h) for p, h in ((8, "Ostern 1807"), (9, "x"), (20, "1808"), (25, "1841"), (30, "1809"))], "volume string, page int, head string")
    assert [(r["source_page"], r["year_helper"]) for r in registers.page_years(heads).orderBy("source_page").collect()] == [(8, 1807), (20, 1808), (25, 1809)]


def test_finalize(spark):
    df = spark.createDataFrame([("Karl", "von Berg", 1834, "x", "bonn", "Pfarrer, Köln", True, False), ("A", "B", 1900, "x", "kiel", None, False, True)], "first_names string, last_name string, first_year long, field string, school string, father_occupation string, theology boolean, medicine boolean").withColumns({c: F.lit(False) for c in ("law_admin", "sciences", "humanities")})
    r = registers.finalize(df, {"Pfarrer": "1"}, {"1": "clergy"}).collect()
    assert len(r) == 1 and r[0]["era"] == 4 and r[0]["field"] == "theology" and r[0]["noble"] and r[0]["new_school"] and r[0]["father_occupation"] == "clergy"
    rel = spark.createDataFrame([(x,) for x in ("kath.", "ev.", "jüd.", "?", None)], "r string").select(registers.religion_class(F.col("r"))).collect()
    assert [x[0] for x in rel] == ["catholic", "protestant", "jewish", None, None]
    canon = registers.canonical(spark.createDataFrame([("Pastor",), ("Oberförster",), ("?",), (None,)], "p string"), "p", {"pastor": "clergy"}, [("förster", "forestry")])
    assert sorted(r["p"] or "" for r in canon.collect()) == ["", "?", "clergy", "forestry"]


def test_positional_tsv(spark, tmp_path):
    lines = [f"{i}\t P \t\tx{i}\textra" for i in range(12_000)] + ["T2084\tN\t\"q\"\tlast"]
    (tmp_path / "t.out").write_text("\n".join(lines))
    df = readers.positional_tsv(spark, str(tmp_path / "t.out"), ["id", "flag", "none", "name"])
    assert df.count() == 12_001 and df.where("id = 'T2084' and none = '\"q\"'").count() == 1 and df.where("none is null and flag = 'P'").count() == 12_000
    with pytest.raises(ValueError):
        readers.positional_tsv(spark, str(tmp_path / "t.out"), [f"c{i}" for i in range(9)])


def test_other_readers(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"1": "Ostern 1807", "2": "x"}))
    assert sorted(tuple(r) for r in readers.page_heads(spark, str(tmp_path / "h.json")).collect()) == [("h", 1, "Ostern 1807"), ("h", 2, "x")]
    (tmp_path / "t.csv").write_text("b,a\nx,1\ny,z\n")
    assert [tuple(r) for r in readers.typed_csv(spark, str(tmp_path / "t.csv"), "a int, b string, c double").collect()] == [(1, "x", None), (None, "y", None)]
    sinks.write_parquet(readers.by_extension(spark, str(tmp_path / "t.csv")), f"{tmp_path}/o.parquet")
    assert readers.by_extension(spark, f"{tmp_path}/o.parquet").count() == 2
    sinks.write_csv(readers.by_extension(spark, f"{tmp_path}/o.parquet"), f"{tmp_path}/o_csv", one_file=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/o_csv").count() == 2
    (tmp_path / "order.txt").write_text("b_1/x.csv\n\na_1/y.csv\n")
    assert readers.chosen(readers.read_manifest(spark, str(tmp_path / "order.txt")), "a_", "b_") == [(0, "b_1/x.csv"), (1, "a_1/y.csv")]


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 4, 4, 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "l.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body + struct.pack(">2i", 2, 2) + struct.pack("<i", 0))
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
    (tmp_path / "l.dbf").write_bytes(b"\3" + b"\0" * 3 + struct.pack("<IHH", 2, 32 + 32 + 1, 7) + b"\0" * 20 + field + b"\r" + b" Baden " + b" none  ")
    rows = readers.shapefile(spark, str(tmp_path), tag="1819").collect()
    assert len(rows) == 1 and rows[0]["attributes"] == {"NAME": "Baden"} and rows[0]["tag"] == "1819" and [(p["x"], p["y"]) for p in rows[0]["rings"][0]] == ring


def test_cells():
    assert [sinks.shown(x, "number") for x in (1.23456, -0.5, -0.0001, None, float("nan"))] == ["$1.235$", "$-0.500$", "$0.000$", "", ""]
    assert sinks.shown(0.1, "error") == "(0.100)" and [sinks.shown(p, "significance") for p in (0.001, 0.03, 0.07, 0.5)] == ["$^{***}$", "$^{**}$", "$^{*}$", ""]
    assert sinks.shown(0.0001, "probability") == "$<$0.001" and sinks.shown(12345, "count") == "12,345" and sinks.shown("a_b & 5%") == r"a\_b \& 5\%"


def test_coefficient_report(spark):
    rows = spark.createDataFrame([("a", "x", -1.5, 0.2, 0.001), ("b", "x", 0.25, 0.2, 0.2), ("a", "y", 9.0, 1.0, 0.5)], "model string, term string, estimate double, error double, p double")
    t = sinks.latex(sinks.coefficient_report(rows, {"a": "Flow", "b": "Share"}, {"x": "Distance", "z": "None"}, [("N", ["1,000", "900"])])).splitlines()
    assert t == [
        r"\begin{tabular}{lcc}", r"\toprule", r" & (1) & (2) \\", r" & Flow & Share \\", r"\midrule", r"Distance & $-1.500$$^{***}$ & $0.250$ \\", r" & (0.200) & (0.200) \\", r"None &  &  \\", r" &  &  \\",
        r"\midrule", r"N & 1,000 & 900 \\", r"\bottomrule", r"\end{tabular}",
    ]


def test_frame_report_and_groups(spark):
    df = spark.createDataFrame([("a_b", 1234, 0.5), (None, None, None)], "name string, n long, x double")
    report = sinks.frame_report(df)
    report.groups = [(2, 3, "Both")]
    assert sinks.latex(report).splitlines()[2:7] == [r" & \multicolumn{2}{c}{Both} \\", r"\cmidrule(lr){2-3}", r"name & n & x \\", r"\midrule", r"a\_b & 1,234 & $0.500$ \\"]
    with pytest.raises(ValueError):
        sinks.frame_report(df, most=1)


def test_fills_across_volumes(spark):
    import random

    from almanac.operators import ordered

    r = random.Random(5)
    rows = [(f, i, r.choice([None, None, None, "a", "b", "="])) for f in range(7) for i in range(r.choice([0, 1, 3, 30]))]
    df = spark.createDataFrame(rows, "file_rank int, line_no long, v string")
    for limit in (None, 2, 12):
        seen, want = None, {}
        for at, (f, i, v) in enumerate(rows):
            if v is not None:
                seen = (at, v)
            want[f, i] = seen[1] if seen and (limit is None or at - seen[0] <= limit) else None
        got = {(x["file_rank"], x["line_no"]): x["filled"] for x in ordered.fill_across(df, "filled", F.col("v"), "file_rank", ["line_no"], limit).collect()}
        assert got == want
