import re

from almanac.llm import license_scan as L

ROWS = [
    (1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0. apache license version 2 again"), (3, "cc by-nc cc BY nc"), (4, None), (5, ""), (6, "--- !!"),
    (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this Software and associated documentation files"),
    (8, "This work is licensed under the GNU General Public License, version 3."), (9, "the general public met under a licensed roof of version control"), (10, "ünder the mit license under the mit licenses"),
    (11, "word " * 60_000 + "under the mit license"), (1, "Released under the MIT License."), (None, "cc by nc"),
    *[(100 + i, f"plain text number {i} of the common kind") for i in range(40)],
]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, n) for n, p in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in places}))


def test_base_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, labels int")
    out = L.scan(df).collect()
    assert len(out) == len(ROWS)
    text = dict(ROWS)
    for r in out:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))
    by = {r["doc_id"]: r for r in out}
    assert by[7]["labels"] == "mit" and by[8]["labels"] == "gpl-3" and by[9]["labels"] == "" and by[9]["score"] < L.SUPPORT
    assert all(by[100 + i]["labels"] == "" for i in range(40))
    assert L.scan(df.limit(0)).count() == 0


def test_relative_positions_matter(spark):
    scattered = "version word license word public word gnu word licensed word under word general word 3 gnu general public license version 3"
    rows = [(1, scattered), (2, "licensed under the gnu general public license version 3"), *[(10 + i, f"t{i}") for i in range(30)]]
    got = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["labels"] == "gpl-3" and got[2]["score"] == 1.0 and got[1]["score"] <= got[2]["score"]


def test_no_python_in_the_plan(spark):
    plan = L.scan(spark.createDataFrame([(1, "under the mit license")], "doc_id int, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
