import hashlib
import re

from almanac.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, kept int"
ROWS = [
    (5, "a  b", "x", 1), (3, "a b", "y", 2), (4, "a\t\nb", None, 3), (9, None, "z", 4), (8, "", "z", 5), (7, " ", "z", 6),
    (1, "a b", "n", 7), (2, "A b", "c", 8), (3, "a b", "y", 2), (None, "q", "q", 9), (None, "q", "q", 10), (6, "w" * 300_000, "l", 11),
]


def brute(rows):
    norm = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r)
    return {k: (min((r[0] for r in v if r[0] is not None), default=None), len(v)) for k, v in groups.items()}, norm


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    groups, norm = brute(ROWS)
    for bound in (None, 1, 2):  # with a bound of 1 all groups are hot and salted
        out = exact_dedup(df, carry=["doc_id", "text"], bound=bound).collect()
        assert len(out) == len(ROWS)
        for r in out:
            assert (r["keep_id"], r["group_size"]) == groups[norm(r["text"])]
            assert r["text_sha256"] == hashlib.sha256(norm(r["text"]).encode()).hexdigest()
        assert sum(r["kept"] for r in out) == len(groups)  # exactly one of each, repeated rows too
        assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])


def test_rows_that_stay_keep_their_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = exact_dedup(df, carry=df.columns, only_kept=True)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    rows = [tuple(r) for r in out.collect()]
    assert set(rows) <= set(ROWS) and (3, "a b", "y", 2) in rows and (7, " ", "z", 6) in rows and (8, "", "z", 5) in rows
    assert exact_dedup(df.limit(0)).count() == 0


def test_a_large_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('t', id)) as text")
    out = exact_dedup(df, bound=100)
    assert out.where("kept").count() == 2001
    assert out.where("group_size = 1000 and keep_id = 0").count() == 1000
