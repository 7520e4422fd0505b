"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from almanac.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool | str | bytes):
        return x
    return round(float(x), 6) if hasattr(x, "__float__") else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    mine = rows(df.columns, df.collect())
    found = con.execute(SQL[name])
    theirs = rows([c[0] for c in found.description], found.fetchall())
    assert mine[0] == theirs[0] and len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]


def test_the_whole_resolution_finds_most_places(spark):
    out = QUERIES["place_resolution"](spark, FOLDER)
    rows_ = out.collect()
    assert len(rows_) == spark.read.parquet(f"{FOLDER}/customer.parquet").count() and out.columns[:2] == ["student", "location_id"]
    own = sum(r["location_id"] is not None for r in rows_)
    assert own > 0.8 * len(rows_)
