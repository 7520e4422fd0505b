import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import aggregates, joins, linkage, ordered, panel
from almanac.streaming.spells import session_spells


def model(values, marks, n):
    out, held, age = [], None, 0
    for v in values:
        if v in marks:
            age += 1
            out.append(held if held is not None and (n is None or age <= n) else None)
        else:
            held, age = v, 0
            out.append(v)
    return out


@pytest.mark.parametrize("n", [None, 3])
def test_ditto_fill(spark, n):
    r = random.Random(1)
    values = [r.choice(['"', "a", "b", "-", "="]) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(3)
    got = [x[0] for x in df.withColumn("f", ordered.ditto_fill(F.col("v"), ['"', "-", "="], [], ["i"], n)).orderBy("i").select("f").collect()]
    assert got == model(values, {'"', "-", "="}, n)


def test_true_nulls_stay(spark):
    df = spark.createDataFrame([(0, "a"), (1, "="), (2, None), (3, "=")], "i int, v string")
    got = [x[0] for x in df.withColumn("f", ordered.ditto_fill(F.col("v"), ["="], [], ["i"], 10, keep_nulls=True)).orderBy("i").select("f").collect()]
    assert got == ["a", "a", None, None]


def test_misread_heads(spark):
    rows = [("v", i, y) for i, y in enumerate([1840, 1841, 1814, 1842, 1843, 1843, 1844])] + [("w", 0, 1807)]
    df = spark.createDataFrame(rows, "v string, p int, y int")
    out = ordered.steps_of_one(ordered.repair_misread(df, "y", ["v"], ["p"]), "y", ["v"], ["p"])
    assert [(r["v"], r["p"], r["y"]) for r in out.orderBy("v", "p").collect()] == [("v", 0, 1840), ("v", 1, 1841), ("v", 2, 1842), ("v", 4, 1843), ("v", 6, 1844), ("w", 0, 1807)]


def test_record_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = ordered.record_id(df, ["k"]).collect()
    assert all(r["record_id"] == r["k"] for r in got) and len(got) == 1000


def test_joins(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "i int, k string")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, v int")
    assert {(r["i"], r["v"]) for r in joins.null_safe(a, b, ["k"]).collect()} == {(1, 10), (2, None)}
    with pytest.raises(ValueError):
        joins.one_to_one(a.union(a), b, ["k"])
    chain = spark.createDataFrame([(i, i + 1) for i in range(15)] + [(15, 15)], "c long, p long")
    got = {r["c"]: r["ancestors"] for r in joins.closure(chain, "c", "p").collect()}
    assert got[0] == list(range(1, 16)) and got[14] == [15] and 15 not in got
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "c long, p long")
    assert {r["c"]: r["ancestors"] for r in joins.closure(ring, "c", "p").collect()}[1] == [2, 3]


def test_same_result_under_any_partitioning(spark):
    df = spark.createDataFrame([(i % 5, i % 7, float(i % 3)) for i in range(200)], "k int, v int, s double")
    results = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        d = df.repartition(n + 1)
        results.append((sorted(map(tuple, aggregates.mode_smallest(d, ["k"], "v").collect())), sorted(map(tuple, ordered.best_per_key(d.distinct(), ["k"], [F.desc("s"), F.asc("v")]).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1]


def test_union_and_top(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, n string"), spark.createDataFrame([("q", 2.5)], "i string, z double")
    assert sorted((r["i"], r["n"], r["z"]) for r in aggregates.union_relaxed([a, b]).collect()) == [("1", "x", None), ("q", None, 2.5)]
    t = spark.createDataFrame([("a", 5, 1.0), ("b", 3, 2.0), ("c", 1, 4.0), ("d", 1, 0.0)], "l string, w int, m double")
    assert {(r["l"], r["w"], r["m"]) for r in aggregates.top_and_other(t, "l", "w", 2, ["m"]).collect()} == {("a", 5, 1.0), ("b", 3, 2.0), ("Other", 2, 2.0)}


def test_panel(spark):
    g = spark.createDataFrame([(50.0, 10.0, 50.0, 10.001, 101, 102, "catholic", "catholic"), (50.0, 10.0, 52.0, 10.0, 101, 205, "protestant", "x")], "lat double, lon double, lat_uni double, lon_uni double, polity_o int, polity_d int, confession_o string, confession_d string")
    a, b = panel.covariates(g).orderBy("dist_km").collect()
    assert a["same_city"] and a["same_state"] and not a["same_polity"] and a["ss_sc"] == 1 and not b["same_state"] and b["ds_sc"] == 0
    s = spark.createDataFrame([("p", 1, 1799), ("p", 1, 1815), ("q", 2, 1815)], "place string, pol int, y int")
    guilds = spark.createDataFrame([("p", None, 1798, 1810), (None, 2, 1805, 0)], "standard_location_name string, standard_polity_id int, abolition_year int, reinstatement_year int")
    assert [r[0] for r in panel.guild_status(s, guilds, "place", "pol", "y").orderBy("place", "y").select("guild_abolished").collect()] == [True, False, True]


def people(n=200, seed=4):
    r = random.Random(seed)
    last = ["".join(r.choice(["mann", "er", "berg", "stein", "hof", "bach", "Schu", "Kel", "Bru", "Tor"]) for _ in range(3)).capitalize() for _ in range(n)]
    rows, i = [], 0
    for p in range(n):
        first = r.choice(["Johann Peter", "Carl Ludwig", "Wilhelm", "Georg Adolf", "Heinrich", "Franz Anton"])
        year, place = r.randint(1805, 1840), r.randint(0, 59)
        for k, school in enumerate(r.sample(["berlin", "bonn", "jena", "kiel", "giessen", "erlangen"], r.randint(1, 2))):
            for _ in range(r.randint(1, 3) if school in ("berlin", "bonn", "jena") else 1):
                name = first if r.random() > 0.3 else "".join(x[0] + ". " for x in first.split()).strip()
                rows.append((i, last[p], name, year, school, place, p))
                i, year = i + 1, year + 1
            year += k
    return rows


def test_linkage_recovers_people_and_is_stable(spark):
    rows = people()
    df = spark.createDataFrame([r[:6] for r in rows], "record_id long, last_name string, first_names string, first_year long, school string, location_id long")
    runs = []
    for n in (2, 5):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(sorted(map(tuple, linkage.link(df.repartition(n), ["berlin", "bonn", "jena"], threshold=0.9, sample=60).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    truth = spark.createDataFrame([(r[0], r[6]) for r in rows], "record_id long, person long")
    found = spark.createDataFrame(runs[0], "record_id long, spell_id long, student_id long")
    e = linkage.evaluate(found, truth, "record_id", "student_id", "person").first()
    assert e["precision"] > 0.9 and e["recall"] > 0.6 and e["purity"] > 0.95


def test_chain_and_merge():
    assert linkage.chain([(1810, "jf", None), (1811, "j", ["johann"]), (1811, "k", None), (1814, "jf", None)]) == [0, 0, 1, 2]
    spans = {1: ("a", 1810, 1812), 2: ("b", 1812, 1814), 3: ("a", 1815, 1816), 4: ("c", 1830, 1831)}
    assert linkage.merge([(5.0, 1, 2), (4.0, 2, 3), (9.0, 1, 4)], spans) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components(spark):
    edges = spark.createDataFrame([(5, 6), (6, 7), (1, 2), (9, 5), (20, 30)], "lid long, rid long")
    assert {r["id"]: r["component"] for r in linkage.connected(edges).collect()} == {5: 5, 6: 5, 7: 5, 9: 5, 1: 1, 2: 1, 20: 20, 30: 20}


def test_session_spells(spark):
    df = spark.createDataFrame([("a", "2020-01-01 00:00:00"), ("a", "2020-01-01 01:00:00"), ("a", "2020-01-01 09:00:00"), ("b", "2020-01-01 00:00:00")], "k string, s string").select("k", F.to_timestamp("s").alias("t"))
    assert sorted((r["k"], r["n"]) for r in session_spells(df, "k", "t").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_stream_of_spells(spark, tmp_path):
    df = spark.createDataFrame([("a", "2020-01-01 00:00:00"), ("a", "2020-01-01 01:00:00"), ("a", "2020-01-03 00:00:00")], "k string, s string").select("k", F.to_timestamp("s").alias("t"))
    df.write.parquet(f"{tmp_path}/in")
    stream = session_spells(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k", "t")
    q = stream.writeStream.format("memory").queryName("spells_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    assert [(r["k"], r["n"]) for r in spark.table("spells_out").collect()] == [("a", 2)]
