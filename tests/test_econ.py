import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import econ


def panel(seed=1, shock=-0.7):
    r, rows = np.random.default_rng(seed), []
    for o in range(60):
        for i, d in enumerate("ABC"):
            km = float(r.uniform(2, 6))
            for y in range(1834, 1840):
                mean = math.exp(4.5 - 0.5 * km + 0.3 * i + shock * (d == "A" and y > 1837) + 0.01 * o)
                rows.append((o, d, y, km, int(d == "A"), int(r.poisson(mean))))
    return rows


SCHEMA = "origin_id long, dest string, first_year long, log_dist double, treated int, flow long"


def test_equals_a_dense_newton_fit(spark):
    rows = panel()
    f = econ.ppml(spark.createDataFrame(rows, SCHEMA), "flow ~ log_dist | origin_id + dest^first_year", cluster="origin_id")
    y, km = np.array([x[5] for x in rows], float), np.array([x[3] for x in rows])
    o, d = np.array([x[0] for x in rows]), np.array(["ABC".index(x[1]) * 6 + x[2] - 1834 for x in rows])
    x = np.column_stack([km, *[o == i for i in range(60)], *[d == i for i in range(1, 18)]]).astype(float)
    b = np.zeros(x.shape[1])
    b[1:61] = math.log(y.mean())
    for _ in range(60):
        mu = np.exp(x @ b)
        h = (x * mu[:, None]).T @ x
        b = b + np.linalg.solve(h, x.T @ (y - mu))
    assert f["log_dist"][0] == pytest.approx(b[0], abs=1e-8)
    scores = x * (y - mu)[:, None]
    g = np.array([scores[o == i].sum(axis=0) for i in range(60)])
    bread = np.linalg.inv(h)
    se = math.sqrt((bread @ (g.T @ g) @ bread)[0, 0])
    assert f["log_dist"][1] == pytest.approx(se * math.sqrt(60 / 59 * (len(y) - 1) / (len(y) - 18)), rel=1e-6)


def test_event_study_finds_the_shock(spark):
    f, path = econ.event_study(spark.createDataFrame(panel(), SCHEMA), "flow", "treated", "first_year", 1837, "origin_id + dest + first_year", controls=("log_dist",))
    by = {k: b for k, b, _ in path}
    assert by[1837] == 0.0 and np.mean([by[1838], by[1839]]) - np.mean([by[y] for y in (1834, 1835, 1836)]) < -0.4
    assert f.joint_zero([n for n in f.names if "1838" in n or "1839" in n])[2] < 0.01 < f.joint_zero([n for n in f.names if "183" in n and n < "_d:first_year[T.1837]"])[2]


def test_collinear_and_empty_groups(spark):
    rows = [(*x, x[3] * 2) for x in panel()] + [(99, "A", 1834, 3.0, 1, 0, 6.0)]
    f = econ.ppml(spark.createDataFrame(rows, SCHEMA + ", twice double"), "flow ~ log_dist + twice + treated | origin_id + dest + first_year")
    assert f.n == len(rows) - 1 and f.names == ["log_dist"] and set(f.dropped) == {"twice", "treated"}


def test_interactions_and_splits(spark):
    df = spark.createDataFrame(panel(), SCHEMA).withColumn("post", (F.col("first_year") > 1837).cast("int"))
    f = econ.ppml(df, "flow ~ log_dist + log_dist:C(dest) | origin_id + dest^first_year")
    assert f.names == ["log_dist", "log_dist:dest[T.B]", "log_dist:dest[T.C]"]
    g = econ.ppml(df, "flow ~ log_dist:C(dest) | origin_id + dest^first_year")
    assert g.names == ["log_dist:dest[A]", "log_dist:dest[B]", "log_dist:dest[C]"] and g["log_dist:dest[B]"][0] == pytest.approx(sum(f[n][0] for n in ("log_dist", "log_dist:dest[T.B]")), abs=1e-7)
    assert g.equal(g.names)[2] > 0.001
    split = econ.near_and_far(df, "flow", "treated", "post", "log_dist", 4.0, "origin_id + dest + first_year")
    assert split.names == ["near_effect", "far_effect"] and all(split[n][0] < -0.3 for n in split.names)
    p = econ.placebos(df, "flow", "dest", "post", "origin_id + dest + first_year", ["A", "B"])
    assert p[0][1] < -0.4 < p[1][1]


def test_distributions():
    assert econ.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    for x, k, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307, 10, 0.05), (100.0, 3, 1.55e-21)):
        assert econ.chi2_p(x, k) == pytest.approx(p, rel=2e-3)
    assert econ.parse("y ~ a + a:C(b) | f + g^h") == ("y", ["a", "a:C(b)"], ["f", "g^h"])
    assert econ.series(1.0, 0.1, {2: (0.5, 0.1)})[0][:2] == (2, 1.5)


def test_robustness_is_a_fit_for_each_check(spark):
    df = spark.createDataFrame(panel(), SCHEMA)
    checks = [("all", None, "flow ~ log_dist | origin_id + dest^first_year"), ("near", F.col("log_dist") < 4, "flow ~ log_dist | origin_id + dest"), ("without A", "dest != 'A'", "flow ~ log_dist | dest + first_year")]
    rows = econ.robustness(df, checks, "origin_id")
    assert [r[0] for r in rows] == ["all", "near", "without A"] and all(r[1] == "log_dist" for r in rows)
    alone = econ.ppml(df.where("dest != 'A'"), "flow ~ log_dist | dest + first_year", "origin_id")
    assert rows[2][2] == pytest.approx(alone["log_dist"][0]) and rows[2][3] == pytest.approx(alone["log_dist"][1]) and rows[2][5] == alone.n < rows[0][5]
