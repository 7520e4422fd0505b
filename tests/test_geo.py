import math

import pytest
from pyspark.sql import functions as F

from almanac.functions import geo
from almanac.operators import geometry


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def lits(*x):
    return [F.lit(float(v)) for v in x]


def test_distances(spark):
    assert one(spark, geo.haversine(*lits(0, 0, 0, 1))) == pytest.approx(math.pi * 6371 / 180, rel=1e-12)
    a, b = lits(52.5, 13.4, 48.1, 11.6), lits(48.1, 11.6, 52.5, 13.4)
    assert one(spark, geo.haversine(*a)) == one(spark, geo.haversine(*b)) == pytest.approx(504, abs=3)
    assert one(spark, geo.equirectangular(*lits(50, 8, 50.1, 8.1))) == pytest.approx(one(spark, geo.haversine(*lits(50, 8, 50.1, 8.1))), rel=0.01)
    assert one(spark, geo.log_distance(F.lit(0.2))) == math.log(0.5) and one(spark, geo.log_distance(F.lit(None).cast("double"))) is None


def test_utm(spark):
    e, n = geo.utm(*lits(52.0, 15.0))
    assert one(spark, e) == pytest.approx(500_000, abs=1e-6) and one(spark, n) == pytest.approx(5_761_038.21, abs=0.05)
    e, n = geo.utm(*lits(50.0, 12.0))
    assert one(spark, e) == pytest.approx(284_961.0, abs=60) and 5_540_000 < one(spark, n) < 5_546_000


def test_bins(spark):
    upper = geo.edges(10, 1000)
    df = spark.createDataFrame([(None,), (0.0,), (1e9,), (10.0,)], "km double")
    assert [r[0] for r in df.select(geo.bin_of(F.col("km"), upper)).collect()] == [-1, 0, 9, 3]
    assert sum(w for _, w, _ in geo.bin_shape(upper)) == pytest.approx(1000)


def test_prior_and_interpolation(spark):
    upper = geo.edges(12, 3000)
    rows = spark.createDataFrame([("a", 10.0, 1)] * 100 + [("b", 400.0, 1)] * 100, "school string, km double, w int")
    prior = geo.distance_prior(rows, "school", "km", "w", upper)
    shape = {b: w for b, w, _ in geo.bin_shape(upper)}
    for s in "ab":
        d = {r["bin"]: r["log_density"] for r in prior.where(F.col("school") == s).collect()}
        assert sum(math.exp(v) * shape[b] for b, v in d.items() if b >= 0) == pytest.approx(1)
        assert d[-1] == pytest.approx(sum(math.exp(v) * shape[b] * v for b, v in d.items() if b >= 0))
    out = geo.interpolated(spark.createDataFrame([("a", 10.0), ("a", 400.0), ("a", None)], "school string, km double"), prior, "school", "km", upper).collect()
    assert out[0]["dist_ll"] > out[1]["dist_ll"] and all(r["dist_ll"] is not None for r in out)


def test_polygons(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in [*p, p[0]]]
    shapes = spark.createDataFrame([("square", 1, [ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (2, 1), (2, 2), (1, 2))]), ("other", 2, [ring((10, 10), (12, 10), (11, 14))])], f"name string, year int, rings {geometry.RINGS}")
    points = spark.createDataFrame([(0, 3.0, 3.0, 1), (1, 1.5, 1.5, 1), (2, 4.0, 2.0, 1), (3, 11.0, 11.0, 2), (4, 11.0, 11.0, 1), (5, None, 1.0, 1)], "i int, x double, y double, year int")
    got = {r["i"]: r["name"] for r in geometry.point_in_polygon(points, shapes, "x", "y", ["year"]).collect()}
    assert got == {0: "square", 1: None, 2: "square", 3: "other", 4: None, 5: None}


def test_hulls():
    pts = [(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 1)]
    assert set(geometry.convex_hull(pts)) == {(0, 0), (4, 0), (4, 4), (0, 4)}
    assert (5, 1) in geometry.concave_hull([(0, 0), (10, 0), (10, 3), (0, 3), (2, 1), (5, 1)], 0.2)
    assert geometry.concave_hull(pts, 1.0) == geometry.convex_hull(pts)
    assert geometry.convex_hull([(1, 1)]) == [(1, 1), (1, 1)]


def test_viewport():
    lat, lon, zoom = geo.viewport(47, 55, 6, 15, 800, 600)
    assert 50 < lat < 52 and lon == 10.5 and 5 < zoom < 7
