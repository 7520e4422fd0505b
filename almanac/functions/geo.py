"""Distances, bins and projections as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column, km_per_degree: float = 111.0) -> Column:
    x, y = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)), lat2 - lat1
    return km_per_degree * F.sqrt(x * x + y * y)


def box_area(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, km_per_degree: float = 111.0) -> Column:
    """km^2 of a box of degrees; 0 where a side is missing."""
    middle = F.cos((lat_min + lat_max) / 2 * 3.14159265 / 180)
    return F.coalesce(F.abs(lat_max - lat_min) * F.abs(lon_max - lon_min) * middle * km_per_degree**2, F.lit(0.0))


def log_distance(km: Column, near: float = 0.5) -> Column:
    """ln(km), with ``near`` in place of all under 1 km."""
    return F.when(km >= 1, F.ln(km)).when(km.isNotNull(), F.lit(math.log(near)))


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def prominence(counts: dict[str, float]) -> Column:
    """The weighted sum of log1p of columns; null counts as 0."""
    out = F.lit(0.0)
    for name, weight in counts.items():
        out = out + weight * F.log1p(F.coalesce(F.col(name).cast("double"), F.lit(0.0)))
    return out


# ---------------------------------------------------------------- bins of distance


#: Kilometres at which an open last bin ends.
FARTHEST = 20_000.0


def edges(n: int = 20, most_km: float = 3000.0) -> list[float]:
    """Upper edges of n bins of log10(1 + km), evenly spaced."""
    top = math.log10(1 + most_km)
    return [top * (i + 1) / n for i in range(n)]


def bin_of(km: Column, upper: list[float]) -> Column:
    """0 .. len(upper) - 1; the last takes all beyond; -1 for null."""
    out = F.lit(len(upper) - 1)
    at = F.log10(1 + km)
    for i in range(len(upper) - 2, -1, -1):
        out = F.when(at < upper[i], i).otherwise(out)
    return F.when(km.isNull(), -1).otherwise(out)


def bin_shape(upper: list[float]) -> list[tuple[int, float, float]]:
    """(bin, width in km, middle as log10(1 + km)). An open last bin (inf) reaches to FARTHEST; then the first and
    the last one's middles lie 0.25 from their inner edge."""
    low = [0.0, *upper[:-1]]
    if math.isinf(upper[-1]):
        ends = [10**b - 1 for b in upper[:-1]] + [FARTHEST]
        middle = [upper[0] - 0.25, *[(a + b) / 2 for a, b in zip(upper[:-2], upper[1:-1], strict=True)], upper[-2] + 0.25]
        return [(i, max(b - a, 1.0), m) for i, (a, b, m) in enumerate(zip([0.0, *ends[:-1]], ends, middle, strict=True))]
    return [(i, 10**b - 10**a, (a + b) / 2) for i, (a, b) in enumerate(zip(low, upper, strict=True))]


def distance_prior(rows: DataFrame, school: str, km: str, weight: str, upper: list[float], shrink: float = 50.0, tail: float = 0.05, uniform: float = 0.15) -> DataFrame:
    """school, bin, log_density: the density of distances per km for each school.

    Shares shrink towards those of all schools by ``shrink`` pseudo-rows, get a floor (pooled shares mixed with
    even ones; widths are summed over the whole school x bin grid), and are renormalised by school. Bin -1 holds the
    expectation, for distances that aren't known."""
    spark = rows.sparkSession
    shape = spark.createDataFrame(bin_shape(upper), "bin int, width double, middle double")
    counted = rows.where(F.col(km).isNotNull()).groupBy(school, bin_of(F.col(km), upper).alias("bin")).agg(F.sum(weight).cast("double").alias("n"))
    grid = rows.select(school).distinct().join(F.broadcast(shape), F.lit(True)).join(counted, [school, "bin"], "left").fillna(0.0, ["n"])
    by_bin, by_school, all_ = Window.partitionBy("bin"), Window.partitionBy(school), F.broadcast(grid.agg(F.sum("n").alias("_n"), F.sum("width").alias("_w")))
    p = grid.withColumn("pooled", F.sum("n").over(by_bin)).join(all_, F.lit(True)).withColumn("pooled", F.try_divide("pooled", "_n"))
    p = p.withColumn("raw", (F.col("n") + shrink * F.col("pooled")) / (F.sum("n").over(by_school) + shrink))
    p = p.withColumn("p", (1 - tail) * F.col("raw") + tail * ((1 - uniform) * F.col("pooled") + uniform * F.col("width") / F.col("_w")))
    p = p.withColumn("p", F.col("p") / F.sum("p").over(by_school)).withColumn("log_density", F.ln(F.col("p") / F.col("width")))
    unknown = p.groupBy(school).agg(F.sum(F.col("p") * F.col("log_density")).alias("log_density")).select(school, F.lit(-1).alias("bin"), "log_density")
    return p.select(school, "bin", "log_density").unionByName(unknown)


def interpolated(rows: DataFrame, prior: DataFrame, school: str, km: str, upper: list[float]) -> DataFrame:
    """rows with dist_ll: log density between the middles of the bin and of the neighbour that lies towards km."""
    shape = prior.sparkSession.createDataFrame(bin_shape(upper), "bin int, width double, middle double")
    table = prior.join(F.broadcast(shape.select("bin", "middle")), "bin", "left")
    own, other = (table.select(F.col(school).alias(f"{p}s"), F.col("bin").alias(f"{p}b"), F.col("log_density").alias(f"{p}d"), F.col("middle").alias(f"{p}m")) for p in ("o_", "n_"))
    at = F.log10(1 + F.col(km))
    first = rows.withColumn("_bin", bin_of(F.col(km), upper)).join(F.broadcast(own), (F.col(school) == F.col("o_s")) & (F.col("_bin") == F.col("o_b")), "left")
    first = first.withColumn("_to", F.when(F.col("_bin") >= 0, F.col("_bin") + F.when(at >= F.col("o_m"), 1).otherwise(-1)))
    both = first.join(F.broadcast(other), (F.col(school) == F.col("n_s")) & (F.col("_to") == F.col("n_b")) & (F.col("n_b") >= 0), "left")
    part = clip((at - F.col("o_m")) / (F.col("n_m") - F.col("o_m")), 0.0, 1.0)
    ll = F.when(F.col("n_d").isNull(), F.col("o_d")).otherwise(F.col("o_d") + part * (F.col("n_d") - F.col("o_d")))
    return both.withColumn("dist_ll", ll).drop("_bin", "_to", "o_s", "o_b", "o_d", "o_m", "n_s", "n_b", "n_d", "n_m")


def coherence(km: Column, other_there: Column, scale: float = 75.0, unknown: float = 500.0) -> Column:
    """-ln(1 + km / scale); 0 without another field, and ``unknown`` km where the distance isn't known."""
    return F.when(~other_there, 0.0).otherwise(-F.log1p(F.coalesce(km, F.lit(unknown)) / scale))


def utm(lat: Column, lon: Column, zone: int = 33) -> tuple[Column, Column]:
    """Easting and northing in metres (WGS 84, northern half), by Krüger's series to n^3."""
    f, a = 1 / 298.257223563, 6378137.0
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    atanh = lambda x: 0.5 * F.ln((1 + x) / (1 - x))
    phi, dl = F.radians(lat), F.radians(lon - (6 * zone - 183))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * big_a * x, 0.9996 * big_a * y


def viewport(south: float, north: float, west: float, east: float, width: int, height: int) -> tuple[float, float, float]:
    """(latitude, longitude, zoom) of a Web Mercator map that shows a box."""
    mercator = lambda d: math.log(math.tan(math.pi / 4 + math.radians(d) / 2))
    zoom_x = math.log2(width * 360 / (256 * max(east - west, 1e-9)))
    zoom_y = math.log2(height * 2 * math.pi / (256 * max(mercator(north) - mercator(south), 1e-12)))
    middle = (mercator(north) + mercator(south)) / 2
    return math.degrees(2 * math.atan(math.exp(middle)) - math.pi / 2), (west + east) / 2, min(zoom_x, zoom_y)
