"""Polygons without a geometry library: rings as arrays of points, tested by ray casting.

A polygon is array<array<struct<x, y>>>: rings of points. Even-odd counting makes holes of inner rings; a point on an
edge counts as inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def crossings(x: Column, y: Column, rings: Column) -> tuple[Column, Column]:
    """(edges that a ray to the right crosses, whether the point is on an edge)."""
    edges = F.flatten(F.transform(rings, lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.struct(F.get(r, i).alias("a"), F.get(r, i + 1).alias("b")))))

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)

    def touches(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        on_line = (bx - ax) * (y - ay) == (by - ay) * (x - ax)
        return on_line & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    return F.size(F.filter(edges, crosses)), F.exists(edges, touches)


def inside(x: Column, y: Column, rings: Column) -> Column:
    n, edge = crossings(x, y, rings)
    return edge | (n % 2 == 1)


def boxed(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """polygons with their bounding boxes."""
    flat = F.flatten(rings)
    return polygons.withColumns({
        "x_min": F.array_min(F.transform(flat, lambda p: p["x"])), "x_max": F.array_max(F.transform(flat, lambda p: p["x"])),
        "y_min": F.array_min(F.transform(flat, lambda p: p["y"])), "y_max": F.array_max(F.transform(flat, lambda p: p["y"])),
    })


def point_in_polygon(points: DataFrame, polygons: DataFrame, x: str, y: str, on: list[str] = (), rings: str = "rings", cell: float = 1.0) -> DataFrame:
    """points left joined to the polygons that hold them.

    Both sides meet in cells of a grid (a point in its own, a polygon in all that its box touches), so the join is
    an equality; the box and then the rings are tested in it."""
    floor = lambda c: F.floor(c / cell)
    shapes = boxed(polygons, rings).withColumn("_cx", F.explode(F.sequence(floor(F.col("x_min")), floor(F.col("x_max"))))).withColumn(
        "_cy", F.explode(F.sequence(floor(F.col("y_min")), floor(F.col("y_max"))))
    )
    keyed = points.withColumns({"_cx": floor(F.col(x)), "_cy": floor(F.col(y))})
    p, s = keyed.alias("p"), shapes.alias("s")
    same = (F.col("p._cx") == F.col("s._cx")) & (F.col("p._cy") == F.col("s._cy"))
    for c in on:
        same = same & (F.col(f"p.{c}") == F.col(f"s.{c}"))
    px, py = F.col(f"p.{x}"), F.col(f"p.{y}")
    held = px.between(F.col("s.x_min"), F.col("s.x_max")) & py.between(F.col("s.y_min"), F.col("s.y_max")) & inside(px, py, F.col(f"s.{rings}"))
    extra = [c for c in polygons.columns if c not in (*on, rings)]
    return p.join(s, same & held, "left").select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"s.{c}").alias(c) for c in extra])


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The hull's corners, closed, counter-clockwise (monotone chain)."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return [*pts, pts[0]] if pts else []
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    halves = []
    for seq in (pts, pts[::-1]):
        half: list = []
        for p in seq:
            while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return [*halves[0], *halves[1], halves[0][0]]


def concave_hull(points: list[tuple[float, float]], ratio: float = 0.85) -> list[tuple[float, float]]:
    """A hull whose edges longer than the limit are dug in to the nearest inner point that keeps it simple.

    The limit lies between the shortest and the longest edge of the convex hull, at ``ratio``. An approximation: a
    triangulation-based hull of the same ratio may differ in single corners."""
    from math import dist

    hull = convex_hull(points)
    if len(hull) < 4:
        return hull
    lengths = [dist(a, b) for a, b in zip(hull, hull[1:], strict=False)]
    limit = min(lengths) + ratio * (max(lengths) - min(lengths))
    left = set(points) - set(hull)
    ring, i = hull[:-1], 0
    while i < len(ring):
        a, b = ring[i], ring[(i + 1) % len(ring)]
        if dist(a, b) > limit and left:
            p = min(left, key=lambda q: (dist(a, q) + dist(q, b), q))
            if max(dist(a, p), dist(p, b)) < dist(a, b) and not any(_cross(a, p, *e) or _cross(p, b, *e) for e in zip(ring, ring[1:] + ring[:1], strict=True) if not {a, b, p} & set(e)):
                ring.insert(i + 1, p)
                left.discard(p)
                continue
        i += 1
    return [*ring, ring[0]]


def _cross(a, b, c, d) -> bool:
    side = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
