"""Plane geometry as column arithmetic.  Points are (x, y) pairs of columns, segments (x1, y1, x2, y2)."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]
Segment = tuple[Column, Column, Column, Column]


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, value))


def segment(prefix: str = "") -> Segment:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def length(s: Segment) -> Column:
    return hypot(s[2] - s[0], s[3] - s[1])


def angle_delta(a: Column, b: Column) -> Column:
    """Acute difference of angles modulo 180."""
    d = F.abs(a - b) % 180.0
    return F.least(d, 180.0 - d)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once; keeps nested formulas from being written out many times over."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_record(s: Segment) -> Column:
    """The segment in canonical direction with unit vector, normal, angle and length; null if it has no length."""
    x1, y1, x2, y2 = s

    def record(b: Column) -> Column:
        pick = lambda p, q: F.when(b["flip"], p).otherwise(q)
        cx, cy = pick(-b["ux"], b["ux"]), pick(-b["uy"], b["uy"])
        return F.struct(
            pick(b["x2"], b["x1"]).alias("x1"), pick(b["y2"], b["y1"]).alias("y1"), pick(b["x1"], b["x2"]).alias("x2"), pick(b["y1"], b["y2"]).alias("y2"),
            cx.alias("ux"), cy.alias("uy"), (-cy).alias("nx"), cx.alias("ny"), F.pmod(F.degrees(F.atan2(cy, cx)), F.lit(180.0)).alias("angle"), b["n"].alias("length"))

    def flipped(b: Column) -> Column:
        flip = (b["ux"] < -1e-9) | ((F.abs(b["ux"]) <= 1e-9) & (b["uy"] < 0))
        return let(F.struct(*[b[c].alias(c) for c in ("x1", "y1", "x2", "y2", "n", "ux", "uy")], flip.alias("flip")), record)

    def unit(b: Column) -> Column:
        return let(F.struct(*[b[c].alias(c) for c in ("x1", "y1", "x2", "y2", "n")], ((b["x2"] - b["x1"]) / b["n"]).alias("ux"), ((b["y2"] - b["y1"]) / b["n"]).alias("uy")), flipped)

    ends = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), length(s).alias("n"))
    return let(ends, lambda b: F.when(b["n"] > 1e-9, unit(b)))


def point_segment_distance(p: Point, s: Segment) -> Column:
    """Distance to the nearest point of the segment."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    squared = dx * dx + dy * dy
    t = clamp(((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / squared, 0.0, 1.0)
    return F.when(squared <= 1e-12, hypot(p[0] - s[0], p[1] - s[1])).otherwise(hypot(p[0] - s[0] - t * dx, p[1] - s[1] - t * dy))


def line_distance(p: Point, s: Segment) -> Column:
    """Distance to the infinite line."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    return F.abs((p[0] - s[0]) * dy - (p[1] - s[1]) * dx) / hypot(dx, dy)


def intersection(a: Segment, b: Segment) -> Column:
    """Where the infinite lines cross; null if they are parallel."""
    ax, ay, bx, by = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    cross = ax * by - ay * bx
    t = ((b[0] - a[0]) * by - (b[1] - a[1]) * bx) / cross
    return F.when(F.abs(cross) > 1e-9, F.struct((a[0] + t * ax).alias("x"), (a[1] + t * ay).alias("y")))


def transform_point(p: Point, origin: tuple[float, float], scale: float, rotation_deg: float, offset: tuple[Column, Column]) -> Point:
    """Shift to the origin, scale, rotate, add the frame's offset; rounded to 9 places."""
    x, y = (p[0] - origin[0]) * scale, (p[1] - origin[1]) * scale
    c, s = F.cos(F.radians(F.lit(rotation_deg))), F.sin(F.radians(F.lit(rotation_deg)))
    return F.round(x * c - y * s + offset[0], 9), F.round(x * s + y * c + offset[1], 9)


def affine_between(source: tuple[float, float, float, float], target: tuple[float, float, float, float]) -> tuple[float, ...]:
    """(a, b, tx, c, d, ty) that takes points of one registered frame (ox, oy, scale, degrees) to another."""
    import math

    (sx, sy, ss, sr), (tx, ty, ts, tr) = source, target
    k, r = ss / ts, math.radians(sr - tr)
    a, b = k * math.cos(r), -k * math.sin(r)
    return a, b, tx - a * sx - b * sy, -b, a, ty + b * sx - a * sy


def orthogonalize(s: Segment, tolerance_deg: float = 2.0, shortest: float = 0.5) -> Column:
    """Within the tolerance of an axis the segment is snapped to it at its mean coordinate; null if then too short."""
    x1, y1, x2, y2 = s
    angle = F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))
    flat, tall = F.least(angle, 180.0 - angle) <= tolerance_deg, F.abs(angle - 90.0) <= tolerance_deg
    my, mx = (y1 + y2) / 2, (x1 + x2) / 2
    out = F.struct(F.when(tall, mx).otherwise(x1).alias("x1"), F.when(flat, my).otherwise(y1).alias("y1"), F.when(tall, mx).otherwise(x2).alias("x2"), F.when(flat, my).otherwise(y2).alias("y2"), (flat | tall).alias("snapped"))
    return F.when(hypot(out["x2"] - out["x1"], out["y2"] - out["y1"]) >= shortest, out)


def polygon_area(points: Column) -> Column:
    """Shoelace area of array<struct<x, y>>."""
    shifted = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, shifted, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda acc, v: acc + v)) / 2


def vertex_mean(points: Column) -> Column:
    """Mean of the vertices (not the centroid)."""
    n = F.size(points)
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[f]) / n
    return F.struct(total("x").alias("x"), total("y").alias("y"))


def _named(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def clip_polygon(points: Column, xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """The polygon cut to a rectangle, one side after the other, as nested array folds."""

    def cut(poly: Column, axis: str, bound: Column, keep_less: bool) -> Column:
        inside = lambda p: (p[axis] <= bound) if keep_less else (p[axis] >= bound)
        other = "y" if axis == "x" else "x"

        def cross(a: Column, b: Column) -> Column:
            t = (bound - a[axis]) / (b[axis] - a[axis])
            v = a[other] + t * (b[other] - a[other])
            return F.struct((bound if axis == "x" else v).cast("double").alias("x"), (v if axis == "x" else bound).cast("double").alias("y"))

        before = F.concat(F.slice(poly, F.greatest(F.size(poly), F.lit(1)), F.lit(1)), F.slice(poly, 1, F.greatest(F.size(poly) - 1, F.lit(0))))
        none = F.array().cast("array<struct<x:double,y:double>>")
        keep = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
        step = F.zip_with(before, poly, lambda a, b: F.when(inside(a) & inside(b), F.array(keep(b))).when(inside(a), F.array(cross(a, b))).when(inside(b), F.array(cross(a, b), keep(b))).otherwise(none))
        return F.flatten(step)

    for axis, bound, less in (("x", xmin, False), ("x", xmax, True), ("y", ymin, False), ("y", ymax, True)):
        points = _named(points, functools.partial(cut, axis=axis, bound=bound, keep_less=less))
    return points


def box_iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of (x1, y1, x2, y2); 0 without a union."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda s: F.greatest(zero, s[2] - s[0]) * F.greatest(zero, s[3] - s[1])
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def tile_origins(width: Column, height: Column, tile: int, overlap: int) -> Column:
    """Distinct (x, y) of overlapping tiles, rows first; the last ones are moved inside."""
    if tile <= 0 or not 0 <= overlap < tile:
        raise ValueError("tile must be positive and 0 <= overlap < tile")
    stops = lambda size: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(tile - overlap)), lambda v: F.least(v, F.greatest(F.lit(0), size - tile))))
    return F.flatten(F.transform(stops(height), lambda y: F.transform(stops(width), lambda x: F.struct(x.alias("x"), y.alias("y")))))


def nearest(value: Column, axes: Column) -> Column:
    """The nearest of an array of axes, the first on ties; the value itself without axes."""
    best = F.array_min(F.transform(axes, lambda a, i: F.struct(F.abs(a - value).alias("d"), i.alias("i"), a.alias("a"))))
    return F.coalesce(best["a"], value)


def clip_axis_line(s: Segment, bounds: tuple[float, float, float, float]) -> Column:
    """An axis-parallel line cut to (xmin, ymin, xmax, ymax); null outside or without length."""
    xmin, ymin, xmax, ymax = bounds
    x1, y1, x2, y2 = s
    flat = F.abs(x2 - x1) >= F.abs(y2 - y1)
    lo, hi = F.when(flat, F.least(x1, x2)).otherwise(F.least(y1, y2)), F.when(flat, F.greatest(x1, x2)).otherwise(F.greatest(y1, y2))
    fixed = F.when(flat, (y1 + y2) / 2).otherwise((x1 + x2) / 2)
    lo = F.greatest(lo, F.when(flat, F.lit(xmin)).otherwise(F.lit(ymin)))
    hi = F.least(hi, F.when(flat, F.lit(xmax)).otherwise(F.lit(ymax)))
    inside = F.when(flat, fixed.between(ymin, ymax)).otherwise(fixed.between(xmin, xmax))
    return F.when(inside & (hi - lo > 1e-9), F.struct(F.when(flat, lo).otherwise(fixed).alias("x1"), F.when(flat, fixed).otherwise(lo).alias("y1"), F.when(flat, hi).otherwise(fixed).alias("x2"), F.when(flat, fixed).otherwise(hi).alias("y2")))


def distance_confidence(distance: Column, most: float, floor: float = 0.7, slope: float = 0.3) -> Column:
    """P66."""
    return F.greatest(F.lit(floor), 1 - slope * distance / most)


def piecewise(value: Column, controls: Column) -> Column:
    """Linear between control points (array of struct<at, to> by at); end segments extend."""
    n = F.size(controls)
    at = clamp(F.size(F.filter(controls, lambda c: c["at"] <= value)), F.lit(1), n - 1)
    a, b = F.element_at(controls, at), F.element_at(controls, at + 1)
    return F.when(n < 2, F.element_at(controls, 1)["to"]).otherwise(a["to"] + (value - a["at"]) * (b["to"] - a["to"]) / (b["at"] - a["at"]))


def quantities(s: Segment, thickness: Column, height: Column) -> Column:
    """Length, face and plan areas and volume of a wall, gross, rounded to 6 places."""
    n = length(s)
    return F.struct(F.round(n, 6).alias("length"), F.round(n * thickness, 6).alias("plan_area"), F.round(n * height, 6).alias("face_area"), F.round(n * thickness * height, 6).alias("volume"))


def folded_angle(s: Segment) -> Column:
    """Angle in degrees folded to (-45, 45]."""
    a = F.pmod(F.degrees(F.atan2(s[3] - s[1], s[2] - s[0])), F.lit(90.0))
    return F.when(a > 45.0, a - 90.0).otherwise(a)
