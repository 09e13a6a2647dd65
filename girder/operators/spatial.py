"""Spatial joins over plane segments, points and boxes.

Pairs are found by an equi join on grid cells that both boxes touch and kept
only in the first cell they share, so each pair comes once and none is missed.
A drawing is an ordinary key; the join's skew is that of drawing and cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions import geometry as G

#: Boxes that touch more cells than this would make many copies: choose a larger cell.
Box = tuple[Column, Column, Column, Column]


def segment_box(prefix: str = "", reach: Column | float = 0.0) -> Box:
    x1, y1, x2, y2 = G.segment(prefix)
    return F.least(x1, x2) - reach, F.least(y1, y2) - reach, F.greatest(x1, x2) + reach, F.greatest(y1, y2) + reach


def point_box(x: Column, y: Column, reach: Column | float = 0.0) -> Box:
    return x - reach, y - reach, x + reach, y + reach


def _low(box: Box, cell: tuple[float, float]) -> tuple[Column, Column]:
    return F.floor(box[0] / cell[0]).cast("long"), F.floor(box[1] / cell[1]).cast("long")


def _celled(df: DataFrame, box: Box, cell: tuple[float, float]) -> DataFrame:
    xs, ys = (F.sequence(a, b) for a, b in zip(_low(box, cell), _low(box[2:], cell), strict=True))
    out = df.withColumn("_cell", F.explode(F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))))
    return out.select(*df.columns, F.col("_cell.x").alias("_cell_x"), F.col("_cell.y").alias("_cell_y"))


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], left_box: Box, right_box: Box, cell: float | tuple[float, float]) -> DataFrame:
    """All pairs of equal keys whose boxes share a cell; the columns of both sides must have different names.

    Cells are squares of side ``cell``, or as wide and high as its two values say.
    """
    cell = cell if isinstance(cell, tuple) else (cell, cell)
    joined = _celled(left, left_box, cell).join(_celled(right, right_box, cell), [*keys, "_cell_x", "_cell_y"])
    (lx, ly), (rx, ry) = _low(left_box, cell), _low(right_box, cell)
    # The corners are worked out again from the boxes: as columns they would be shuffled with every cell.
    return joined.filter((F.col("_cell_x") == F.greatest(lx, rx)) & (F.col("_cell_y") == F.greatest(ly, ry))).drop("_cell_x", "_cell_y")


def renamed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns])


def segment_pairs(segments: DataFrame, keys: list[str], reach: float, cell: float | None = None, order: str = "seg_id") -> DataFrame:
    """Unordered pairs (a_*, b_*) of segments of equal keys whose boxes, widened by ``reach``, share a cell."""
    a, b = renamed(segments, "a_", keys), renamed(segments, "b_", keys)
    pairs = grid_join(a, b, keys, segment_box("a_", reach), segment_box("b_"), cell or max(4 * reach, 1.0))
    return pairs.filter(F.col(f"a_{order}") < F.col(f"b_{order}"))


def _frame_of(prefix: str) -> tuple[Column, G.Segment]:
    rec = G.line_record(G.segment(prefix))
    return rec, (rec["x1"], rec["y1"], rec["x2"], rec["y2"])


def pair_faces(segments: DataFrame, keys: list[str], min_overlap: float = 0.6, low: float = 0.08, high: float = 0.60, max_angle: float = 2.0, order: str = "seg_id") -> DataFrame:
    """Parallel faces a wall's thickness apart that overlap enough: distance, overlap and centre line."""
    recorded = segments.withColumn("rec", G.line_record(G.segment())).filter(F.col("rec").isNotNull())
    pairs = segment_pairs(recorded, keys, high, order=order)
    a, b = F.col("a_rec"), F.col("b_rec")
    along = lambda x, y: (x - a["x1"]) * a["ux"] + (y - a["y1"]) * a["uy"]
    across = lambda x, y: (x - a["x1"]) * a["nx"] + (y - a["y1"]) * a["ny"]
    p, q = along(b["x1"], b["y1"]), along(b["x2"], b["y2"])
    lo, hi = F.greatest(F.lit(0.0), F.least(p, q)), F.least(a["length"], F.greatest(p, q))
    offset = (across(b["x1"], b["y1"]) + across(b["x2"], b["y2"])) / 2
    out = pairs.filter(G.angle_delta(a["angle"], b["angle"]) <= max_angle).withColumns({"lo": lo, "hi": hi, "offset": offset})
    out = out.withColumn("overlap", F.col("hi") - F.col("lo")).withColumn("distance", F.abs("offset"))
    out = out.filter((F.col("overlap") > 0) & (F.col("overlap") / F.least(a["length"], b["length"]) >= min_overlap) & F.col("distance").between(low, high))
    mid = F.col("offset") / 2
    at = lambda t: (a["x1"] + F.col(t) * a["ux"] + mid * a["nx"], a["y1"] + F.col(t) * a["uy"] + mid * a["ny"])
    (sx, sy), (ex, ey) = at("lo"), at("hi")
    out = out.withColumns({"x1": sx, "y1": sy, "x2": ex, "y2": ey})
    back = lambda x, y: (F.col(x) - b["x1"]) * b["ux"] + (F.col(y) - b["y1"]) * b["uy"]
    out = out.withColumn("b_lo", F.least(back("x1", "y1"), back("x2", "y2"))).withColumn("b_hi", F.greatest(back("x1", "y1"), back("x2", "y2")))
    return out.select(*keys, f"a_{order}", f"b_{order}", "distance", "overlap", "lo", "hi", "b_lo", "b_hi", "x1", "y1", "x2", "y2")


# Wall thicknesses in metres that faces may be apart.
THICKNESSES = (0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60)


def band_pairs(faces: DataFrame, keys: list[str], fixed: str = "fixed", lo: str = "lo", hi: str = "hi", order: str = "face_id", tolerance: float = 0.025, min_overlap: float = 0.30, min_share: float = 0.45, thicknesses: tuple[float, ...] = THICKNESSES) -> DataFrame:
    """Axis-parallel faces whose separation is near an expected thickness and whose spans overlap enough.

    A band join: the axis is cut into bands as wide as the largest separation; a
    face meets its own band and the next.
    """
    reach = max(thicknesses) + tolerance
    f = faces.select(*keys, F.col(order).alias("id"), F.col(fixed).alias("fixed"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    band = F.floor(F.col("fixed") / reach)
    a = renamed(f.withColumn("band", F.explode(F.array(band, band + 1))), "a_", [*keys, "band"])
    b = renamed(f.withColumn("band", band), "b_", [*keys, "band"])
    pairs = a.join(b, [*keys, "band"]).filter((F.col("b_fixed") > F.col("a_fixed")) | ((F.col("b_fixed") == F.col("a_fixed")) & (F.col("b_id") > F.col("a_id"))))
    pairs = pairs.withColumn("separation", F.col("b_fixed") - F.col("a_fixed")).withColumn("overlap", F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo"))
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("separation") - t).alias("error"), F.lit(i).alias("i"), F.lit(t).alias("thickness")) for i, t in enumerate(thicknesses)]))
    out = pairs.withColumn("near", near).filter((F.col("separation") <= reach) & (F.col("near.error") <= tolerance) & (F.col("overlap") >= min_overlap))
    out = out.filter(F.col("overlap") / F.least(F.col("a_hi") - F.col("a_lo"), F.col("b_hi") - F.col("b_lo")) >= min_share)
    return out.select(*keys, "a_id", "b_id", "separation", "overlap", F.col("near.thickness").alias("expected"), F.greatest("a_lo", "b_lo").alias("lo"), F.least("a_hi", "b_hi").alias("hi"), ((F.col("a_fixed") + F.col("b_fixed")) / 2).alias("fixed"))


def near_points(left: DataFrame, right: DataFrame, keys: list[str], reach: float, left_xy: tuple[str, str] = ("x", "y"), right_xy: tuple[str, str] = ("rx", "ry")) -> DataFrame:
    """Pairs of points at most ``reach`` apart, with their distance."""
    cell = max(2 * reach, 1e-6)
    pairs = grid_join(left, right, keys, point_box(F.col(left_xy[0]), F.col(left_xy[1]), reach), point_box(F.col(right_xy[0]), F.col(right_xy[1])), cell)
    return pairs.withColumn("distance", G.hypot(F.col(left_xy[0]) - F.col(right_xy[0]), F.col(left_xy[1]) - F.col(right_xy[1]))).filter(F.col("distance") <= reach)


def mutual_unique(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs that are the only one of both their sides."""
    l, r = Window.partitionBy(left), Window.partitionBy(right)
    return pairs.withColumn("_l", F.count("*").over(l)).withColumn("_r", F.count("*").over(r)).filter("_l = 1 AND _r = 1").drop("_l", "_r")


def strict_one_to_one(left: DataFrame, right: DataFrame, pairs: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """The pairs, or an error row by row if a left row has not exactly one or a right row is used twice or left over."""
    n_left = pairs.groupBy(left_id).agg(F.count("*").alias("n"))
    bad = left.select(left_id).join(n_left, left_id, "left").filter(F.coalesce("n", F.lit(0)) != 1).select(F.concat(F.lit("left "), F.col(left_id).cast("string")).alias("what"))
    n_right = pairs.groupBy(right_id).agg(F.count("*").alias("n"))
    bad = bad.unionByName(right.select(right_id).join(n_right, right_id, "left").filter(F.coalesce("n", F.lit(0)) != 1).select(F.concat(F.lit("right "), F.col(right_id).cast("string")).alias("what")))
    worst = bad.agg(F.min("what").alias("what"))
    return pairs.crossJoin(F.broadcast(worst)).withColumn("_ok", F.when(F.col("what").isNotNull(), F.raise_error(F.concat(F.lit("not one to one: "), F.col("what"))).cast("boolean")).otherwise(True)).filter("_ok").drop("what", "_ok")


def inside_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], cell: float, point_id: str = "point_id") -> DataFrame:
    """Ids of points inside any box (x1, y1, x2, y2), edges included."""
    b = renamed(boxes, "b_", keys)
    pairs = grid_join(points.select(*keys, point_id, "x", "y"), b, keys, point_box(F.col("x"), F.col("y")), tuple(F.col(f"b_{c}") for c in ("x1", "y1", "x2", "y2")), cell)
    return pairs.filter(F.col("x").between(F.col("b_x1"), F.col("b_x2")) & F.col("y").between(F.col("b_y1"), F.col("b_y2"))).select(*keys, point_id).distinct()


def segment_ends(segments: DataFrame, keys: list[str], *carry: str) -> DataFrame:
    """Both ends of each segment: keys, carried columns, end (start or end), x, y."""
    ends = F.array(F.struct(F.lit("start").alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit("end").alias("end"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    return segments.select(*keys, *carry, F.explode(ends).alias("e")).select(*keys, *carry, "e.*")


def supported_ends(ends: DataFrame, segments: DataFrame, keys: list[str], own: str, other: str, reach: Column, most: float, strict: bool = False) -> DataFrame:
    """Ends (own, end) that have a segment other than their own within ``reach`` (a column of both sides' values, at most ``most``)."""
    s = renamed(segments, "s_", keys)
    pairs = grid_join(ends, s, keys, point_box(F.col("x"), F.col("y"), most), segment_box("s_"), 2 * most)
    d = G.point_segment_distance((F.col("x"), F.col("y")), G.segment("s_"))
    hit = (d < reach) if strict else (d <= reach)
    return pairs.filter((F.col(own) != F.col(f"s_{other}")) & hit).select(*keys, own, "end").distinct()


def topology(walls: DataFrame, keys: list[str], wall_id: str = "wall_id", thickness: str = "thickness", tolerance: float = 0.30) -> DataFrame:
    """Per drawing the share of wall ends with another wall near, and of walls with both.

    The tolerance of two walls is half their thicknesses (mm) plus 0.05, at least ``tolerance``, at most 0.8.
    """
    ends = segment_ends(walls, keys, wall_id, thickness)
    reach = F.least(F.lit(0.8), F.greatest(F.lit(tolerance), (F.coalesce(F.col(thickness), F.lit(0.0)) + F.coalesce(F.col(f"s_{thickness}"), F.lit(0.0))) / 2000 + 0.05))
    hit = supported_ends(ends, walls, keys, wall_id, wall_id, reach, 0.8).groupBy(*keys, wall_id).agg(F.count("*").alias("hits"))
    each = walls.select(*keys, wall_id).join(hit, [*keys, wall_id], "left").na.fill(0, ["hits"])
    return each.groupBy(*keys).agg(F.count("*").alias("walls"), F.sum("hits").alias("connected_ends"), F.count(F.when(F.col("hits") == 2, 1)).alias("fully_connected")).withColumn("endpoint_coverage", F.col("connected_ends") / (2 * F.col("walls"))).withColumn("fully_connected_rate", F.col("fully_connected") / F.col("walls"))


def ends_on_columns(ends: DataFrame, columns: DataFrame, keys: list[str], own: str, margin: float, most: float) -> DataFrame:
    """Ends inside a column's box (cx, cy, w, d) widened by the margin; w and d at most ``most``."""
    c = renamed(columns, "c_", keys)
    half = lambda f: F.col(f"c_{f}") / 2 + margin
    pairs = grid_join(ends, c, keys, point_box(F.col("x"), F.col("y")), (F.col("c_cx") - half("w"), F.col("c_cy") - half("d"), F.col("c_cx") + half("w"), F.col("c_cy") + half("d")), most + 2 * margin)
    return pairs.filter((F.abs(F.col("x") - F.col("c_cx")) <= half("w")) & (F.abs(F.col("y") - F.col("c_cy")) <= half("d"))).select(*keys, own, "end").distinct()


def topology_with_columns(walls: DataFrame, columns: DataFrame, keys: list[str], wall_id: str = "wall_id", thickness: str = "thickness", tolerance: float = 0.30, margin: float = 0.15, most: float = 5.0) -> DataFrame:
    """A10: as topology, an end also counts inside a column's widened box."""
    ends = segment_ends(walls, keys, wall_id, thickness)
    reach = F.least(F.lit(0.8), F.greatest(F.lit(tolerance), (F.col(thickness) + F.col(f"s_{thickness}")) / 2000 + 0.05))
    hits = supported_ends(ends, walls, keys, wall_id, wall_id, reach, 0.8).unionByName(ends_on_columns(ends, columns, keys, wall_id, margin, most)).distinct()
    n = hits.groupBy(*keys, wall_id).agg(F.count("*").alias("hits"))
    each = walls.select(*keys, wall_id).join(n, [*keys, wall_id], "left").na.fill(0, ["hits"])
    return each.groupBy(*keys).agg(F.count("*").alias("walls"), F.sum("hits").alias("connected_ends"), F.count(F.when(F.col("hits") == 2, 1)).alias("fully_connected"))


def beam_support(beams: DataFrame, columns: DataFrame, shear: DataFrame, grid: DataFrame, keys: list[str], beam_id: str = "beam_id") -> DataFrame:
    """Per beam whether an end is on a column, a shear wall (< 0.3), another beam (< 0.6) or a grid point (< 0.6).

    columns: cx, cy, w.  shear: wall_id and ends.  grid: gx, gy points.
    """
    ends = segment_ends(beams, keys, beam_id)
    c = columns.select(*keys, F.col("cx").alias("rx"), F.col("cy").alias("ry"), (F.greatest(F.lit(0.4), F.col("w") / 2) + 0.3).alias("radius"))
    on_column = near_points(ends, c, keys, 3.0).filter(F.col("distance") < F.col("radius")).select(*keys, beam_id, "end")
    long_walls = shear.filter(G.length(G.segment()) >= 1e-6).withColumn(beam_id, F.lit(None).cast(dict(beams.dtypes)[beam_id]))
    s = renamed(long_walls.select(*keys, "x1", "y1", "x2", "y2"), "s_", keys)
    on_wall = grid_join(ends, s, keys, point_box(F.col("x"), F.col("y"), 0.3), segment_box("s_"), 2.0).filter(G.point_segment_distance((F.col("x"), F.col("y")), G.segment("s_")) < 0.3).select(*keys, beam_id, "end")
    on_beam = supported_ends(ends, beams.filter(G.length(G.segment()) >= 1e-6), keys, beam_id, beam_id, F.lit(0.6), 0.6, strict=True)
    on_grid = near_points(ends, grid.select(*keys, F.col("gx").alias("rx"), F.col("gy").alias("ry")), keys, 0.6).filter("distance < 0.6").select(*keys, beam_id, "end")
    held = on_column.unionByName(on_wall).unionByName(on_beam).unionByName(on_grid).select(*keys, beam_id).distinct().withColumn("supported", F.lit(True))
    return beams.select(*keys, beam_id).join(held, [*keys, beam_id], "left").na.fill(False, ["supported"])


def grid_attach(columns: DataFrame, axes: DataFrame, keys: list[str], tolerance: float = 0.3, either: bool = False) -> DataFrame:
    """Per column whether the nearest x and the nearest y axis meet within the tolerance.

    ``either``: one of the two axes within it is enough.  axes: keys + xs, ys arrays.
    """
    joined = columns.join(axes, keys, "left")
    dx, dy = F.abs(G.nearest(F.col("cx"), F.col("xs")) - F.col("cx")), F.abs(G.nearest(F.col("cy"), F.col("ys")) - F.col("cy"))
    there = (F.size("xs") > 0) & (F.size("ys") > 0)
    hit = ((dx < tolerance) | (dy < tolerance)) if either else (G.hypot(dx, dy) < tolerance)
    return joined.withColumn("attached", F.coalesce(there & hit, F.lit(False))).drop("xs", "ys")


def covered_intervals(source: DataFrame, candidates: DataFrame, keys: list[str], source_id: str, candidate_id: str, max_angle: float, lateral: float, shortest: float = 0.05) -> DataFrame:
    """The stretch of each source segment along which a candidate runs beside it."""
    s = renamed(source.withColumn("rec", G.line_record(G.segment())), "s_", keys)
    c = renamed(candidates.withColumn("rec", G.line_record(G.segment())), "c_", keys)
    pairs = grid_join(s, c, keys, segment_box("s_", lateral), segment_box("c_", lateral), max(8 * lateral, 2.0))
    x1, y1, x2, y2 = G.segment("s_")
    n = G.length((x1, y1, x2, y2))
    ux, uy = (x2 - x1) / n, (y2 - y1) / n
    along = lambda x, y: (x - x1) * ux + (y - y1) * uy
    p, q = along(F.col("c_x1"), F.col("c_y1")), along(F.col("c_x2"), F.col("c_y2"))
    out = pairs.filter(F.col("s_rec").isNotNull() & F.col("c_rec").isNotNull() & (G.angle_delta(F.col("s_rec.angle"), F.col("c_rec.angle")) <= max_angle))
    out = out.withColumn("lo", F.greatest(F.lit(0.0), F.least(p, q))).withColumn("hi", F.least(n, F.greatest(p, q))).filter(F.col("hi") - F.col("lo") > shortest)
    beside = lambda t: G.line_distance((x1 + t * ux, y1 + t * uy), G.segment("c_"))
    worst = F.greatest(beside(F.col("lo")), beside((F.col("lo") + F.col("hi")) / 2), beside(F.col("hi")))
    return out.filter(worst <= lateral).select(*keys, F.col(f"s_{source_id}").alias("source_id"), F.col(f"c_{candidate_id}").alias("candidate_id"), "lo", "hi", n.alias("length"))


def associate(candidates: DataFrame, vectors: DataFrame, keys: list[str], candidate_id: str, vector_id: str, max_distance: float = 5.0, max_angle: float = 4.0, min_share: float = 0.20, shown: int = 12) -> DataFrame:
    """Vectors beside each candidate by (distance, angle, -overlap): the first ones with their place, and the count of all."""
    c = renamed(candidates.withColumn("rec", G.line_record(G.segment())), "c_", keys)
    v = renamed(vectors.withColumn("rec", G.line_record(G.segment())), "v_", keys)
    pairs = grid_join(c, v, keys, segment_box("c_", max_distance), segment_box("v_"), 8 * max_distance)
    r, w = F.col("c_rec"), F.col("v_rec")
    mx, my = (F.col("v_x1") + F.col("v_x2")) / 2, (F.col("v_y1") + F.col("v_y2")) / 2
    distance = F.abs((mx - r["x1"]) * r["nx"] + (my - r["y1"]) * r["ny"])
    along = lambda x, y: (x - r["x1"]) * r["ux"] + (y - r["y1"]) * r["uy"]
    p, q = along(w["x1"], w["y1"]), along(w["x2"], w["y2"])
    overlap = F.least(r["length"], F.greatest(p, q)) - F.greatest(F.lit(0.0), F.least(p, q))
    out = pairs.filter(r.isNotNull() & w.isNotNull()).select(*keys, f"c_{candidate_id}", f"v_{vector_id}", distance.alias("distance"), G.angle_delta(r["angle"], w["angle"]).alias("angle"), overlap.alias("overlap"), r["length"].alias("n"))
    out = out.filter((F.col("angle") <= max_angle) & (F.col("distance") <= max_distance) & (F.col("overlap") >= min_share * F.col("n")))
    per = Window.partitionBy(*keys, f"c_{candidate_id}")
    ranked = out.withColumn("matches", F.count("*").over(per)).withColumn("place", F.row_number().over(per.orderBy("distance", "angle", F.desc("overlap"), f"v_{vector_id}")))
    return ranked.filter(F.col("place") <= shown).drop("n")


def nearest_end(walls: DataFrame, px: Column, py: Column, tolerance: float) -> Column:
    """Which end is within the tolerance of a point; the nearer, "end" on ties; null for none."""
    a, b = G.hypot(F.col("x1") - px, F.col("y1") - py), G.hypot(F.col("x2") - px, F.col("y2") - py)
    return F.when((b <= tolerance) & (b <= a), "end").when(a <= tolerance, "start")


def missing_openings(stored: DataFrame, approved: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Approved openings without a stored one of the same mark nearby, to be appended."""
    reach = max(0.05, tolerance)
    s = stored.select(*keys, "mark", F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = near_points(approved, s, [*keys, "mark"], reach).select("opening_id").distinct()
    return approved.join(near, "opening_id", "left_anti")


def duplicate_lines(lines: DataFrame, keys: list[str], order: str = "ord", places: int = 1) -> DataFrame:
    """The first line per layer and unordered, rounded ends."""
    p = lambda x, y: F.struct(F.round(x, places).alias("x"), F.round(y, places).alias("y"))
    ends = F.array_sort(F.array(p("x1", "y1"), p("x2", "y2")))
    packed = F.min_by(F.struct(*lines.columns), F.col(order))
    return lines.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], ends.alias("_ends")).agg(packed.alias("_r")).select("_r.*")


def unique_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with exactly one distinct value, and the value; the others need review."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n"), F.min(value).alias("value")).withColumn("status", F.when(F.col("n") == 1, "matched").otherwise("review_required"))
