"""Door leaves told by geometry: a thin rectangle with exactly one quarter arc that swings its free corner about its hinge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions import geometry as G
from girder.operators import spatial
from girder.plans.staging import stage

# Metres and degrees.
LENGTH, THICKNESS, NEAR, ANGLE, ON_WALL = (0.60, 1.20), (0.015, 0.080), 0.002, 1.0, 0.15
KEYS = ["drawing", "occurrence"]


def _corner(i: int):
    return F.get("points", F.lit(i % 4))


def _rectangles(profiles: DataFrame) -> DataFrame:
    """profiles with length and thickness (m) of their four edges; null if they make no rectangle."""
    ok = (F.size("points") == 4) & F.forall("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    edge = lambda i: F.struct((_corner(i + 1)["x"] - _corner(i)["x"]).alias("x"), (_corner(i + 1)["y"] - _corner(i)["y"]).alias("y"), G.hypot(_corner(i + 1)["x"] - _corner(i)["x"], _corner(i + 1)["y"] - _corner(i)["y"]).alias("n"))
    rows = stage(profiles.withColumn("_e", F.when(ok, F.array(*(edge(i) for i in range(4))))), "leaf-edges")  # written, not written out in each formula below
    e = [F.get("_e", F.lit(i)) for i in range(4)]
    sizes = F.transform("_e", lambda x: x["n"])
    rows = rows.withColumns({"length": F.array_max(sizes), "thickness": F.array_min(sizes)})
    square = [F.abs((e[i - 1]["x"] * e[i]["x"] + e[i - 1]["y"] * e[i]["y"]) / F.nullif(e[i - 1]["n"] * e[i]["n"], F.lit(0.0))) for i in range(4)]
    alike = (F.abs(e[0]["n"] - e[2]["n"]) <= F.greatest(F.lit(NEAR), F.col("length") * 0.005)) & (F.abs(e[1]["n"] - e[3]["n"]) <= F.greatest(F.lit(NEAR), F.col("thickness") * 0.05))
    fits = (F.col("thickness") > 1e-9) & alike & (F.greatest(*square) <= F.sin(F.radians(F.lit(ANGLE))))
    return stage(rows.withColumn("_fits", fits), "leaves").withColumns({c: F.when(F.col("_fits"), F.col(c)) for c in ("length", "thickness")}).drop("_e", "_fits")


def swings(profiles: DataFrame, arcs: DataFrame, walls: DataFrame) -> DataFrame:
    """A row per profile in review: what became of it, and of a door leaf its arc, hinge and free corner.

    profiles: KEYS, candidate_id, status, identified, points (array of x, y), x1, y1, x2, y2 (centre line); arcs: KEYS,
    arc_id, cx, cy, radius, start_angle, end_angle (degrees); walls: drawing, x1, y1, x2, y2, candidate_id; all in m.
    outcome: identity_incomplete, invalid_geometry, out_of_range, missing_arc, ambiguous_arc, held_by_walls, door_leaf.
    """
    rows = _rectangles(profiles.filter("status = 'NEEDS_REVIEW'"))
    sized = F.col("length").between(*LENGTH) & F.col("thickness").between(*THICKNESS)
    open_ = rows.filter(F.coalesce("identified", F.lit(False)) & sized)
    corners = open_.select(*KEYS, "candidate_id", "length", "points", F.posexplode("points").alias("corner", "p")).select(*KEYS, "candidate_id", "length", "points", "corner", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    turn = F.pmod(F.col("end_angle") - F.col("start_angle"), F.lit(360.0))
    quarter = arcs.filter((F.col("radius") > 0) & (F.abs(turn - 90.0) <= ANGLE))
    tip = lambda a, f, c: (F.col(c) + F.col("radius") * f(F.radians(a)))
    ends = {f"{n}{i}": tip(a, f, c) for i, a in ((1, "start_angle"), (2, "end_angle")) for n, f, c in (("ex", F.cos, "cx"), ("ey", F.sin, "cy"))}
    quarter = quarter.withColumns(ends).select(*KEYS, "arc_id", "radius", F.col("cx").alias("rx"), F.col("cy").alias("ry"), *ends)
    met = spatial.near_points(corners, quarter, KEYS, NEAR).filter(F.abs(F.col("radius") - F.col("length")) <= F.greatest(F.lit(NEAR), F.col("length") * 0.005))
    hinge = met.groupBy(*KEYS, "candidate_id", "arc_id").agg(F.min(F.struct("distance", "corner", "length", "points", "ex1", "ey1", "ex2", "ey2")).alias("h"))
    # A hinge's free corner is the one next to it at the length of the leaf.
    at = lambda step: F.get("h.points", F.pmod(F.col("h.corner") + step, F.lit(4)))
    long = lambda step: F.abs(G.hypot(at(step)["x"] - at(0)["x"], at(step)["y"] - at(0)["y"]) - F.col("h.length")) <= F.greatest(F.lit(NEAR), F.col("h.length") * 0.005)
    hinge = hinge.withColumn("step", F.when(long(-1) != long(1), F.when(long(-1), -1).otherwise(1))).filter("step IS NOT NULL")
    free = at(F.col("step"))
    error = F.least(*(G.hypot(F.col(f"h.ex{i}") - free["x"], F.col(f"h.ey{i}") - free["y"]) for i in (1, 2)))
    fitting = hinge.withColumn("free_error", error).filter(F.col("free_error") <= NEAR)
    one = F.struct("arc_id", F.col("h.corner").alias("hinge"), F.pmod(F.col("h.corner") + F.col("step"), F.lit(4)).alias("free"), F.col("h.distance").alias("hinge_error"), "free_error")
    found = fitting.groupBy(*KEYS, "candidate_id").agg(F.count("*").alias("arcs"), F.min(one).alias("one"))
    tips = open_.join(found.filter("arcs = 1").select(*KEYS, "candidate_id"), [*KEYS, "candidate_id"]).select("drawing", "occurrence", "candidate_id", F.explode(F.array(*(F.struct(F.lit(i).alias("tip"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2)))).alias("t")).select("drawing", "occurrence", "candidate_id", "t.*")
    near_walls = spatial.renamed(walls, "w_", ["drawing"])
    held = spatial.grid_join(tips, near_walls, ["drawing"], spatial.point_box(F.col("x"), F.col("y"), ON_WALL), spatial.segment_box("w_"), 2.0)
    held = held.filter(~F.col("candidate_id").eqNullSafe(F.col("w_candidate_id")) & (G.point_segment_distance((F.col("x"), F.col("y")), G.segment("w_")) <= ON_WALL))
    both = held.groupBy(*KEYS, "candidate_id").agg(F.count_distinct("tip").alias("tips"))
    # Without a centre line nothing tells that the ends are free.
    lined = F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    out = rows.join(found, [*KEYS, "candidate_id"], "left").join(both, [*KEYS, "candidate_id"], "left")
    outcome = (
        F.when(~F.coalesce("identified", F.lit(False)), "identity_incomplete").when(F.col("length").isNull(), "invalid_geometry").when(~sized, "out_of_range").when(F.col("arcs").isNull(), "missing_arc").when(F.col("arcs") > 1, "ambiguous_arc")
        .when(~lined | (F.coalesce("tips", F.lit(0)) == 2), "held_by_walls").otherwise("door_leaf"))
    out = out.withColumn("outcome", outcome)
    leaf = lambda c: F.when(F.col("outcome") == "door_leaf", F.col(f"one.{c}")).alias(c)
    return out.select(*KEYS, "candidate_id", "length", "thickness", "outcome", *map(leaf, ("arc_id", "hinge", "free", "hinge_error", "free_error")))
