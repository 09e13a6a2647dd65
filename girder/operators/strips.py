"""A wall strip proved by one closed outline of four straight edges, as column expressions over its vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions import domain as D
from girder.functions import geometry as G

# Degrees, ratios, metres.
MAX_ERROR, OPPOSITE, ASPECT, THICKNESS = 2.0, 0.95, 3.0, (0.08, 0.60)
NO_LINETYPE = ("", "BYLAYER", "BYBLOCK")


def _at(i: int) -> Column:
    return F.get("points", F.lit(i % 4))


def closed_strips(entities: DataFrame, min_length: float = 0.5) -> DataFrame:
    """A row per outline that is a strip: the entity's columns, wall_group, centre line, length and thickness (m), errors, blockers, status.

    entities: kind, closed, layer, linetype, layer_linetype, points (array of x, y, bulge, in metres).  An outline with
    a blocker is reserved for review as one unit; any other shape gives no row, and its edges stay open to pairing.
    """
    finite = F.forall("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    straight = F.forall("points", lambda p: F.abs(F.coalesce(p["bulge"], F.lit(0.0))) <= 1e-9)
    rows = entities.withColumn("wall_group", D.wall_group(F.col("layer"))).filter((F.col("kind") == "LWPOLYLINE") & F.col("closed") & F.col("wall_group").isNotNull() & (F.size("points") == 4) & finite & straight)
    edge = lambda i: G.line_record((_at(i)["x"], _at(i)["y"], _at(i + 1)["x"], _at(i + 1)["y"]))
    rows = rows.withColumns({f"_e{i}": edge(i) for i in range(4)}).filter(" AND ".join(f"_e{i} IS NOT NULL" for i in range(4)))
    turn = lambda i: (_at(i + 1)["x"] - _at(i)["x"]) * (_at(i + 2)["y"] - _at(i + 1)["y"]) - (_at(i + 1)["y"] - _at(i)["y"]) * (_at(i + 2)["x"] - _at(i + 1)["x"])
    rows = rows.withColumn("_turns", F.array(*map(turn, range(4)))).filter(F.forall("_turns", lambda t: t > 1e-9) | F.forall("_turns", lambda t: t < -1e-9))
    e = [F.col(f"_e{i}") for i in range(4)]
    parallel = F.greatest(*(G.angle_delta(e[i]["angle"], e[i + 2]["angle"]) for i in (0, 1)))
    dot = lambda a, b: F.least(F.lit(1.0), F.abs(a["ux"] * b["ux"] + a["uy"] * b["uy"]))
    right = F.greatest(*(F.abs(90.0 - F.degrees(F.acos(dot(e[i], e[(i + 1) % 4])))) for i in range(4)))
    ratio = F.least(*(F.least(e[i]["length"], e[i + 2]["length"]) / F.greatest(e[i]["length"], e[i + 2]["length"]) for i in (0, 1)))
    mean = [(e[i]["length"] + e[i + 2]["length"]) / 2 for i in (0, 1)]
    rows = rows.withColumns({"parallel_error": parallel, "right_error": right, "opposite_ratio": ratio, "_first": mean[0] >= mean[1], "length": F.greatest(*mean), "thickness": F.least(*mean)})
    rows = rows.filter((F.col("parallel_error") <= MAX_ERROR) & (F.col("right_error") <= MAX_ERROR) & (F.col("opposite_ratio") >= OPPOSITE) & (F.col("thickness") > 1e-9) & (F.col("length") / F.col("thickness") >= ASPECT))
    middle = lambda i, j, c: (_at(i)[c] + _at(j)[c]) / 2
    ends = {f"{c}{n}": F.when(F.col("_first"), middle(*a, c)).otherwise(middle(*b, c)) for n, a, b in ((1, (0, 3), (0, 1)), (2, (1, 2), (3, 2))) for c in "xy"}
    own, of_layer = F.upper(F.coalesce("linetype", F.lit("BYLAYER"))), F.upper(F.coalesce("layer_linetype", F.lit("")))
    given = lambda t: ~t.isin(*NO_LINETYPE)
    line = F.when(given(own), own).when(given(of_layer), of_layer)
    pattern = F.concat_ws("|", F.upper("layer"), F.coalesce(line, own))
    blockers = F.array_compact(F.array(
        F.when(F.col("length") < min_length, "centerline_below_modeling_min_length"), F.when(~F.col("thickness").between(*THICKNESS), "thickness_outside_80_600mm"),
        F.when(pattern.contains("DASH") | pattern.contains("HIDDEN"), "dash_hidden_pattern_conflict"), F.when(line.isNull(), "linetype_resolution_incomplete")))
    rows = rows.withColumns(ends | {"blockers": blockers}).withColumn("status", F.when(F.size("blockers") > 0, "NEEDS_REVIEW").otherwise("APPROVED_BY_RULE"))
    return rows.drop("_turns", "_first", *(f"_e{i}" for i in range(4)))


def face_edges(strips: DataFrame, key: str) -> DataFrame:
    """(key, edge, role) of a strip's four edges, which general pairing must leave alone: two faces along it and two end caps."""
    length = lambda i: G.hypot(_at(i)["x"] - _at(i + 1)["x"], _at(i)["y"] - _at(i + 1)["y"])
    along = length(0) + length(2) >= length(1) + length(3)
    return strips.select(key, F.explode(F.array(*(F.struct(F.lit(i).alias("edge"), F.when(along == F.lit(i % 2 == 0), "wall_face").otherwise("end_cap").alias("role")) for i in range(4)))).alias("e")).select(key, "e.*")
