"""Structure and architecture drawings of one floor fused where a single transform, fixed by both, proves every match.

The coordinate contracts of the two drawings give one affine map; it is never
fitted to what it should prove.  Axes, columns and wall views are then matched in
cells as wide as the tolerance allows, and a floor with any ambiguity is refused
whole, with the reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.operators import spatial
from girder.plans import staging
from girder.plans.tables import dealt

# Metres within which columns, wall ends, sizes and axes are the same, millimetres of thickness, and the slack of a map that does not turn.
ALIGNMENT, SIZE, AXIS, THICKNESS, TURN = 0.001, 0.001, 0.001, 1.0, 1e-8
#: Side of a cell in metres.
CELL = 1.0


#: Bytes, as staged, of the rows that a task looks up: staged rows repeat and are some twenty times as large in memory.
SHARE = 512 << 10


def stage(df: DataFrame, name: str) -> DataFrame:
    """Staged and joined by sorting: its small files would pass for small tables, and be gathered on the driver."""
    return staging.stage(df, name).hint("merge")


def moved(x: Column, y: Column, source: str = "structure", target: str = "architecture") -> tuple[Column, Column]:
    """A point of one drawing in metres of the other.

    Both contracts are structs of origin_x, origin_y, centre_x, centre_y (mm) and rotation (degrees): a drawing is turned
    about the centre of its grid, then its origin is taken off.
    """
    part = lambda side, n: F.col(f"{side}.{n}")

    def turned(px: Column, py: Column, side: str, sign: int) -> tuple[Column, Column]:
        angle = F.radians(part(side, "rotation")) * sign
        cx, cy = part(side, "centre_x"), part(side, "centre_y")
        return (px - cx) * F.cos(angle) - (py - cy) * F.sin(angle) + cx, (px - cx) * F.sin(angle) + (py - cy) * F.cos(angle) + cy

    world = turned(x * 1000 + part(source, "origin_x"), y * 1000 + part(source, "origin_y"), source, -1)
    there = turned(*world, target, 1)
    return (there[0] - part(target, "origin_x")) / 1000, (there[1] - part(target, "origin_y")) / 1000


def _sides(rows: DataFrame, contracts: DataFrame, keys: list[str], points: tuple[tuple[str, str], ...]) -> tuple[DataFrame, DataFrame]:
    """Architecture as a_*, and structure as s_* with its points moved."""
    there = rows.filter("side = 'structure'").join(contracts, keys)
    for x, y in points:
        to = moved(F.col(x), F.col(y))
        there = there.withColumns({f"_{x}": to[0], f"_{y}": to[1]})
    names = {n: f"_{n}" for p in points for n in p}
    plain = [c for c in rows.columns if c not in keys and c != "side"]
    s = there.select(*keys, *(F.col(names.get(c, c)).alias(f"s_{c}") for c in plain))
    a = rows.filter("side = 'architecture'").select(*keys, *(F.col(c).alias(f"a_{c}") for c in plain))
    return stage(a, "architecture"), stage(s, "structure-moved")


def _close(a: DataFrame, s: DataFrame, keys: list[str], at: tuple[Column, Column, Column, Column], within: float) -> DataFrame:
    return spatial.grid_join(a, s, keys, spatial.point_box(at[0], at[1], within * 2), spatial.point_box(at[2], at[3]), CELL)


def _unmatched(rows: DataFrame, pairs: DataFrame, keys: list[str], key: str, issue: str) -> DataFrame:
    """Floors where a row has no match or several."""
    rows = dealt(rows.select(*keys, key), *keys, key, share=SHARE)
    counted = pairs.groupBy(*keys, key).agg(F.count("*").alias("_n")).hint("merge")
    return rows.join(counted, [*keys, key], "left").filter(F.coalesce("_n", F.lit(0)) != 1).select(*keys, F.lit(issue).alias("issue")).distinct()


def _columns(columns: DataFrame, contracts: DataFrame, keys: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    c = F.col
    a, s = _sides(columns, contracts, keys, (("x", "y"),))
    away = F.sqrt((c("a_x") - c("s_x")) ** 2 + (c("a_y") - c("s_y")) ** 2)
    pairs = _close(a, s, keys, (c("a_x"), c("a_y"), c("s_x"), c("s_y")), ALIGNMENT).withColumn("residual", away)
    pairs = stage(pairs.filter((c("residual") <= ALIGNMENT) & (F.greatest(F.abs(c("a_w") - c("s_w")), F.abs(c("a_h") - c("s_h"))) <= SIZE)), "column-pairs")
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    counts = contracts.select(*keys).join(n(a, "n_a"), keys, "left").join(n(s, "n_s"), keys, "left").na.fill(0, ["n_a", "n_s"])
    bad = counts.filter((c("n_a") == 0) | (c("n_a") != c("n_s"))).select(*keys, F.lit("column_counts_differ").alias("issue"))
    return pairs, [bad, _unmatched(a, pairs, keys, "a_id", "column_not_one_to_one"), _unmatched(s, pairs, keys, "s_id", "column_not_one_to_one")]


def _axes(axes: DataFrame, contracts: DataFrame, keys: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """Axes by direction: along x they are moved as (coord, 0), along y as (0, coord), which holds only without a turn."""
    c, zero = F.col, F.lit(0.0)
    points = axes.withColumns({"x": F.when(c("direction") == "x", c("coord")).otherwise(zero), "y": F.when(c("direction") == "y", c("coord")).otherwise(zero)})
    a, s = _sides(points.drop("coord"), contracts, keys, (("x", "y"),))
    coord = lambda p: F.when(c(f"{p}_direction") == "x", c(f"{p}_x")).otherwise(c(f"{p}_y"))
    a, s = (df.select(*keys, c(f"{p}_direction").alias("direction"), f"{p}_id", coord(p).alias(f"{p}_at")) for df, p in ((a, "a"), (s, "s")))
    origin, unit = moved(zero, zero), moved(F.lit(1.0), zero)
    turn = contracts.filter((F.abs(unit[0] - origin[0] - 1) > TURN) | (F.abs(unit[1] - origin[1]) > TURN)).select(*keys, F.lit("rotation_differs").alias("issue"))
    order = Window.partitionBy(*keys, "direction").orderBy("s_at")
    twice = s.withColumn("_gap", c("s_at") - F.lag("s_at").over(order)).filter(c("_gap") <= AXIS).select(*keys, F.lit("duplicate_axes").alias("issue")).distinct()
    near = spatial.grid_join(a, s, [*keys, "direction"], spatial.point_box(c("a_at"), zero, AXIS * 2), spatial.point_box(c("s_at"), zero), CELL)
    pairs = stage(near.withColumn("residual", F.abs(c("a_at") - c("s_at"))).filter(c("residual") <= AXIS), "axis-pairs")
    axes_out = s.join(pairs.select(*keys, "s_id", "a_id", "residual"), [*keys, "s_id"], "left")
    # On a turned map axes have no place on a line: nothing else is said of them.
    straight = lambda df: df.join(turn.select(*keys), keys, "left_anti")
    return axes_out, [turn, straight(twice), straight(_unmatched(a, pairs, keys, "a_id", "axes_not_of_structure"))]


def _walls(walls: DataFrame, contracts: DataFrame, keys: list[str]) -> DataFrame:
    """Wall views of both sides: those that are each other's only match corroborate each other, whichever way they run."""
    c = F.col
    a, s = _sides(walls, contracts, keys, (("x1", "y1"), ("x2", "y2")))
    far = lambda i, j: F.sqrt((c(f"a_x{i}") - c(f"s_x{j}")) ** 2 + (c(f"a_y{i}") - c(f"s_y{j}")) ** 2)
    away = F.least(F.greatest(far(1, 1), far(2, 2)), F.greatest(far(1, 2), far(2, 1)))
    middle = lambda p, n: (c(f"{p}_{n}1") + c(f"{p}_{n}2")) / 2
    pairs = _close(a, s, keys, (middle("a", "x"), middle("a", "y"), middle("s", "x"), middle("s", "y")), ALIGNMENT)
    pairs = pairs.withColumn("residual", away).filter((c("residual") <= ALIGNMENT) & (F.abs(c("a_thickness") - c("s_thickness")) <= THICKNESS))
    pairs = pairs.withColumns({"_na": F.count("*").over(Window.partitionBy(*keys, "a_id")), "_ns": F.count("*").over(Window.partitionBy(*keys, "s_id"))})
    only = stage(pairs.filter("_na = 1 AND _ns = 1").select(*keys, "a_id", "s_id", "residual"), "wall-pairs")
    one = s.select(*keys, "s_id").join(only, [*keys, "s_id"], "left").select(*keys, "s_id", "a_id", "residual")
    other = a.select(*keys, "a_id").join(only, [*keys, "a_id"], "left_anti")
    return one.unionByName(other, allowMissingColumns=True)


def fuse_floors(contracts: DataFrame, axes: DataFrame, columns: DataFrame, walls: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(verdicts, elements) of floors.  verdicts: keys, status (fused or refused), issues.  elements of fused floors: keys,
    kind (axis_x, axis_y, column, wall), structure_id, architecture_id, status, residual.

    contracts: keys, structure, architecture (see ``moved``); axes: keys, side, direction (x or y), id, coord; columns: keys,
    side, id, x, y, w, h; walls: keys, side, id, x1, y1, x2, y2, thickness (mm).  Every column must have exactly one of the
    other side, every architecture axis exactly one of the structure, and drawings may not be turned.  Walls may stay alone.
    """
    contracts = contracts.hint("merge")
    pairs, column_issues = _columns(columns, contracts, keys)
    lines, axis_issues = _axes(axes, contracts, keys)
    issues = None
    for found in column_issues + axis_issues:
        issues = found if issues is None else issues.unionByName(found)
    named = issues.groupBy(*keys).agg(F.sort_array(F.collect_set("issue")).alias("issues"))
    verdicts = stage(contracts.select(*keys).join(named, keys, "left").select(*keys, F.when(F.col("issues").isNull(), "fused").otherwise("refused").alias("status"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues")), "floor-verdicts")
    row = lambda df, kind, status: df.select(*keys, kind.alias("kind"), F.col("s_id").alias("structure_id"), F.col("a_id").alias("architecture_id"), status.alias("status"), "residual")
    seen = F.when(F.col("a_id").isNull(), "UNMATCHED_STRUCTURE_VIEW").when(F.col("s_id").isNull(), "UNMATCHED_ARCHITECTURE_VIEW").otherwise("CORROBORATED")
    elements = row(lines, F.concat(F.lit("axis_"), F.col("direction")), F.when(F.col("a_id").isNull(), "STRUCTURE_ONLY").otherwise("EXACT"))
    elements = elements.unionByName(row(pairs, F.lit("column"), F.lit("EXACT"))).unionByName(row(_walls(walls, contracts, keys), F.lit("wall"), seen))
    return verdicts, elements.join(verdicts.filter("status = 'fused'").select(*keys), keys, "left_semi")
