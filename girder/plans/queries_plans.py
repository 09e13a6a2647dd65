"""Queries over what drawings enclose and models refer to: rooms, topology with supports, building models in STEP text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators import doors, lineage, planar, runs, short_walls, strips
from girder.operators import rules
from girder.plans import fixtures as X
from girder.plans.registry import query
from girder.plans.staging import stage
from girder.plans.tables import table
from girder.sources import ifc

_SEG = f"WITH RECURSIVE {X.SEGMENT_SQL}"

#: Euler: the bounded faces of a plane graph are edges - nodes + parts, so rooms are counted without walking them.
_FACES = """
meet AS (
  SELECT a.drawing, a.seg_id AS a, b.seg_id AS b, CASE WHEN a.upright = b.upright THEN [greatest(a.lo, b.lo), least(a.hi, b.hi)] END AS along,
         CASE WHEN a.upright = b.upright THEN NULL ELSE b.fixed END AS cut
  FROM net a JOIN net b ON a.drawing = b.drawing AND a.seg_id <> b.seg_id
   AND ((a.upright = b.upright AND a.fixed = b.fixed AND a.lo <= b.hi AND b.lo <= a.hi)
     OR (a.upright <> b.upright AND b.fixed BETWEEN a.lo AND a.hi AND a.fixed BETWEEN b.lo AND b.hi))),
cuts AS (
  SELECT DISTINCT seg_id, spot FROM (
    SELECT seg_id, unnest([lo, hi]) AS spot FROM net UNION ALL SELECT a, cut FROM meet WHERE cut IS NOT NULL UNION ALL SELECT a, unnest(along) FROM meet WHERE along IS NOT NULL)),
line AS (
  SELECT n.drawing, n.upright, n.fixed, c.spot, lead(c.spot) OVER (PARTITION BY c.seg_id ORDER BY c.spot) AS nxt FROM cuts c JOIN net n USING (seg_id)),
e AS (SELECT drawing, count(*) AS n FROM (SELECT DISTINCT drawing, upright, fixed, spot, nxt FROM line WHERE nxt IS NOT NULL) GROUP BY 1),
v AS (SELECT drawing, count(*) AS n FROM (SELECT DISTINCT drawing, CASE WHEN upright = 1 THEN fixed ELSE spot END AS x, CASE WHEN upright = 1 THEN spot ELSE fixed END AS y FROM line) GROUP BY 1),
w AS (SELECT seg_id AS node, seg_id AS label FROM net UNION SELECT meet.b, w.label FROM w JOIN meet ON meet.a = w.node),
p AS (SELECT drawing, count(DISTINCT label) AS n FROM (SELECT node, min(label) AS label FROM w GROUP BY 1) JOIN net ON seg_id = node GROUP BY 1),
faces AS (SELECT drawing, e.n - v.n + p.n AS rooms FROM e JOIN v USING (drawing) JOIN p USING (drawing))"""


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.segments(spark, sf_dir).select("drawing", "seg_id", "upright", "x1", "y1", "x2", "y2", "thickness")


@query(_SEG + ", net AS (SELECT * FROM seg)," + _FACES + " SELECT drawing, rooms FROM faces WHERE rooms > 0")
def room_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planar.rooms(_drawn(spark, sf_dir), ["drawing"]).groupBy("drawing").agg(F.count("*").alias("rooms"))


@query()
def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the rooms of each drawing, largest first; compared with a flood fill in tests."""
    from pyspark.sql import Window

    found = planar.rooms(_drawn(spark, sf_dir), ["drawing"])
    place = Window.partitionBy("drawing").orderBy(F.desc("area"), "face")
    return found.select("drawing", F.row_number().over(place).alias("room"), F.round("area", 6).alias("area"), "edges")


_D = "(CASE WHEN o.upright = 1 THEN sqrt(pow(e.x - o.fixed, 2) + pow(greatest(o.lo - e.y, e.y - o.hi, 0), 2)) ELSE sqrt(pow(e.y - o.fixed, 2) + pow(greatest(o.lo - e.x, e.x - o.hi, 0), 2)) END)"


@query(_SEG + f""", net AS (SELECT *, CASE seg_id % 5 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS side, CASE WHEN seg_id % 5 = 4 THEN 0 ELSE thickness END AS wide FROM seg),{_FACES},
ends AS (SELECT drawing, seg_id, wide, 0 AS k, x1 AS x, y1 AS y FROM net WHERE side = 0 UNION ALL SELECT drawing, seg_id, wide, 1, x2, y2 FROM net WHERE side = 0),
c AS (SELECT drawing, x1 AS cx, y1 AS cy, thickness / 250 AS w FROM seg WHERE seg_id % 7 = 0),
h AS (SELECT e.seg_id, k FROM ends e JOIN net o ON e.drawing = o.drawing AND e.seg_id <> o.seg_id AND {_D} <= least(0.8::DOUBLE, greatest(0.3::DOUBLE, (e.wide + o.wide) / 2000 + 0.05::DOUBLE))
  UNION SELECT e.seg_id, k FROM ends e JOIN c ON e.drawing = c.drawing AND abs(x - cx) <= w / 2 + 0.3::DOUBLE AND abs(y - cy) <= w / 2 + 0.3::DOUBLE),
n AS (SELECT seg_id, count(*) AS n FROM h GROUP BY 1),
t AS (SELECT drawing, count(*) FILTER (side = 0) AS walls, count(*) FILTER (side = 1) AS support_walls, count(*) FILTER (side = 2) AS opening_bridges, coalesce(sum(n), 0)::BIGINT AS connected_ends, count(*) FILTER (n = 2) AS fully_connected FROM net LEFT JOIN n USING (seg_id) GROUP BY 1)
SELECT t.*, coalesce(rooms, 0) AS rooms FROM t LEFT JOIN faces USING (drawing)""")
def topology_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _drawn(spark, sf_dir).withColumnRenamed("seg_id", "wall_id")
    part = F.col("wall_id") % 5
    columns = s.filter("wall_id % 7 = 0").select("drawing", F.col("x1").alias("cx"), F.col("y1").alias("cy"), (F.col("thickness") / 250).alias("w"), (F.col("thickness") / 250).alias("d"))
    out = planar.topology_with_support(s.filter(part < 3), ["drawing"], support=s.filter(part == 3), bridges=s.filter(part == 4).withColumn("thickness", F.lit(0.0)), columns=columns)
    return out.select("drawing", "walls", "support_walls", "opening_bridges", "connected_ends", "fully_connected", "rooms")


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ifc.elements(ifc.instances(X.step_statements(spark, sf_dir)))


@query(f"""WITH {X.STEP_SQL}
SELECT file, global_id, ifc_type, CASE ifc_type WHEN 'IFCWALL' THEN '墙' WHEN 'IFCSLAB' THEN '楼板' WHEN 'IFCCOLUMN' THEN '柱' ELSE '梁' END AS type, name, container, 100.0::DOUBLE + size AS x, 200.0::DOUBLE + place AS y,
       CASE WHEN upper THEN 3600.5::DOUBLE ELSE 0.5::DOUBLE END AS z, CASE WHEN upper THEN 100.0::DOUBLE + size ELSE 100.0::DOUBLE - place END AS origin_x, CASE WHEN upper THEN 200.0::DOUBLE + place ELSE 200.0::DOUBLE + size END AS origin_y,
       fire, load_bearing, mark, width, materials, thickness, level, has_geometry FROM ifc""")
def ifc_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, taken = F.try_element_at("psets", F.lit("Pset_Own")), F.try_element_at("quantities", F.lit("Qto_Base"))
    value = lambda m, n: F.try_element_at(m, F.lit(n))
    return _model(spark, sf_dir).select(
        "file", "global_id", "ifc_type", "type", "name", F.col("container.name").alias("container"), F.col("placement.x").alias("x"), F.col("placement.y").alias("y"), F.col("placement.z").alias("z"),
        F.col("origin.x").alias("origin_x"), F.col("origin.y").alias("origin_y"), value(own, "FireRating").alias("fire"), value(own, "LoadBearing").alias("load_bearing"), value(own, "Mark").alias("mark"), value(taken, "Width").alias("width"),
        F.array_join(F.transform("materials", lambda m: m["name"]), ",").alias("materials"), F.col("geom_thickness").alias("thickness"), F.col("geom_elevation").alias("level"), "has_geometry")


@query(f"""WITH {X.STEP_SQL}
SELECT global_id AS element_id, unnest([x FOR x IN [
  CASE WHEN ifc_type = 'IFCWALL' AND NOT has_geometry AND width IS NULL THEN 'HR-001' END, CASE WHEN ifc_type = 'IFCSLAB' AND NOT has_geometry AND nullif(level, 0) IS NULL THEN 'HR-002' END,
  CASE WHEN ifc_type = 'IFCSLAB' AND NOT has_geometry AND width::DOUBLE < 100 THEN 'HR-005' END, CASE WHEN ifc_type = 'IFCCOLUMN' AND width IS NULL THEN 'HR-006' END, CASE WHEN ifc_type = 'IFCBEAM' AND width IS NULL THEN 'HR-007' END,
  CASE WHEN name = '未命名' THEN 'HR-003' END, CASE WHEN ifc_type <> 'IFCSLAB' AND materials = '' THEN 'HR-004' END] IF x IS NOT NULL]) AS rule_id FROM ifc""")
def ifc_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.check_rules(ifc.baseline(_model(spark, sf_dir))).select("element_id", "rule_id")


@query(f"""WITH {X.STEP_SQL}
SELECT element_id, d.kind AS kind, d.prop AS prop FROM (SELECT global_id AS element_id, unnest([x FOR x IN [
  CASE WHEN name = '未命名' THEN {{'kind': 'name_mismatch', 'prop': ''}} END, CASE WHEN container = 'L2' THEN {{'kind': 'location_mismatch', 'prop': ''}} END, CASE WHEN mark IS NULL THEN {{'kind': 'property_missing', 'prop': 'Mark'}} END,
  CASE WHEN materials = '' THEN {{'kind': 'property_missing', 'prop': 'Material'}} WHEN materials <> 'Steel' THEN {{'kind': 'property_mismatch', 'prop': 'Material'}} END] IF x IS NOT NULL]) AS d FROM ifc)""")
def ifc_model_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.operators import diff

    parts = X.elements(spark, sf_dir).select("ord", "element_id", "ifc_type").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), "p_name", "p_size"), "ord")
    expected = parts.select("element_id", "ifc_type", F.concat("p_name", F.lit("'s")).alias("name"), F.create_map(F.lit("Mark"), F.col("p_size").cast("string"), F.lit("Material"), F.lit("Steel")).alias("properties"), F.lit("L1").alias("location"))
    return diff.model_diff(expected, ifc.baseline(_model(spark, sf_dir)))


@query("WITH p AS (SELECT 'model-' || p_partkey // 100 AS file, ['墙', '楼板', '柱', '梁'][p_partkey % 4 + 1] AS type FROM part UNION ALL SELECT DISTINCT 'model-' || p_partkey // 100, 'IFCSPACE' FROM part) SELECT file, type, count(*) AS n FROM p GROUP BY ALL")
def ifc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst = ifc.instances(X.step_statements(spark, sf_dir))
    return ifc.summary(inst, ifc.elements(inst))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as unresolved source ranges: one in eleven has no complete identity, one in nine stands on another leaf layer."""
    k = F.col("seg_id")
    return X.segments(spark, sf_dir).select(
        F.col("drawing").cast("string").alias("drawing"), F.lit("o").alias("occurrence"), k.alias("unit_id"), F.concat(F.lit("s"), k.cast("string")).alias("source_id"), F.when(k % 9 == 0, "X$0$A-PART").otherwise("A-WALL").alias("layer"), "x1", "y1", "x2", "y2",
        F.lit("NEEDS_REVIEW").alias("status"), F.lit("UNMAPPED_SOURCE_RANGE").alias("unit_type"), F.lit("POSSIBLE_OMISSION").alias("bucket"), F.lit("").alias("reason"), (k % 11 != 0).alias("complete"), F.array().cast("array<string>").alias("limits"), F.array().cast("array<string>").alias("support_ids"), F.lit(None).cast("string").alias("profile_id"))


_SHORT = X.SEGMENT_SQL + """,
u AS (SELECT *, CASE WHEN seg_id % 9 = 0 THEN 'A-PART' ELSE 'A-WALL' END AS leaf FROM seg WHERE seg_id % 11 <> 0),
sp AS (SELECT a.drawing, a.upright, least(a.fixed, b.fixed) AS low, greatest(a.fixed, b.fixed) AS high, a.seg_id AS a, b.seg_id AS b, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi, least(a.lo, b.lo) AS wide_lo, greatest(a.hi, b.hi) AS wide_hi
  FROM u a JOIN u b ON a.drawing = b.drawing AND a.upright = b.upright AND a.seg_id < b.seg_id AND abs(a.fixed - b.fixed) BETWEEN 0.08 AND 0.6 AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.15
   AND (least(a.hi, b.hi) - greatest(a.lo, b.lo)) / least(a.hi - a.lo, b.hi - b.lo) >= 0.6),
sg AS (SELECT drawing, upright, low, high, count(*) AS pairs, (high - low) * 1000 AS thickness_mm, max(wide_hi) - min(wide_lo) AS hull FROM sp GROUP BY ALL),
sm AS (SELECT *, max(hi) OVER (PARTITION BY drawing, upright, low, high ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
sn AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY drawing, upright, low, high ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM sm),
sr AS (SELECT drawing, upright, low, high, run, min(lo) AS lo, max(hi) AS hi FROM sn GROUP BY ALL),
sl AS (SELECT drawing, upright, low, high, count(*) AS runs, sum(hi - lo) AS length FROM sr GROUP BY ALL),
sf AS (SELECT DISTINCT drawing, upright, low, high, f AS seg_id FROM (SELECT *, unnest([a, b]) AS f FROM sp)),
sa AS (SELECT seg_id FROM sf GROUP BY 1 HAVING count(*) > 1),
sx AS (SELECT drawing, upright, low, high, count(DISTINCT leaf) > 1 AS leaf_mismatch, bool_or(seg_id IN (SELECT seg_id FROM sa)) AS ambiguous FROM sf JOIN u USING (drawing, upright, seg_id) GROUP BY ALL)"""


@query(f"WITH {_SHORT} SELECT drawing::VARCHAR AS drawing, pairs, round(thickness_mm, 3) AS thickness_mm, runs, round(length, 6) AS length, round(hull, 6) AS hull, leaf_mismatch, ambiguous FROM sg JOIN sl USING (drawing, upright, low, high) JOIN sx USING (drawing, upright, low, high)")
def short_wall_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _, _ = short_walls.pair_groups(_units(spark, sf_dir))
    return groups.select("drawing", "pairs", F.round("thickness_mm", 3).alias("thickness_mm"), "runs", F.round("length", 6).alias("length"), F.round("hull", 6).alias("hull"), "leaf_mismatch", "ambiguous")


@query(f"""WITH {_SHORT},
w AS (SELECT *, thickness / 1000 AS t FROM seg WHERE seg_id % 2 = 0),
se AS (SELECT sr.*, unnest([0, 1]) AS e, unnest([sr.lo, sr.hi]) AS spot FROM sr),
sh AS (SELECT se.drawing, se.upright, low, high, run, e, count(*) AS n FROM se JOIN w ON w.drawing = se.drawing AND w.upright <> se.upright
   AND sqrt(pow(spot - w.fixed, 2) + pow(greatest(w.lo - low, low - w.hi, 0), 2)) <= t / 2 + 0.005::DOUBLE AND sqrt(pow(spot - w.fixed, 2) + pow(greatest(w.lo - high, high - w.hi, 0), 2)) <= t / 2 + 0.005::DOUBLE
   AND sqrt(pow(spot - w.fixed, 2) + pow(greatest(w.lo - (low + high) / 2, (low + high) / 2 - w.hi, 0), 2)) <= t / 2 + 0.005::DOUBLE GROUP BY ALL),
ss AS (SELECT drawing, upright, low, high, run, e, CASE WHEN n > 1 THEN 'AMBIGUOUS_SUPPORT' WHEN n = 1 THEN 'SINGLE_WALL_JUNCTION' ELSE 'UNSUPPORTED' END AS s FROM se LEFT JOIN sh USING (drawing, upright, low, high, run, e))
SELECT sr.drawing::VARCHAR AS drawing, round(sr.hi - sr.lo, 6) AS length, round((high - low) * 1000, 3) AS thickness_mm, a.s AS start_support, b.s AS end_support, CASE WHEN 'UNSUPPORTED' IN (a.s, b.s) THEN 'INSUFFICIENT_SUPPORT' ELSE 'PROPOSED_SHORT_WALL' END AS status, 'NEEDS_REVIEW' AS approval
FROM sr JOIN ss a USING (drawing, upright, low, high, run) JOIN ss b USING (drawing, upright, low, high, run) WHERE a.e = 0 AND b.e = 1""")
def short_wall_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    walls = X.segments(spark, sf_dir).filter("seg_id % 2 = 0").select(F.col("drawing").cast("string").alias("drawing"), F.lit("o").alias("occurrence"), F.col("seg_id").alias("wall_id"), "x1", "y1", "x2", "y2", (F.col("thickness") / 1000).alias("thickness"), F.lit(False).alias("paired"), F.lit(1).alias("faces"))
    found = short_walls.proposals(_units(spark, sf_dir), walls, walls.select("drawing", "occurrence", "wall_id", "x1", "y1", "x2", "y2"))
    return found.select("drawing", F.round("length", 6).alias("length"), F.round("thickness_mm", 3).alias("thickness_mm"), "start_support", "end_support", "status", "approval")


@query("""
WITH b AS (SELECT p_partkey, p_size * 0.25::DOUBLE AS w, 0.05::DOUBLE * (p_partkey % 13 + 1) AS h, p_partkey % 7 = 0 AS skewed, p_partkey % 5 AS kind FROM part),
c AS (SELECT * FROM b WHERE kind <> 4 AND NOT skewed AND least(w, h) > 0 AND greatest(w, h) / least(w, h) >= 3)
SELECT p_partkey, round(greatest(w, h), 6) AS length, round(least(w, h), 6) AS thickness,
       concat_ws(',', CASE WHEN greatest(w, h) < 0.5 THEN 'centerline_below_modeling_min_length' END, CASE WHEN least(w, h) < 0.08 OR least(w, h) > 0.6 THEN 'thickness_outside_80_600mm' END, CASE WHEN kind = 1 THEN 'dash_hidden_pattern_conflict' END, CASE WHEN kind = 2 THEN 'linetype_resolution_incomplete' END) AS blockers FROM c""")
def closed_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines from parts: their size gives one side, their key the other; one in seven is skewed, one in five is on no wall layer."""
    k = F.col("p_partkey")
    w, h = F.col("p_size") * 0.25, 0.05 * (k % 13 + 1)
    lean = F.when(k % 7 == 0, h).otherwise(F.lit(0.0))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.lit(0.0).alias("bulge"))
    zero = F.lit(0.0)
    rows = table(spark, sf_dir, "part").select(
        k, F.lit("LWPOLYLINE").alias("kind"), F.lit(True).alias("closed"), F.when(k % 5 == 4, "A-DOOR").otherwise("B$0$S-WALL").alias("layer"), F.when(k % 5 == 1, "DASHED").when(k % 5 == 2, "BYLAYER").otherwise("CONTINUOUS").alias("linetype"), F.lit(None).cast("string").alias("layer_linetype"),
        F.array(corner(zero, zero), corner(w, zero), corner(w + lean, h), corner(lean, h)).alias("points"))
    out = strips.closed_strips(rows)
    return out.select("p_partkey", F.round("length", 6).alias("length"), F.round("thickness", 6).alias("thickness"), F.array_join("blockers", ",").alias("blockers"))


@query()
def enclosed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a raster of 0.1 m that the walls of each drawing close off; compared with a flood fill in tests."""
    found = runs.enclosed_regions(_drawn(spark, sf_dir), ["drawing"])
    return found.select("drawing", "cells", "area")


def detection_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes, reference runs and images in cells of an eighth of a metre: odd segments are the reference, a fifth of all are detected, shifted by what their key says."""
    s = X.segments(spark, sf_dir)
    k = F.col("seg_id")
    lines = s.filter(k % 2 == 1).select("drawing", *((F.col(c) * 8).alias(c) for c in ("x1", "y1", "x2", "y2")), F.lit(2.0).alias("width"))
    away = k % 4 * 1.5
    boxes = s.filter(k % 5 == 0).select("drawing", k.alias("box_id"), (F.col("x1") * 8 - 3 + away).alias("x1"), (F.col("y1") * 8 - 3 + away).alias("y1"), (F.col("x2") * 8 + 3.5).alias("x2"), (F.col("y2") * 8 + 3.5).alias("y2"), (k % 10 / 10).alias("confidence"))
    images = s.select("drawing").distinct().select("drawing", F.lit(260).cast("long").alias("width"), F.lit(260).cast("long").alias("height"))
    return boxes, runs.line_runs(lines, ["drawing"]), images


@query()
def detection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compared with masks of pixels in tests."""
    return runs.detection_quality(*detection_input(spark, sf_dir), ["drawing"])


def profile_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """L-shaped profiles beside every twentieth wall, and walls, in mm."""
    s = X.segments(spark, sf_dir)
    mm = lambda c: (F.col(c) * 1000).alias(c)
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    shape = F.array(*(corner(x, y) for x, y in ((0, 0), (600, 0), (600, 200), (200, 200), (200, 600), (0, 600))))
    columns = s.filter("seg_id % 20 = 3").select("drawing", F.col("seg_id").alias("column_id"), (F.col("x1") * 1000 + 400).alias("x"), (F.col("y1") * 1000 - 250).alias("y"), shape.alias("points"))
    return columns, s.select("drawing", mm("x1"), mm("y1"), mm("x2"), mm("y2"), "thickness")


@query()
def profile_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles moved onto walls by at most 1.5 m; compared with trying every shift in tests."""
    return runs.register_profiles(*profile_input(spark, sf_dir), ["drawing"], max_shift=1500.0, group_distance=1500.0)


@query("""
WITH p AS (SELECT p_partkey AS k, p_partkey % 7 AS kind, 0.45::DOUBLE + p_size % 10 * 0.1 AS n, 0.012::DOUBLE * (p_partkey % 9 + 1) AS t FROM part)
SELECT k AS candidate_id, CASE WHEN kind = 1 THEN 'identity_incomplete' WHEN kind = 2 THEN 'invalid_geometry' WHEN n NOT BETWEEN 0.6 AND 1.2 OR t NOT BETWEEN 0.015 AND 0.08 THEN 'out_of_range' WHEN kind = 3 THEN 'missing_arc' WHEN kind = 4 THEN 'ambiguous_arc' WHEN kind = 5 THEN 'held_by_walls' ELSE 'door_leaf' END AS outcome,
       CASE WHEN kind IN (0, 6) AND NOT (n NOT BETWEEN 0.6 AND 1.2 OR t NOT BETWEEN 0.015 AND 0.08) THEN 'a' || k END AS arc_id FROM p""")
def door_leaf_swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf for each part, with a quarter arc about its first corner: none, two, or between two walls by what the key says."""
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", (k % 7).alias("kind"), (0.45 + size % 10 * 0.1).alias("n"), (0.012 * (k % 9 + 1)).alias("t"), (k % 50 * 10.0).alias("ox"), (F.floor(k / 50) * 10.0).alias("oy"), F.lit("d").alias("drawing"), F.lit("o").alias("occurrence"))
    c = F.col
    lean = F.when(c("kind") == 2, 0.05).otherwise(0.0)
    corner = lambda x, y: F.struct((c("ox") + x).alias("x"), (c("oy") + y).alias("y"))
    zero = F.lit(0.0)
    profiles = p.select("drawing", "occurrence", k.alias("candidate_id"), F.lit("NEEDS_REVIEW").alias("status"), (c("kind") != 1).alias("identified"), F.array(corner(zero, zero), corner(c("n"), zero), corner(c("n") + lean, c("t")), corner(lean, c("t"))).alias("points"), c("ox").alias("x1"), (c("oy") + c("t") / 2).alias("y1"), (c("ox") + c("n")).alias("x2"), (c("oy") + c("t") / 2).alias("y2"))
    copies = F.when(c("kind") == 3, F.array().cast("array<string>")).when(c("kind") == 4, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    arcs = p.select("drawing", "occurrence", F.explode(copies).alias("copy"), "*").select("drawing", "occurrence", F.concat("copy", k.cast("string")).alias("arc_id"), c("ox").alias("cx"), c("oy").alias("cy"), c("n").alias("radius"), F.lit(0.0).alias("start_angle"), F.lit(90.0).alias("end_angle"))
    side = lambda x: F.struct(x.alias("x1"), (c("oy") - 1).alias("y1"), x.alias("x2"), (c("oy") + 1).alias("y2"))
    walls = p.filter("kind IN (5, 6)").select("drawing", F.explode(F.when(c("kind") == 5, F.array(side(c("ox") - 0.1), side(c("ox") + c("n") + 0.1))).otherwise(F.array(side(c("ox") - 0.1)))).alias("w")).select("drawing", "w.*", F.lit(None).cast("long").alias("candidate_id"))
    return doors.swings(profiles, arcs, walls).select("candidate_id", "outcome", "arc_id")


@query("""
WITH r AS (SELECT DISTINCT p_partkey % 23 AS run_id FROM part)
SELECT run_id, CASE WHEN run_id % 11 = 0 THEN 'verified' ELSE 'broken' END AS status,
       ['project_mismatch', 'entities_not_of_manifest', 'evidence_not_of_entities', 'model_not_of_evidence', 'duplicate_source', 'unknown_source', 'duplicate_entity', 'duplicate_evidence', 'unknown_entity', 'unknown_evidence'][nullif(run_id % 11, 0)] AS first_issue FROM r""")
def model_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of parts, sealed after all but three kinds of harm: by what the run's number says, one link of each is broken."""
    k, run = F.col("p_partkey"), F.col("run_id")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", (k % 23).alias("run_id"))
    bad = lambda n: run % 11 == n
    first = p.groupBy("run_id").agg(F.min("p_partkey").alias("p_partkey"))
    is_first = p.join(first.withColumn("first", F.lit(True)), ["run_id", "p_partkey"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    is_first = stage(is_first, "lineage-parts")
    twice = lambda df, n: df.unionByName(df.filter(F.col("first") & bad(n)))
    source = F.concat(F.lit("s"), (k % 2).cast("string"))
    entity = (source.alias("source_id"), k.cast("string").alias("entity_id"), F.concat(F.lit("/e:"), k.cast("string")).alias("locator"))
    sources = first.select("run_id", F.explode(F.array(F.lit("s0"), F.lit("s1"))).alias("source_id"))
    manifest = sources.unionByName(sources.filter(bad(5) & (F.col("source_id") == "s0"))).withColumn("note", F.lit("as sealed"))
    entities = twice(is_first, 7).select("run_id", F.when(F.col("first") & bad(6), "s9").otherwise(source).alias("source_id"), *entity[1:], "p_name")
    of = F.struct(F.when(F.col("first") & bad(6), "s9").otherwise(source).alias("source_id"), F.when(F.col("first") & bad(9), "none").otherwise(k.cast("string")).alias("entity_id"), entity[2])
    evidence = twice(is_first, 8).select("run_id", F.concat(F.lit("v"), k.cast("string")).alias("evidence_id"), F.array(of).alias("refs"), F.lit("as sealed").alias("note"))
    model = is_first.select("run_id", F.concat(F.lit("w"), k.cast("string")).alias("wall_id"), F.array(F.concat(F.lit("v"), k.cast("string")), F.when(F.col("first") & bad(10), "v-none").otherwise(F.concat(F.lit("v"), k.cast("string")))).alias("evidence_ids"))
    contents = {"manifest": manifest, "entities": entities, "evidence": evidence, "model": model}
    artifacts = lineage.sealed(first.select("run_id", F.lit("t").alias("tenant_id"), F.lit("p").alias("project_id")), contents)
    late = F.lit(" changed later")
    contents["manifest"] = manifest.withColumn("note", F.when(bad(2), late).otherwise(F.col("note")))
    contents["entities"] = entities.withColumn("p_name", F.when(bad(3), F.concat("p_name", late)).otherwise(F.col("p_name")))
    contents["evidence"] = evidence.withColumn("note", F.when(bad(4), late).otherwise(F.col("note")))
    artifacts = artifacts.withColumn("project_id", F.when(bad(1) & (F.col("kind") == "evidence"), "q").otherwise(F.col("project_id")))
    return lineage.verdicts(artifacts, contents).select("run_id", "status", "first_issue")
