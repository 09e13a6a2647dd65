"""Queries over plane values, building models and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import geometry as G
from girder.operators import diff, model, spatial, stats
from girder.plans import fixtures as X
from girder.plans.registry import query
from girder.plans.tables import table

_SEG = f"WITH {X.SEGMENT_SQL}\n"
_POINTS = ("x1", "y1", "x2", "y2")


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


@query(_SEG + """SELECT seg_id, 2 * x1 + 1 AS ax, 2 * y1 AS ay, 30 - x1 / 2 AS tx, 40 - y1 / 2 AS ty, fixed AS cross_x, fixed AS cross_y, (hi - lo) * 4 AS area,
       greatest(0, least(hi, 15) - greatest(lo, 5)) * greatest(0, least(fixed + 4, 15) - greatest(fixed, 5)) AS clipped,
       round(greatest(0, least(hi, 15) - greatest(lo, 5)) * greatest(0, least(fixed + 4, 15) - greatest(fixed, 5)) / ((hi - lo) * 4 + 100 - greatest(0, least(hi, 15) - greatest(lo, 5)) * greatest(0, least(fixed + 4, 15) - greatest(fixed, 5))), 9) AS iou,
       CASE WHEN fixed BETWEEN 5 AND 15 AND least(hi, 15) - greatest(lo, 5) > 1e-9 THEN greatest(lo, 5) END AS cut_lo, CASE WHEN fixed BETWEEN 5 AND 15 AND least(hi, 15) - greatest(lo, 5) > 1e-9 THEN least(hi, 15) END AS cut_hi,
       round(CASE WHEN fixed < 10 THEN fixed * 10 ELSE 100 + (fixed - 10) * 5 END, 9) AS mapped, round(greatest(0.7, 1 - 0.3 * fixed / 5), 9) AS confidence, lo + (hi - lo) / 2 AS centre
FROM seg""")
def plane_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, lo, hi, fixed = G.segment(), F.col("lo"), F.col("hi"), F.col("fixed")
    a, b, tx, c, d, ty = G.affine_between((1.0, 2.0, 0.5, 0.0), (3.0, 4.0, 0.25, 0.0))
    moved = G.transform_point((F.col("x1"), F.col("y1")), (0.0, 0.0), 0.5, 180.0, (F.lit(30.0), F.lit(40.0)))
    cross = G.intersection(s, (F.lit(0.0), F.lit(0.0), F.lit(8.0), F.lit(8.0)))
    box = F.array(_xy(lo, fixed), _xy(hi, fixed), _xy(hi, fixed + 4), _xy(lo, fixed + 4))
    clipped = G.polygon_area(G.clip_polygon(box, F.lit(5.0), F.lit(15.0), F.lit(5.0), F.lit(15.0)))
    cut = G.clip_axis_line((lo, fixed, hi, fixed), (5.0, 5.0, 15.0, 15.0))
    controls = F.array(*(F.struct(F.lit(x).alias("at"), F.lit(y).alias("to")) for x, y in ((0.0, 0.0), (10.0, 100.0), (20.0, 150.0))))
    return X.segments(spark, sf_dir).select(
        "seg_id", (a * F.col("x1") + b * F.col("y1") + tx).alias("ax"), (c * F.col("x1") + d * F.col("y1") + ty).alias("ay"), moved[0].alias("tx"), moved[1].alias("ty"),
        F.round(cross["x"], 9).alias("cross_x"), F.round(cross["y"], 9).alias("cross_y"), G.polygon_area(box).alias("area"), clipped.alias("clipped"), F.round(G.box_iou((lo, fixed, hi, fixed + 4), tuple(map(F.lit, (5.0, 5.0, 15.0, 15.0)))), 9).alias("iou"),
        cut["x1"].alias("cut_lo"), cut["x2"].alias("cut_hi"), F.round(G.piecewise(fixed, controls), 9).alias("mapped"), F.round(G.distance_confidence(fixed, 5.0), 9).alias("confidence"), G.vertex_mean(box)["x"].alias("centre"))


@query(_SEG + """, t AS (SELECT seg_id, lo, hi, fixed, (seg_id % 3 * 3)::DOUBLE / 64 AS tilt FROM seg),
o AS (SELECT *, degrees(atan2(tilt, hi - lo)) <= 2 AS flat FROM t)
SELECT seg_id, flat AS snapped, CASE WHEN flat THEN fixed + tilt / 2 ELSE fixed END AS y1, CASE WHEN flat THEN fixed + tilt / 2 ELSE fixed + tilt END AS y2 FROM o WHERE sqrt((hi - lo) ^ 2 + CASE WHEN flat THEN 0 ELSE tilt ^ 2 END) >= 1.5""")
def orthogonal_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tilt = F.col("seg_id") % 3 * 3 / 64
    rows = X.segments(spark, sf_dir).select("seg_id", G.orthogonalize((F.col("lo"), F.col("fixed"), F.col("hi"), F.col("fixed") + tilt), 2.0, 1.5).alias("o"))
    return rows.filter(F.col("o").isNotNull()).select("seg_id", "o.snapped", "o.y1", "o.y2")


@query(_SEG + "SELECT drawing, thickness, min(least(x1, x2)) AS xmin, min(least(y1, y2)) AS ymin, max(greatest(x1, x2)) AS xmax, max(greatest(y1, y2)) AS ymax, min(seg_id) AS first FROM seg GROUP BY ALL")
def drawing_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir)
    first = spatial.duplicate_lines(rows.withColumns({c: F.lit(0.0) for c in _POINTS}).withColumn("ord", F.col("seg_id")), ["drawing", "thickness"]).select("drawing", "thickness", F.col("seg_id").alias("first"))
    return stats.bounds(rows, ["drawing", "thickness"]).join(first, ["drawing", "thickness"])


@query(_SEG + """SELECT drawing, upright, round(least(x1, x2), 0) AS ax, round(least(y1, y2), 0) AS ay, round(greatest(x1, x2), 0) AS bx, round(greatest(y1, y2), 0) AS b_y, min(seg_id) AS kept FROM
(SELECT drawing, upright, seg_id, floor(x1 / 2) AS x1, floor(y1 / 2) AS y1, floor(x2 / 2) AS x2, floor(y2 / 2) AS y2 FROM seg) GROUP BY ALL""")
def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines drawn both ways round are one."""
    rows = X.segments(spark, sf_dir).select("drawing", "upright", F.col("seg_id").alias("ord"), *(F.floor(F.col(c) / 2).cast("double").alias(c) for c in _POINTS))
    turned = F.col("ord") % 2 == 0
    rows = rows.select("drawing", "upright", "ord", *(F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))))
    kept = spatial.duplicate_lines(rows, ["drawing", "upright"])
    return kept.select("drawing", "upright", F.least("x1", "x2").alias("ax"), F.least("y1", "y2").alias("ay"), F.greatest("x1", "x2").alias("bx"), F.greatest("y1", "y2").alias("b_y"), F.col("ord").alias("kept"))


@query(_SEG + """, r AS (SELECT seg_id, ['S-WALL', 'a-dim', 'A-WALL', 'Temp_Wall'][seg_id % 4 + 1] AS layer, ['x', 'Axis'][seg_id // 4 % 2 + 1] AS other FROM seg)
SELECT layer, other, count(*) FILTER (NOT contains(lower(layer), 'dim') AND NOT contains(lower(other), 'axis')) AS kept, count(*) FILTER (contains(lower(layer), 'dim')) AS dims, count(*) FILTER (contains(lower(other), 'axis')) AS axes FROM r GROUP BY ALL""")
def layer_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("seg_id")
    rows = X.segments(spark, sf_dir).select("seg_id", F.get(F.array(*map(F.lit, ("S-WALL", "a-dim", "A-WALL", "Temp_Wall"))), (k % 4).cast("int")).alias("layer"), F.get(F.array(F.lit("x"), F.lit("Axis")), (F.floor(k / 4) % 2).cast("int")).alias("other"))
    kept, report = model.exclude_layers(rows, ["DIM", "axis"], F.array("layer", "other"))
    n = kept.groupBy("layer", "other").agg(F.count("*").alias("kept"))
    every = rows.select("layer", "other").distinct()
    per = rows.groupBy("layer", "other").agg(F.count("*").alias("n"))
    hit = report.groupBy("layer").agg(F.max(F.when(F.col("pattern") == "DIM", F.col("n"))).alias("dims"), F.max(F.when(F.col("pattern") == "axis", F.col("n"))).alias("axes"))
    out = every.join(n, ["layer", "other"], "left").join(per, ["layer", "other"]).join(hit, "layer", "left")
    mine = lambda c, test: F.when(test & F.col(c).isNotNull(), F.col("n")).otherwise(0)
    return out.select("layer", "other", F.coalesce("kept", F.lit(0)).alias("kept"), mine("dims", F.contains(F.lower("layer"), F.lit("dim"))).alias("dims"), mine("axes", F.col("other") == "Axis").alias("axes"))


@query(_SEG + """, f AS (SELECT seg_id, hi - lo AS n, fixed, lo, hi, seg_id % 6 AS corners FROM seg)
SELECT seg_id, n >= 4 AND fixed <= 12 AND lo <= 12 AND hi <= 12 AS is_beam, corners >= 4 AND n * 2 >= 6 AS is_slab, CASE WHEN corners >= 4 AND n * 2 >= 6 THEN n * 2 END AS area FROM f""")
def beams_and_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir)
    beams = model.beam_lines(rows, ["drawing"], 4.0, 12.0).select("seg_id", F.lit(True).alias("is_beam"))
    lo, hi, fixed = F.col("lo"), F.col("hi"), F.col("fixed")
    box = F.slice(F.array(_xy(lo, fixed), _xy(hi, fixed), _xy(hi, fixed + 2), _xy(lo, fixed + 2), _xy(lo, fixed + 1)), 1, (F.col("seg_id") % 6).cast("int"))
    slabs = model.slab_outlines(rows.select("seg_id", box.alias("points")), smallest=6.0).select("seg_id", F.lit(True).alias("is_slab"), "area")
    return rows.select("seg_id").join(beams, "seg_id", "left").join(slabs, "seg_id", "left").select("seg_id", F.coalesce("is_beam", F.lit(False)).alias("is_beam"), F.coalesce("is_slab", F.lit(False)).alias("is_slab"), "area")


@query(f"""WITH {X.ELEMENT_SQL},
e AS (SELECT *, 'e' || (ord % 150) AS id, CASE WHEN ifc_type = 'IFCWALL' THEN 0 ELSE 1 END AS kind FROM element WHERE ifc_type IN ('IFCWALL', 'IFCBEAM')),
v AS (SELECT kind, id, 0 AS rule_ord, 'named' AS rule FROM e WHERE kind = 0 AND name = '' UNION ALL SELECT kind, id, 1, 'thickness' FROM e WHERE kind = 0 AND thickness IS NULL UNION ALL SELECT kind, id, 0, 'material' FROM e WHERE kind = 1 AND material IS NULL),
d AS (SELECT kind, id, 999 AS rule_ord, 'duplicate_id' AS rule FROM (SELECT kind, id, row_number() OVER (PARTITION BY id ORDER BY kind) AS n FROM e) WHERE n > 1)
SELECT kind AS kind_ord, id, rule_ord, rule, count(*) AS n FROM (SELECT * FROM v UNION ALL SELECT * FROM d) GROUP BY ALL""")
def model_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.elements(spark, sf_dir).withColumn("id", F.concat(F.lit("e"), (F.col("ord") % 150).cast("string")))
    walls, beams = rows.filter("ifc_type = 'IFCWALL'"), rows.filter("ifc_type = 'IFCBEAM'")
    prop = lambda k: F.try_element_at("properties", F.lit(k))
    out = model.standard_violations({"wall": (walls, {"named": F.col("name") == "", "thickness": prop("Thickness").isNull()}), "beam": (beams, {"material": prop("Material").isNull()})}, "id")
    return out.groupBy("kind_ord", "id", "rule_ord", "rule").agg(F.count("*").alias("n"))


@query(f"""WITH {X.ELEMENT_SQL} SELECT element_id, concat_ws(',', CASE WHEN name = '' THEN 'name' END, CASE WHEN thickness IS NULL OR thickness::INT <= 100 THEN 'thickness' END, CASE WHEN NOT has_geometry THEN 'geometry' END) AS issues FROM element""")
def payload_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    thick = F.try_element_at("properties", F.lit("Thickness")).cast("int") > 100
    out = model.payload_issues(X.elements(spark, sf_dir), {"name": F.col("name") != "", "thickness": thick, "geometry": F.col("has_geometry")})
    return out.select("element_id", F.array_join("issues", ",").alias("issues"))


@query("""WITH r AS (SELECT l_orderkey AS wall, l_linenumber AS n, l_partkey % 5 = 0 AS lost, l_suppkey % 7 <> 0 AS mine, l_partkey * 100000 + l_suppkey AS o FROM lineitem),
g AS (SELECT wall, count(*) AS n, bool_or(lost) AS lost, bool_and(mine) AS mine FROM r GROUP BY ALL)
SELECT o_orderkey AS wall, coalesce(n, 0) > 0 AS present, NOT coalesce(lost, false) AS complete, coalesce(mine, true) AS same_drawing, o_orderkey % 2 = 0 OR coalesce(n, 0) = 0 AS same_occurrence, coalesce(n, 0) > 0 AND o_orderkey % 3 > 0 AS declared
FROM orders LEFT JOIN g ON wall = o_orderkey""")
def wall_traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    ref = F.struct(F.when(F.col("l_partkey") % 5 != 0, F.col("l_linenumber")).alias("id"), F.when(F.col("l_suppkey") % 7 == 0, "other").otherwise("d1").alias("drawing"), F.lit("o0").alias("occurrence"))
    refs = l.groupBy(F.col("l_orderkey").alias("wall")).agg(F.array_sort(F.collect_list(ref)).alias("refs"))
    walls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("wall")).join(refs, "wall", "left").withColumn("refs", F.coalesce("refs", F.array().cast(dict(refs.dtypes)["refs"])))
    walls = walls.withColumn("ref_ids", F.when(F.col("wall") % 3 > 0, F.when(F.size("refs") > 0, F.transform("refs", lambda r: r["id"]))).otherwise(F.array(F.lit(-1).cast(dict(l.dtypes)["l_linenumber"]))))
    return model.traceability(walls, ["wall"], F.lit("d1"), F.when(F.col("wall") % 2 == 0, "o0").otherwise("o1"))


@query("""SELECT o_orderkey AS wall, CASE WHEN n IS NULL THEN 'NO_SEGMENTS' WHEN n <> 4 THEN 'NOT_FOUR_SEGMENTS' END AS limitation FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber <> 1 GROUP BY ALL) ON l_orderkey = o_orderkey""")
def column_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "lineitem").filter("l_linenumber <> 1").select(F.col("l_orderkey").alias("wall"), F.col("l_partkey").alias("segment_id"))
    return model.provenance(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("wall")), segments, ["wall"]).select("wall", "limitation")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'wall' WHEN o_orderkey % 3 = 0 THEN 'column' WHEN o_orderkey % 5 = 0 THEN 'grid' ELSE 'unresolved' END AS support FROM orders""")
def end_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return model.classify_ends(k, [(name, k.filter(F.col("k") % n == 0)) for name, n in (("wall", 2), ("column", 3), ("grid", 5))], ["k"])


@query(_SEG + """SELECT seg_id AS wall_id, CASE WHEN seg_id % 3 > 0 THEN 'none' WHEN seg_id % 2 = 0 THEN 'applied' ELSE 'stale' END AS replay, CASE WHEN seg_id % 6 = 0 THEN x1 + 1 ELSE x1 END AS x1, CASE WHEN seg_id % 6 = 0 THEN y2 - 1 ELSE y2 END AS y2 FROM seg""")
def approved_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("wall_id")
    base = X.segments(spark, sf_dir).select(F.col("seg_id").alias("wall_id"), *_POINTS, F.sha2(F.col("seg_id").cast("string"), 256).alias("hash"))
    change = base.filter(k % 3 == 0).select("wall_id", F.when(k % 2 == 0, F.col("hash")).otherwise("old").alias("base_hash"), (F.col("x1") + 1).alias("x1"), "y1", "x2", (F.col("y2") - 1).alias("y2"))
    return model.apply_if_unchanged(base, change).select("wall_id", "replay", "x1", "y2")


@query("""WITH p AS (SELECT l_orderkey AS a, l_suppkey AS b FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 = 0), u AS (SELECT a, b FROM p QUALIFY count(*) OVER (PARTITION BY a) = 1 AND count(*) OVER (PARTITION BY b) = 1)
SELECT o_orderkey AS a, u.b, CASE WHEN u.b IS NULL THEN 'structure' ELSE 'both' END AS origin FROM orders LEFT JOIN u ON u.a = o_orderkey UNION ALL SELECT NULL, s_suppkey, 'architecture' FROM supplier WHERE s_suppkey NOT IN (SELECT b FROM u)""")
def fused_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 AND l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"))
    return model.fuse_floor(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b")), pairs, "a", "b").select("a", "b", "origin")


@query("""WITH o AS (SELECT o_custkey AS run_id, o_orderkey AS stage, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT run_id, stage, CASE WHEN before IS NULL THEN stage % 5 <> 0 ELSE stage % 5 <> 0 END AS linked FROM o""")
def run_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("stage"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    before = F.lag("sha256").over(Window.partitionBy("run_id").orderBy("stage"))
    rows = rows.withColumn("parent_sha256", F.when(F.col("stage") % 5 == 0, "lost").otherwise(before))
    return model.verify_lineage(rows).select("run_id", "stage", "linked")


@query("""SELECT floor || '_wall_' || row_number() OVER (PARTITION BY floor ORDER BY ord) AS id, ord FROM (SELECT CASE WHEN p_size % 3 = 0 THEN '1F' ELSE '2F' END AS floor, p_partkey AS ord FROM part WHERE p_size % 3 < 2)""")
def floor_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), "p_size")
    of = lambda test: rows.filter(test).select("ord")
    return model.union_floors({"1F": of("p_size % 3 = 0"), "2F": of("p_size % 3 = 1"), "3F": of("p_size < 0")}, "wall").select("id", "ord")


@query("""WITH s AS (SELECT DISTINCT o_custkey % 9 AS k, o_orderkey * 7 % 41 AS x, o_orderkey * 11 % 37 AS y FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 9 < 8), t AS (SELECT DISTINCT o_custkey % 9 AS k, o_orderkey * 7 % 41 AS x, o_orderkey * 11 % 37 AS y FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 9 > 0),
a AS (SELECT k, count(*) AS a, count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE t.k = s.k AND abs(t.x - s.x) <= 1 AND abs(t.y - s.y) <= 1)) AS ma FROM s GROUP BY ALL),
b AS (SELECT k, count(*) AS b, count(*) FILTER (EXISTS (SELECT 1 FROM s WHERE t.k = s.k AND abs(t.x - s.x) <= 1 AND abs(t.y - s.y) <= 1)) AS mb FROM t GROUP BY ALL),
j AS (SELECT k, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(ma, 0) AS ma, coalesce(mb, 0) AS mb FROM a FULL JOIN b USING (k))
SELECT k, round(CASE WHEN a > 0 AND b > 0 THEN ma / a ELSE 0 END, 9) AS recall, round(CASE WHEN a > 0 AND b > 0 THEN mb / b ELSE 0 END, 9) AS precision, round(CASE WHEN a > 0 AND b > 0 THEN least(ma / a, mb / b) ELSE 0 END, 9) AS edge_iou,
       round(CASE WHEN a > 0 AND b > 0 THEN ((ma + mb) / 2) / (a + b - (ma + mb) / 2) ELSE 0 END, 9) AS raw_iou FROM j""")
def pixel_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 9).alias("k"), (k * 7 % 41).alias("x"), (k * 11 % 37).alias("y"), k.alias("o"))
    out = model.pixel_iou(rows.filter("o % 2 = 0 AND k < 8"), rows.filter("o % 3 = 0 AND k > 0"), ["k"], 1)
    return out.select("k", *(F.round(c, 9).alias(c) for c in ("recall", "precision", "edge_iou", "raw_iou")))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 4 AS axes, o_custkey % 3 AS labels, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 END AS flips, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 11)::DOUBLE / 10 END AS rate, o_custkey % 2 AS outliers FROM orders)
SELECT k, concat_ws(',', CASE WHEN axes <> 0 AND labels <> 0 AND axes > labels THEN 'PIT-01' END, CASE WHEN flips <> 0 THEN 'PIT-03' END, CASE WHEN rate < 0.9 THEN 'PIT-06' END, CASE WHEN outliers > 0 THEN 'PIT-08' END) AS pitfalls FROM r""")
def report_pitfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), (k % 4).alias("axis_count"), (F.col("o_custkey") % 3).alias("axis_label_count"), F.when(k % 5 != 0, k % 2).alias("orient_flips"), F.when(k % 7 != 0, k % 11 / 10).alias("main_match_rate"), (F.col("o_custkey") % 2).alias("coord_outliers"))
    return model.pitfalls(rows).select("k", F.array_join("pitfalls", ",").alias("pitfalls"))


@query(_SEG + """, c AS (SELECT seg_id AS beam_id, drawing, x1 AS x, y1 AS y, 0.9::DOUBLE AS confidence FROM seg WHERE upright = 0), l AS (SELECT seg_id AS label_id, 'LL' || seg_id AS mark, drawing, x2 AS x, y2 AS y FROM seg WHERE upright = 1),
p AS (SELECT beam_id, label_id, mark, row_number() OVER (PARTITION BY beam_id ORDER BY (c.x - l.x) ^ 2 + (c.y - l.y) ^ 2, label_id) AS n FROM c JOIN l ON c.drawing = l.drawing AND (c.x - l.x) ^ 2 + (c.y - l.y) ^ 2 <= 1)
SELECT c.beam_id, label_id, CASE WHEN label_id IS NULL THEN 'LL-' || substr(sha256(printf('%.3f', x) || ':' || printf('%.3f', y)), 1, 8) ELSE mark END AS mark, CASE WHEN label_id IS NULL THEN 0.85 ELSE 0.9 END::DOUBLE AS confidence FROM c LEFT JOIN (SELECT * FROM p WHERE n = 1) p USING (beam_id)""")
def beam_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir)
    beams = rows.filter("upright = 0").select(F.col("seg_id").alias("beam_id"), "drawing", F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(0.9).alias("confidence"))
    labels = rows.filter("upright = 1").select(F.col("seg_id").alias("label_id"), F.concat(F.lit("LL"), F.col("seg_id").cast("string")).alias("mark"), "drawing", F.col("x2").alias("x"), F.col("y2").alias("y"))
    return model.beam_labels(beams, labels, ["drawing"], 1.0).select("beam_id", "label_id", "mark", "confidence")


COLUMN_SQL = "col AS (SELECT seg_id AS col_id, drawing, lo AS cx, fixed AS cy, 0.5 + seg_id % 3 * 0.25 AS w, 0.75::DOUBLE AS d FROM seg WHERE seg_id % 5 = 0)"


def columns_of(rows: DataFrame) -> DataFrame:
    k = F.col("seg_id")
    return rows.filter(k % 5 == 0).select(k.alias("col_id"), "drawing", F.col("lo").alias("cx"), F.col("fixed").alias("cy"), (0.5 + k % 3 * 0.25).alias("w"), F.lit(0.75).alias("d"))


@query(_SEG + f""", {COLUMN_SQL}, e AS (SELECT seg_id, drawing, thickness, 'start' AS e, x1 AS x, y1 AS y FROM seg UNION ALL SELECT seg_id, drawing, thickness, 'end', x2, y2 FROM seg),
h AS (SELECT DISTINCT e.drawing, e.seg_id, e.e FROM e JOIN seg s ON s.drawing = e.drawing AND s.seg_id <> e.seg_id AND (greatest(s.x1 - e.x, e.x - s.x2, 0)) ^ 2 + (greatest(s.y1 - e.y, e.y - s.y2, 0)) ^ 2 <= least(0.8, greatest(0.3, (e.thickness + s.thickness) / 2000 + 0.05)) ^ 2
  UNION SELECT e.drawing, e.seg_id, e.e FROM e JOIN col c ON c.drawing = e.drawing AND abs(e.x - cx) <= w / 2 + 0.15 AND abs(e.y - cy) <= d / 2 + 0.15),
n AS (SELECT seg.drawing, seg.seg_id, count(h.e) AS hits FROM seg LEFT JOIN h ON h.seg_id = seg.seg_id AND h.drawing = seg.drawing GROUP BY ALL)
SELECT drawing, count(*) AS walls, sum(hits)::BIGINT AS connected_ends, count(*) FILTER (hits = 2) AS fully_connected FROM n GROUP BY ALL""")
def topology_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir)
    return spatial.topology_with_columns(rows, columns_of(rows), ["drawing"], "seg_id")


@query(_SEG + f""", {COLUMN_SQL}, v AS (SELECT seg_id AS vector_id, drawing, x1, y1, x2, y2 FROM seg WHERE seg_id % 3 = 0), m AS (SELECT c.drawing, c.col_id AS end_id, v.vector_id, least((c.cx - v.x1) ^ 2 + (c.cy - v.y1) ^ 2, (c.cx - v.x2) ^ 2 + (c.cy - v.y2) ^ 2) <= 0.25 AS near FROM col c JOIN v ON v.drawing = c.drawing),
g AS (SELECT end_id, count(DISTINCT vector_id) FILTER (near) AS n, min(vector_id) FILTER (near) AS v FROM m GROUP BY ALL)
SELECT col_id AS end_id, coalesce(n, 0) AS vectors, CASE WHEN n = 1 THEN v END AS vector_id FROM col LEFT JOIN g ON end_id = col_id""")
def door_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir)
    ends = columns_of(rows).select(F.col("col_id").alias("end_id"), "drawing", F.col("cx").alias("x"), F.col("cy").alias("y"))
    vectors = rows.filter("seg_id % 3 = 0").select(F.col("seg_id").alias("vector_id"), "drawing", *_POINTS)
    return model.door_vectors(ends, vectors, ["drawing"], 0.5).select("end_id", "vectors", "vector_id")


@query(_SEG + f""", {COLUMN_SQL}, a AS (SELECT col_id AS opening_id, drawing, cx AS x, cy AS y, 'M' || col_id % 2 AS mark FROM col WHERE col_id % 2 = 0 OR col_id % 3 = 0), s AS (SELECT seg_id, drawing, x1 AS x, y1 AS y, 'M' || seg_id % 2 AS mark FROM seg WHERE seg_id % 7 = 0),
e AS (SELECT seg_id, CASE WHEN (x2 - 10) ^ 2 + (y2 - 10) ^ 2 <= 9 AND (x2 - 10) ^ 2 + (y2 - 10) ^ 2 <= (x1 - 10) ^ 2 + (y1 - 10) ^ 2 THEN 'end' WHEN (x1 - 10) ^ 2 + (y1 - 10) ^ 2 <= 9 THEN 'start' END AS side FROM seg)
SELECT opening_id, side FROM a JOIN e ON e.seg_id = opening_id WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.drawing = a.drawing AND s.mark = a.mark AND (s.x - a.x) ^ 2 + (s.y - a.y) ^ 2 <= 1)""")
def openings_to_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir)
    mark = lambda c: F.concat(F.lit("M"), (F.col(c) % 2).cast("string")).alias("mark")
    approved = columns_of(rows).filter("col_id % 2 = 0 OR col_id % 3 = 0").select(F.col("col_id").alias("opening_id"), "drawing", F.col("cx").alias("x"), F.col("cy").alias("y"), mark("col_id"))
    stored = rows.filter("seg_id % 7 = 0").select("drawing", F.col("x1").alias("x"), F.col("y1").alias("y"), mark("seg_id"))
    side = rows.select(F.col("seg_id").alias("opening_id"), spatial.nearest_end(rows, F.lit(10.0), F.lit(10.0), 3.0).alias("side"))
    return spatial.missing_openings(stored, approved, ["drawing"], 1.0).select("opening_id").join(side, "opening_id")


@query("""SELECT p_brand, p_size % 10 AS mark, count(DISTINCT p_size) AS n, min(p_size) AS value, CASE WHEN count(DISTINCT p_size) = 1 THEN 'matched' ELSE 'review_required' END AS status FROM part GROUP BY ALL""")
def declared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.unique_values(table(spark, sf_dir, "part").withColumn("mark", F.col("p_size") % 10), ["p_brand", "mark"], "p_size")


@query("""SELECT s_suppkey AS left_id, s_suppkey + 1000 AS right_id FROM supplier""")
def strict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pairing that uses each row of both sides once; any other fails."""
    left = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("left_id"))
    pairs = left.withColumn("right_id", F.col("left_id") + 1000)
    return spatial.strict_one_to_one(left, pairs.select("right_id"), pairs, "left_id", "right_id")


@query(f"""WITH {X.ELEMENT_SQL}, a AS (SELECT * FROM element WHERE ord % 3 > 0)
SELECT b.element_id, b.ifc_type FROM element b WHERE b.element_id IN (SELECT element_id FROM a) OR b.ifc_type IN ('IFCWALL', 'IFCSLAB')""")
def corrected_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.elements(spark, sf_dir)
    missing = rows.filter("ord % 3 = 0").select("element_id", F.lit("missing").alias("kind"))
    return diff.apply_corrections(rows, missing, ("IFCWALL", "IFCSLAB")).select("element_id", "ifc_type")


@query("""WITH e AS (SELECT p_partkey AS ord, p_size::DOUBLE AS thickness, (p_size * 2)::DOUBLE AS height, p_brand AS material FROM part), a AS (SELECT ord, thickness + ord % 4 AS thickness, height - ord % 3 AS height, CASE WHEN ord % 5 = 0 THEN NULL ELSE material END AS material FROM e WHERE ord % 2 = 0),
d AS (SELECT e.ord, 'thickness' AS attribute FROM e JOIN a USING (ord) WHERE abs(e.thickness - a.thickness) > 1 UNION ALL SELECT e.ord, 'height' FROM e JOIN a USING (ord) WHERE abs(e.height - a.height) > 1 UNION ALL SELECT e.ord, 'material' FROM e JOIN a USING (ord) WHERE coalesce(e.material, '') <> coalesce(a.material, ''))
SELECT ord, 'e' || ord AS element_id, attribute FROM d ORDER BY ord, attribute LIMIT 20""")
def attribute_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    e = table(spark, sf_dir, "part").select(k.alias("ord"), F.concat(F.lit("e"), k.cast("string")).alias("element_id"), z.cast("double").alias("thickness"), (z * 2).cast("double").alias("height"), F.col("p_brand").alias("material"))
    o = F.col("ord")
    a = e.filter(o % 2 == 0).select("element_id", (F.col("thickness") + o % 4).alias("thickness"), (F.col("height") - o % 3).alias("height"), F.when(o % 5 != 0, F.col("material")).alias("material"))
    return diff.compare_attributes(e, a)
