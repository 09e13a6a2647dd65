"""Queries over wall segments, boxes, axes and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import domain as D
from girder.functions import geometry as G
from girder.operators import graph, interval, ordered, spatial, stats
from girder.plans import fixtures as X
from girder.plans.registry import query
from girder.plans.tables import spread, table

_SEG = f"WITH {X.SEGMENT_SQL}\n"


@query("WITH c AS (SELECT p_brand, round(p_size / 8::DOUBLE, 2) AS w, round(p_size % 7 / 4::DOUBLE, 2) AS d, count(*) AS n FROM part GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, w, d)::INT AS place FROM c QUALIFY place <= 3")
def size_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") / 8).alias("width"), (F.col("p_size") % 7 / 4).alias("depth"))
    return stats.size_histogram(rows, ["p_brand"], "width", "depth")


@query("""
WITH a AS (SELECT DISTINCT o_custkey % 50 AS drawing, (o_orderkey * 37 % 23 * (4000 + o_custkey % 50 * 10) + o_orderkey % 3 * 200)::DOUBLE AS v FROM orders),
g AS (SELECT drawing, v, v - lag(v) OVER (PARTITION BY drawing ORDER BY v) AS gap FROM a), h AS (SELECT drawing, gap, count(*) AS n, min(v) AS first FROM g WHERE gap > 3000 AND gap < 15000 GROUP BY 1, 2),
m AS (SELECT drawing, arg_max(gap, (n, -first)) AS mode FROM h GROUP BY 1)
SELECT DISTINCT a.drawing, coalesce(mode, 9000) AS pitch FROM a LEFT JOIN m USING (drawing)""")
def axis_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    drawing = F.col("o_custkey") % 50
    rows = table(spark, sf_dir, "orders").select(drawing.alias("drawing"), (k * 37 % 23 * (4000 + drawing * 10) + k % 3 * 200).cast("double").alias("v"))
    return stats.axis_pitch(rows, ["drawing"])


@query(_SEG + """, t AS (SELECT drawing, hi - lo AS n, CASE WHEN seg_id % 3 = 0 THEN 0.0::DOUBLE ELSE 45.0::DOUBLE END AS angle, greatest(1, least(100, round_even(hi - lo, 0)))::BIGINT AS w FROM seg),
e AS (SELECT drawing, angle, unnest(range(w)) FROM t WHERE n > 0.5)
SELECT drawing, -quantile_cont(angle, 0.5) AS rotation FROM e GROUP BY 1""")
def median_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir).withColumn("n", F.col("hi") - F.col("lo"))
    flat = F.col("seg_id") % 3 == 0
    d = F.col("n") / F.sqrt(F.lit(2.0))
    rows = rows.withColumns({"x1": F.lit(0.0), "y1": F.lit(0.0)}).withColumn("x2", F.when(flat, F.col("n")).otherwise(d)).withColumn("y2", F.when(flat, F.lit(0.0)).otherwise(d))
    return stats.dominant_rotation(rows, ["drawing"]).select("drawing", F.round("rotation", 6).alias("rotation"))


@query("SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, count(*) AS n FROM lineitem GROUP BY 1, 2")
def linfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.line_fit(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


@query("""
WITH d AS (SELECT o_custkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS lo, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 30 + o_orderkey % 90 AS hi FROM orders),
r AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
s AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM r),
i AS (SELECT o_custkey, run, min(lo) AS lo, max(hi) AS hi FROM s GROUP BY 1, 2)
SELECT o_custkey, count(*) AS runs, sum(hi - lo)::BIGINT AS covered FROM i GROUP BY 1""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_custkey", day.alias("lo"), (day + 30 + F.col("o_orderkey") % 90).alias("hi"))
    covered = interval.union_length(rows, ["o_custkey"], "lo", "hi", 0)
    return interval.islands(rows, ["o_custkey"], "lo", "hi").groupBy("o_custkey").agg(F.count("*").alias("runs")).join(covered.select("o_custkey", F.col("covered").cast("long").alias("covered")), "o_custkey")


@query(_SEG + """, r AS (SELECT *, max(hi) OVER w AS reach FROM seg WINDOW w AS (PARTITION BY drawing, upright, floor(fixed) ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 0.35::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY drawing, upright, floor(fixed) ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT drawing, upright, floor(fixed) AS band, run::BIGINT AS run, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM s GROUP BY 1, 2, 3, 4""")
def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval.islands(X.segments(spark, sf_dir).withColumn("band", F.floor("fixed")), ["drawing", "upright", "band"], "lo", "hi", 0.35)


_COVER = """, a AS (SELECT * FROM seg WHERE seg_id % 2 = 0 OR seg_id % 5 = 0), p AS (SELECT * FROM seg WHERE seg_id % 3 <> 0),
i AS (SELECT a.drawing, a.seg_id, a.hi - a.lo AS n, greatest(a.lo, p.lo) AS lo, least(a.hi, p.hi) AS hi FROM a JOIN p ON a.drawing = p.drawing AND a.upright = p.upright AND abs(a.fixed - p.fixed) <= 0.25 AND least(a.hi, p.hi) - greatest(a.lo, p.lo) > 0.05::DOUBLE),
r AS (SELECT *, max(hi) OVER (PARTITION BY seg_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
c AS (SELECT seg_id, sum(greatest(0, hi - CASE WHEN reach IS NULL OR lo > reach THEN lo ELSE least(reach, hi) END)) AS covered FROM r GROUP BY 1)
"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each segment meets many: a small file read by one task would have it score all pairs.
    s = spread(X.segments(spark, sf_dir).select("drawing", "seg_id", "x1", "y1", "x2", "y2", "thickness"))
    actual, predicted = s.filter("seg_id % 2 = 0 OR seg_id % 5 = 0"), s.filter("seg_id % 3 <> 0")
    spans = spatial.covered_intervals(actual, predicted, ["drawing"], "seg_id", "seg_id", 2.0, 0.25)
    covered = interval.union_length(spans, ["source_id"], "lo", "hi")
    return actual.withColumn("length", G.length(G.segment())).join(covered.withColumnRenamed("source_id", "seg_id"), "seg_id", "left").na.fill(0.0, ["covered"])


@query(_SEG + _COVER + "SELECT a.drawing, count(*) AS walls, round(sum(a.hi - a.lo), 6) AS length, round(sum(least(coalesce(covered, 0), a.hi - a.lo)), 6) AS covered, count(*) FILTER (coalesce(covered, 0) >= 0.5 * (a.hi - a.lo)) AS half, count(*) FILTER (coalesce(covered, 0) >= 0.8::DOUBLE * (a.hi - a.lo)) AS most FROM a LEFT JOIN c USING (seg_id) GROUP BY 1")
def length_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = F.col("length"), F.col("covered")
    return _covered(spark, sf_dir).groupBy("drawing").agg(F.count("*").alias("walls"), F.round(F.sum(n), 6).alias("length"), F.round(F.sum(F.least(c, n)), 6).alias("covered"), F.count(F.when(c >= 0.5 * n, 1)).alias("half"), F.count(F.when(c >= 0.8 * n, 1)).alias("most"))


@query(_SEG + _COVER + "SELECT a.drawing, (a.hi - a.lo >= 0.5)::INT + (a.hi - a.lo >= 1)::INT + (a.hi - a.lo >= 3)::INT + (a.hi - a.lo >= 6)::INT AS bin, count(*) AS n, round(sum(a.hi - a.lo), 6) AS length, count(*) FILTER (coalesce(covered, 0) >= 0.5 * (a.hi - a.lo)) AS half_covered FROM a LEFT JOIN c USING (seg_id) GROUP BY 1, 2")
def length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.recall_by_bin(_covered(spark, sf_dir), ["drawing"]).select("drawing", "bin", "n", F.round("length", 6).alias("length"), "half_covered")


@query(_SEG + """
SELECT a.drawing, a.seg_id AS a_seg_id, b.seg_id AS b_seg_id, abs(a.fixed - b.fixed) AS distance, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap
FROM seg a JOIN seg b ON a.drawing = b.drawing AND a.upright = b.upright AND a.seg_id < b.seg_id AND abs(a.fixed - b.fixed) BETWEEN 0.08 AND 0.60
WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) > 0 AND (least(a.hi, b.hi) - greatest(a.lo, b.lo)) / least(a.hi - a.lo, b.hi - b.lo) >= 0.6::DOUBLE""")
def pair_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir).select("drawing", "seg_id", "x1", "y1", "x2", "y2")
    return spatial.pair_faces(s, ["drawing"]).select("drawing", "a_seg_id", "b_seg_id", "distance", "overlap")


@query(_SEG + """
SELECT a.drawing, a.upright, a.seg_id AS a_id, b.seg_id AS b_id, b.fixed - a.fixed AS separation, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap
FROM seg a JOIN seg b ON a.drawing = b.drawing AND a.upright = b.upright AND (b.fixed > a.fixed OR b.fixed = a.fixed AND b.seg_id > a.seg_id)
WHERE b.fixed - a.fixed <= 0.625 AND list_min([abs(b.fixed - a.fixed - t) FOR t IN [0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60]::DOUBLE[]]) <= 0.024::DOUBLE AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.3::DOUBLE
  AND (least(a.hi, b.hi) - greatest(a.lo, b.lo)) / least(a.hi - a.lo, b.hi - b.lo) >= 0.45::DOUBLE""")
def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.band_pairs(X.segments(spark, sf_dir), ["drawing", "upright"], order="seg_id", tolerance=0.024)
    return out.select("drawing", "upright", "a_id", "b_id", "separation", "overlap")


@query(_SEG + """, p AS (SELECT a.drawing, a.seg_id AS l, b.seg_id AS r FROM seg a JOIN seg b ON a.drawing = b.drawing AND a.seg_id % 2 = 0 AND b.seg_id % 2 = 1 AND sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.y1 - b.y1) * (a.y1 - b.y1)) <= 1.5)
SELECT drawing, l, r FROM (SELECT *, count(*) OVER (PARTITION BY l) AS nl, count(*) OVER (PARTITION BY r) AS nr FROM p) WHERE nl = 1 AND nr = 1""")
def mutual_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir)
    left = s.filter("seg_id % 2 = 0").select("drawing", F.col("seg_id").alias("l"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    right = s.filter("seg_id % 2 = 1").select("drawing", F.col("seg_id").alias("r"), F.col("x1").alias("rx"), F.col("y1").alias("ry"))
    return spatial.mutual_unique(spatial.near_points(left, right, ["drawing"], 1.5), "l", "r").select("drawing", "l", "r")


@query(_SEG + """, b AS (SELECT drawing, lo AS x1, fixed AS y1, lo + 2 AS x2, fixed + 1 AS y2 FROM seg WHERE seg_id % 10 = 0)
SELECT DISTINCT s.drawing, s.seg_id AS point_id FROM seg s JOIN b ON s.drawing = b.drawing AND (s.x1 + s.x2) / 2 BETWEEN b.x1 AND b.x2 AND (s.y1 + s.y2) / 2 BETWEEN b.y1 AND b.y2""")
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir)
    boxes = s.filter("seg_id % 10 = 0").select("drawing", F.col("lo").alias("x1"), F.col("fixed").alias("y1"), (F.col("lo") + 2).alias("x2"), (F.col("fixed") + 1).alias("y2"))
    points = s.select("drawing", F.col("seg_id").alias("point_id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return spatial.inside_boxes(points, boxes, ["drawing"], 2.0)


#: Distance of a point to an axis-parallel segment.
_D = "sqrt(pow(greatest(0, o.x1 - e.x, e.x - o.x2), 2) + pow(greatest(0, o.y1 - e.y, e.y - o.y2), 2))"


@query(_SEG + f""", e AS (SELECT drawing, seg_id, thickness, 0 AS k, x1 AS x, y1 AS y FROM seg UNION ALL SELECT drawing, seg_id, thickness, 1, x2, y2 FROM seg),
h AS (SELECT DISTINCT e.seg_id, k FROM e JOIN seg o ON e.drawing = o.drawing AND e.seg_id <> o.seg_id AND {_D} <= least(0.8::DOUBLE, greatest(0.3::DOUBLE, (e.thickness + o.thickness) / 2000 + 0.05::DOUBLE))),
n AS (SELECT seg_id, count(*) AS n FROM h GROUP BY 1)
SELECT drawing, count(*) AS walls, sum(coalesce(n, 0))::BIGINT AS connected_ends, count(*) FILTER (n = 2) AS fully_connected FROM seg LEFT JOIN n USING (seg_id) GROUP BY 1""")
def topology_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir).select("drawing", F.col("seg_id").alias("wall_id"), "x1", "y1", "x2", "y2", "thickness")
    return spatial.topology(s, ["drawing"]).select("drawing", "walls", "connected_ends", "fully_connected")


@query(_SEG + f""", b AS (SELECT * FROM seg WHERE seg_id % 3 = 0), c AS (SELECT drawing, x1 AS cx, y1 AS cy, thickness / 250 AS w FROM seg WHERE seg_id % 3 = 1), w AS (SELECT * FROM seg WHERE seg_id % 3 = 2), g AS (SELECT drawing, x2 AS gx, y2 AS gy FROM seg WHERE seg_id % 7 = 0),
e AS (SELECT drawing, seg_id, x1 AS x, y1 AS y FROM b UNION ALL SELECT drawing, seg_id, x2, y2 FROM b),
h AS (SELECT e.seg_id FROM e JOIN c ON e.drawing = c.drawing AND sqrt((e.x - cx) * (e.x - cx) + (e.y - cy) * (e.y - cy)) < greatest(0.4::DOUBLE, w / 2) + 0.3::DOUBLE
  UNION SELECT e.seg_id FROM e JOIN w o ON e.drawing = o.drawing AND {_D} < 0.3::DOUBLE UNION SELECT e.seg_id FROM e JOIN b o ON e.drawing = o.drawing AND e.seg_id <> o.seg_id AND {_D} < 0.6::DOUBLE
  UNION SELECT e.seg_id FROM e JOIN g ON e.drawing = g.drawing AND sqrt((e.x - gx) * (e.x - gx) + (e.y - gy) * (e.y - gy)) < 0.6::DOUBLE)
SELECT drawing, seg_id AS beam_id, seg_id IN (SELECT seg_id FROM h) AS supported FROM b""")
def beam_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir).select("drawing", "seg_id", "x1", "y1", "x2", "y2", "thickness")
    beams = s.filter("seg_id % 3 = 0").select("drawing", F.col("seg_id").alias("beam_id"), "x1", "y1", "x2", "y2")
    columns = s.filter("seg_id % 3 = 1").select("drawing", F.col("x1").alias("cx"), F.col("y1").alias("cy"), (F.col("thickness") / 250).alias("w"))
    shear = s.filter("seg_id % 3 = 2").select("drawing", "x1", "y1", "x2", "y2")
    grid = s.filter("seg_id % 7 = 0").select("drawing", F.col("x2").alias("gx"), F.col("y2").alias("gy"))
    return spatial.beam_support(beams, columns, shear, grid, ["drawing"])


@query(_SEG + """, g AS (SELECT drawing, list(DISTINCT x1) FILTER (seg_id % 20 = 0) AS xs, list(DISTINCT y1) FILTER (seg_id % 20 = 0) AS ys FROM seg GROUP BY 1)
SELECT seg.drawing, seg_id, sqrt(pow(list_min([abs(v - x2) FOR v IN xs]), 2) + pow(list_min([abs(v - y2) FOR v IN ys]), 2)) < 0.3::DOUBLE AS attached FROM seg JOIN g USING (drawing)""")
def grid_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir)
    axes = s.filter("seg_id % 20 = 0").groupBy("drawing").agg(F.array_sort(F.collect_set("x1")).alias("xs"), F.array_sort(F.collect_set("y1")).alias("ys"))
    return spatial.grid_attach(s.select("drawing", "seg_id", F.col("x2").alias("cx"), F.col("y2").alias("cy")), axes, ["drawing"]).select("drawing", "seg_id", "attached")


@query("""
WITH s AS (SELECT l_orderkey % 100 AS grp, l_quantity * (1 - l_discount) AS v FROM lineitem)
SELECT grp, count(v) AS n, round(min(v), 6) AS "min", round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS "max" FROM s GROUP BY 1""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("grp"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("v"))
    return stats.percentiles(rows, ["grp"], "v").select("grp", "n", *[F.round(c, 6).alias(c) for c in ("min", "p50", "p95", "max")])


@query(_SEG + """, e AS (SELECT *, CASE WHEN seg_id % 4 = 0 THEN 'A-FURN' ELSE 'S-WALL' END AS layer, 'ev' || seg_id % 50 AS evidence_id, seg_id % 9 = 0 AS supported FROM seg)
SELECT drawing, layer, fixed, upright, lo, hi, list_sort(list(DISTINCT evidence_id)) AS evidence_ids, bool_or(supported) AS supported, CASE WHEN layer = 'A-FURN' THEN 'rejected' WHEN bool_or(supported) THEN 'supported' ELSE 'review' END AS status
FROM e GROUP BY drawing, layer, fixed, upright, lo, hi""")
def evidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("seg_id")
    rows = X.segments(spark, sf_dir).select("drawing", F.when(k % 4 == 0, "A-FURN").otherwise("S-WALL").alias("layer"), "x1", "y1", "x2", "y2", F.concat(F.lit("ev"), (k % 50).cast("string")).alias("evidence_id"), (k % 9 == 0).alias("supported"), F.lit("line").alias("kind"), k.alias("ord"))
    out = stats.evidence_rollup(rows, ["drawing", "layer"], D.first_equal(F.col("layer"), [("A-FURN", F.lit("furniture"))], F.lit(None)))
    a, b = F.element_at("ends", 1), F.element_at("ends", 2)
    up = a["x"] == b["x"]
    return out.select("drawing", "layer", F.when(up, a["x"]).otherwise(a["y"]).alias("fixed"), up.cast("long").alias("upright"), F.when(up, a["y"]).otherwise(a["x"]).alias("lo"), F.when(up, b["y"]).otherwise(b["x"]).alias("hi"), "evidence_ids", "supported", "status")


@query(_SEG + """, b AS (SELECT drawing, seg_id, lo AS b_lo, hi AS b_hi, upright, fixed FROM seg WHERE seg_id % 4 = 1), t AS (SELECT * FROM seg WHERE seg_id % 4 <> 1),
c AS (SELECT b.drawing, b.seg_id, b_lo, b_hi, greatest(t.lo, b_lo) AS lo, least(t.hi, b_hi) AS hi FROM b JOIN t ON b.drawing = t.drawing AND b.upright = t.upright AND floor(b.fixed) = floor(t.fixed) AND t.lo < b_hi AND t.hi > b_lo),
m AS (SELECT *, max(hi) OVER (PARTITION BY seg_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
g AS (SELECT seg_id, coalesce(reach, b_lo) AS lo, lo AS hi FROM m WHERE lo > coalesce(reach, b_lo) UNION ALL SELECT seg_id, max(hi), any_value(b_hi) FROM c GROUP BY 1 HAVING any_value(b_hi) > max(hi) UNION ALL SELECT seg_id, b_lo, b_hi FROM b WHERE seg_id NOT IN (SELECT seg_id FROM c))
SELECT seg_id, (row_number() OVER (PARTITION BY seg_id ORDER BY lo) - 1)::INT AS piece, lo, hi FROM g WHERE hi - lo >= 0.25""")
def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir).select("drawing", "upright", F.floor("fixed").alias("fixed"), "seg_id", "lo", "hi")
    base = s.filter("seg_id % 4 = 1")
    line = ["drawing", "upright", "fixed"]
    spans = base.select(*line, "seg_id", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    taken = interval.overlapping(spans, s.filter("seg_id % 4 <> 1").select(*line, "lo", "hi"), line, ("b_lo", "b_hi"), ("lo", "hi"), 4.0).select("seg_id", "lo", "hi")
    return interval.difference(base.select("seg_id", "lo", "hi"), taken, ["seg_id"], "lo", "hi", 0.25)


@query(_SEG + "SELECT seg_id, round(hi - lo, 6) AS length, round((hi - lo) * (thickness / 1000), 6) AS plan_area, round((hi - lo) * 3, 6) AS face_area FROM seg")
def quantity_takeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir)
    return s.select("seg_id", G.quantities(G.segment(), F.col("thickness") / 1000, F.lit(3.0)).alias("q")).select("seg_id", "q.length", "q.plan_area", "q.face_area")


@query("""
WITH p AS (SELECT p_partkey, 500 + p_size * 37 AS w, 400 + p_size * 23 AS h FROM part), x AS (SELECT p_partkey, h, w, unnest(list_distinct([least(v, greatest(0, w - 512)) FOR v IN range(0, w, 384)])) AS x FROM p),
t AS (SELECT p_partkey, x, unnest(list_distinct([least(v, greatest(0, h - 512)) FOR v IN range(0, h, 384)])) AS y FROM x)
SELECT p_partkey, count(*)::INT AS tiles, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM t GROUP BY 1""")
def tile_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", G.tile_origins(500 + F.col("p_size") * 37, 400 + F.col("p_size") * 23, 512, 128).alias("t"))
    total = lambda f: F.aggregate("t", F.lit(0).cast("long"), lambda acc, v: acc + v[f])
    return p.select("p_partkey", F.size("t").alias("tiles"), total("x").alias("sx"), total("y").alias("sy"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by the metre-wide band they lie in: neighbours in a band make a sparse graph."""
    return X.segments(spark, sf_dir).select("drawing", "seg_id", F.floor("fixed").alias("fixed"), "lo", "hi", "upright")


@query(_SEG.replace("WITH ", "WITH RECURSIVE ", 1) + """, ed AS (SELECT a.seg_id AS a, b.seg_id AS b FROM seg a JOIN seg b ON a.drawing = b.drawing AND a.upright = b.upright AND floor(a.fixed) = floor(b.fixed) AND a.seg_id <> b.seg_id AND a.lo <= b.hi AND b.lo <= a.hi),
w AS (SELECT DISTINCT a AS node, a AS label FROM ed UNION SELECT ed.b, w.label FROM w JOIN ed ON ed.a = w.node)
SELECT node, min(label) AS label FROM w GROUP BY 1""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _edges(spark, sf_dir)
    line = ["drawing", "upright", "fixed"]
    a, b = s.select(*line, F.col("seg_id").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi")), s.select(*line, F.col("seg_id").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    return graph.components(interval.overlapping(a, b, line, ("alo", "ahi"), ("blo", "bhi"), 4.0).filter("a < b").select("a", "b"))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _edges(spark, sf_dir)
    line = ["drawing", "upright", "fixed"]
    a, b = s.filter("seg_id % 2 = 0").select(*line, F.col("seg_id").alias("left"), F.col("lo").alias("alo"), F.col("hi").alias("ahi")), s.filter("seg_id % 2 = 0 OR seg_id % 3 = 0").select(*line, F.col("seg_id").alias("right"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    return interval.overlapping(a, b, line, ("alo", "ahi"), ("blo", "bhi"), 4.0).filter("left <> right AND alo < bhi AND blo < ahi").select("left", "right")


@query()
def max_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.matching(_sides(spark, sf_dir))


@query(_SEG.replace("WITH ", "WITH RECURSIVE ", 1) + """, ed AS (SELECT 'l:' || a.seg_id AS l, 'r:' || b.seg_id AS r FROM seg a JOIN seg b ON a.drawing = b.drawing AND a.upright = b.upright AND floor(a.fixed) = floor(b.fixed) AND a.seg_id <> b.seg_id AND a.seg_id % 2 = 0 AND (b.seg_id % 2 = 0 OR b.seg_id % 3 = 0) AND a.lo < b.hi AND b.lo < a.hi),
nl AS (SELECT l, count(*) AS n FROM ed GROUP BY 1), nr AS (SELECT r, count(*) AS n FROM ed GROUP BY 1),
one AS (SELECT ed.l, ed.r, nl.n AS nl, nr.n AS nr, max(nr.n) OVER (PARTITION BY ed.l) AS worst_r, max(nl.n) OVER (PARTITION BY ed.r) AS worst_l FROM ed JOIN nl USING (l) JOIN nr USING (r))
SELECT substr(l, 3) AS "left", substr(r, 3) AS "right", CASE WHEN nl > 1 THEN 'left' ELSE 'right' END AS single FROM one WHERE (nl >= 2 AND worst_r = 1) OR (nr >= 2 AND worst_l = 1)""")
def components_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _sides(spark, sf_dir)
    out = graph.stars(e.select(F.col("left").cast("string").alias("left"), F.col("right").cast("string").alias("right")))
    return out.select("left", "right", "single")


@query()
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir)
    boxes = s.select(F.col("drawing").alias("image"), (F.col("seg_id") % 3).alias("class_id"), F.col("seg_id").alias("box_id"), (F.col("seg_id") * 7 % 101 / 101).alias("confidence"), F.col("lo").alias("x1"), F.col("fixed").alias("y1"), (F.col("lo") + 3).alias("x2"), (F.col("fixed") + 3).alias("y2"))
    return ordered.nms(boxes, 0.5)


@query()
def cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.clusters(X.segments(spark, sf_dir), ["drawing", "upright"], "fixed", 0.3)


@query()
def cluster_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir).groupBy("drawing", "upright").agg(F.collect_list("fixed").alias("v"))
    return rows.select("drawing", "upright", F.posexplode(ordered.cluster_fold(F.col("v"), 0.3)).alias("cluster", "centre"))


@query()
def opening_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces moved to whole metres, so that some lie on one line with gaps between them."""
    row = F.floor("fixed").cast("double")
    up = F.col("upright") == 1
    s = X.segments(spark, sf_dir).select("drawing", F.col("seg_id").alias("id"), F.when(up, row).otherwise(F.col("x1")).alias("x1"), F.when(up, F.col("y1")).otherwise(row).alias("y1"), F.when(up, row).otherwise(F.col("x2")).alias("x2"), F.when(up, F.col("y2")).otherwise(row).alias("y2"), "thickness")
    return ordered.walls_by_group(s, ["drawing"], ordered.opening_bridges, "x1 double, y1 double, x2 double, y2 double, gap double", ["id"])


@query()
def collinear_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir).select("drawing", F.col("seg_id").alias("id"), "x1", "y1", "x2", "y2", "thickness")
    return ordered.walls_by_group(s, ["drawing"], ordered.merge_collinear, "x1 double, y1 double, x2 double, y2 double, thickness double, ids array<long>", ["id"])


@query()
def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir).select("drawing", F.col("seg_id").alias("id"), "x1", "y1", "x2", "y2", (F.col("thickness") / 1000).alias("thickness"))
    return ordered.walls_by_group(s, ["drawing"], lambda walls: ordered.classify_junctions(ordered.heal_junctions(walls, 0.3), 0.3), "kind string, x double, y double, members array<long>", ["id"])
