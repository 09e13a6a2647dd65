"""Queries over drawings as rasters: centre lines of edges, registered renders and their verdicts, floors fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators import fusion, rasters, runs
from girder.plans import fixtures as X
from girder.plans.registry import query
from girder.plans.tables import table

#: Edges of 48 pixels a metre lie on multiples of 6: only edges of one line are joined, and walls are 6 to 24 wide.
_EDGES = X.SEGMENT_SQL + """,
l AS (SELECT drawing, upright, fixed * 48 AS coord, lo * 48 AS lo, hi * 48 AS hi FROM seg),
m AS (SELECT *, max(hi) OVER (PARTITION BY drawing, upright, coord ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 8 THEN 1 ELSE 0 END) OVER (PARTITION BY drawing, upright, coord ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM m),
r AS (SELECT drawing, upright, coord, run, min(lo) AS lo, max(hi) AS hi FROM n GROUP BY ALL),
p AS (SELECT drawing, upright, a.coord AS coord, a.lo AS start, b.coord - a.coord AS t, b.lo AS b_lo, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM r a JOIN r b USING (drawing, upright) WHERE b.coord - a.coord BETWEEN 3 AND 24 AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 15),
w AS (SELECT *, coord + t / 2 AS mid, row_number() OVER (PARTITION BY drawing, upright, coord, start ORDER BY t, lo - hi, b_lo) AS k FROM p)"""


def raster_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as edges in pixels; every other one runs backwards."""
    back = F.col("seg_id") % 4 < 2
    px = lambda a, b: (F.when(back, F.col(b)).otherwise(F.col(a)) * 48).alias(a)
    return X.segments(spark, sf_dir).select("drawing", px("x1", "x2"), px("y1", "y2"), px("x2", "x1"), px("y2", "y1"))


@query(f"""WITH {_EDGES}
SELECT drawing, CASE WHEN upright = 1 THEN 'V' ELSE 'H' END AS axis, round(CASE WHEN upright = 1 THEN mid ELSE lo END, 2) AS x1, round(CASE WHEN upright = 1 THEN lo ELSE mid END, 2) AS y1,
       round(CASE WHEN upright = 1 THEN mid ELSE hi END, 2) AS x2, round(CASE WHEN upright = 1 THEN hi ELSE mid END, 2) AS y2, round(t, 2) AS thickness, 0.85::DOUBLE AS confidence FROM w WHERE k = 1""")
def raster_centerlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.centerlines(raster_edges(spark, sf_dir), ["drawing"])


@query()
def raster_walls_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge serves one wall; compared with taking edges in order in tests."""
    return rasters.centerlines(raster_edges(spark, sf_dir), ["drawing"], reuse=False)


def render_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages of 40 parts, a line each, and renders of them on a larger page, turned by what the page's number says.

    One page in five keeps its size; of one in three, a tenth of the lines are not rendered.
    """
    k, page = F.col("p_partkey"), F.col("page")
    fixed, lo, up = k * 37 % 161 + 10, k * 101 % 150 + 10, k % 2 == 1
    hi = lo + 8 + k * 13 % 41
    one = lambda v: v.cast("double")
    rows = table(spark, sf_dir, "part").select(F.floor(k / 40).alias("page"), "p_partkey", *(one(F.when(up, a).otherwise(b)).alias(n) for n, a, b in (("x1", fixed, lo), ("y1", lo, fixed), ("x2", fixed, hi), ("y2", hi, fixed))), F.lit(1.0).alias("width"))
    kept, quarter = page % 5 == 4, page % 4
    wide, high, dx, dy = F.when(kept, 260).otherwise(280), F.when(kept, 220).otherwise(236), F.when(kept, 0).otherwise(7), F.when(kept, 0).otherwise(5)
    turn = F.when(kept, 0).otherwise(quarter)

    def corner(i: int) -> list:
        x, y = F.col(f"x{i}") + dx, F.col(f"y{i}") + dy
        at = {0: (x, y), 1: (y, wide - 1 - x), 2: (wide - 1 - x, high - 1 - y), 3: (high - 1 - y, x)}
        pick = lambda j: F.when(turn == 1, at[1][j]).when(turn == 2, at[2][j]).when(turn == 3, at[3][j]).otherwise(at[0][j])
        return [one(pick(0)).alias(f"x{i}"), one(pick(1)).alias(f"y{i}")]

    rendered = rows.filter((page % 3 != 0) | (k % 10 != 0)).select("page", *corner(1), *corner(2), "width")
    side = turn % 2 == 1
    images = rows.select("page").distinct().select("page", F.lit(260).alias("width"), F.lit(220).alias("height"), F.when(side, high).otherwise(wide).alias("t_width"), F.when(side, wide).otherwise(high).alias("t_height"))
    return images, runs.line_runs(rows, ["page"]), runs.line_runs(rendered, ["page"])


@query()
def render_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where renders lie on their pages; compared with sets of pixels and planted turns in tests."""
    return rasters.register_renders(*render_input(spark, sf_dir), ["page"])


@query()
def render_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over the registered renders; one page in seven is not approved, one in eleven has a stale hash."""
    images, source, target = render_input(spark, sf_dir)
    page, text = F.col("page"), F.col("page").cast("string")
    counts = {n: F.lit(v) for kind, v in (("walls", 40), ("columns", 3), ("beams", 2)) for n in (kind, f"read_{kind}", f"made_{kind}")}
    results = images.select(
        "page", F.sha2(text, 256).alias("model_sha256"), F.sha2(text, 256).alias("result_model_sha256"), *(F.lit(v).alias(n) for v, names in (("t", ("tenant", "result_tenant")), ("p", ("project", "result_project"))) for n in names),
        F.when(page % 7 == 5, "draft").otherwise("approved").alias("approval"), F.lit("succeeded").alias("status"), F.concat(F.lit("x"), text).alias("transaction_id"), *(v.alias(n) for n, v in counts.items()),
        F.sha2(F.concat(F.lit("s"), text), 256).alias("source_sha256"), F.sha2(F.concat(F.lit("v"), text), 256).alias("view_sha256"), F.sha2(F.concat(F.when(page % 11 == 6, "old").otherwise("v"), text), 256).alias("recorded_view_sha256"))
    verdicts = rasters.audit_verdicts(rasters.register_renders(images, source, target, ["page"]), results, ["page"])
    return verdicts.select("page", "status", F.array_join("issues", ",").alias("issues"), "similarity")


def floor_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Floors of 20 parts: a column, a wall and two axes a part on both drawings; five floors of six break a rule each by their first part."""
    k, floor = F.col("p_partkey"), F.col("floor")
    p = table(spark, sf_dir, "part").select(F.floor(k / 20).alias("floor"), "p_partkey", (k % 20 * 3.0).alias("at"), (k % 20 == 0).alias("first"))
    contract = lambda ox, oy, turn: F.struct(F.lit(ox).alias("origin_x"), F.lit(oy).alias("origin_y"), F.lit(500.0).alias("centre_x"), F.lit(250.0).alias("centre_y"), turn.alias("rotation"))
    contracts = p.select("floor").distinct().select("floor", contract(4000.0, -1000.0, F.when(floor % 6 == 1, 90.0).otherwise(0.0)).alias("structure"), contract(1000.0, 2000.0, F.lit(0.0)).alias("architecture"))
    both = p.withColumn("side", F.explode(F.array(F.lit("structure"), F.lit("architecture"))))
    ours = F.col("side") == "structure"
    x, y = F.col("at") - F.when(ours, 3.0).otherwise(0.0), F.col("at") * 2 + F.when(ours, 3.0).otherwise(0.0)
    bad = lambda n: F.col("first") & (floor % 6 == n)
    key = F.concat(F.substring("side", 1, 1), k.cast("string")).alias("id")
    nudge = F.when(ours & bad(2), 0.002).when(ours & (k % 7 == 1), 0.0005).otherwise(0.0)
    columns = both.select("floor", "side", key, (x + nudge).alias("x"), y.alias("y"), (0.5 + F.when(ours & bad(5), 0.0015).otherwise(0.0)).alias("w"), F.lit(0.5).alias("h"))
    axes = both.filter(ours | (k % 3 != 2) | F.col("first")).select("floor", "side", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("direction"), k.alias("k"), "first", x.alias("x"), y.alias("y"))
    lines = axes.select("floor", "side", "direction", F.concat(F.substring("side", 1, 1), "direction", F.col("k").cast("string")).alias("id"), (F.when(F.col("direction") == "x", F.col("x")).otherwise(F.col("y")) + F.when(~ours & bad(4), 0.5).otherwise(0.0)).alias("coord"))
    again = axes.filter(ours & bad(3) & (F.col("direction") == "x")).select("floor", "side", "direction", F.concat(F.lit("sx-again"), F.col("k").cast("string")).alias("id"), (F.col("x") + 0.0004).alias("coord"))
    here = F.when(ours, k % 4 != 0).otherwise(k % 3 != 0)
    turned = ours & (k % 2 == 0)
    ends = {"x1": (x, x + 2), "x2": (x + 2, x), "y1": (y, y + 1), "y2": (y + 1, y)}
    walls = both.filter(here).select("floor", "side", key, *(F.when(turned, b).otherwise(a).alias(n) for n, (a, b) in ends.items()), (200.0 + F.when(ours & (k % 5 == 0), 2.0).when(ours, 1.0).otherwise(0.0)).alias("thickness"))
    return contracts, lines.unionByName(again), columns, walls


@query("""
WITH f AS (SELECT DISTINCT p_partkey // 20 AS floor FROM part)
SELECT floor, CASE floor % 6 WHEN 0 THEN 'fused' ELSE 'refused' END AS status,
       coalesce(['column_not_one_to_one,rotation_differs', 'column_not_one_to_one', 'axes_not_of_structure,duplicate_axes', 'axes_not_of_structure', 'column_not_one_to_one'][nullif(floor % 6, 0)], '') AS issues FROM f""")
def floor_fusion_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, _ = fusion.fuse_floors(*floor_input(spark, sf_dir), ["floor"])
    return verdicts.select("floor", "status", F.array_join("issues", ",").alias("issues"))


@query("""
WITH p AS (SELECT p_partkey // 20 AS floor, p_partkey AS k FROM part WHERE p_partkey // 20 % 6 = 0),
d AS (SELECT *, unnest(['x', 'y']) AS d FROM p)
SELECT floor, 'axis_' || d AS kind, 's' || d || k AS structure_id, CASE WHEN k % 3 <> 2 THEN 'a' || d || k END AS architecture_id, CASE WHEN k % 3 <> 2 THEN 'EXACT' ELSE 'STRUCTURE_ONLY' END AS status, CASE WHEN k % 3 <> 2 THEN 0.0::DOUBLE END AS residual FROM d
UNION ALL SELECT floor, 'column', 's' || k, 'a' || k, 'EXACT', CASE WHEN k % 7 = 1 THEN 0.0005::DOUBLE ELSE 0.0 END FROM p
UNION ALL SELECT floor, 'wall', CASE WHEN k % 4 <> 0 THEN 's' || k END, CASE WHEN k % 3 <> 0 THEN 'a' || k END, CASE WHEN k % 3 = 0 THEN 'UNMATCHED_STRUCTURE_VIEW' WHEN k % 4 = 0 THEN 'UNMATCHED_ARCHITECTURE_VIEW' ELSE 'CORROBORATED' END, CASE WHEN k % 3 <> 0 AND k % 4 <> 0 THEN 0.0::DOUBLE END FROM p WHERE k % 12 <> 0 AND NOT (k % 5 = 0 AND k % 3 <> 0 AND k % 4 <> 0)
UNION ALL SELECT floor, 'wall', 's' || k, NULL, 'UNMATCHED_STRUCTURE_VIEW', NULL FROM p WHERE k % 5 = 0 AND k % 3 <> 0 AND k % 4 <> 0
UNION ALL SELECT floor, 'wall', NULL, 'a' || k, 'UNMATCHED_ARCHITECTURE_VIEW', NULL FROM p WHERE k % 5 = 0 AND k % 3 <> 0 AND k % 4 <> 0""")
def floor_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, elements = fusion.fuse_floors(*floor_input(spark, sf_dir), ["floor"])
    return elements.withColumn("residual", F.round("residual", 6))
