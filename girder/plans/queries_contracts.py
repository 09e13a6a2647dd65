"""Queries over the named rules of building models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import geometry as G
from girder.operators import contracts
from girder.plans import fixtures as X
from girder.plans.registry import query
from girder.plans.tables import table

_SEG = f"WITH {X.SEGMENT_SQL}\n"
_LAYERS = ("S-WALL", "x$0$s_wall_rc", "f|A-WALL-FIN", "A-WALL-S", "隔墙", "0")


def _pick(values: tuple, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


@query(f"""WITH r AS (SELECT l_orderkey AS wall, [{", ".join(f"'{v}'" for v in _LAYERS)}][l_partkey % 6 + 1] AS layer FROM lineitem),
g AS (SELECT wall, bool_or(layer IN ('S-WALL', 'x$0$s_wall_rc')) AS s, bool_or(layer IN ('f|A-WALL-FIN', '隔墙')) AS a FROM r GROUP BY ALL)
SELECT wall, CASE WHEN s AND NOT a THEN 'shear_wall' WHEN a AND NOT s THEN 'architectural_wall' ELSE 'unresolved' END AS role FROM g""")
def wall_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("wall")).agg(F.collect_list(_pick(_LAYERS, F.col("l_partkey") % 6)).alias("layers"))
    return rows.select("wall", contracts.wall_role(F.col("layers")).alias("role"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey WHEN 2 THEN o_custkey END::DOUBLE AS x, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 2 THEN 7 END::DOUBLE AS y FROM orders""")
def element_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ('{"x": %d, "y": %d}', '{"placement": {"x": %d, "y": "%d"}}', '{"start": [%d], "end": [%d, 7]}', '{"start": {"x": "%d"}, "z": %d}')
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    body = F.when(k % 4 == 0, F.format_string(forms[0], c, k)).when(k % 4 == 1, F.format_string(forms[1], c, k)).when(k % 4 == 2, F.format_string(forms[2], k, c)).otherwise(F.format_string(forms[3], c, k))
    return table(spark, sf_dir, "orders").select(k.alias("id"), contracts.element_xy(body).alias("p")).select("id", "p.x", "p.y")


@query("""SELECT o_orderkey AS id, concat_ws(';', CASE WHEN o_orderkey % 3 = 0 THEN 'project 缺少 levels' END, CASE WHEN o_orderkey % 2 = 0 THEN 'grid 为空（无轴网）' END, CASE WHEN o_orderkey % 5 = 0 THEN 'model_elements[0] 墙缺 start/end' END, CASE WHEN o_orderkey % 7 = 0 THEN 'model_elements[1] 未知类型: Pipe' ELSE 'model_elements[1] 柱缺 x/y' END) AS issues FROM orders""")
def model_file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    part = lambda n, yes, no: F.when(k % n == 0, F.lit(yes)).otherwise(F.lit(no))
    data = F.concat(
        F.lit('{"project": {"units": "m"'), part(3, "}", ', "levels": []}'), F.lit(', "grid": {"x_axes": '), part(2, "[]", "[1]"), F.lit('}, "model_elements": [{"type": "Wall", "start": '), part(5, "null", "[0, 0]"),
        F.lit(', "end": [1, 1]}, {"x": 1, "type": "'), part(7, "Pipe", "Column"), F.lit('"}]}'))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.array_join(contracts.ir_issues(data), ";").alias("issues"))


@query("""WITH e AS (SELECT l_orderkey AS m, l_linenumber % 3 AS k, l_linenumber AS ord, 'e' || (l_linenumber % 5) AS id, l_partkey AS p FROM lineitem),
u AS (SELECT *, row_number() OVER (PARTITION BY m, id ORDER BY k, ord) AS n FROM e),
v AS (SELECT m, k, ord, id, 0 AS r, 'duplicate_element_id' AS code FROM u WHERE n > 1 UNION ALL SELECT m, k, ord, id, 1, 'missing_source_refs' FROM u WHERE p % 2 = 0 UNION ALL SELECT m, k, ord, id, 2, 'level_mismatch' FROM u WHERE p % 3 = 0
 UNION ALL SELECT m, k, ord, id, 3, 'missing_quantities' FROM u WHERE p % 5 = 0 UNION ALL SELECT m, k, ord, id, 4, 'missing_construction_info' FROM u WHERE p % 7 = 0 UNION ALL SELECT m, k, ord, id, 5, 'construction_category_mismatch' FROM u WHERE p % 7 > 0 AND k > 0
 UNION ALL SELECT o_orderkey, -1, 0, NULL, 0, 'units_must_be_m' FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, -1, 0, NULL, 2, 'missing_transform_chain' FROM orders WHERE o_orderkey % 3 = 0)
SELECT m AS model_id, k AS kind_ord, ord, id AS element_id, r AS rule_ord, code FROM v""")
def delivery_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p, n = F.col("o_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    models = table(spark, sf_dir, "orders").select(k.alias("model_id"), F.when(k % 2 == 0, "mm").otherwise("m").alias("units"), F.lit("0,0").alias("coordinate_origin"), F.when(k % 3 == 0, 0).otherwise(1).alias("transform_steps"), F.lit("L1").alias("level_id"))
    made = F.struct(F.lit("Wall").alias("category"), F.lit("t").alias("type_name"), F.lit("").alias("classification_code"), F.lit(None).cast("string").alias("material_name"))
    elements = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("model_id"), _pick(("Wall", "Column", "Beam"), n % 3).alias("kind"), n.alias("ord"), F.concat(F.lit("e"), (n % 5).cast("string")).alias("element_id"), F.when(p % 3 == 0, "L2").otherwise("L1").alias("level_id"),
        F.when(p % 2 > 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("source_refs"), (p % 5 > 0).alias("has_quantities"), F.when(p % 7 > 0, made).alias("construction"))
    return contracts.delivery_violations(models, elements)


@query("""WITH w AS (SELECT l_orderkey AS m, count(*) FILTER (l_partkey % 11 = 0) AS untraced, min(l_suppkey % 10) AS least, count(*) FILTER (l_partkey % 13 = 0) AS conflicts FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL),
c AS (SELECT l_orderkey AS m, count(*) FILTER (l_quantity < 5) AS bad FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL),
f AS (SELECT o_orderkey AS m, o_orderkey % 4 AS evidence, o_orderkey % 10 AS dangling, o_custkey % 3 AS grids, w.*, coalesce(bad, 0) AS bad FROM orders LEFT JOIN w ON w.m = o_orderkey LEFT JOIN c ON c.m = o_orderkey),
e AS (SELECT f.m AS model_id, concat_ws(',', CASE WHEN evidence = 0 THEN 'wall_evidence_present' END, CASE WHEN least IS NULL THEN 'model_walls_present' END, CASE WHEN untraced > 0 THEN 'all_walls_traceable' END, CASE WHEN least < 3 THEN 'all_walls_confident' END,
 CASE WHEN dangling > 6 THEN 'topology_within_limit' END, CASE WHEN bad > 0 THEN 'column_geometry_valid' END, CASE WHEN grids < 2 THEN 'grid_present_when_required' END, CASE WHEN conflicts > 0 THEN 'specification_conflicts_free' END) AS errors FROM f)
SELECT model_id, errors, CASE WHEN errors = '' THEN 'pass' ELSE 'fail' END AS status FROM e""")
def model_review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p, l = F.col("o_orderkey"), F.col("l_partkey"), table(spark, sf_dir, "lineitem").withColumn("model_id", F.col("l_orderkey"))
    none, refs = F.array().cast("array<string>"), F.array(F.lit("s"))
    grids = F.col("o_custkey") % 3
    models = table(spark, sf_dir, "orders").select(k.alias("model_id"), (k % 4).alias("evidence_count"), (k % 10).cast("double").alias("dangling_ratio"), grids.alias("vertical_grids"), F.lit(2).alias("horizontal_grids"), *(F.lit(0).alias(c) for c in ("error_count", "wall_collisions", "column_collisions")))
    walls = l.filter("l_linenumber % 2 = 1").select("model_id", (F.col("l_suppkey") % 10).cast("double").alias("confidence"), refs.alias("evidence_ids"), F.when(p % 11 == 0, none).otherwise(refs).alias("source_refs"), F.when(p % 13 == 0, "conflict").alias("specification_status"))
    columns = l.filter("l_linenumber % 2 = 0").select("model_id", F.when(F.col("l_quantity") < 5, 0.0).otherwise(0.4).alias("width_m"), F.lit(0.4).alias("depth_m"), refs.alias("source_refs"), F.lit("matched").alias("specification_status"))
    beams = walls.select("model_id", F.lit("matched").alias("specification_status"), F.lit("matched").alias("elevation_status"))
    out = contracts.review_gate(contracts.gate_facts(models, walls, columns, beams), 3.0, 6.0)
    return out.select("model_id", F.array_join("errors", ",").alias("errors"), "status")


@query("""SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'unknown_source' WHEN l_partkey % 7 = 0 THEN 'page_missing' WHEN l_partkey % 11 = 0 THEN 'frame_differs' ELSE 'page_not_read' END AS issue, count(*) AS n FROM lineitem
WHERE l_suppkey % 5 = 0 OR l_partkey % 7 = 0 OR l_partkey % 11 = 0 OR l_linenumber > 5 GROUP BY ALL
UNION ALL SELECT 'offset_unknown', 2""")
def frame_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    sources = spark.createDataFrame([(f"s{i}",) for i in range(1, 5)], "source_id string")
    pages = sources.withColumn("page_no", F.explode(F.sequence(F.lit(1), F.lit(5))))
    entities = l.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("entity_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("source_id"), F.when(p % 7 > 0, F.col("l_linenumber")).alias("page_no"), F.when(p % 11 == 0, "elsewhere").alias("frame_id"))
    offsets = spark.createDataFrame([("s1",), ("s1:page:0005",), ("s1:page:0006",), ("s9",)], "frame_id string")
    return contracts.frame_issues(sources, pages, entities, offsets, True).groupBy("issue").agg(F.count("*").alias("n"))


@query(_SEG + """, w AS (SELECT drawing, seg_id, seg_id % 5 = 0 AS moved, seg_id % 7 = 0 AS thick FROM seg),
s AS (SELECT drawing, seg_id, CASE WHEN moved OR thick THEN 'mismatch' ELSE 'built' END AS status, concat_ws(',', CASE WHEN moved THEN 'position_mismatch' END, CASE WHEN thick THEN 'thickness_mismatch' END) AS issues, moved OR thick AS calls FROM w)
SELECT drawing, seg_id, status, issues, CASE WHEN calls AND nth <= 40 THEN 'update' END AS repair, calls AND nth > 40 AS truncated FROM (SELECT *, count(*) FILTER (calls) OVER (PARTITION BY drawing ORDER BY seg_id) AS nth FROM s)""")
def built_wall_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("seg_id")
    walls = X.segments(spark, sf_dir).select("drawing", k.alias("ord"), k.alias("id"), "x1", "y1", "x2", "y2", "thickness")
    shift = F.when(F.col("id") % 5 == 0, 0.0625).otherwise(0.03125)
    built = walls.withColumns({"x1": F.col("x2") + shift, "y1": F.col("y2"), "x2": F.col("x1") + shift, "y2": F.col("y1"), "thickness": F.col("thickness") + F.when(F.col("id") % 7 == 0, 12).otherwise(10)})
    out = contracts.built_states(walls, built, ["drawing"], most=40)
    return out.select("drawing", F.col("id").alias("seg_id"), "status", F.array_join("issues", ",").alias("issues"), "repair", "truncated")


@query(_SEG + """SELECT seg_id, CASE WHEN seg_id % 3 = 0 THEN 5 ELSE 4 END AS n, (hi - lo) * 4 + CASE WHEN seg_id % 3 = 0 THEN (hi - lo) / 2 ELSE 0 END AS area FROM seg""")
def simplified_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi, y, apex = F.col("lo"), F.col("hi"), F.col("fixed"), F.when(F.col("seg_id") % 3 == 0, 1.0).otherwise(0.0625)
    at = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    ring = F.array(at(lo, y), at(lo + (hi - lo) / 4, y), at(hi, y), at(hi, y + 4), at((lo + hi) / 2, y + 4 + apex), at(lo, y + 4))
    rows = X.segments(spark, sf_dir).select("seg_id", contracts.simplified_profile(ring, 0.0625).alias("p"))
    return rows.select("seg_id", F.size("p").alias("n"), G.polygon_area(F.col("p")).alias("area"))
