"""Queries over specifications in drawing texts: dimensions, levels, scales, schedules, beam elevations, layers, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators import specs
from girder.plans.registry import query
from girder.plans.tables import table


def _say(*parts) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_partkey"), F.col("p_size")


@query("""
WITH t AS (SELECT p_partkey AS k, 200 + p_size * 10 AS a, 300 + p_size * 20 AS b FROM part)
SELECT k AS p_partkey, ['Q', 'LL', 'KZ'][k % 4 + 1] || k AS mark, ['wall', 'beam', 'column'][k % 4 + 1] AS kind, CASE WHEN k % 4 = 2 THEN 'schedule' ELSE 'annotation' END AS source_kind,
       CASE k % 4 WHEN 1 THEN a::DOUBLE WHEN 2 THEN b::DOUBLE END AS width, CASE k % 4 WHEN 1 THEN b::DOUBLE WHEN 2 THEN a::DOUBLE END AS depth, CASE WHEN k % 4 = 0 THEN a::DOUBLE END AS thickness FROM t WHERE k % 4 < 3""")
def spec_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, size = _parts(spark, sf_dir)
    a, b = 200 + size * 10, 300 + size * 20
    text = F.when(k % 4 == 0, _say("Q", k, " 墙厚 ", a, "mm")).when(k % 4 == 1, _say("LL", k, " ", b, "x", a)).when(k % 4 == 2, _say("KZ", k, " ", a, "×", b, " 柱表")).otherwise(_say("说明 ", a))
    return specs.parse_specs(p.select("p_partkey", text.alias("text"))).select("p_partkey", "mark", "kind", "source_kind", "dims.width", "dims.depth", "dims.thickness")


@query("""
WITH e AS (SELECT p_partkey AS id, p_partkey % 5 AS f, CASE WHEN p_partkey % 2 = 0 THEN 'wall' ELSE 'column' END AS kind, CASE WHEN p_partkey % 3 <> 0 THEN 'M' || p_partkey % 40 END AS mark, p_partkey % 100 * 4.0::DOUBLE AS x, p_partkey // 100 * 4.0::DOUBLE AS y FROM part),
s AS (SELECT s_suppkey % 5 AS f, CASE WHEN s_suppkey % 2 = 0 THEN 'wall' ELSE 'column' END AS kind, 'M' || s_suppkey % 40 AS mark, s_suppkey % 4 AS rank, 100.0::DOUBLE + s_suppkey % 3 * 50 AS t, s_suppkey % 100 * 4.0::DOUBLE + 1 AS x, 0.0::DOUBLE AS y FROM supplier),
m AS (SELECT e.id, s.t, s.rank FROM e JOIN s ON e.kind = s.kind AND ((e.mark = s.mark) OR (e.f = s.f AND e.mark IS NULL AND sqrt((e.x - s.x) * (e.x - s.x) + (e.y - s.y) * (e.y - s.y)) <= 3))),
g AS (SELECT id, count(DISTINCT t) AS n, min(t) AS t, min(rank) AS rank FROM m GROUP BY 1)
SELECT e.id AS p_partkey, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'conflict' ELSE 'matched' END AS spec_status, CASE WHEN n = 1 THEN t END AS thickness, CASE WHEN n = 1 THEN ['detail', 'schedule', 'legend', 'annotation'][rank + 1] END AS source_kind FROM e LEFT JOIN g USING (id)""")
def spec_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, _ = _parts(spark, sf_dir)
    s = F.col("s_suppkey")
    kind = lambda c: F.when(c % 2 == 0, "wall").otherwise("column").alias("kind")
    elements = p.select(F.col("p_partkey"), (k % 5).alias("f"), kind(k), F.when(k % 3 != 0, _say("M", k % 40)).alias("mark"), (k % 100 * 4.0).alias("x"), (F.floor(k / 100) * 4.0).alias("y"))
    null = F.lit(None).cast("double")
    dims = F.struct(null.alias("width"), null.alias("depth"), (100.0 + s % 3 * 50).alias("thickness"))
    rows = table(spark, sf_dir, "supplier").select((s % 5).alias("f"), kind(s), _say("M", s % 40).alias("mark"), F.get(F.array(*map(F.lit, specs.SOURCE_ORDER)), (s % 4).cast("int")).alias("source_kind"), dims.alias("dims"), (s % 100 * 4.0 + 1).alias("x"), F.lit(0.0).alias("y"))
    out = specs.resolve_specs(elements, rows, ["f"], 3.0, "p_partkey")
    one = lambda c: F.when(F.col("spec_status") == "matched", F.col(c))
    return out.select("p_partkey", "spec_status", one("spec.dims.thickness").alias("thickness"), one("spec.source_kind").alias("source_kind"))


@query("""
WITH t AS (SELECT p_partkey AS k, p_size AS size, CASE p_partkey % 4 WHEN 1 THEN p_partkey % 9 + 1 WHEN 2 THEN p_partkey % 10 + 1 END AS floor_no FROM part)
SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS levels,
       CASE WHEN k % 3 = 0 THEN '标高' || coalesce(floor_no, 2) WHEN k % 4 = 0 THEN '标高' || size WHEN k % 4 = 3 THEN '标高1' ELSE floor_no || 'F-AR' END AS name, CASE WHEN k % 3 = 0 THEN size + 0.5::DOUBLE ELSE 0.0::DOUBLE END AS elevation FROM t""")
def drawing_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, size = _parts(spark, sf_dir)
    number = F.substring(F.lit("一二三四五六七八九十"), (k % 10 + 1).cast("int"), F.lit(1))
    name = F.when(k % 4 == 0, _say("标高", size)).when(k % 4 == 1, _say(k % 9 + 1, "F-AR")).when(k % 4 == 2, F.concat(number, F.lit("层平面"))).otherwise("plan")
    notes = F.when(k % 3 == 0, F.array(F.lit("比例 1:100"), _say("参照标高 +", size, ".5m"))).otherwise(F.array(F.lit("5 m")))
    levels = p.select("p_partkey", specs.level_from_texts(name, notes).alias("v"))
    last = F.element_at("v", -1)
    return levels.select("p_partkey", F.size("v").alias("levels"), last["name"].alias("name"), last["elevation"].alias("elevation"))


@query("""
WITH t AS (SELECT p_partkey // 10 AS file, 50 * (p_partkey % 3 + 1) AS scale, CASE WHEN p_partkey % 10 = 4 AND p_size % 2 = 0 THEN 12 ELSE 1 END AS score FROM part),
g AS (SELECT file, scale, max(score) AS score, least(count(*), 5) AS n FROM t GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY file ORDER BY score DESC, n DESC) AS place FROM g)
SELECT file, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN count(*) = 1 THEN min(scale) END AS scale FROM r WHERE place = 1 GROUP BY 1""")
def drawing_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, size = _parts(spark, sf_dir)
    row = lambda n, text, dx: F.struct((k * 2 + n).alias("text_id"), text.alias("text"), (k % 10 * 1000.0 + dx).alias("x"))
    titled = (k % 10 == 4) & (size % 2 == 0)
    texts = F.array_compact(F.array(row(0, _say("比例 1:", 50 * (k % 3 + 1)), 0.0), F.when(titled, row(1, F.lit("一层平面图"), 100.0))))
    rows = p.select(F.floor(k / 10).alias("file"), F.lit("p").alias("frame_id"), F.explode(texts).alias("t")).select("file", "frame_id", "t.*", F.lit(0.0).alias("y"))
    return specs.drawing_scale(rows, ["file"]).select("file", "status", F.when(F.col("status") == "ok", F.col("scale")).alias("scale"))


@query("""
SELECT p_partkey // 10 AS page, 'D' || p_partkey AS mark, p_size * 20.0::DOUBLE + 60 AS width, 900.0::DOUBLE AS height, CASE WHEN p_size % 2 = 0 THEN -0.5::DOUBLE ELSE p_size / 10.0::DOUBLE END AS sill
FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 <> 0""")
def opening_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table a page, upright on even pages, turned on odd ones; one row in seven has no sill."""
    p, k, size = _parts(spark, sf_dir)
    page = F.floor(k / 10)
    cell = lambda n, text, u, v: F.struct((k * 10 + n).alias("row_id"), text.alias("text"), F.when(page % 2 == 0, u).otherwise(v).alias("x"), F.when(page % 2 == 0, v).otherwise(u).alias("y"))
    at, col = -(k % 10).cast("double"), lambda x: F.lit(float(x))
    row = [cell(1, _say("D", k), col(0), at), cell(2, _say(size * 20 + 60, " x 900"), col(5), at), F.when(k % 7 != 0, cell(3, F.when(size % 2 == 0, "-0.5").otherwise(_say(size * 100, "mm")), col(10), at))]
    body = p.filter(k % 10 != 0).select(page.alias("page"), F.explode(F.array_compact(F.array(*row))).alias("c"))
    first = p.groupBy(page.alias("page")).agg(F.min("p_partkey").alias("p_partkey"))
    head = [cell(n, F.lit(t), col(u), col(0)) for n, t, u in ((7, "洞口编号", 0), (8, "洞口尺寸", 5), (9, "洞底标高", 10))]
    heads = first.select("page", F.explode(F.array(*head)).alias("c"))
    return specs.opening_schedule(body.unionByName(heads).select("page", "c.*"), ["page"], 0.5, 50.0)


@query("""
WITH b AS (SELECT p_partkey AS k, p_partkey % 4 AS kind, p_partkey % 5 <> 0 AS marked, p_size::DOUBLE AS v FROM part)
SELECT k AS beam_id, CASE WHEN kind = 1 THEN v + 0.5 WHEN kind IN (0, 2) AND marked THEN v END AS top, CASE WHEN kind = 1 THEN v WHEN kind IN (0, 2) AND marked THEN v - 0.5 END AS base,
       CASE WHEN kind = 1 OR (kind IN (0, 2) AND marked) THEN 'matched' WHEN k % 8 = 3 AND marked THEN 'conflict' ELSE 'missing' END AS status FROM b""")
def beam_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked evidence stands on another sheet, unmarked evidence half a metre away; an unmarked beam takes only the latter."""
    p, k, size = _parts(spark, sf_dir)
    beams = p.select(k.alias("beam_id"), F.when(k % 5 != 0, _say("LL", k)).alias("mark"), _say("f", k % 3).alias("frame_id"), (k * 10.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.5).alias("depth"))
    marked = lambda reference, value: F.struct(_say("LL", k).alias("mark"), F.lit("other").alias("frame_id"), F.lit(0.0).alias("x"), F.lit(reference).alias("reference"), value.cast("double").alias("value"))
    near = F.struct(F.lit(None).cast("string").alias("mark"), _say("f", k % 3).alias("frame_id"), (k * 10.0 + 0.5).alias("x"), F.lit("base").alias("reference"), size.cast("double").alias("value"))
    said = F.when(k % 4 == 0, F.array(marked("top", size))).when(k % 4 == 1, F.array(near)).when(k % 4 == 2, F.array(marked("top", size), marked("base", size - 0.5))).when(k % 8 == 3, F.array(marked("top", size), marked("top", size + 1))).otherwise(F.array().cast("array<struct<mark:string,frame_id:string,x:double,reference:string,value:double>>"))
    evidence = p.select(F.explode(said).alias("e")).select("e.*", F.lit(0.0).alias("y"))
    return specs.beam_elevations(beams, evidence, 2.0).select("beam_id", "top", "base", "status")


_LAYERS = ("S-WALL", "X-WALL", "BEAM", "A-COLU", "TXT")


@query("""
WITH l AS (SELECT p_partkey // 4 AS drawing_id, ['S-WALL', 'X-WALL', 'BEAM', 'A-COLU', 'TXT'][p_partkey % 5 + 1] || '-' || p_size AS layer FROM part),
p(profile, ord, keyword, role) AS (VALUES ('first', 1, 's-wall', 'wall'), ('first', 1, 'colu', 'column'), ('second', 2, 'beam', 'beam')),
r(role, keyword) AS (VALUES ('wall', 'wall'), ('beam', 'beam'), ('column', 'col')),
h AS (SELECT drawing_id, layer, p.* FROM l JOIN p ON contains(lower(layer), keyword)), c AS (SELECT drawing_id, profile, min(ord) AS ord, count(DISTINCT keyword) AS n FROM h GROUP BY 1, 2),
b AS (SELECT drawing_id, profile FROM c QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY n DESC, ord) = 1),
x AS (SELECT drawing_id, role, layer FROM h JOIN b USING (drawing_id, profile) QUALIFY row_number() OVER (PARTITION BY drawing_id, role ORDER BY length(layer), layer) = 1),
y AS (SELECT drawing_id, role, layer FROM l JOIN r ON contains(lower(layer), keyword) QUALIFY row_number() OVER (PARTITION BY drawing_id, role ORDER BY length(layer), layer) = 1)
SELECT drawing_id, role, coalesce(x.layer, y.layer) AS layer FROM x FULL JOIN y USING (drawing_id, role)""")
def layer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, size = _parts(spark, sf_dir)
    layers = p.select(F.floor(k / 4).alias("drawing_id"), F.concat(F.get(F.array(*map(F.lit, _LAYERS)), (k % 5).cast("int")), F.lit("-"), size.cast("string")).alias("layer"))
    profiles = spark.createDataFrame([("first", 1, "s-wall", "wall"), ("first", 1, "colu", "column"), ("second", 2, "beam", "beam")], "profile string, ord int, keyword string, role string")
    roles = spark.createDataFrame([("wall", "wall"), ("beam", "beam"), ("column", "col")], "role string, keyword string")
    return specs.best_layers(layers, profiles, roles)


@query("""
WITH p AS (SELECT p_partkey // 4 AS drawing_id, p_partkey AS plan_id, ['一层平面图', '墙柱图', '夹层平面图', '详图', '墙柱定位'][p_size % 5 + 1] AS name FROM part),
r AS (SELECT drawing_id, plan_id, CASE WHEN contains(name, '平面图') THEN 0 WHEN contains(name, '墙柱') THEN 1 END AS rank FROM p WHERE NOT contains(name, '夹层')),
b AS (SELECT * FROM r WHERE rank IS NOT NULL QUALIFY rank = min(rank) OVER (PARTITION BY drawing_id)), n AS (SELECT drawing_id, count(*) AS n, min(plan_id) AS plan_id FROM b GROUP BY 1)
SELECT d.drawing_id, CASE WHEN n = 1 THEN n.plan_id END AS plan_id, CASE WHEN n = 1 THEN 'ok' ELSE 'ambiguous_or_missing' END AS status FROM (SELECT DISTINCT drawing_id FROM p) d LEFT JOIN n USING (drawing_id)""")
def main_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, size = _parts(spark, sf_dir)
    names = F.array(*map(F.lit, ("一层平面图", "墙柱图", "夹层平面图", "详图", "墙柱定位")))
    return specs.main_plan(p.select(F.floor(k / 4).alias("drawing_id"), k.alias("plan_id"), F.get(names, (size % 5).cast("int")).alias("name")))
