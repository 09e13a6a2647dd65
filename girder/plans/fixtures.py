"""Stand-ins for the domain's tables, made from the driver's tables by the same rule in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import domain as D
from girder.plans.tables import spread, table

RAW_MATERIALS = ("HRB400 钢筋", "商砼", "机制砂", "p.o42.5 水泥", "热轧卷板", "盘条", "电解铜", "玻璃")
RAW_UNITS = ("元/m3", "元/吨", "", "元/平方米")
AS_OF = "2001-06-15"


def sql_contains(value: str, pairs: list[tuple[str, str]], default: str) -> str:
    """CASE over containment, in order."""
    quoted = lambda w: w.replace("'", "''")
    return "CASE " + " ".join(f"WHEN contains({value}, '{quoted(w)}') THEN '{r}'" for w, r in pairs) + f" ELSE {default} END"


def sql_material(value: str) -> str:
    pairs = [(a.upper(), std) for std, words in D.MATERIAL_ALIASES.items() for a in words]
    exact = " ".join(f"WHEN {value} = '{a}' THEN '{s}'" for a, s in pairs)
    return f"CASE {exact} ELSE {sql_contains(value, pairs, value)} END"


PRICE_SQL = """price AS (
  SELECT (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity::BIGINT AS ord,
         ['HRB400 钢筋', '商砼', '机制砂', 'p.o42.5 水泥', '热轧卷板', '盘条', '电解铜', '玻璃'][p_partkey % 8 + 1] AS material, p_brand AS spec, s_name AS market,
         l_extendedprice / l_quantity / 10 AS price_low, l_extendedprice / l_quantity / 10 * (1 + l_discount) AS price_high,
         ['元/m3', '元/吨', '', '元/平方米'][s_suppkey % 4 + 1] AS unit, strftime(l_shipdate, '%m-%d') AS price_date, l_returnflag AS source, l_shipdate AS updated_at
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""


def _ord() -> Column:
    """An order of line items without ties: order and line number do not tell them apart."""
    return (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")


def price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = l.join(p, F.col("p_partkey") == F.col("l_partkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    pick = lambda values, key: F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))
    low = F.col("l_extendedprice") / F.col("l_quantity") / 10
    return rows.select(
        _ord().alias("ord"), pick(RAW_MATERIALS, "p_partkey").alias("material"), F.col("p_brand").alias("spec"), F.col("s_name").alias("market"),
        low.alias("price_low"), (low * (1 + F.col("l_discount"))).alias("price_high"), pick(RAW_UNITS, "s_suppkey").alias("unit"), F.date_format("l_shipdate", "MM-dd").alias("price_date"), F.col("l_returnflag").alias("source"), F.col("l_shipdate").alias("updated_at"))


ITEM_SQL = """item AS (
  SELECT l_orderkey AS order_no, (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity::BIGINT AS ord, p_type AS material_name, (l_quantity - 1)::DOUBLE AS quantity,
         l_extendedprice / l_quantity / 10 AS unit_price, CASE WHEN l_linenumber % 5 = 0 THEN '方' ELSE '吨' END AS unit,
         CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE p_retailprice END AS market_price, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE '元/吨' END AS market_unit
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    quoted = F.col("l_linenumber") % 3 != 0
    return rows.select(
        F.col("l_orderkey").alias("order_no"), _ord().alias("ord"), F.col("p_type").alias("material_name"), (F.col("l_quantity") - 1).alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 10).alias("unit_price"), F.when(F.col("l_linenumber") % 5 == 0, "方").otherwise("吨").alias("unit"), F.when(quoted, F.col("p_retailprice")).alias("market_price"), F.when(quoted, "元/吨").alias("market_unit"))


#: Elements of a building model from parts: each kind with what it lacks.
ELEMENT_SQL = """element AS (
  SELECT p_partkey AS ord, 'e' || p_partkey AS element_id, ['IFCWALL', 'IFCSLAB', 'IFCCOLUMN', 'IFCBEAM'][p_partkey % 4 + 1] AS ifc_type, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS name,
         CASE WHEN p_partkey % 2 = 0 THEN 'ifc_parse' ELSE 'drawing' END AS source, p_partkey % 3 = 0 AS has_geometry, CASE WHEN p_partkey % 13 = 0 THEN 'finishing' ELSE 'structural' END AS element_category,
         CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_size * 10)::VARCHAR END AS thickness, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS material, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size::VARCHAR END AS elevation
  FROM part)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    kinds = F.array(*map(F.lit, ("IFCWALL", "IFCSLAB", "IFCCOLUMN", "IFCBEAM")))
    props = {"Thickness": F.when(size % 4 != 0, (size * 10).cast("string")), "Material": F.when(size % 3 != 0, F.col("p_brand")), "Elevation": F.when(size % 5 != 0, size.cast("string"))}
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("key"), v.alias("value"))) for n, v in props.items()]))
    return p.select(k.alias("ord"), F.concat(F.lit("e"), k.cast("string")).alias("element_id"), F.get(kinds, (k % 4).cast("int")).alias("ifc_type"), F.when(k % 11 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(k % 2 == 0, "ifc_parse").otherwise("drawing").alias("source"), (k % 3 == 0).alias("has_geometry"), F.when(k % 13 == 0, "finishing").otherwise("structural").alias("element_category"), F.map_from_entries(entries).alias("properties"), F.col("p_brand").alias("location"))


#: Axis-parallel wall faces on an eighth-metre grid, 300 orders to a drawing: all coordinates are exact doubles.
SEGMENT_SQL = """seg0 AS (
  SELECT o_orderkey AS seg_id, o_orderkey // 300 AS drawing, o_orderkey % 2 AS upright, (o_orderkey * 37 % 161)::DOUBLE / 8 AS fixed, (o_orderkey * 101 % 197)::DOUBLE / 8 AS lo,
         (o_orderkey * 101 % 197)::DOUBLE / 8 + 0.5 + (o_orderkey * 13 % 61)::DOUBLE / 8 AS hi, (100 + o_orderkey % 5 * 50)::DOUBLE AS thickness
  FROM orders),
seg AS (SELECT *, CASE WHEN upright = 1 THEN fixed ELSE lo END AS x1, CASE WHEN upright = 1 THEN lo ELSE fixed END AS y1, CASE WHEN upright = 1 THEN fixed ELSE hi END AS x2, CASE WHEN upright = 1 THEN hi ELSE fixed END AS y2 FROM seg0)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("seg_id"), F.floor(k / 300).alias("drawing"), (k % 2).alias("upright"), ((k * 37 % 161) / 8).alias("fixed"), ((k * 101 % 197) / 8).alias("lo"), ((k * 101 % 197) / 8 + 0.5 + (k * 13 % 61) / 8).alias("hi"), (100 + k % 5 * 50).cast("double").alias("thickness"))
    up = F.col("upright") == 1
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return rows.withColumns({"x1": pick("fixed", "lo"), "y1": pick("lo", "fixed"), "x2": pick("fixed", "hi"), "y2": pick("hi", "fixed")})


#: Turns of a conversation as question and answer rounds.
ROUND_SQL = """round0 AS (SELECT conv_id, turn AS seq, text AS user_text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role FROM conversations),
rounds AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS seq, user_text, coalesce(answer, '') AS answer FROM round0 WHERE role = 'user')"""


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(w)).filter("role = 'user'")
    return rows.select("conv_id", F.row_number().over(w).alias("seq"), F.col("text").alias("user_text"), F.coalesce("answer", F.lit("")).alias("answer"))


#: Building models in STEP text: a file of a building with two storeys for every hundred parts, an element with its relations for each part.
_IFC_HEAD = (
    "ISO-10303-21", "DATA",
    "#1=IFCPROJECT('project',$,'P',$,$,$,$,$,$)", "#2=IFCBUILDING('building',$,'B',$,$,#12,$,$,.ELEMENT.,$,$,$)",
    "#3=IFCBUILDINGSTOREY('storey1',$,'L1',$,$,#13,$,$,.ELEMENT.,0.)", "#4=IFCBUILDINGSTOREY('storey2',$,'L2',$,$,#14,$,$,.ELEMENT.,3600.)",
    "#12=IFCLOCALPLACEMENT($,#21)", "#13=IFCLOCALPLACEMENT(#12,#23)", "#14=IFCLOCALPLACEMENT(#12,#27)",
    "#20=IFCCARTESIANPOINT((100.,200.,0.))", "#21=IFCAXIS2PLACEMENT3D(#20,$,$)", "#22=IFCCARTESIANPOINT((0.,0.,0.))", "#23=IFCAXIS2PLACEMENT3D(#22,#24,#25)",
    "#24=IFCDIRECTION((0.,0.,1.))", "#25=IFCDIRECTION((0.,1.,0.))", "#26=IFCCARTESIANPOINT((0.,0.,3.6E3))", "#27=IFCAXIS2PLACEMENT3D(#26,$,$)",
    "#30=IFCMATERIAL('\\X2\\6DF751DD571F\\X0\\ C30',$,$)", "#31=IFCMATERIAL('Steel')", "#32=IFCMATERIALLAYER(#30,200.,$)", "#33=IFCMATERIALLAYER(#31,5.,$)",
    "#34=IFCMATERIALLAYERSET((#32,#33),'layers')", "#35=IFCMATERIALLAYERSETUSAGE(#34,.AXIS2.,.POSITIVE.,0.)",
    "#40=IFCWALLTYPE('type',$,'W',$,$,(#41),$,$,$,.STANDARD.)", "#41=IFCPROPERTYSET('common',$,'Pset_Own',$,(#42,#43))",
    "#42=IFCPROPERTYSINGLEVALUE('FireRating',$,IFCLABEL('of type'),$)", "#43=IFCPROPERTYSINGLEVALUE('LoadBearing',$,IFCBOOLEAN(.T.),$)",
    "#50=IFCSPACE('space',$,'S1',$,$,$,$,'long',.ELEMENT.,.INTERNAL.,$)",
)


def step_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, statement) of such models."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))  # a part becomes some twenty statements
    k, size = F.col("p_partkey"), F.col("p_size")
    file = F.concat(F.lit("model-"), F.floor(k / 100).cast("string"))
    base = 1000 + 100 * (k % 100)
    at = lambda j: F.concat(F.lit("#"), (base + j).cast("string"))
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    upper = size % 2 == 1
    kinds = F.get(F.array(*map(F.lit, ("IFCWALL", "IFCSLAB", "IFCCOLUMN", "IFCBEAM"))), (k % 4).cast("int"))
    shaped = (k % 3 == 0) & (k % 4 < 2)
    name = F.when(k % 11 == 0, "$").otherwise(say("'", F.col("p_name"), "''s'"))
    solid = F.when(k % 8 == 0, say(at(17), "=IFCBOOLEANCLIPPINGRESULT(.DIFFERENCE.,", at(18), ",", at(19), ")")).otherwise(say(at(17), "=IFCEXTRUDEDAREASOLID(", at(20), ",", at(21), ",#24,3000.)"))
    lines = [
        say(at(0), "=", kinds, "('e", k, "',$,", name, ",$,'made',", at(1), ",", F.when(shaped, at(15)).otherwise("$"), ",'tag',.STANDARD.)"),
        say(at(1), "= IFCLOCALPLACEMENT(", F.when(upper, "#14").otherwise("#13"), ", ", at(2), ")"),
        say(at(2), "=IFCAXIS2PLACEMENT3D(", at(3), ",$,$)"), say(at(3), "=IFCCARTESIANPOINT((", size, ".,", k % 100, ".,0.5))"),
        F.when(k % 5 != 0, say(at(4), "=IFCRELCONTAINEDINSPATIALSTRUCTURE('c',$,$,$,(", at(0), "),", F.when(upper, "#4").otherwise("#3"), ")")).when(k % 100 != 0, say(at(5), "=IFCRELAGGREGATES('a',$,$,$,", at(-100), ",(", at(0), "))")),
        *(F.when(size % 4 != 0, x) for x in (
            say(at(6), "=IFCRELDEFINESBYPROPERTIES('d',$,$,$,(", at(0), "),", at(7), ")"), say(at(7), "=IFCPROPERTYSET('s',$,'Pset_Own',$,(", at(8), ",", at(9), "))"),
            say(at(8), "=IFCPROPERTYSINGLEVALUE('FireRating',$,IFCLABEL('", size, "h; (a, b)'),$)"), say(at(9), "=IFCPROPERTYSINGLEVALUE('Mark',$,IFCINTEGER(", size, "),$)"))),
        F.when(k % 4 == 0, say(at(10), "=IFCRELDEFINESBYTYPE('t',$,$,$,(", at(0), "),#40)")),
        *(F.when(size % 3 != 0, x) for x in (
            say(at(11), "=IFCRELDEFINESBYPROPERTIES('d',$,$,$,(", at(0), "),", at(12), ")"), say(at(12), "=IFCELEMENTQUANTITY('q',$,'Qto_Base',$,$,(", at(13), "))"),
            say(at(13), "=IFCQUANTITYLENGTH('Width',$,$,", size * 10, ".)"))),
        F.when(size % 2 == 0, say(at(14), "=IFCRELASSOCIATESMATERIAL('m',$,$,$,(", at(0), "),#35)")).when(size % 3 != 0, say(at(14), "=IFCRELASSOCIATESMATERIAL('m',$,$,$,(", at(0), "),#31)")),
        *(F.when(shaped, x) for x in (
            say(at(15), "=IFCPRODUCTDEFINITIONSHAPE($,$,(", at(16), "))"), say(at(16), "=IFCSHAPEREPRESENTATION(#99,'Body','SweptSolid',(", at(17), "))"), solid,
            F.when(k % 8 == 0, say(at(18), "=IFCEXTRUDEDAREASOLID(", at(20), ",", at(21), ",#24,3000.)")), F.when(k % 8 == 0, say(at(19), "=IFCHALFSPACESOLID(#98,.F.)")),
            say(at(20), "=IFCRECTANGLEPROFILEDEF(.AREA.,$,$,", size + 100, ".,5000.)"), say(at(21), "=IFCAXIS2PLACEMENT3D(", at(22), ",$,$)"), say(at(22), "=IFCCARTESIANPOINT((0.,0.,", size, "."  "))"))),
    ]
    rows = p.select(file.alias("file"), F.explode(F.array_compact(F.array(*lines))).alias("statement"))
    heads = p.select(file.alias("file")).distinct().select("file", F.explode(F.array(*map(F.lit, _IFC_HEAD))).alias("statement"))
    return rows.unionByName(heads)


#: What such a model says of each part.
STEP_SQL = """ifc0 AS (
  SELECT p_partkey AS k, p_size AS size, 'model-' || p_partkey // 100 AS file, 'e' || p_partkey AS global_id, ['IFCWALL', 'IFCSLAB', 'IFCCOLUMN', 'IFCBEAM'][p_partkey % 4 + 1] AS ifc_type,
         CASE WHEN p_partkey % 11 = 0 THEN '未命名' ELSE p_name || '''s' END AS name, p_size % 2 = 1 AS upper, p_partkey % 3 = 0 AND p_partkey % 4 < 2 AS has_geometry, p_partkey % 100 AS place FROM part),
ifc AS (
  SELECT a.*, CASE WHEN a.k % 5 <> 0 THEN CASE WHEN a.upper THEN 'L2' ELSE 'L1' END WHEN a.place <> 0 THEN CASE WHEN b.upper THEN 'L2' ELSE 'L1' END END AS container,
         CASE WHEN a.size % 4 <> 0 THEN a.size || 'h; (a, b)' WHEN a.k % 4 = 0 THEN 'of type' END AS fire, CASE WHEN a.k % 4 = 0 THEN 'True' END AS load_bearing, CASE WHEN a.size % 4 <> 0 THEN a.size::VARCHAR END AS mark,
         CASE WHEN a.size % 3 <> 0 THEN (a.size * 10)::DOUBLE::VARCHAR END AS width, CASE WHEN a.size % 2 = 0 THEN '混凝土 C30,Steel' WHEN a.size % 3 <> 0 THEN 'Steel' ELSE '' END AS materials,
         CASE WHEN a.has_geometry AND a.k % 4 = 0 THEN (a.size + 100)::DOUBLE END AS thickness,
         CASE WHEN a.k % 4 = 1 THEN CASE WHEN a.has_geometry THEN a.size::DOUBLE WHEN a.k % 5 <> 0 THEN CASE WHEN a.upper THEN 3600.0::DOUBLE ELSE 0.0::DOUBLE END END END AS level
  FROM ifc0 a LEFT JOIN ifc0 b ON b.k = a.k - 1)"""
