"""Building models in STEP text as rows, and their elements by joins over the reference graph.

A file is one row per statement; no element's references are walked in one task.
Statements become a table of instances (file, id, class, args).  Relation
entities are exploded to edges and joined; chains of unknown length (placements,
containers) are resolved by pointer doubling, in about log2 of their depth rounds.

Edge cases: statements that are no instances are left out; a reference to a
missing instance is as if it were not given; chains that run in a circle end
where the circle is found; strings are decoded (doubled quotes, \\X\\, \\X2\\);
empty input gives empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.plans.staging import settle, stage, staged

_STRING = r"'(?:[^']++|'')*+'"


def _list(depth: int) -> str:
    """A bracketed list, nested up to ``depth`` times; possessive, so that long lists need no stack."""
    inner = rf"[^'()]++|{_STRING}" + (f"|{_list(depth - 1)}" if depth > 1 else "")
    return rf"\((?:{inner})*+\)"


ARGUMENT = rf"(?:[^,'()]++|{_STRING}|{_list(5)})++"
STATEMENT = r"(?s)^(?:\s|/\*.*?\*/)*#(\d+)\s*=\s*([A-Za-z0-9_]+)\s*\((.*)\)\s*;?\s*$"
INSTANCE = "file string, id long, class string, args array<string>"

# Names of kinds of elements, and the classes of the spatial structure, which are no elements.
KIND_NAMES = {
    "IFCWALL": "墙", "IFCWALLSTANDARDCASE": "墙", "IFCCOLUMN": "柱", "IFCBEAM": "梁", "IFCSLAB": "楼板", "IFCDOOR": "门", "IFCWINDOW": "窗", "IFCSTAIR": "楼梯",
    "IFCSTAIRFLIGHT": "楼梯", "IFCROOF": "屋顶", "IFCMEMBER": "杆件", "IFCOPENINGELEMENT": "洞口", "IFCPLATE": "板件", "IFCCURTAINWALL": "幕墙", "IFCRAILING": "栏杆",
    "IFCBUILDINGELEMENTPROXY": "体量", "IFCCOVERING": "覆盖层", "IFCFURNISHINGELEMENT": "家具", "IFCPILE": "桩", "IFCFOOTING": "基础", "IFCGRID": "轴网", "IFCPROXY": "代理构件",
}
RULE_KINDS = {"墙": "IFCWALL", "柱": "IFCCOLUMN", "梁": "IFCBEAM", "楼板": "IFCSLAB", "门": "IFCDOOR", "窗": "IFCWINDOW", "楼梯": "IFCSTAIR", "屋顶": "IFCROOF"}
SPATIAL = ("IFCSPACE", "IFCBUILDINGSTOREY", "IFCBUILDING", "IFCSITE", "IFCPROJECT")
NO_NAME = "未命名"
#: Classes of the schema that are products besides those with a kind name, by their beginnings; types and styles are none.
PRODUCTS = r"^IFC(?:WALL|COLUMN|BEAM|SLAB|DOOR|WINDOW|STAIR|ROOF|MEMBER|OPENING|PLATE|CURTAINWALL|RAILING|RAMP|BUILDINGELEMENT|BUILTELEMENT|COVERING|FURNI|SYSTEMFURNI|PILE|FOOTING|GRID$|PROXY|ANNOTATION|ELEMENTASSEMBLY|TRANSPORTELEMENT|REINFORCING|TENDON|MECHANICALFASTENER|FASTENER|DISCRETEACCESSORY|VIRTUALELEMENT|FLOW|DISTRIBUTION|ENERGYCONVERSION|PIPE|DUCT|CABLE|LIGHTFIXTURE|SANITARYTERMINAL|AIRTERMINAL|VALVE|PUMP|FAN$|CHIMNEY|SHADINGDEVICE|CIVILELEMENT|GEOGRAPHICELEMENT|STRUCTURALCURVE|STRUCTURALSURFACE)"
NOT_PRODUCTS = r"(?:TYPE|STYLE|PROPERTIES|TYPEENUM)$"
MATERIAL_PARTS = {
    "IFCMATERIALLAYERSETUSAGE": 0, "IFCMATERIALLAYERSET": 0, "IFCMATERIALLAYER": 0, "IFCMATERIALLIST": 0, "IFCMATERIALCONSTITUENTSET": 2, "IFCMATERIALCONSTITUENT": 2,
    "IFCMATERIALPROFILESETUSAGE": 0, "IFCMATERIALPROFILESET": 2, "IFCMATERIALPROFILE": 2,
}
QUANTITIES = ("IFCQUANTITYLENGTH", "IFCQUANTITYAREA", "IFCQUANTITYVOLUME", "IFCQUANTITYCOUNT", "IFCQUANTITYWEIGHT", "IFCQUANTITYTIME")


def read_statements(spark: SparkSession, path: str, end: str = ";\n") -> DataFrame:
    """(file, statement) of STEP files, a row each; files of another line end are split all the same, only not among tasks."""
    rows = spark.read.text(path, lineSep=end).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.select("file", F.explode(F.split("value", r";\r?\n")).alias("statement"))


def instances(statements: DataFrame) -> DataFrame:
    """(file, id, class, args) of each instance statement."""
    # The expression is costly: it is tried once to filter and once to cut, not once for each part.
    cut = statements.filter(F.col("statement").rlike(STATEMENT)).select("file", F.split(F.regexp_replace("statement", STATEMENT, "$1\u0001$2\u0001$3"), "\u0001", 3).alias("part"))
    rows = cut.select("file", F.col("part")[0].cast("long").alias("id"), F.upper(F.col("part")[1]).alias("class"), F.col("part")[2].alias("args"))
    return rows.withColumn("args", F.transform(F.regexp_extract_all("args", F.lit(ARGUMENT), F.lit(0)), lambda x: F.trim(x)))


def arg(i: int) -> Column:
    return F.get("args", F.lit(i))


def ref(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"^#(\d+)$", 1), F.lit("")).cast("long")


def refs(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def number(value: Column) -> Column:
    return F.when(value.rlike(r"^[+-]?\d*\.?\d*(?:[eE][+-]?\d+)?$") & value.rlike(r"\d"), value.try_cast("double"))


def text(value: Column) -> Column:
    """A STEP string decoded; null for anything else."""
    raw = F.replace(F.regexp_extract(value, r"(?s)^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    wide = F.split(raw, r"\\X2\\|\\X0\\")  # odd pieces are hexadecimal
    raw = F.array_join(F.transform(wide, lambda p, i: F.when(i % 2 == 1, F.decode(F.unhex(p), "UTF-16BE")).otherwise(p)), "")
    bytes_ = F.split(raw, r"\\X\\")
    raw = F.array_join(F.transform(bytes_, lambda p, i: F.when(i > 0, F.concat(F.decode(F.unhex(F.substring(p, 1, 2)), "ISO-8859-1"), F.substring(p, 3, 2**31 - 1))).otherwise(p)), "")
    return F.when(value.startswith("'"), F.replace(raw, F.lit("\\\\"), F.lit("\\")))


def enum(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"^\.(\w+)\.$", 1), F.lit(""))


def typed_value(value: Column) -> Column:
    """The text of a typed value such as IFCTEXT('a'), IFCREAL(3.) or IFCBOOLEAN(.T.)."""
    inner = F.coalesce(F.nullif(F.regexp_extract(value, r"(?s)^\w+\s*\((.*)\)$", 1), F.lit("")), value)
    flag = F.when(inner == ".T.", "True").when(inner == ".F.", "False")
    real = F.when(inner.rlike(r"[.eE]"), number(inner).cast("string")).otherwise(F.when(number(inner).isNotNull(), inner))
    return F.when(~inner.isin("$", "*"), F.coalesce(text(inner), flag, real, enum(inner), inner))


def _of(inst: DataFrame, *classes: str, **columns: Column) -> DataFrame:
    return inst.filter(F.col("class").isin(*classes)).select("file", *(c.alias(n) for n, c in columns.items()))


def follow(nodes: DataFrame, more, name: str) -> DataFrame:
    """Pointer doubling: nodes of (file, id, parent, value) until no parent is left.

    ``more(value, of_parent)`` joins a node's value with that of the node it
    points to; then it points where that one did.  A parent that is no node ends
    a chain.  When no further node ends, the rest run in circles and end there.
    """
    since = staged()
    now, open_before = settle(nodes, name, since), None
    while True:
        still = now.filter(F.col("parent").isNotNull()).count()
        if not still or still == open_before:
            return now
        open_before = still
        ahead = now.select("file", F.col("id").alias("parent"), F.col("parent").alias("_next"), F.col("value").alias("_value"), F.lit(True).alias("_met"))
        moved = now.filter(F.col("parent").isNotNull()).join(ahead, ["file", "parent"], "left")
        value = F.when(F.col("_met"), more(F.col("value"), F.col("_value"))).otherwise(F.col("value"))
        now = settle(now.filter(F.col("parent").isNull()).unionByName(moved.select("file", "id", F.col("_next").alias("parent"), value.alias("value"))), name, since)


def _vector(inst: DataFrame, kind: str) -> DataFrame:
    """(file, ref, xyz) of points or directions; planar ones have z null."""
    xyz = F.transform(F.regexp_extract_all(F.coalesce(arg(0), F.lit("")), F.lit(r"[^(),\s]+"), F.lit(0)), number)
    return _of(inst, kind, ref=F.col("id"), xyz=xyz)


IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def _unit(v: Column) -> Column:
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return F.transform(v, lambda x: x / n)


def _cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _compose(inner: Column, outer: Column) -> Column:
    """The 3 x 4 matrix that applies ``inner``, then ``outer``, row by row."""
    cell = lambda r, c: outer[4 * r] * inner[c] + outer[4 * r + 1] * inner[4 + c] + outer[4 * r + 2] * inner[8 + c] + (outer[4 * r + 3] if c == 3 else F.lit(0.0))
    return F.array(*(cell(r, c) for r in range(3) for c in range(4)))


def placements(inst: DataFrame) -> DataFrame:
    """(file, placement, sum, matrix): the locations added up along the chain of parents, and the composed transform.

    The sum ends at a placement without a location of three coordinates.
    """
    points, directions = _vector(inst, "IFCCARTESIANPOINT"), _vector(inst, "IFCDIRECTION")
    axes = _of(inst, "IFCAXIS2PLACEMENT3D", axes=F.col("id"), location=ref(arg(0)), axis=ref(arg(1)), direction=ref(arg(2)))
    own = _of(inst, "IFCLOCALPLACEMENT", id=F.col("id"), parent=ref(arg(0)), axes=ref(arg(1)))
    for what, side in (("location", points), ("axis", directions), ("direction", directions)):
        axes = axes.join(side.select("file", F.col("ref").alias(what), F.col("xyz").alias(f"{what}_xyz")), ["file", what], "left")
    own = own.join(axes, ["file", "axes"], "left")
    whole = lambda v: F.when((F.size(v) == 3) & ~F.exists(v, lambda x: x.isNull()), v)
    at = whole(F.col("location_xyz"))
    z = _unit(F.coalesce(whole(F.col("axis_xyz")), F.array(*map(F.lit, (0.0, 0.0, 1.0)))))
    x = F.coalesce(whole(F.col("direction_xyz")), F.array(*map(F.lit, (1.0, 0.0, 0.0))))
    own = own.select("file", "id", "parent", at.alias("at"), z.alias("z"), x.alias("x"))
    dot = F.aggregate(F.zip_with("x", "z", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    own = own.withColumn("x", _unit(F.zip_with("x", "z", lambda a, b: a - b * dot))).withColumn("y", _cross(F.col("z"), F.col("x")))
    here = F.coalesce("at", F.array(*map(F.lit, (0.0, 0.0, 0.0))))
    matrix = F.array(*(c for r in range(3) for c in (F.col("x")[r], F.col("y")[r], F.col("z")[r], here[r])))
    nodes = own.select("file", "id", "parent", F.struct(F.coalesce("at", F.array(*map(F.lit, (0.0, 0.0, 0.0)))).alias("sum"), F.col("at").isNotNull().alias("found"), F.col("at").isNotNull().alias("whole"), matrix.alias("matrix")).alias("value"))
    more = lambda v, up: F.struct(
        F.when(v["whole"], F.zip_with(v["sum"], up["sum"], lambda a, b: a + b)).otherwise(v["sum"]).alias("sum"), v["found"].alias("found"),
        (v["whole"] & up["whole"]).alias("whole"), _compose(v["matrix"], up["matrix"]).alias("matrix"))
    done = follow(nodes, more, "ifc-placements")
    return done.select("file", F.col("id").alias("placement"), F.when(F.col("value.found"), F.col("value.sum")).alias("sum"), F.col("value.matrix").alias("matrix"))


def containers(inst: DataFrame) -> DataFrame:
    """(file, id, container, direct): the spatial structure that holds an element, by itself or through what it is a part, an opening or a filling of."""
    held = inst.filter(F.col("class") == "IFCRELCONTAINEDINSPATIALSTRUCTURE").select("file", F.col("id").alias("by"), ref(arg(5)).alias("container"), F.explode(refs(arg(4))).alias("id"))
    held = held.groupBy("file", "id").agg(F.min_by("container", "by").alias("container"))
    parts = inst.filter(F.col("class") == "IFCRELAGGREGATES").select("file", F.col("id").alias("by"), ref(arg(4)).alias("parent"), F.explode(refs(arg(5))).alias("id"))
    voids = _of(inst, "IFCRELVOIDSELEMENT", "IFCRELFILLSELEMENT", by=F.col("id"), parent=ref(arg(4)), id=ref(arg(5)))
    ups = parts.unionByName(voids).groupBy("file", "id").agg(F.min_by("parent", "by").alias("parent"))
    nodes = held.join(ups, ["file", "id"], "full").select("file", "id", F.when(F.col("container").isNull(), F.col("parent")).alias("parent"), F.col("container").alias("value"))
    done = follow(nodes, lambda own, up: F.coalesce(own, up), "ifc-containers").filter("value is not null")
    return done.join(held.select("file", "id", F.lit(True).alias("direct")), ["file", "id"], "left").select("file", "id", F.col("value").alias("container"), F.coalesce("direct", F.lit(False)).alias("direct"))


def _types(inst: DataFrame) -> DataFrame:
    """(file, id, type) of what has a type object."""
    return inst.filter(F.col("class") == "IFCRELDEFINESBYTYPE").select("file", ref(arg(5)).alias("type"), F.explode(refs(arg(4))).alias("id"))


def property_sets(inst: DataFrame) -> DataFrame:
    """(file, id, psets, quantities): maps of set to map of name to value; an element's own values go before those of its type."""
    own = inst.filter(F.col("class") == "IFCRELDEFINESBYPROPERTIES").select("file", ref(arg(5)).alias("set"), F.explode(refs(arg(4))).alias("id"), F.lit(0).alias("rank"))
    of_type = inst.filter(F.col("class").rlike("(?:TYPE|STYLE)$")).select("file", F.col("id").alias("type"), F.explode(refs(arg(5))).alias("set"))
    links = own.unionByName(_types(inst).join(of_type, ["file", "type"]).select("file", "set", "id", F.lit(1).alias("rank")))
    sets = inst.filter(F.col("class").isin("IFCPROPERTYSET", "IFCELEMENTQUANTITY")).select(
        "file", F.col("id").alias("set"), text(arg(2)).alias("set_name"), (F.col("class") == "IFCPROPERTYSET").alias("is_pset"),
        F.posexplode(F.when(F.col("class") == "IFCPROPERTYSET", refs(arg(4))).otherwise(refs(arg(5)))).alias("pos", "prop"))
    values = _of(inst, "IFCPROPERTYSINGLEVALUE", prop=F.col("id"), name=text(arg(0)), value=typed_value(arg(2))).unionByName(_of(inst, *QUANTITIES, prop=F.col("id"), name=text(arg(0)), value=typed_value(arg(3))))
    filled = sets.join(values, ["file", "prop"]).filter("name is not null and set_name is not null").groupBy("file", "set", "set_name", "is_pset").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "value"))).alias("values"))
    rows = links.join(filled, ["file", "set"]).select("file", "id", "rank", "set", "set_name", "is_pset", F.explode("values").alias("v"))
    # One exchange by element serves all three groupings.
    rows = rows.repartition("file", "id").groupBy("file", "id", "is_pset", "set_name", "v.name").agg(F.min_by("v.value", F.struct("rank", -F.col("set"), -F.col("v.pos"))).alias("value"), F.min(F.struct("rank", "set", "v.pos")).alias("place"))
    maps = rows.groupBy("file", "id", "is_pset", "set_name").agg(F.array_sort(F.collect_list(F.struct("place", "name", "value"))).alias("values"))
    entry = F.struct(F.col("values")[0]["place"].alias("place"), F.col("set_name").alias("key"), F.map_from_entries(F.transform("values", lambda v: F.struct(v["name"], v["value"]))).alias("value"))
    kind = lambda keep: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(entry["place"].alias("place"), entry["key"].alias("key"), F.map_entries(entry["value"]).alias("entries"))))), lambda e: F.struct(e["key"], F.map_from_entries(e["entries"]))))
    return maps.groupBy("file", "id").agg(kind(F.col("is_pset")).alias("psets"), kind(~F.col("is_pset")).alias("quantities"))


def materials(inst: DataFrame) -> DataFrame:
    """(file, id, materials): name and description of each material, in the order of its layers; own ones before those of the type."""
    given = inst.filter(F.col("class") == "IFCRELASSOCIATESMATERIAL").select("file", ref(arg(5)).alias("top"), F.explode(refs(arg(4))).alias("id"))
    by_type = _types(inst).join(given.withColumnRenamed("id", "type"), ["file", "type"]).select("file", "top", "id", F.lit(1).alias("rank"))
    links = given.withColumn("rank", F.lit(0)).unionByName(by_type).groupBy("file", "id").agg(F.min(F.struct("rank", "top")).alias("best")).select("file", "id", F.col("best.top").alias("top"))
    inner = [F.when(F.col("class") == c, refs(arg(i))) for c, i in MATERIAL_PARTS.items()]
    edges = inst.filter(F.col("class").isin(*MATERIAL_PARTS)).select("file", F.col("id").alias("node"), F.posexplode(F.coalesce(*inner)).alias("pos", "to"))
    found = links.select("file", "top").distinct().select("file", "top", F.col("top").alias("node"), F.array().cast("array<int>").alias("path"))
    steps = [found]
    for _ in range(3):  # usage, set, layer, material
        steps.append(steps[-1].join(edges, ["file", "node"]).select("file", "top", F.col("to").alias("node"), F.concat("path", F.array("pos")).alias("path")))
    names = _of(inst, "IFCMATERIAL", node=F.col("id"), name=text(arg(0)), description=text(arg(1)))
    listed = reduce(DataFrame.unionByName, steps).join(names, ["file", "node"]).groupBy("file", "top").agg(F.array_sort(F.collect_list(F.struct("path", "name", "description"))).alias("m"))
    return links.join(listed, ["file", "top"]).select("file", "id", F.transform("m", lambda m: F.struct(m["name"].alias("name"), m["description"].alias("description"))).alias("materials"))


def shapes(inst: DataFrame, products: DataFrame) -> DataFrame:
    """(file, id, thickness, level): the width of the first rectangle that is extruded, and the height of the first solid, of each product (file, id, shape)."""
    reps = _of(inst, "IFCPRODUCTDEFINITIONSHAPE", shape=F.col("id"), reps=refs(arg(2))).select("file", "shape", F.posexplode("reps").alias("r", "rep"))
    items = _of(inst, "IFCSHAPEREPRESENTATION", rep=F.col("id"), items=refs(arg(3))).select("file", "rep", F.posexplode("items").alias("i", "node"))
    front = products.join(reps, ["file", "shape"]).join(items, ["file", "rep"]).select("file", "id", "node", F.array("r", "i").alias("path"))
    pair = F.array(F.struct(F.lit(0).alias("k"), ref(arg(1)).alias("to")), F.struct(F.lit(1).alias("k"), ref(arg(2)).alias("to")))
    cut = inst.filter(F.col("class").isin("IFCBOOLEANRESULT", "IFCBOOLEANCLIPPINGRESULT")).select("file", F.col("id").alias("node"), F.explode(pair).alias("part"))
    front = stage(front, "ifc-items")
    leaves, now = [front], front
    while True:  # a round for each level of cuts, all products at once
        now = stage(now.join(cut, ["file", "node"]).select("file", "id", F.col("part.to").alias("node"), F.concat("path", F.array("part.k")).alias("path")), "ifc-items")
        if now.isEmpty() or len(leaves) > 200:
            break
        leaves.append(now)
    leaves = reduce(DataFrame.unionByName, leaves)
    solid = _of(inst, "IFCEXTRUDEDAREASOLID", node=F.col("id"), area=ref(arg(0)), axes=ref(arg(1)))
    wide = _of(inst, "IFCRECTANGLEPROFILEDEF", area=F.col("id"), width=number(arg(3)))
    heights = _vector(inst, "IFCCARTESIANPOINT").select("file", F.col("ref").alias("point"), F.get("xyz", F.lit(2)).alias("z"))
    axes = _of(inst, "IFCAXIS2PLACEMENT3D", axes=F.col("id"), point=ref(arg(0)))
    solid = solid.join(wide, ["file", "area"], "left").join(axes, ["file", "axes"], "left").join(heights, ["file", "point"], "left").select("file", "node", F.nullif("width", F.lit(0.0)).alias("width"), "z")
    first = lambda c: F.get(refs(c), F.lit(0))
    brep = _of(inst, "IFCFACETEDBREP", node=F.col("id"), shell=first(arg(0)))
    for kind, now_, to in ((("IFCCLOSEDSHELL",), "shell", "face"), (("IFCFACE", "IFCFACESURFACE", "IFCADVANCEDFACE"), "face", "bound"), (("IFCFACEOUTERBOUND", "IFCFACEBOUND"), "bound", "loop"), (("IFCPOLYLOOP",), "loop", "point")):
        brep = brep.join(_of(inst, *kind, **{now_: F.col("id"), to: first(arg(0))}), ["file", now_]).drop(now_)
    brep = brep.join(heights, ["file", "point"]).select("file", "node", F.lit(None).cast("double").alias("width"), "z")
    first_of = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("path")))
    met = leaves.join(solid, ["file", "node"]).unionByName(front.join(brep, ["file", "node"]))
    return met.groupBy("file", "id").agg(first_of("width").alias("thickness"), first_of("z").alias("level"))


def elements(inst: DataFrame) -> DataFrame:
    """A row per product outside the spatial structure, with all that the relations say of it."""
    inst = stage(inst, "ifc-instances")
    kinds = F.create_map(*(F.lit(x) for kv in KIND_NAMES.items() for x in kv))
    is_product = F.col("class").rlike(PRODUCTS) & ~F.col("class").rlike(NOT_PRODUCTS) & ~F.col("class").isin(*SPATIAL)
    products = inst.filter(is_product).select(
        "file", "id", F.coalesce(text(arg(0)), F.lit("")).alias("global_id"), F.col("class").alias("ifc_type"), F.coalesce(F.try_element_at(kinds, "class"), F.regexp_replace("class", "^IFC", "")).alias("type"),
        F.coalesce(F.nullif(text(arg(2)), F.lit("")), F.lit(NO_NAME)).alias("name"), text(arg(3)).alias("description"), text(arg(4)).alias("object_type"),
        F.when(F.col("class").isin("IFCDOOR", "IFCWINDOW"), enum(arg(10))).otherwise(enum(arg(8))).alias("predefined_type"), ref(arg(5)).alias("placement"), ref(arg(6)).alias("shape"))
    spatial = inst.filter(F.col("class").isin(*SPATIAL)).select("file", F.col("id").alias("container"), F.struct(F.col("class").alias("ifc_type"), text(arg(2)).alias("name"), text(arg(0)).alias("global_id"), F.when(F.col("class") == "IFCBUILDINGSTOREY", number(arg(9))).alias("elevation")).alias("held"))
    within = containers(inst).join(spatial, ["file", "container"]).select("file", "id", "held", "direct")
    sized = shapes(inst, products.filter(F.col("ifc_type").isin("IFCWALL", "IFCWALLSTANDARDCASE", "IFCSLAB")).select("file", "id", "shape"))
    out = products.join(placements(inst), ["file", "placement"], "left")
    for side in (within, property_sets(inst), materials(inst), sized):
        out = out.join(side, ["file", "id"], "left")
    none = lambda kind: F.map_from_entries(F.array().cast(f"array<struct<k:string,v:{kind}>>"))
    at = lambda values, *index: F.struct(*(F.round(values[i], 2).alias(n) for n, i in zip("xyz", index, strict=True)))
    storey = F.when(F.col("direct"), F.col("held.elevation"))
    return out.select(
        "file", "id", "global_id", "ifc_type", "type", "name", "description", "object_type", "predefined_type", F.col("held").alias("container"),
        F.when(F.col("sum").isNotNull(), at(F.col("sum"), 0, 1, 2)).alias("placement"), F.when(F.col("matrix").isNotNull(), at(F.col("matrix"), 3, 7, 11)).alias("origin"), F.col("matrix").alias("transform"),
        F.coalesce("psets", none("map<string,string>")).alias("psets"), F.coalesce("quantities", none("map<string,string>")).alias("quantities"), F.coalesce("materials", F.array().cast("array<struct<name:string,description:string>>")).alias("materials"),
        F.when(F.col("ifc_type").isin("IFCWALL", "IFCWALLSTANDARDCASE"), F.col("thickness")).alias("geom_thickness"), F.when(F.col("ifc_type") == "IFCSLAB", F.coalesce("level", storey)).alias("geom_elevation"), F.col("shape").isNotNull().alias("has_geometry"))


def baseline(found: DataFrame) -> DataFrame:
    """Elements as the rules and the model comparison read them: properties of sets, then quantities, the first of a name stays; material, thickness and level fill what is open."""
    flat = F.flatten(F.transform(F.concat(F.map_values("psets"), F.map_values("quantities")), F.map_entries))
    fill = lambda name, value: F.when(value.isNotNull(), F.array(F.struct(F.lit(name).alias("key"), value.alias("value"))))
    text_of = lambda c: F.nullif(F.col(c), F.lit(0.0)).cast("string")
    extra = [fill("Material", F.get("materials", F.lit(0))["name"]), fill("Thickness", text_of("geom_thickness")), fill("Elevation", text_of("geom_elevation"))]
    entries = F.filter(F.concat(flat, *(F.coalesce(e, F.slice(flat, 1, 0)) for e in extra)), lambda e: e["value"].isNotNull())
    names = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    back = F.create_map(*(F.lit(x) for kv in RULE_KINDS.items() for x in kv))
    return found.select(
        F.col("id").alias("ord"), "file", F.col("global_id").alias("element_id"), F.coalesce(F.try_element_at(back, "type"), "ifc_type").alias("ifc_type"), "name", F.lit("ifc_parse").alias("source"), "has_geometry",
        F.lit(None).cast("string").alias("element_category"), F.map_from_entries(first).alias("properties"), F.when(F.col("container.ifc_type") == "IFCBUILDINGSTOREY", F.col("container.name")).alias("location"))


def summary(inst: DataFrame, found: DataFrame) -> DataFrame:
    """(file, type, n) of the elements, with spaces as a type of their own."""
    spaces = inst.filter(F.col("class") == "IFCSPACE").select("file", F.lit("IFCSPACE").alias("type"))
    return found.select("file", "type").unionByName(spaces).groupBy("file", "type").agg(F.count("*").alias("n"))

