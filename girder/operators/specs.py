"""Specifications in drawing texts: dimensions, marks, levels, scales, schedules, and their ties to elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions import geometry as G
from girder.functions.text import SPACE, contains_any
from girder.operators import spatial
from girder.plans.tables import fit_for_broadcast

#: Marks such as Q1, KZ-2, LL12a.
MARK = r"(?<![A-Z0-9])((?:LL|KL|KZ|XZ|GZ|YBZ|GBZ|Q|W)\s*-?\s*\d+[A-Z]?)(?![0-9])"
SIZES = r"(\d{2,5}(?:\.\d+)?)\s*[xX×*]\s*(\d{2,5}(?:\.\d+)?)"
SCALE = r"1\s*[:：]\s*(\d{2,4})(?!\d)"
# Words of component kinds, of where a text stands, and of plan titles.
BEAM_WORDS, COLUMN_WORDS, WALL_WORDS = ("梁", "BEAM"), ("柱", "截面", "COLUMN"), ("墙", "剪力", "WALL", "厚度")
DETAIL_WORDS, SCHEDULE_WORDS, LEGEND_WORDS = ("大样", "详图", "DETAIL", "SECTION"), ("构件表", "柱表", "墙表", "SCHEDULE", "明细表"), ("图例", "LEGEND", "说明", "标准")
PLAN_WORDS = ("平面图", "PLAN")
SOURCE_ORDER = ("detail", "schedule", "legend", "annotation")


def mark(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(F.upper(text), MARK, 1), rf"{SPACE}+", ""), F.lit(""))


def component_kind(text: Column, m: Column) -> Column:
    up = F.upper(text)
    starts = lambda *ps: F.coalesce(m.rlike("^(?:" + "|".join(ps) + ")"), F.lit(False))
    return F.when(starts("LL", "KL") | contains_any(up, BEAM_WORDS), "beam").when(starts("KZ", "XZ", "GZ", "YBZ", "GBZ") | contains_any(up, COLUMN_WORDS), "column").when(contains_any(up, WALL_WORDS) | starts("Q", "W"), "wall").otherwise("unknown")


def source_kind(text: Column) -> Column:
    up = F.upper(text)
    return F.when(contains_any(up, DETAIL_WORDS), "detail").when(contains_any(up, SCHEDULE_WORDS), "schedule").when(contains_any(up, LEGEND_WORDS), "legend").otherwise("annotation")


def compact_split(digits: Column) -> Column:
    """Six to eight digits as two sizes of 3 or more digits within 100..5000, the widest first one; null if none fits."""
    cut = lambda i: F.struct(F.substring(digits, F.lit(1), i).cast("double").alias("a"), F.substr(digits, i + 1).cast("double").alias("b"))
    pairs = F.filter(F.transform(F.sequence(F.lit(3), F.greatest(F.length(digits) - 3, F.lit(3))), cut), lambda p: p["a"].between(100, 5000) & p["b"].between(100, 5000))
    return F.when(digits.rlike(r"^\d{6,8}$"), F.array_max(pairs))


def dimensions(text: Column, kind: Column, m: Column) -> Column:
    """struct(width, depth, thickness) in mm by the kind's rule, null without: walls 50..2000 thick; beams the
    smaller as width; columns the larger as width, compact digits split with the widest first value."""
    a, b = (F.nullif(F.regexp_extract(text, SIZES, i), F.lit("")).cast("double") for i in (1, 2))
    rest = F.regexp_replace(F.regexp_replace(F.upper(text), MARK, ""), r"（[^（）]*）|\([^()]*\)|^[ :：=-]+|[ :：=-]+$", "")
    explicit = F.nullif(F.regexp_extract(text, r"(?:墙厚|厚度|厚)\s*[:：=]?\s*(\d{2,4}(?:\.\d+)?)", 1), F.lit(""))
    compact_wall = F.when(m.isNotNull() & rest.rlike(r"^\s*\d{2,4}(?:\.\d+)?\s*(?:MM|毫米)?\s*$"), F.regexp_extract(rest, r"(\d{2,4}(?:\.\d+)?)", 1))
    thick = F.coalesce(explicit, compact_wall).cast("double")
    null = F.lit(None).cast("double")
    make = lambda w, d, t: F.struct(w.alias("width"), d.alias("depth"), t.alias("thickness"))
    split = compact_split(F.regexp_replace(rest, rf"{SPACE}+", ""))
    column = F.when(a.between(100, 5000) & b.between(100, 5000) & (m.isNotNull() | F.contains(text, F.lit("截面"))), make(F.greatest(a, b), F.least(a, b), null)).when(split.isNotNull(), make(F.greatest(split["a"], split["b"]), F.least(split["a"], split["b"]), null))
    return F.when((kind == "wall") & thick.between(50, 2000), make(null, null, thick)).when((kind == "beam") & m.isNotNull() & a.between(50, 2000) & b.between(50, 5000), make(F.least(a, b), F.greatest(a, b), null)).when(kind == "column", column)


def parse_specs(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with mark, kind, source_kind and dims, only those that give dimensions."""
    out = rows.withColumn("mark", mark(F.col(text))).withColumn("kind", component_kind(F.col(text), F.col("mark")))
    return out.withColumn("source_kind", source_kind(F.col(text))).withColumn("dims", dimensions(F.col(text), F.col("kind"), F.col("mark"))).filter(F.col("dims").isNotNull())


def resolve_specs(elements: DataFrame, specs: DataFrame, keys: list[str], reach: float, element_id: str = "element_id") -> DataFrame:
    """The specification of each element: nearby ones of its kind, and all with its mark; the best source
    per (mark, dims); several dimension signatures are a conflict.

    elements: keys, id, kind, mark, x, y.  specs: keys, kind, mark, source_kind, dims, x, y.
    """
    rank = F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source_kind"))
    s = specs.select(*keys, F.col("kind").alias("s_kind"), F.col("mark").alias("s_mark"), "source_kind", "dims", F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = spatial.near_points(elements, s, keys, reach).filter((F.col("kind") == F.col("s_kind")) & (F.col("mark").isNull() | F.col("s_mark").eqNullSafe(F.col("mark")))).select(element_id, "s_mark", "source_kind", "dims", "distance")
    # A mark's specifications are summed up before its elements meet them: repeated ones would meet each of those.
    of_mark = s.filter(F.col("s_mark").isNotNull()).groupBy(F.col("s_kind").alias("kind"), F.col("s_mark").alias("mark"), "dims").agg(F.min_by("source_kind", rank).alias("source_kind"))
    marked = elements.filter(F.col("mark").isNotNull()).select(element_id, "kind", "mark").join(of_mark, ["kind", "mark"]).select(element_id, F.col("mark").alias("s_mark"), "source_kind", "dims", F.lit(None).cast("double").alias("distance"))
    best = near.unionByName(marked).groupBy(element_id, "s_mark", "dims").agg(F.min_by("source_kind", rank).alias("source_kind"), F.min("distance").alias("distance"))
    out = best.groupBy(element_id).agg(F.count_distinct("dims").alias("signatures"), F.min_by(F.struct("dims", "source_kind", "s_mark"), F.struct(F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source_kind")), F.coalesce("distance", F.lit(1e18)))).alias("spec"))
    return elements.join(out, element_id, "left").withColumn("spec_status", F.when(F.col("signatures").isNull(), "missing").when(F.col("signatures") > 1, "conflict").otherwise("matched"))


def level_from_texts(name: Column, notes: Column) -> Column:
    """Array of struct(name, elevation) in metres: a reference elevation in the notes, else the title's number, else its floor, else one level."""
    hinted = F.filter(notes, lambda t: t.rlike(r"[+-]?\s*[0-9]+(?:\.[0-9]+)?\s*m") & (contains_any(t, ("标高", "参照", "零点")) | F.contains(F.lower(t), F.lit("hh"))))
    reference = F.regexp_replace(F.regexp_extract(F.get(hinted, F.lit(0)), r"([+-]?\s*[0-9]+(?:\.[0-9]+)?)\s*m", 1), r"\s", "").try_cast("double")
    titled = F.regexp_extract(name, r"标高\s*([0-9.]+)", 1).try_cast("double").cast("int")
    digits = F.coalesce(F.regexp_extract(F.upper(name), r"([0-9]+)F[-_]?AR", 1).try_cast("int"), F.regexp_extract(name, r"([0-9]+)层", 1).try_cast("int"), F.nullif(F.instr(F.lit("一二三四五六七八九十"), F.nullif(F.regexp_extract(name, "([一二三四五六七八九十])层", 1), F.lit(""))), F.lit(0)))
    level = lambda n, e: F.struct(n.alias("name"), e.cast("double").alias("elevation"))
    zero, first = F.lit(0.0), F.lit("标高1")
    with_reference = F.when(reference != 0, F.array(level(first, zero), level(F.concat(F.lit("标高"), F.coalesce(digits, F.lit(2)).cast("string")), reference))).otherwise(F.array(level(first, zero)))
    return F.when(reference.isNotNull(), with_reference).when(titled.isNotNull(), F.array(level(F.concat(F.lit("标高"), titled.cast("string")), zero))).when(digits.isNotNull(), F.array(level(F.concat(digits.cast("string"), F.lit("F-AR")), zero))).otherwise(F.array(level(first, zero)))


def drawing_scale(texts: DataFrame, keys: list[str], reach: float = 180.0) -> DataFrame:
    """The scale of each file by its best-titled text, then by how often it is written (5 at most); equal leaders fail.

    texts: keys, frame_id, text_id, text, x, y.
    """
    found = texts.withColumn("scale", F.explode(F.transform(F.regexp_extract_all(F.upper("text"), F.lit(SCALE), F.lit(1)), lambda x: x.cast("int")))).filter(F.col("scale").between(10, 2000))
    other = texts.select(*keys, "frame_id", F.upper("text").alias("near"), F.col("text_id").alias("near_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    around = spatial.near_points(found, other, [*keys, "frame_id"], reach).groupBy(*keys, "text_id", "scale").agg(F.concat_ws(" ", F.collect_list("near")).alias("context"))
    primary = contains_any(F.col("context"), ("MAIN PLAN",)) | F.col("context").rlike("[B0-9一二三四五六七八九十]+层.{0,12}平面")
    score = 1 + F.when(contains_any(F.col("context"), PLAN_WORDS), 5).otherwise(0) + F.when(primary, 6).otherwise(0) - F.when(contains_any(F.col("context"), DETAIL_WORDS), 3).otherwise(0)
    ranked = around.withColumn("score", score).groupBy(*keys, "scale").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc(F.least("n", F.lit(5))))
    top = ranked.withColumn("place", F.rank().over(order)).filter("place = 1")
    out = top.groupBy(*keys).agg(F.count("*").alias("leaders"), F.min("scale").alias("scale"))
    return out.withColumn("status", F.when(F.col("leaders") > 1, "ambiguous").otherwise("ok"))


def opening_schedule(rows: DataFrame, keys: list[str], alignment: float, search: float, mark_pattern: str = "^[A-Z]+-?[0-9]+$") -> DataFrame:
    """(keys, mark, width, height, sill) from tables with a header row of mark, size and sill, upright or rotated.

    A cell shares a row with its mark and a column with its header; rows are told
    apart by at most 0.4 of the nearest row's distance; exactly one size and one sill.
    rows: keys, row_id, text, x, y.
    """
    clean = F.replace(F.replace(F.regexp_replace("text", rf"{SPACE}+", ""), F.lit("−"), F.lit("-")), F.lit("±"), F.lit("+"))
    size = r"^(\d+(?:\.\d+)?)[xX×*](\d+(?:\.\d+)?)$"
    elevation = r"^([+-]?\d+(?:\.\d+)?)(mm|毫米|m|米)?$"
    t = rows.withColumn("t", clean)
    role = F.when(F.col("t").isin("洞口编号", "墙洞编号"), "h_mark").when(F.col("t").isin("洞口尺寸", "宽x高", "宽×高", "洞口宽x高"), "h_size").when(F.col("t").isin("洞底标高", "洞口底标高"), "h_sill").when(F.upper("t").rlike(mark_pattern), "mark").when(F.col("t").rlike(size), "size").when(F.col("t").rlike(elevation), "sill")
    # Both orientations at once: u runs along the header row, v across it.
    turned = t.withColumn("role", role).filter(F.col("role").isNotNull()).withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("u", F.when(F.col("turn") == 0, F.col("x")).otherwise(F.col("y"))).withColumn("v", F.when(F.col("turn") == 0, F.col("y")).otherwise(F.col("x")))
    part = lambda r: turned.filter(F.col("role") == r).select(*keys, "turn", F.col("row_id").alias(f"{r}_id"), F.col("t").alias(f"{r}_t"), F.col("u").alias(f"{r}_u"), F.col("v").alias(f"{r}_v"))
    on = [*keys, "turn"]
    apart = lambda a, b: F.abs(F.col(a) - F.col(b))
    heads = part("h_mark").join(part("h_size"), on).join(part("h_sill"), on)
    heads = heads.filter((apart("h_size_v", "h_mark_v") <= 2 * alignment) & (apart("h_sill_v", "h_mark_v") <= 2 * alignment) & (F.least(apart("h_size_u", "h_mark_u"), apart("h_sill_u", "h_size_u"), apart("h_sill_u", "h_mark_u")) > 2 * alignment))
    within = lambda c: G.hypot(F.col(f"{c}_u") - F.col("h_mark_u"), F.col(f"{c}_v") - F.col("h_mark_v")) <= search
    marks = heads.join(part("mark"), on).filter(within("mark") & (apart("mark_u", "h_mark_u") <= alignment))
    w = Window.partitionBy(*on, "h_mark_id", "h_size_id", "h_sill_id").orderBy("mark_v")
    gap = F.least(F.col("mark_v") - F.lag("mark_v").over(w), F.lead("mark_v").over(w) - F.col("mark_v"))
    marks = marks.withColumn("slack", F.least(F.lit(alignment), F.coalesce(gap * 0.4, F.lit(alignment))))

    def cells(kind: str) -> DataFrame:
        hit = marks.join(part(kind), on).filter(within(kind) & (apart(f"{kind}_u", f"h_{kind}_u") <= 1.5 * alignment) & (apart(f"{kind}_v", "mark_v") <= F.col("slack")))
        return hit.groupBy(*on, "h_mark_id", "h_size_id", "h_sill_id", "mark_id", "mark_t").agg(F.count("*").alias("n"), F.first(f"{kind}_t").alias(kind)).filter("n = 1").drop("n")

    both = cells("size").join(cells("sill"), [*on, "h_mark_id", "h_size_id", "h_sill_id", "mark_id", "mark_t"])
    unit = F.lower(F.regexp_extract("sill", elevation, 2))
    out = both.select(*keys, F.upper("mark_t").alias("mark"), F.regexp_extract("size", size, 1).cast("double").alias("width"), F.regexp_extract("size", size, 2).cast("double").alias("height"), (F.regexp_extract("sill", elevation, 1).cast("double") / F.when(unit.isin("mm", "毫米"), 1000).otherwise(1)).alias("sill"))
    return out.filter(F.col("width").between(50, 20000) & F.col("height").between(50, 20000) & (F.abs("sill") <= 1000)).distinct()


def opening_cuts(openings: DataFrame, specs: DataFrame) -> DataFrame:
    """The one (width, height, sill) of each opening's mark, else review_required; a configured sill (sill_override) wins."""
    s = specs.groupBy("mark").agg(F.count_distinct("width", "height", "sill").alias("n"), F.min(F.struct("width", "height", "sill")).alias("s"))
    out = openings.join(s, "mark", "left")
    ok = F.col("n") == 1
    return out.select(*openings.columns, F.when(ok, F.col("s.width")).alias("width"), F.when(ok, F.col("s.height")).alias("height"), F.coalesce("sill_override", F.when(ok, F.col("s.sill"))).alias("sill"), F.when(ok, "matched").otherwise("review_required").alias("status"))


def beam_elevations(beams: DataFrame, evidence: DataFrame, reach: float, level_top: Column | None = None) -> DataFrame:
    """Top and base of each beam: marked evidence counts across sheets, unmarked only nearby in its frame;
    more than one value per reference is a conflict; a missing side follows from the depth; both must agree within 5 mm.

    beams: beam_id, mark, frame_id, x, y, depth.  evidence: mark, frame_id, x, y, reference (top, base), value.
    """
    by_mark = beams.filter(F.col("mark").isNotNull()).select("beam_id", "mark").join(evidence.filter(F.col("mark").isNotNull()).select("mark", "reference", "value"), "mark").select("beam_id", "reference", "value")
    loose = evidence.filter(F.col("mark").isNull()).select("frame_id", "reference", "value", F.col("x").alias("rx"), F.col("y").alias("ry"))
    nearby = spatial.near_points(beams, loose, ["frame_id"], reach).select("beam_id", "reference", "value")
    each = by_mark.unionByName(nearby).groupBy("beam_id").pivot("reference", ["top", "base"]).agg(F.count_distinct("value").alias("n"), F.min("value").alias("v"))
    out = beams.join(each, "beam_id", "left")
    clash = (F.coalesce("top_n", F.lit(0)) > 1) | (F.coalesce("base_n", F.lit(0)) > 1) | F.coalesce(F.abs(F.col("top_v") - F.col("base_v") - F.col("depth")) > 0.005, F.lit(False))
    top = F.coalesce(F.col("top_v"), F.col("base_v") + F.col("depth"), *([level_top] if level_top is not None else []))
    return out.select(*beams.columns, F.when(~clash, top).alias("top"), F.when(~clash, F.coalesce(F.col("base_v"), top - F.col("depth"))).alias("base"), F.when(clash, "conflict").when(top.isNull(), "missing").otherwise("matched").alias("status"))


def best_layers(layers: DataFrame, profiles: DataFrame, roles: DataFrame) -> DataFrame:
    """Per drawing the profile with the most keywords in its layers (the first on ties), then per role the
    profile's layer, else the shortest layer that holds a keyword.

    layers: drawing_id, layer.  profiles: profile, ord, keyword, role.  roles: role, keyword.
    """
    low = layers.select("drawing_id", "layer", F.lower("layer").alias("_l"))
    hit = low.join(fit_for_broadcast(profiles), F.contains("_l", F.lower("keyword")))
    count = hit.groupBy("drawing_id", "profile").agg(F.count_distinct("keyword").alias("n"), F.min("ord").alias("ord"))
    best = count.groupBy("drawing_id").agg(F.max_by("profile", F.struct(F.col("n"), (-F.col("ord")).alias("o"))).alias("profile"))
    shortest = lambda df: df.groupBy("drawing_id", "role").agg(F.min_by("layer", F.struct(F.length("layer"), "layer")).alias("layer"))
    first = shortest(hit.join(best, ["drawing_id", "profile"])).withColumnRenamed("layer", "by_profile")
    second = shortest(low.join(fit_for_broadcast(roles), F.contains("_l", F.lower("keyword")))).withColumnRenamed("layer", "by_keyword")
    return first.join(second, ["drawing_id", "role"], "full").select("drawing_id", "role", F.coalesce("by_profile", "by_keyword").alias("layer"))


def main_plan(plans: DataFrame, floor_hint: Column | None = None) -> DataFrame:
    """Per drawing the one placed block named a floor plan, else a wall and column plan, no mezzanine; else an error status."""
    named = plans.filter(~F.contains("name", F.lit("夹层")))
    if floor_hint is not None:
        named = named.filter(F.contains("name", floor_hint))
    rank = F.when(F.col("name").rlike("平面图|层平面"), 0).when(F.col("name").rlike("墙柱"), 1)
    first = named.withColumn("rank", rank).filter(F.col("rank").isNotNull()).withColumn("best", F.min("rank").over(Window.partitionBy("drawing_id"))).filter("rank = best")
    out = first.groupBy("drawing_id").agg(F.count("*").alias("n"), F.min("plan_id").alias("plan_id"))
    return plans.select("drawing_id").distinct().join(out, "drawing_id", "left").select("drawing_id", F.when(F.col("n") == 1, F.col("plan_id")).alias("plan_id"), F.when(F.col("n") == 1, "ok").otherwise("ambiguous_or_missing").alias("status"))
