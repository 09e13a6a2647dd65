"""The named rules of building models: roles, model files, delivery standard, review gate, frames and built walls."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions import geometry as G
from girder.operators import model, rules

# Layers that say what a wall is.
SHEAR_LAYER = r"S[-_]WALL(?:[-_](?:CONC|RC|SW|S))?|剪力墙|抗震墙"
ARCHITECTURAL_LAYER = r"A[-_]WALL(?:[-_](?:FIN|MASONRY|PARTITION))?|A[-_]PART(?:[-_]S)?|A[-_](?:MASONRY|后砌)|建筑墙|后砌|砌体|砌块|填充墙|隔墙"
# Parts of a model file and kinds of its elements.
TOP_KEYS = ("project", "grid", "model_elements")
ELEMENT_TYPES = ("Wall", "Column", "Beam", "Floor", "Slab")


def wall_role(layers: Column) -> Column:
    """What the source layers of a wall say of it; none, or both kinds, leave it unresolved.

    Of a layer drawn in from another file only the name after the last ``$0$`` and ``|`` counts.
    """
    leaf = F.transform(layers, lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?s)^.*(?:\$0\$|\|)", "")))
    is_ = lambda pattern: F.coalesce(F.exists(leaf, lambda x: x.rlike(rf"(?iu)\A(?:{pattern})\z")), F.lit(False))
    shear, other = is_(SHEAR_LAYER), is_(ARCHITECTURAL_LAYER)
    return F.when(shear & ~other, "shear_wall").when(other & ~shear, "architectural_wall").otherwise("unresolved")


def element_xy(element: Column) -> Column:
    """(x, y) of an element's JSON: its own, else its placement's, else its start's, else its end's (objects or lists of two and more).

    Only numbers count; each coordinate is looked for by itself.
    """
    v = F.try_parse_json(element)

    def number(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double"))

    def listed(key: str, i: int) -> Column:
        return F.when(F.try_variant_get(v, f"$.{key}[1]", "variant").isNotNull(), number(f"$.{key}[{i}]"))

    def first(name: str, i: int) -> Column:
        ends = [c for key in ("start", "end") for c in (number(f"$.{key}.{name}"), listed(key, i))]
        return F.coalesce(number(f"$.{name}"), number(f"$.placement.{name}"), *ends)

    return F.struct(first("x", 0).alias("x"), first("y", 1).alias("y"))


def ir_issues(data: Column) -> Column:
    """what a model file (JSON text) lacks, in order; an empty array passes it, and null or broken text lacks everything."""
    at = F.get_json_object
    keys = lambda part: F.coalesce(F.json_object_keys(part), F.array().cast("array<string>"))
    empty = lambda c: c.isNull() | c.isin("[]", "{}", "", "0", "0.0", "false")
    top, project = keys(data), keys(at(data, "$.project"))
    elements = F.coalesce(F.from_json(at(data, "$.model_elements"), "array<string>"), F.array().cast("array<string>"))

    def of(e: Column, i: Column) -> Column:
        kind, name = at(e, "$.type"), F.concat(F.lit("model_elements["), i.cast("string"), F.lit("]"))
        known = F.coalesce(kind.isin(*ELEMENT_TYPES), F.lit(False))
        ends, place = empty(at(e, "$.start")) | empty(at(e, "$.end")), at(e, "$.x").isNull() | at(e, "$.y").isNull()
        return (
            F.when(~known, F.concat(name, F.lit(" 未知类型: "), F.coalesce(kind, F.lit("None"))))
            .when((kind == "Wall") & ends, F.concat(name, F.lit(" 墙缺 start/end"))).when((kind == "Column") & place, F.concat(name, F.lit(" 柱缺 x/y")))
        )

    whole = [
        *(F.when(~F.array_contains(top, k), F.lit(f"缺少顶层字段: {k}")) for k in TOP_KEYS),
        *(F.when(~F.array_contains(project, k), F.lit(f"project 缺少 {k}")) for k in ("units", "levels")),
        F.when(empty(at(data, "$.grid.x_axes")) & empty(at(data, "$.grid.y_axes")), F.lit("grid 为空（无轴网）")),
        F.when(F.size(elements) == 0, F.lit("model_elements 为空（无构件）")),
    ]
    return F.array_compact(F.concat(F.array(*whole), F.transform(elements, of)))


@dataclass(frozen=True)
class Standard:
    """what a delivery must hold."""

    units: str = "m"
    level: bool = True
    source_refs: bool = True
    quantities: bool = True
    instance_parameters: bool = True
    classification_code: bool = False
    material: bool = False


def delivery_violations(models: DataFrame, elements: DataFrame, standard: Standard = Standard()) -> DataFrame:
    """every rule broken by a model or an element: (model_id, kind_ord, ord, rule_ord, element_id, code), to be read in that order.

    models: model_id, units, coordinate_origin, transform_steps, level_id.  elements: model_id, kind (Wall, Column, Beam),
    ord (within its kind), element_id, level_id, source_refs, has_quantities, construction (category, type_name,
    classification_code, material_name).  An id counts as repeated from its second use on, across all kinds.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    c, none = F.col("construction"), F.col("construction").isNull()
    kind_ord = F.when(F.col("kind") == "Wall", 0).when(F.col("kind") == "Column", 1).otherwise(2)

    def broken(checks: dict[str, Column]) -> Column:
        return F.explode(F.array_compact(F.array(*(F.when(hit, F.struct(F.lit(i).alias("rule_ord"), F.lit(code).alias("code"))) for i, (code, hit) in enumerate(checks.items())))))

    of_model = {
        "units_must_be_m": ~F.col("units").eqNullSafe(F.lit(standard.units)), "missing_coordinate_origin": blank(F.col("coordinate_origin")),
        "missing_transform_chain": F.coalesce("transform_steps", F.lit(0)) == 0, "missing_level": F.lit(standard.level) & blank(F.col("level_id")),
    }
    of_element = {
        "duplicate_element_id": F.col("_use") > 1, "missing_source_refs": F.lit(standard.source_refs) & (F.coalesce(F.size("source_refs"), F.lit(0)) <= 0),
        "level_mismatch": F.lit(standard.level) & ~F.col("level_id").eqNullSafe(F.col("_level")), "missing_quantities": F.lit(standard.quantities) & ~F.coalesce("has_quantities", F.lit(False)),
        "missing_construction_info": F.lit(standard.instance_parameters) & none, "construction_category_mismatch": ~none & ~c["category"].eqNullSafe(F.col("kind")),
        "missing_type_name": F.lit(standard.instance_parameters) & ~none & blank(c["type_name"]), "missing_classification_code": F.lit(standard.classification_code) & ~none & blank(c["classification_code"]),
        "missing_material": F.lit(standard.material) & ~none & (F.coalesce(c["material_name"], F.lit("")) == ""),
    }
    out = ("model_id", "kind_ord", "ord", "element_id", "r.rule_ord", "r.code")
    whole = models.select("model_id", F.lit(-1).alias("kind_ord"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("element_id"), broken(of_model).alias("r")).select(*out)
    use = F.row_number().over(Window.partitionBy("model_id", "element_id").orderBy("kind_ord", "ord"))
    rows = elements.withColumn("kind_ord", kind_ord).withColumn("_use", use).join(models.select("model_id", F.col("level_id").alias("_level")), "model_id")
    parts = rows.select("model_id", "kind_ord", F.col("ord").cast("long").alias("ord"), F.col("element_id").cast("string").alias("element_id"), broken(of_element).alias("r")).select(*out)
    return whole.unionByName(parts)


def gate_facts(models: DataFrame, walls: DataFrame, columns: DataFrame, beams: DataFrame) -> DataFrame:
    """Per model what the gate asks of its elements, added to the counts that ``models`` brings.

    walls: model_id, confidence, evidence_ids, source_refs, specification_status.  columns: model_id, width_m, depth_m,
    source_refs, specification_status.  beams: model_id, specification_status, elevation_status.
    """
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    lacks = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    conflict = n(F.col("specification_status") == "conflict")
    w = walls.groupBy("model_id").agg(F.count("*").alias("walls"), n(lacks("evidence_ids") | lacks("source_refs")).alias("untraced"), F.min(F.coalesce("confidence", F.lit(0.0))).alias("least_confidence"), conflict.alias("_cw"))
    sound = F.coalesce((F.col("width_m") > 0) & (F.col("depth_m") > 0), F.lit(False)) & ~lacks("source_refs")
    c = columns.groupBy("model_id").agg(n(~sound).alias("bad_columns"), conflict.alias("_cc"))
    b = beams.groupBy("model_id").agg(conflict.alias("_cb"), n(F.col("elevation_status") == "conflict").alias("elevation_conflicts"))
    out = models.join(w, "model_id", "left").join(c, "model_id", "left").join(b, "model_id", "left").na.fill(0, ["walls", "untraced", "bad_columns", "elevation_conflicts", "_cw", "_cc", "_cb"])
    return out.withColumn("spec_conflicts", F.col("_cw") + F.col("_cc") + F.col("_cb")).drop("_cw", "_cc", "_cb")


def review_gate(facts: DataFrame, min_confidence: float, max_dangling: float, grid_required: bool = True) -> DataFrame:
    """The twelve checks of a model, the names of those that fail, and pass or fail.

    facts: as of ``gate_facts``, with evidence_count, dangling_ratio, error_count, vertical_grids, horizontal_grids,
    wall_collisions and column_collisions.  Violations of the delivery standard are reported apart.
    """
    zero = lambda c: F.col(c) == 0
    checks = {
        "wall_evidence_present": F.col("evidence_count") > 0, "model_walls_present": F.col("walls") > 0, "all_walls_traceable": zero("untraced"),
        "all_walls_confident": F.col("least_confidence").isNull() | (F.col("least_confidence") >= min_confidence), "topology_within_limit": F.col("dangling_ratio") <= max_dangling,
        "source_diagnostics_have_no_errors": zero("error_count"), "column_geometry_valid": zero("bad_columns"),
        "grid_present_when_required": F.lit(not grid_required) | ((F.col("vertical_grids") >= 2) & (F.col("horizontal_grids") >= 2)),
        "wall_collision_free": zero("wall_collisions"), "wall_column_collision_free": zero("column_collisions"), "specification_conflicts_free": zero("spec_conflicts"), "beam_elevation_conflicts_free": zero("elevation_conflicts"),
    }
    out = rules.model_checks(facts, checks)
    failed = F.filter(F.array(*map(F.lit, checks)), lambda k: ~F.try_element_at("checks", k))
    return out.withColumn("errors", failed).withColumn("status", F.when(F.col("passed"), "pass").otherwise("fail"))


def frame_issues(sources: DataFrame, pages: DataFrame, entities: DataFrame, offsets: DataFrame, paged: bool) -> DataFrame:
    """(issue, id) of entities and offsets that name no frame of the sources; none means that the registry is sound.

    sources: source_id.  pages: source_id, page_no (those that were read; only of paged sources).  entities: entity_id,
    source_id, page_no, frame_id.  offsets: frame_id.  A frame is a source, or of paged ones also ``source:page:0001``.
    """
    page = lambda: F.concat(F.col("source_id"), F.lit(":page:"), F.lpad(F.col("page_no").cast("string"), 4, "0"))
    known = sources.select("source_id").distinct()
    emitted = pages.join(known, "source_id", "left_semi").select(page().alias("frame_id")).distinct()
    e = entities.join(known.withColumn("_known", F.lit(True)), "source_id", "left").withColumn("_frame", page() if paged else F.col("source_id"))
    actual = F.coalesce(F.when(F.col("frame_id") != "", F.col("frame_id")), F.col("_frame"))
    e = e.join(emitted.select(F.col("frame_id").alias("_frame"), F.lit(True).alias("_read")), "_frame", "left")
    issue = F.when(F.col("_known").isNull(), "unknown_source").when(F.lit(paged) & F.col("page_no").isNull(), "page_missing").when(F.lit(not paged) & F.col("page_no").isNotNull(), "page_not_allowed")
    issue = issue.when(actual != F.col("_frame"), "frame_differs").when(F.lit(paged) & F.col("_read").isNull(), "page_not_read")
    frames = known.select(F.col("source_id").alias("frame_id"))
    stray = offsets.select("frame_id").distinct().join(frames.unionByName(emitted) if paged else frames, "frame_id", "left_anti")
    return e.withColumn("issue", issue).filter("issue IS NOT NULL").select("issue", F.col("entity_id").alias("id")).unionByName(stray.select(F.lit("offset_unknown").alias("issue"), F.col("frame_id").alias("id")))


def built_states(walls: DataFrame, built: DataFrame, keys: list[str], position: float = 50.0, angle: float = 0.1, thickness: float = 10.0, most: int = 200) -> DataFrame:
    """Walls of a model against those built (both: keys, ord, id, x1, y1, x2, y2 in m, thickness in mm): one row each, and one per wall built without cause.

    Status built, mismatch, missing or extra; errors in mm and degrees off the nearest axis; the repair it calls for
    (create, update, review_delete) for the first ``most`` of the keys in order, walls before extras; ``truncated`` beyond.
    """
    pairs = model.match_built(walls.drop("ord"), built.drop("ord"), keys).select(*keys, "id", "built_id")
    b = built.select(*keys, F.col("id").alias("built_id"), F.col("ord").alias("b_ord"), *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2", "thickness")))
    m = walls.join(pairs, [*keys, "id"], "left").join(b, [*keys, "built_id"], "left")
    d = lambda p, q: G.hypot(F.col(f"x{p}") - F.col(f"b_x{q}"), F.col(f"y{p}") - F.col(f"b_y{q}"))
    off = F.pmod(F.degrees(F.atan2(F.col("b_y2") - F.col("b_y1"), F.col("b_x2") - F.col("b_x1"))), F.lit(90.0))
    m = m.withColumns({"position_error": 1000 * F.least(F.greatest(d(1, 1), d(2, 2)), F.greatest(d(1, 2), d(2, 1))), "axis_deviation": F.least(off, 90 - off), "thickness_error": F.abs(F.coalesce("b_thickness", F.lit(0.0)) - F.coalesce("thickness", F.lit(0.0)))})
    found = F.col("b_ord").isNotNull()
    issues = F.array_compact(F.array(F.when(F.col("position_error") > position, F.lit("position_mismatch")), F.when(F.col("axis_deviation") > angle, F.lit("angle_mismatch")), F.when(F.col("thickness_error") > thickness, F.lit("thickness_mismatch"))))
    m = m.withColumn("issues", F.when(found, issues).otherwise(F.array(F.lit("revit_element_missing")))).withColumn("thickness_error", F.when(found, F.col("thickness_error")))
    m = m.withColumn("status", F.when(~found, "missing").when(F.size("issues") > 0, "mismatch").otherwise("built")).withColumn("_part", F.lit(0))
    extra = b.join(pairs, [*keys, "built_id"], "left_anti").select(*keys, "built_id", F.col("b_ord").alias("ord"), F.array(F.lit("unexpected_revit_wall")).alias("issues"), F.lit("extra").alias("status"), F.lit(1).alias("_part"))
    out = m.select(*keys, "ord", "id", "built_id", "status", "issues", "position_error", "axis_deviation", "thickness_error", "_part").unionByName(extra, allowMissingColumns=True)
    calls = F.when(F.col("status") == "missing", "create").when(F.col("status") == "mismatch", "update").when(F.col("status") == "extra", "review_delete")
    nth = F.count(calls).over(Window.partitionBy(*keys).orderBy("_part", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumn("truncated", calls.isNotNull() & (nth > most))
    return out.withColumn("repair", F.when(~F.col("truncated"), calls)).drop("_part")


def _without_flat(ring: np.ndarray, tolerance: float) -> np.ndarray:
    while len(ring) > 3:
        before, chord = np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - np.roll(ring, 1, axis=0)
        square = (chord**2).sum(axis=1)
        long = square > tolerance * tolerance
        share = ((ring - before) * chord).sum(axis=1) / np.where(long, square, 1.0)
        away = np.hypot(*(ring - before - share[:, None] * chord).T)
        flat = long & (share >= 0) & (share <= 1) & (away <= tolerance)
        if not flat.any() or len(ring) - flat.sum() < 3:
            break
        ring = ring[~flat]
    return ring


def simplified_profile(points: Column, tolerance: float = 1.0) -> Column:
    """A closed outline without the vertices that lie on the chord of their neighbours, dropped together, round after
    round; a round that would leave fewer than three is not taken.  Points are array<struct<x:double,y:double>>; null stays null."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(outlines: pd.Series) -> pd.Series:
        def one(points):
            if points is None:
                return None
            ring = _without_flat(np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2), tolerance)
            return [{"x": x, "y": y} for x, y in ring.tolist()]

        return outlines.map(one)

    return run(points)
