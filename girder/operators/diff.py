"""Comparing models: differences by id, by name within tolerances, and findings injected into elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions import domain as D


def flatten_properties(sets: Column, quantities: Column, materials: Column | None = None) -> Column:
    """Property sets, then quantities, the last one of a name wins; Material is the joined materials.

    sets, quantities: map<set, map<name, value>>.  Last-wins is built by dropping
    earlier entries, so it does not depend on the session's map policy.
    """
    entries = F.flatten(F.transform(F.concat(F.coalesce(F.map_values(sets), F.array()), F.coalesce(F.map_values(quantities), F.array())), F.map_entries))
    if materials is not None:
        joined = F.array_join(F.filter(materials, lambda m: m != ""), "、")
        entries = F.concat(entries, F.when(F.size(materials) > 0, F.array(F.struct(F.lit("Material").alias("key"), joined.alias("value")))).otherwise(F.slice(entries, 1, 0)))
    names = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), e["key"]))
    return F.map_from_entries(last)


def model_diff(baseline: DataFrame, built: DataFrame) -> DataFrame:
    """(element_id, kind, prop) of every difference: missing, extra, type, name, property, location.

    Both sides: element_id, ifc_type, name, properties map<string,string>, location;
    duplicate ids of the built side were reduced to the last before (latest).
    """
    b = baseline.select("element_id", F.struct("ifc_type", "name", "properties", "location").alias("b"))
    a = built.filter(F.col("element_id").isNotNull()).select("element_id", F.struct("ifc_type", "name", "properties", "location").alias("a"))
    both = b.join(a, "element_id", "full")
    one = lambda kind, prop=None: F.struct(F.lit(kind).alias("kind"), (prop if prop is not None else F.lit("")).alias("prop"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    met = F.col("a").isNotNull() & F.col("b").isNotNull()
    simple = F.array_compact(F.array(
        F.when(F.col("a").isNull(), one("missing")), F.when(F.col("b").isNull(), one("extra")),
        F.when(met & (F.upper(blank(F.col("b.ifc_type"))) != F.upper(blank(F.col("a.ifc_type")))), one("type_mismatch")),
        F.when(met & (blank(F.col("b.name")) != blank(F.col("a.name"))), one("name_mismatch")),
        F.when(met & (blank(F.col("b.location")) != "") & (blank(F.col("a.location")) != "") & (F.col("a.location") != F.col("b.location")), one("location_mismatch"))))
    value = lambda e: F.try_element_at(F.col("a.properties"), e["key"])
    props = F.transform(F.map_entries(F.coalesce("b.properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda e: F.when(value(e).isNull(), one("property_missing", e["key"])).when(D.normal_value(value(e)) != D.normal_value(e["value"]), one("property_mismatch", e["key"])))
    found = F.when(met, F.concat(simple, F.array_compact(props))).otherwise(simple)
    return both.select("element_id", F.explode(found).alias("d")).select("element_id", "d.kind", "d.prop")


def apply_corrections(baseline: DataFrame, diffs: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """The baseline without missing elements of types that cannot be generated."""
    missing = diffs.filter(F.col("kind") == "missing").select("element_id").distinct().withColumn("_missing", F.lit(True))
    out = baseline.join(missing, "element_id", "left")
    return out.filter(F.col("_missing").isNull() | F.col("ifc_type").isin(*supported)).drop("_missing")


def compare_positions(expected: DataFrame, actual: DataFrame, tolerance: float = 100.0, shown: int = 50) -> DataFrame:
    """(group, ord, element_id, kind, axis, expected, actual) with missing names and positions off by more than the tolerance.

    Position differences beyond the first ``shown`` per group are counted by their place.
    """
    last = actual.groupBy("group_id", "name").agg(F.max_by(F.struct("x", "y"), F.col("ord")).alias("a"))
    joined = expected.join(last, ["group_id", "name"], "left")
    off = lambda axis: F.when(F.abs(F.col(axis) - F.col(f"a.{axis}")) > tolerance, F.struct(F.lit("position").alias("kind"), F.lit(axis).alias("axis"), F.col(axis).alias("expected"), F.col(f"a.{axis}").alias("actual")))
    missing = F.struct(F.lit("missing").alias("kind"), F.lit("").alias("axis"), F.lit(None).cast("double").alias("expected"), F.lit(None).cast("double").alias("actual"))
    rows = joined.select("group_id", "ord", "element_id", F.explode(F.array_compact(F.when(F.col("a").isNull(), F.array(missing)).otherwise(F.array(off("x"), off("y"))))).alias("d")).select("group_id", "ord", "element_id", "d.*")
    place = F.row_number().over(Window.partitionBy("group_id", "kind").orderBy("ord", "axis"))
    return rows.withColumn("place", F.when(F.col("kind") == "position", place)).withColumn("shown", F.coalesce(F.col("place") <= shown, F.lit(True)))


def compare_attributes(expected: DataFrame, actual: DataFrame, tolerance: float = 1.0, shown: int = 20) -> DataFrame:
    """(element_id, attribute): thickness and height beyond the tolerance, other material; the first ones."""
    a = actual.select("element_id", F.struct("thickness", "height", "material").alias("a"))
    joined = expected.join(a, "element_id", "left").filter(F.col("a").isNotNull())
    off = [F.when(F.abs(F.col(c) - F.col(f"a.{c}")) > tolerance, F.lit(c)) for c in ("thickness", "height")]
    off.append(F.when(F.coalesce(F.col("material"), F.lit("")) != F.coalesce(F.col("a.material"), F.lit("")), F.lit("material")))
    rows = joined.select("ord", "element_id", F.explode(F.array_compact(F.array(*off))).alias("attribute"))
    return rows.orderBy("ord", "attribute").limit(shown)


def inject_findings(elements: DataFrame, violations: DataFrame, shown: int = 5) -> DataFrame:
    """Findings by id, then by name, the first five; one that matches both ways comes twice."""
    item = F.struct("ord", "rule_id", "severity")
    few = lambda key: violations.filter(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).filter(F.col("_n") <= shown).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(f"by_{key}"))
    out = elements.join(few("element_id"), "element_id", "left").join(few("name"), "name", "left")
    none = F.array().cast("array<struct<ord:bigint,rule_id:string,severity:string>>")
    both = F.slice(F.concat(F.coalesce("by_element_id", none), F.coalesce("by_name", none)), 1, shown)
    return out.withColumn("review", both).drop("by_element_id", "by_name")
