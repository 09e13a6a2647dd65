"""Floor fusion: hand-made floors at the limits of each rule."""

import math

from pyspark.sql import functions as F

from girder.operators import fusion

CONTRACT = "origin_x double, origin_y double, centre_x double, centre_y double, rotation double"


def fused(spark, contracts, axes, columns, walls):
    part = CONTRACT.replace(" double", ":double")
    return [df.collect() for df in fusion.fuse_floors(
        spark.createDataFrame(contracts, f"g int, structure struct<{part}>, architecture struct<{part}>"), spark.createDataFrame(axes, "g int, side string, direction string, id string, coord double"),
        spark.createDataFrame(columns, "g int, side string, id string, x double, y double, w double, h double"), spark.createDataFrame(walls, "g int, side string, id string, x1 double, y1 double, x2 double, y2 double, thickness double"), ["g"])]


def test_map_of_contracts(spark):
    """Both turns are about each drawing's own centre."""
    source, target = (300.0, -40.0, 1000.0, 500.0, 30.0), (-70.0, 25.0, 900.0, -800.0, -45.0)
    df = spark.createDataFrame([(source, target, 2.0, -3.0)], f"structure struct<{CONTRACT.replace(' double', ':double')}>, architecture struct<{CONTRACT.replace(' double', ':double')}>, x double, y double")
    x, y = fusion.moved(F.col("x"), F.col("y"))
    got = df.select(x.alias("x"), y.alias("y")).first()
    p = complex(2000 + 300, -3000 - 40)
    for (*_, cx, cy, turn), sign in ((source, -1), (target, 1)):
        p = (p - complex(cx, cy)) * complex(math.cos(math.radians(sign * turn)), math.sin(math.radians(sign * turn))) + complex(cx, cy)
    assert abs(got.x - (p.real + 70) / 1000) < 1e-9 and abs(got.y - (p.imag - 25) / 1000) < 1e-9


def test_limits_of_fusion(spark):
    """A thousandth of a metre is near enough, more is not; ambiguous columns and walls that see two views are told apart."""
    still = (0.0, 0.0, 0.0, 0.0, 0.0)
    contracts = [(g, still, still) for g in range(7)]
    columns = [(g, side, f"{side[0]}{i}", 5.0 * i, 1.0, 0.5, 0.5) for g in (0, 5, 6) for side in ("structure", "architecture") for i in range(3)]
    columns += [(1, "structure", "s0", 0.00099, 0.0, 0.5, 0.50099), (1, "architecture", "a0", 0.0, 0.0, 0.5, 0.5)]
    columns += [(2, "structure", "s0", 0.0011, 0.0, 0.5, 0.5), (2, "architecture", "a0", 0.0, 0.0, 0.5, 0.5)]
    columns += [(3, "structure", "s0", 0.0, 0.0, 0.5, 0.5), (3, "structure", "s1", 0.0005, 0.0, 0.5, 0.5), (3, "architecture", "a0", 0.0, 0.0, 0.5, 0.5), (3, "architecture", "a1", 0.0, 0.0002, 0.5, 0.5)]
    axes = [(5, "structure", "x", "sx0", 1.0), (5, "structure", "x", "sx1", 1.002), (5, "architecture", "x", "ax0", 1.0005), (6, "structure", "x", "sx0", 1.0), (6, "structure", "x", "sx1", 1.0009), (6, "structure", "y", "sy0", 1.0009), (6, "architecture", "y", "ay0", 1.002)]
    walls = [(0, "structure", "s0", 0.0, 0.0, 4.0, 0.0, 200.0), (0, "architecture", "a0", 4.0, 0.0005, 0.0, 0.0, 201.0), (0, "structure", "s1", 0.0, 9.0, 4.0, 9.0, 200.0), (0, "architecture", "a1", 0.0, 9.0, 4.0, 9.0, 201.5),
             (0, "structure", "s2", 0.0, 5.0, 4.0, 5.0, 200.0), (0, "architecture", "a2", 0.0, 5.0, 4.0, 5.0, 200.0), (0, "architecture", "a3", 0.0, 5.0, 4.0, 5.0, 200.0), (2, "structure", "s9", 0.0, 0.0, 1.0, 0.0, 100.0)]
    verdicts, elements = fused(spark, contracts, axes, columns, walls)
    assert {r.g: (r.status, r.issues) for r in verdicts} == {
        0: ("fused", []), 1: ("fused", []), 2: ("refused", ["column_not_one_to_one"]), 3: ("refused", ["column_not_one_to_one"]), 4: ("refused", ["column_counts_differ"]), 5: ("fused", []), 6: ("refused", ["axes_not_of_structure", "duplicate_axes"])}
    mine = {(r.kind, r.structure_id, r.architecture_id, r.status) for r in elements if r.g == 0 and r.kind == "wall"}
    far = "UNMATCHED_STRUCTURE_VIEW", "UNMATCHED_ARCHITECTURE_VIEW"
    assert mine == {("wall", "s0", "a0", "CORROBORATED"), ("wall", "s1", None, far[0]), ("wall", "s2", None, far[0]), ("wall", None, "a1", far[1]), ("wall", None, "a2", far[1]), ("wall", None, "a3", far[1])}
    assert {(r.structure_id, r.architecture_id, r.status) for r in elements if r.g == 5 and r.kind == "axis_x"} == {("sx0", "ax0", "EXACT"), ("sx1", None, "STRUCTURE_ONLY")}
    assert {r.g for r in elements} == {0, 1, 5} and all(r.residual is None or r.residual <= 0.001 for r in elements)


def test_turned_and_empty(spark):
    still, turned = (0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 90.0)
    columns = [(1, "structure", "s0", 0.0, -2.0, 0.5, 0.5), (1, "architecture", "a0", -2.0, 0.0, 0.5, 0.5)]
    axes = [(1, "structure", "x", "sx0", 1.0), (1, "structure", "x", "sx1", 2.0), (1, "architecture", "x", "ax0", 7.0)]
    verdicts, elements = fused(spark, [(1, turned, still)], axes, columns, [])
    assert [(r.status, r.issues) for r in verdicts] == [("refused", ["rotation_differs"])] and not elements
    assert fused(spark, [], [], [], []) == [[], []]
