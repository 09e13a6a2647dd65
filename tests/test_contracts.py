import json

from pyspark.sql import functions as F

from girder.operators import contracts as C


def test_wall_role(spark):
    cases = [(["S-WALL"], "shear_wall"), (["ref$0$s_wall_conc", None, "0"], "shear_wall"), (["x|A-WALL-FIN "], "architectural_wall"), (["S-WALL", "隔墙"], "unresolved"), (["A-WALL-S"], "unresolved"), ([], "unresolved"), (None, "unresolved"), (["S-WALL-2"], "unresolved")]
    rows = spark.createDataFrame([(i, l) for i, (l, _) in enumerate(cases)], "i int, layers array<string>")
    assert [r.role for r in rows.orderBy("i").select(C.wall_role(F.col("layers")).alias("role")).collect()] == [want for _, want in cases]


def test_element_xy(spark):
    cases = [({"x": 1, "y": 2.5}, (1.0, 2.5)), ({"x": "7", "placement": {"x": 3, "y": 4}}, (3.0, 4.0)), ({"start": [5, 6], "y": 9}, (5.0, 9.0)), ({"start": [5], "end": {"x": 1, "y": 2}}, (1.0, 2.0)), ({"start": [None, 8], "end": [3, 4]}, (3.0, 8.0)), ({}, (None, None))]
    rows = spark.createDataFrame([(i, json.dumps(e)) for i, (e, _) in enumerate(cases)], "i int, e string")
    assert [tuple(r.p) for r in rows.orderBy("i").select(C.element_xy(F.col("e")).alias("p")).collect()] == [want for _, want in cases]


def test_ir_issues(spark):
    good = {"project": {"units": "m", "levels": []}, "grid": {"x_axes": [1]}, "model_elements": [{"type": "Wall", "start": [0, 0], "end": [1, 0]}, {"type": "Column", "x": 0, "y": 0}, {"type": "Beam"}]}
    bad = {"project": {"units": None}, "grid": {"x_axes": []}, "model_elements": [{"type": "Wall", "start": [0, 0]}, {"type": "Column", "x": 0}, {"type": "Pipe"}, {}]}
    rows = spark.createDataFrame([(0, json.dumps(good)), (1, json.dumps(bad)), (2, "{}"), (3, None)], "i int, data string")
    got = [r.v for r in rows.orderBy("i").select(C.ir_issues(F.col("data")).alias("v")).collect()]
    assert got[0] == []
    assert got[1] == ["project 缺少 levels", "grid 为空（无轴网）", "model_elements[0] 墙缺 start/end", "model_elements[1] 柱缺 x/y", "model_elements[2] 未知类型: Pipe", "model_elements[3] 未知类型: None"]
    everything = [f"缺少顶层字段: {k}" for k in C.TOP_KEYS] + ["project 缺少 units", "project 缺少 levels", "grid 为空（无轴网）", "model_elements 为空（无构件）"]
    assert got[2] == everything and got[3] == everything


def test_delivery_violations(spark):
    models = spark.createDataFrame([("a", "m", "0,0", 1, "L1"), ("b", "mm", " ", 0, "")], "model_id string, units string, coordinate_origin string, transform_steps int, level_id string")
    full = ("Wall", "t", "c", "concrete")
    rows = [("a", "Wall", 0, "e1", "L1", ["s"], True, full), ("a", "Column", 0, "e1", "L1", ["s"], True, ("Column", "t", "", None)), ("a", "Beam", 0, "e2", "L2", [], False, None), ("a", "Wall", 1, "e3", "L1", ["s"], True, ("Beam", " ", "c", "m"))]
    elements = spark.createDataFrame(rows, "model_id string, kind string, ord int, element_id string, level_id string, source_refs array<string>, has_quantities boolean, construction struct<category:string,type_name:string,classification_code:string,material_name:string>")
    read = lambda s: [(r.model_id, r.element_id, r.code) for r in C.delivery_violations(models, elements, s).orderBy("model_id", "kind_ord", "ord", "rule_ord").collect()]
    whole = [("b", None, c) for c in ("units_must_be_m", "missing_coordinate_origin", "missing_transform_chain", "missing_level")]
    e3 = [("a", "e3", "construction_category_mismatch"), ("a", "e3", "missing_type_name")]
    e2 = [("a", "e2", c) for c in ("missing_source_refs", "level_mismatch", "missing_quantities", "missing_construction_info")]
    assert read(C.Standard()) == [*e3, ("a", "e1", "duplicate_element_id"), *e2, *whole]
    strict = [*e3, ("a", "e1", "duplicate_element_id"), ("a", "e1", "missing_classification_code"), ("a", "e1", "missing_material"), *e2, *whole]
    assert read(C.Standard(classification_code=True, material=True)) == strict
    assert read(C.Standard(level=False, source_refs=False, quantities=False, instance_parameters=False)) == [e3[0], ("a", "e1", "duplicate_element_id"), *whole[:3]]


def test_review_gate(spark):
    models = spark.createDataFrame([("ok", 1, 0.1, 0, 2, 2, 0, 0), ("none", 0, 0.2, 1, 1, 2, 1, 1), ("odd", 1, 0.1, 0, 2, 2, 0, 0)], "model_id string, evidence_count int, dangling_ratio double, error_count int, vertical_grids int, horizontal_grids int, wall_collisions int, column_collisions int")
    walls = spark.createDataFrame([("ok", 0.8, ["e"], ["s"], "matched"), ("odd", 0.79, ["e"], [], "conflict")], "model_id string, confidence double, evidence_ids array<string>, source_refs array<string>, specification_status string")
    columns = spark.createDataFrame([("ok", 0.4, 0.4, ["s"], None), ("odd", 0.0, 0.4, ["s"], None)], "model_id string, width_m double, depth_m double, source_refs array<string>, specification_status string")
    beams = spark.createDataFrame([("odd", None, "conflict")], "model_id string, specification_status string, elevation_status string")
    got = {r.model_id: (r.status, r.errors) for r in C.review_gate(C.gate_facts(models, walls, columns, beams), 0.8, 0.1).collect()}
    assert got["ok"] == ("pass", [])
    assert got["none"] == ("fail", ["wall_evidence_present", "model_walls_present", "topology_within_limit", "source_diagnostics_have_no_errors", "grid_present_when_required", "wall_collision_free", "wall_column_collision_free"])
    assert got["odd"] == ("fail", ["all_walls_traceable", "all_walls_confident", "column_geometry_valid", "specification_conflicts_free", "beam_elevation_conflicts_free"])


def test_frame_issues(spark):
    sources = spark.createDataFrame([("s",)], "source_id string")
    pages = spark.createDataFrame([("s", 1)], "source_id string, page_no int")
    kind = "entity_id string, source_id string, page_no int, frame_id string"
    offsets = spark.createDataFrame([("s",), ("s:page:0001",), ("s:page:0009",)], "frame_id string")
    paged = spark.createDataFrame([("e1", "s", 1, None), ("e2", "x", 1, None), ("e3", "s", None, None), ("e4", "s", 1, "s"), ("e5", "s", 9, "")], kind)
    assert {tuple(r) for r in C.frame_issues(sources, pages, paged, offsets, True).collect()} == {("unknown_source", "e2"), ("page_missing", "e3"), ("frame_differs", "e4"), ("page_not_read", "e5"), ("offset_unknown", "s:page:0009")}
    plain = spark.createDataFrame([("e1", "s", None, None), ("e2", "s", 1, None), ("e3", "s", None, "t")], kind)
    assert {tuple(r) for r in C.frame_issues(sources, pages, plain, offsets, False).collect()} == {("page_not_allowed", "e2"), ("frame_differs", "e3"), ("offset_unknown", "s:page:0001"), ("offset_unknown", "s:page:0009")}


def test_built_states(spark):
    kind = "d int, ord int, id string, x1 double, y1 double, x2 double, y2 double, thickness double"
    walls = spark.createDataFrame([(0, 0, "a", 0.0, 0.0, 5.0, 0.0, 200.0), (0, 1, "b", 0.0, 3.0, 5.0, 3.0, 200.0), (0, 2, "c", 0.0, 90.0, 5.0, 90.0, 200.0)], kind)
    built = spark.createDataFrame([(0, 0, "a", 0.0, 0.0, 5.0, 0.0, 210.0), (0, 1, "r9", 5.0, 3.06, 0.0, 3.0, 211.0), (0, 2, "r8", 40.0, 0.0, 45.0, 0.0, 200.0)], kind)
    got = {r.id or r.built_id: (r.status, r.issues, r.repair, r.truncated) for r in C.built_states(walls, built, ["d"], most=2).collect()}
    assert got == {
        "a": ("built", [], None, False), "b": ("mismatch", ["position_mismatch", "angle_mismatch", "thickness_mismatch"], "update", False),
        "c": ("missing", ["revit_element_missing"], "create", False), "r8": ("extra", ["unexpected_revit_wall"], None, True),
    }


def test_simplified_profile(spark):
    square = [(0.0, 0.0), (5.0, 0.4), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 5.0)]
    flat = [(0.0, 0.0), (5.0, 0.0), (10.0, 0.0), (15.0, 0.0)]
    rows = spark.createDataFrame([(1, square), (2, flat), (3, square[:2]), (4, []), (5, None)], "i int, points array<struct<x:double,y:double>>")
    got = {r.i: r.p and [tuple(q) for q in r.p] for r in rows.select("i", C.simplified_profile(F.col("points")).alias("p")).collect()}
    assert got == {1: [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], 2: flat, 3: square[:2], 4: [], 5: None}
