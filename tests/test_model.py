from pyspark.sql import functions as F

from girder.operators import model, specs

SEG = "d int, id int, x1 double, y1 double, x2 double, y2 double, thickness double"


def test_specs_of_texts(spark):
    cases = {"Q1 墙厚 200mm": ("wall", None, None, 200.0), "Q2 （3排） 500": ("wall", None, None, 500.0), "LL1 250x600": ("beam", 250.0, 600.0, None), "KL2 600×250": ("beam", 250.0, 600.0, None), "KZ1 500x700": ("column", 700.0, 500.0, None), "KZ2 9001000": ("column", 1000.0, 900.0, None), "KZ3 1400300": ("column", 1400.0, 300.0, None)}
    rows = spark.createDataFrame([(t,) for t in [*cases, "无尺寸", "墙厚 20", "梁 250x600"]], "text string")
    got = {r.text: (r.kind, r.dims.width, r.dims.depth, r.dims.thickness) for r in specs.parse_specs(rows).collect()}
    assert got == cases


def test_levels(spark):
    def levels(name, notes):
        col = specs.level_from_texts(F.lit(name), F.array(*map(F.lit, notes)) if notes else F.array().cast("array<string>"))
        return [(x.name, x.elevation) for x in spark.range(1).select(col.alias("v")).first().v]

    assert levels("二层平面", ["hh+5.7m（为零点）参照"]) == [("标高1", 0.0), ("标高2", 5.7)]
    assert levels("楼层平面-标高3", []) == [("标高3", 0.0)] and levels("2F-AR", []) == [("2F-AR", 0.0)] and levels("x", ["5 m"]) == [("标高1", 0.0)]


def test_scale(spark):
    rows = [("f", "p", 1, "一层平面图", 0.0, 0.0), ("f", "p", 2, "1:100", 10.0, 0.0), ("f", "p", 3, "详图 1:20", 900.0, 0.0), ("g", "p", 4, "1:50", 0.0, 0.0), ("g", "p", 5, "1:20", 900.0, 0.0)]
    got = specs.drawing_scale(spark.createDataFrame(rows, "f string, frame_id string, text_id int, text string, x double, y double"), ["f"])
    assert {r.f: (r.status, r.scale if r.status == "ok" else None) for r in got.collect()} == {"f": ("ok", 100), "g": ("ambiguous", None)}


def test_schedule(spark):
    table = [("洞口编号", 0, 0), ("洞口尺寸", 5, 0), ("洞底标高", 10, 0), ("D1", 0, -1), ("800x900", 5, -1), ("-0.5", 10, -1), ("D2", 0, -2), ("700x700", 5, -2), ("1200mm", 10, -2), ("D3", 0, -3), ("1x1", 5, -3), ("2", 10, -3)]
    upright = [("a", i, t, float(x), float(y)) for i, (t, x, y) in enumerate(table)]
    rotated = [("b", i, t, float(y), float(x)) for i, (t, x, y) in enumerate(table)]
    rows = spark.createDataFrame(upright + rotated, "page string, row_id int, text string, x double, y double")
    got = sorted((r.page, r.mark, r.width, r.height, r.sill) for r in specs.opening_schedule(rows, ["page"], 0.5, 50.0).collect())
    assert got == [(p, *v) for p in "ab" for v in (("D1", 800.0, 900.0, -0.5), ("D2", 700.0, 700.0, 1.2))]
    openings = spark.createDataFrame([(1, "D1", None), (2, "D9", 0.3)], "opening_id int, mark string, sill_override double")
    cuts = {r.opening_id: (r.status, r.sill) for r in specs.opening_cuts(openings, specs.opening_schedule(rows, ["page"], 0.5, 50.0)).collect()}
    assert cuts == {1: ("matched", -0.5), 2: ("review_required", 0.3)}


def test_spec_resolution(spark):
    dims = "struct<width:double,depth:double,thickness:double>"
    els = spark.createDataFrame([("f", "e1", "wall", None, 0.0, 0.0), ("f", "e2", "column", "KZ1", 50.0, 0.0), ("f", "e3", "wall", None, 99.0, 99.0), ("f", "e4", "wall", None, 20.0, 0.0)], "f string, element_id string, kind string, mark string, x double, y double")
    rows = spark.createDataFrame([("f", "wall", "Q1", "annotation", (None, None, 200.0), 1.0, 0.0), ("f", "wall", "Q1", "detail", (None, None, 200.0), 80.0, 0.0), ("f", "column", "KZ1", "schedule", (500.0, 400.0, None), 90.0, 90.0), ("f", "wall", "Q2", "annotation", (None, None, 300.0), 20.5, 0.0), ("f", "wall", "Q3", "annotation", (None, None, 250.0), 20.5, 0.5)], f"f string, kind string, mark string, source_kind string, dims {dims}, x double, y double")
    got = {r.element_id: (r.spec_status, r.spec.dims.thickness if r.spec else None) for r in specs.resolve_specs(els, rows, ["f"], 3.0).collect()}
    assert got["e1"] == ("matched", 200.0) and got["e2"][0] == "matched" and got["e3"] == ("missing", None) and got["e4"][0] == "conflict"


def test_beam_elevations(spark):
    beams = spark.createDataFrame([("b1", "LL1", "f", 0.0, 0.0, 0.6), ("b2", None, "f", 10.0, 0.0, 0.5), ("b3", "LL3", "f", 90.0, 0.0, 0.5)], "beam_id string, mark string, frame_id string, x double, y double, depth double")
    ev = spark.createDataFrame([("LL1", "g", 0.0, 0.0, "top", 3.0), (None, "f", 10.5, 0.0, "base", 2.0), ("LL3", "f", 0.0, 0.0, "top", 3.0), ("LL3", "f", 0.0, 0.0, "top", 4.0)], "mark string, frame_id string, x double, y double, reference string, value double")
    got = {r.beam_id: (r.status, r.top, r.base) for r in specs.beam_elevations(beams, ev, 2.0).collect()}
    assert got == {"b1": ("matched", 3.0, 2.4), "b2": ("matched", 2.5, 2.0), "b3": ("conflict", None, None)}


def test_layers_and_plans(spark):
    layers = spark.createDataFrame([("d", "X-S-WALL-2"), ("d", "S-WALL"), ("d", "BEAM")], "drawing_id string, layer string")
    profiles = spark.createDataFrame([("p1", 1, "s-wall", "wall"), ("p2", 2, "zzz", "wall")], "profile string, ord int, keyword string, role string")
    roles = spark.createDataFrame([("beam", "beam"), ("wall", "wall")], "role string, keyword string")
    assert {r.role: r.layer for r in specs.best_layers(layers, profiles, roles).collect()} == {"wall": "S-WALL", "beam": "BEAM"}
    plans = spark.createDataFrame([("d", 1, "一层平面图"), ("d", 2, "墙柱图"), ("e", 3, "平面图A"), ("e", 4, "平面图B"), ("g", 5, "夹层平面图")], "drawing_id string, plan_id int, name string")
    assert {r.drawing_id: (r.status, r.plan_id) for r in specs.main_plan(plans).collect()} == {"d": ("ok", 1), "e": ("ambiguous_or_missing", None), "g": ("ambiguous_or_missing", None)}


def test_filters_and_audits(spark):
    rows = spark.createDataFrame([(1, ["A-FURN"]), (2, ["S-WALL", "x$furn"]), (3, ["S-WALL"])], "id int, layers array<string>")
    kept, report = model.exclude_layers(rows, ["furn"], F.col("layers"))
    assert [r.id for r in kept.collect()] == [3] and report.count() == 2
    lines = spark.createDataFrame([(0, 1, 0.0, 0.0, 600.0, 0.0, 0.0), (0, 2, 0.0, 0.0, 400.0, 0.0, 0.0), (0, 3, 0.0, 0.0, 3e6, 0.0, 0.0)], SEG)
    assert [r.id for r in model.beam_lines(lines, ["d"]).collect()] == [1]
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    slabs = model.slab_outlines(spark.createDataFrame([(1, square), (2, square[:3])], "id int, points array<struct<x:double,y:double>>")).collect()
    assert [(s.id, s.area, s.centre.x) for s in slabs] == [(1, 4.0, 1.0)]
    walls = spark.createDataFrame([("a", 0.2), ("b", 5.0)], "element_id string, thickness double")
    columns = spark.createDataFrame([("a", 1.0)], "element_id string, width double")
    got = model.standard_violations({"wall": (walls, {"thick": F.col("thickness") > 2}), "column": (columns, {"small": F.col("width") < 0.1})}).collect()
    assert {(r.kind, r.element_id, r.rule) for r in got} == {("wall", "b", "thick"), ("column", "a", "duplicate_id")}
    refs = "array<struct<id:string,drawing:string,occurrence:string>>"
    tr = spark.createDataFrame([(1, [("s1", "d", "o")], ["s1"]), (2, [], []), (3, [("s1", "e", "o")], ["s2"])], f"id int, refs {refs}, ref_ids array<string>")
    audit = {r.id: (r.present, r.same_drawing, r.declared) for r in model.traceability(tr, ["id"], F.lit("d"), F.lit("o")).collect()}
    assert audit == {1: (True, True, True), 2: (False, True, True), 3: (True, False, False)}
    issues = model.payload_issues(walls, {"thin": F.col("thickness") < 1, "named": F.col("element_id").isNotNull()}).collect()
    assert {r.element_id: r.issues for r in issues} == {"a": [], "b": ["thin"]}
    chain = spark.createDataFrame([("r", 1, "h1", None), ("r", 2, "h2", "h1"), ("r", 3, "h3", "x")], "run_id string, stage int, sha256 string, parent_sha256 string")
    assert [r.linked for r in model.verify_lineage(chain).orderBy("stage").collect()] == [True, True, False]


def test_matching_and_splitting(spark):
    m = spark.createDataFrame([(0, 1, 0.0, 0.0, 5.0, 0.0, 200.0), (0, 2, 0.0, 9.0, 8.0, 9.0, 200.0), (0, 3, 0.0, 9.2, 3.0, 9.0, 200.0)], SEG)
    b = spark.createDataFrame([(0, 1, 0.0, 0.0, 5.0, 0.0, 200.0), (0, 77, 8.0, 9.1, 0.0, 9.1, 210.0)], SEG)
    assert {(r.id, r.built_id) for r in model.match_built(m, b, ["d"]).collect()} == {(1, 1), (2, 77)}
    walls = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 0.0, 0.2)], SEG).withColumnRenamed("id", "wall_id")
    columns = spark.createDataFrame([(0, 5.0, 0.0, 1.0, 1.0)], "d int, cx double, cy double, w double, d2 double").withColumnRenamed("d2", "dd")
    pieces = model.split_by_columns(walls.withColumnRenamed("d", "dr"), columns.withColumnRenamed("d", "dr").withColumnRenamed("dd", "d"), ["dr"], 0.1)
    assert [(r.lo, r.hi) for r in pieces.orderBy("piece").collect()] == [(0.0, 4.5), (5.5, 10.0)]
    con = model.end_connectivity(spark.createDataFrame([(0, 1, 0.0, 0.0, 5.0, 0.0, 0.2), (0, 2, 5.0, 0.1, 5.0, 4.0, 0.2)], SEG).withColumnRenamed("id", "wall_id"), spark.createDataFrame([(0, 0.0, 0.05)], "d int, cx double, cy double"), ["d"], 0.1).first()
    assert con.connected == 3 and con.ends == 4
    joined = model.merge_fragments(spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0, 0.0, 0.2), (0, 2, 1.1, 0.0, 2.0, 0.0, 0.2)], SEG), ["d"], 0.2).collect()
    assert len(joined) == 1 and joined[0].ids == [1, 2]
    faces = spark.createDataFrame([(0, 1, 0.0, 0.0, 4.0, 0.0), (0, 2, 0.0, 0.2, 4.0, 0.2), (0, 3, 0.0, 0.5, 4.0, 0.5)], "d int, seg_id int, x1 double, y1 double, x2 double, y2 double")
    assert [(r.a, r.b) for r in model.paired_evidence(faces, ["d"]).collect()] == [(1, 2)]
    labels = spark.createDataFrame([("f", 1, 0.0, 0.0), ("f", 2, 0.1, 0.0)], "f string, label_id int, x double, y double")
    bounds = spark.createDataFrame([("f", 7, 0.1, 0.0), ("f", 8, 0.9, 0.0)], "f string, boundary_id int, x double, y double")
    assert {(r.label_id, r.boundary_id) for r in model.greedy_hosts(labels, bounds, ["f"], 1.0).collect()} == {(2, 7), (1, 8)}


def test_assembly(spark, tmp_path):
    a = spark.createDataFrame([(1, 0.3), (2, 0.4)], "ord int, w double")
    assert sorted(r.id for r in model.union_floors({"1F": a, "2F": a.limit(0)}, "beam").collect()) == ["1F_beam_1", "1F_beam_2"]
    base = spark.createDataFrame([("w1", "h1", 0.0, 0.0, 1.0, 0.0), ("w2", "h2", 0.0, 0.0, 1.0, 0.0)], "wall_id string, hash string, x1 double, y1 double, x2 double, y2 double")
    change = spark.createDataFrame([("w1", "h1", 0.0, 0.0, 2.0, 0.0), ("w2", "old", 9.0, 9.0, 9.0, 9.0)], "wall_id string, base_hash string, x1 double, y1 double, x2 double, y2 double")
    assert {r.wall_id: (r.replay, r.x2) for r in model.apply_if_unchanged(base, change).collect()} == {"w1": ("applied", 2.0), "w2": ("stale", 1.0)}
    px = spark.createDataFrame([("r", i, 0) for i in range(10)] + [("t", 1, 1)], "k string, x long, y long")
    iou = {r.k: r for r in model.pixel_iou(px, px.filter("k = 'r' AND x < 5").withColumn("y", F.lit(1).cast("long")), ["k"], 1).collect()}
    assert (iou["r"].recall, iou["r"].precision, iou["r"].edge_iou) == (0.6, 1.0, 0.6)
    assert (iou["t"].recall, iou["t"].edge_iou, iou["t"].raw_iou) == (0.0, 0.0, 0.0)
    corner = model.pixel_iou(px.filter("k = 't'"), px.filter("k = 't'").withColumns({"x": F.col("x") + 4, "y": F.col("y") + 4}), ["k"], 4).first()
    assert corner.edge_iou == 1.0  # a square reach, not a circle
    calls = []
    for _ in range(2):
        out = model.cached_by_digest(spark, str(tmp_path), "abc", lambda: calls.append(1) or a)
    assert out.count() == 2 and len(calls) == 1
    reg = model.Registry(lambda q: "local")
    reg.register("ann", lambda q: "ann")
    assert reg.call(["x", "ann"], "q") == "ann" and reg.call(["x"], "q") == "local"
    assert [r.score for r in model.scored(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda ts: [len(t) / 3 for t in ts]).collect()] == [0.6667, 0.0]
    ends = spark.createDataFrame([(1, "start"), (2, "end")], "wall_id int, end string")
    assert {r.wall_id: r.support for r in model.classify_ends(ends, [("column", ends.filter("wall_id = 1"))], ["wall_id", "end"]).collect()} == {1: "column", 2: "unresolved"}
    cal = model.grid_calibration(spark.createDataFrame([("d", "x", 0.0, 1.0), ("d", "x", 0.0, 3.0), ("d", "x", 5.0, 9.0), ("d", "y", 0.0, 0.0)], "drawing_id string, axis string, local double, target double"))
    assert {r.axis: (r.status, r.controls[0].to) for r in cal.collect()} == {"x": ("ok", 2.0), "y": ("too_few_grids", 0.0)}


def test_labels_openings_grid_and_pitfalls(spark):
    beams = spark.createDataFrame([("d", 1, 0.0, 0.0, 0.95), ("d", 2, 0.4, 0.0, 0.95), ("d", 3, 50.0, 0.0, 0.95)], "d string, beam_id int, x double, y double, confidence double")
    labels = spark.createDataFrame([("d", 7, "LL1", 0.1, 0.0)], "d string, label_id int, mark string, x double, y double")
    got = {r.beam_id: (r.label_id, r.mark, r.confidence) for r in model.beam_labels(beams, labels, ["d"], 1.0).collect()}
    assert got[1] == (7, "LL1", 0.95) and got[2] == (7, "LL1", 0.95)  # a label serves several beams
    assert got[3][0] is None and got[3][1].startswith("LL-") and got[3][2] == 0.85
    names = spark.createDataFrame([("d", 1, 11, 0.0, 0.0), ("d", 0, 12, 0.3, 0.0)], "d string, ord int, label_id int, x double, y double")
    bounds = spark.createDataFrame([("d", 5, 0.1, 0.0), ("d", 6, 0.9, 0.0)], "d string, boundary_id int, x double, y double")
    assert {(r.label_id, r.boundary_id) for r in model.label_openings(names, bounds, ["d"], 1.0).collect()} == {(12, 5), (11, 6)}  # in input order, not by distance
    axes = spark.createDataFrame([("f", "x", v) for v in (0.0, 0.4, 0.7, 5.0)], "f string, direction string, v double")
    grid = sorted((r.label, r["at"]) for r in model.ifc_grid(axes, ["f"], 0.6).collect())
    assert [g[0] for g in grid] == ["x1", "x2"] and abs(grid[0][1] - 0.45) < 1e-9 and grid[1][1] == 5.0  # (0 + .4) / 2, then (.2 + .7) / 2
    rows = [(3, 2, 1, 0.89, 0), (2, 3, 0, 0.9, 1), (3, None, None, None, None), (3, 0, 0, 0.0, 0)]
    reports = spark.createDataFrame(rows, "axis_count int, axis_label_count int, orient_flips int, main_match_rate double, coord_outliers int")
    assert [r.pitfalls for r in model.pitfalls(reports).collect()] == [["PIT-01", "PIT-03", "PIT-06"], ["PIT-08"], [], ["PIT-06"]]


def test_page_sections():
    from girder.sources.documents import page_sections

    assert page_sections([" a ", "", "b\n"]) == "# Page 1\n\na\n\n# Page 3\n\nb"
