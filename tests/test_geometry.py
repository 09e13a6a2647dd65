import math
import random

import pandas as pd
from pyspark.sql import functions as F

from girder.functions import geometry as G
from girder.operators import graph, interval, ordered, spatial

LIT = lambda *v: tuple(F.lit(float(x)) for x in v)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def wall(x1, y1, x2, y2, thickness=0.2, **more):
    return {"x1": float(x1), "y1": float(y1), "x2": float(x2), "y2": float(y2), "thickness": thickness, **more}


def test_expressions(spark):
    rec = one(spark, G.line_record(LIT(4, 1, 0, 1)))
    assert (rec.x1, rec.x2, rec.ux, rec.angle, rec.length) == (0.0, 4.0, 1.0, 0.0, 4.0)
    assert one(spark, G.line_record(LIT(1, 1, 1, 1))) is None
    assert one(spark, G.point_segment_distance(LIT(5, 1), LIT(0, 0, 4, 0))) == math.sqrt(2) and one(spark, G.angle_delta(F.lit(179.0), F.lit(1.0))) == 2.0
    assert one(spark, G.intersection(LIT(0, 0, 1, 0), LIT(2, -1, 2, 1))).x == 2.0 and one(spark, G.intersection(LIT(0, 0, 1, 0), LIT(0, 1, 1, 1))) is None
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    assert one(spark, G.polygon_area(square)) == 16.0
    assert one(spark, G.polygon_area(G.clip_polygon(square, F.lit(1.0), F.lit(3.0), F.lit(-1.0), F.lit(2.0)))) == 4.0
    assert one(spark, F.size(G.clip_polygon(square, F.lit(9.0), F.lit(10.0), F.lit(0.0), F.lit(1.0)))) == 0
    assert one(spark, G.box_iou(LIT(0, 0, 2, 2), LIT(1, 1, 3, 3))) == 1 / 7 and one(spark, G.box_iou(LIT(0, 0, 0, 0), LIT(0, 0, 0, 0))) == 0.0
    assert one(spark, G.nearest(F.lit(5.0), F.array(F.lit(4.0), F.lit(6.0)))) == 4.0 and one(spark, G.nearest(F.lit(5.0), F.array().cast("array<double>"))) == 5.0
    snapped = one(spark, G.orthogonalize(LIT(0, 0, 10, 0.2)))
    assert snapped.y1 == snapped.y2 == 0.1 and one(spark, G.orthogonalize(LIT(0, 0, 0.3, 0))) is None
    controls = F.array(*[F.struct(F.lit(float(a)).alias("at"), F.lit(float(b)).alias("to")) for a, b in ((0, 0), (1, 10), (2, 30))])
    assert [one(spark, G.piecewise(F.lit(v), controls)) for v in (-1.0, 0.5, 1.5, 3.0)] == [-10.0, 5.0, 20.0, 50.0]
    assert len(one(spark, G.tile_origins(F.lit(1000), F.lit(512), 512, 128))) == 3


def test_affine():
    a, b, tx, c, d, ty = G.affine_between((1.0, 2.0, 0.001, 90.0), (0.0, 0.0, 0.001, 0.0))
    assert [round(a + b * 2 + tx, 9), round(c + d * 2 + ty, 9)] == [0.0, 0.0]
    assert [round(2 * a + 2 * b + tx, 9), round(2 * c + 2 * d + ty, 9)] == [0.0, 1.0]


def brute_cover(spans):
    return sum(max(0, b - a) for a, b in merged(spans))


def merged(spans, gap=0):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def test_intervals(spark):
    rng = random.Random(5)
    rows = [(k, a, a + rng.randint(0, 9)) for k in range(20) for a in [rng.randint(0, 60) for _ in range(rng.randint(1, 12))]]
    df = spark.createDataFrame(rows, "k int, lo int, hi int")
    want = {k: merged([(a, b) for kk, a, b in rows if kk == k], 2) for k in range(20)}
    got = interval.islands(df, ["k"], "lo", "hi", 2).collect()
    assert sorted((r.k, r.lo, r.hi) for r in got) == sorted((k, a, b) for k, v in want.items() for a, b in v)
    cover = {r.k: r.covered for r in interval.union_length(df, ["k"], "lo", "hi", 0).collect()}
    assert cover == {k: brute_cover([(a, b) for kk, a, b in rows if kk == k]) for k in range(20)}


def test_difference(spark):
    base = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 5.0), ("c", 0.0, 3.0)], "id string, lo double, hi double")
    taken = spark.createDataFrame([("a", 2.0, 3.0), ("a", 2.5, 4.0), ("a", 9.0, 12.0), ("c", -1.0, 4.0)], "id string, lo double, hi double")
    got = [(r.id, r.piece, r.lo, r.hi) for r in interval.difference(base, taken, ["id"], "lo", "hi", 0.5).orderBy("id", "piece").collect()]
    assert got == [("a", 0, 0.0, 2.0), ("a", 1, 4.0, 9.0), ("b", 0, 0.0, 5.0)]


def test_tiles(spark):
    rows = [("ok", 0.0, 2.0), ("ok", 2.0005, 5.0), ("gap", 0.0, 2.0), ("gap", 2.5, 5.0)]
    df = spark.createDataFrame(rows, "g string, lo double, hi double").withColumns({"a": F.lit(0.0), "b": F.lit(5.0)})
    assert {r.g: r.proven for r in interval.tiles(df, ["g"], "lo", "hi", "a", "b", 0.001).collect()} == {"ok": True, "gap": False}


def test_components_and_stars(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 100), (200, 200)], "a long, b long")
    got = {r.node: r.label for r in graph.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 103: 100}
    stars = graph.stars(spark.createDataFrame([("s1", "a1"), ("s1", "a2"), ("s2", "a3"), ("s3", "a4"), ("s3", "a5"), ("s4", "a5")], "left string, right string"))
    assert {(r.left, r.right, r.single) for r in stars.collect()} == {("s1", "a1", "left"), ("s1", "a2", "left")}


def test_matching():
    rng = random.Random(9)
    for _ in range(60):
        edges = sorted({(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randint(0, 14))})
        got = graph.max_matching(pd.DataFrame(edges, columns=["left", "right"]))
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) and set(got) <= set(edges)

        def best(i, used):
            if i == 6:
                return 0
            return max([best(i + 1, used), *(1 + best(i + 1, used | {b}) for a, b in edges if a == i and b not in used)])

        assert len(got) == best(0, frozenset())


def test_matching_by_component(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (7, 7)], "left long, right long")
    assert graph.matching(edges).count() == 3


def test_grid_join_finds_each_pair_once(spark):
    rng = random.Random(2)
    rows = [(i % 2, i, rng.uniform(-9, 9), rng.uniform(-9, 9), 0.0, 0.0) for i in range(80)]
    rows = [(d, i, x, y, x + rng.uniform(-4, 4), y + rng.uniform(-4, 4)) for d, i, x, y, _, _ in rows]
    s = spark.createDataFrame(rows, "drawing int, seg_id int, x1 double, y1 double, x2 double, y2 double")
    ends = spatial.segment_ends(s, ["drawing"], "seg_id")
    got = {(r.seg_id, r.end) for r in spatial.supported_ends(ends, s, ["drawing"], "seg_id", "seg_id", F.lit(0.5), 0.5).collect()}
    want = set()
    for d, i, x1, y1, x2, y2 in rows:
        for end, p in (("start", (x1, y1)), ("end", (x2, y2))):
            if any(d == e and i != j and ordered.to_segment(p, wall(*o)) <= 0.5 for e, j, *o in rows):
                want.add((i, end))
    assert got == want


def test_clusterings(spark):
    values = [0.0, 0.2, 0.4, 0.6, 2.0]
    assert [len(g) for g in ordered.cluster_running_mean(values, 0.31)] == [3, 1, 1]
    assert ordered.cluster_first_fit([1.0, 1.2, 5.0], 0.5) == [1.1, 5.0]
    assert one(spark, ordered.cluster_fold(F.array(*LIT(0.0, 0.2, 0.4, 2.0)), 0.35)) == [0.25, 2.0]


def test_suppression():
    import numpy as np

    boxes = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [20, 20, 30, 30], [5, 5, 5, 5]], dtype=float)
    assert ordered.suppress(boxes, 0.5) == [0, 2, 3]


def test_collinear_merge():
    walls = [wall(0, 0, 1, 0, 200, id=1), wall(1.3, 0.05, 2, 0.05, 210, id=2), wall(2.9, 0, 4, 0, 200, id=3), wall(0, 0, 1, 0, 300, id=4), wall(4, 0, 3.9, 0, 200, id=5)]
    out = ordered.merge_collinear(walls)
    assert [(w["x1"], w["x2"], w["ids"]) for w in out] == [(0.0, 2.0, [1, 2]), (2.9, 4.0, [3, 5]), (0.0, 1.0, [4])]


def test_healing_and_topology():
    walls = [wall(0, 0, 3.9, 0), wall(4, 0.1, 4, 3)]
    healed = ordered.heal_junctions(walls, 0.1)
    assert abs(healed[0]["x2"] - 4) < 1e-9 and abs(healed[1]["y1"]) < 1e-9
    found = ordered.classify_junctions(healed, 0.1)
    assert [j["kind"] for j in found] == ["L"] and found[0]["members"] == [0, 1]
    cross = [wall(-2, 0, 2, 0), wall(0, -2, 0, 2), wall(5, 0, 7, 0), wall(7, 0, 9, 0), wall(5, 5, 9, 5), wall(7, 5, 7, 8)]
    assert sorted(j["kind"] for j in ordered.classify_junctions(cross, 0.1)) == ["T", "X", "straight"]
    trimmed = ordered.trim_junctions(healed, found, 0.1)
    assert abs(trimmed[0]["x2"] - 3.9) < 1e-9 and abs(trimmed[1]["y1"] - 0.1) < 1e-9
    assert ordered.keep_reachable_junctions(trimmed, found * 2, 0.1) == found
    axis = ordered.heal_axis_junctions([wall(0, 0, 3.6, 0, 200), wall(4, -1, 4, 3, 200), wall(0, 0, 0.1, 0)])
    assert [w["x2"] for w in axis] == [4.0, 4.0]


def test_merging_and_overlaps():
    a = wall(0, 0, 2, 0, ids=["a"], confidence=0.9)
    b = wall(0, 0.001, 2, 0.001, ids=["b"], confidence=0.95)
    c = wall(2.05, 0, 4, 0, ids=["c"], confidence=0.5)
    out = ordered.dedupe_and_merge([a, b, c], 0.01, 1.0, 0.1)
    assert len(out) == 1 and out[0]["ids"] == ["a", "b", "c"] and out[0]["confidence"] == 0.5 and out[0]["x2"] == 4.0
    assert [w["ids"] for w in ordered.remove_parallel_overlaps([a, {**c, "x1": 1.0}, wall(1, -1, 1, 1, ids=["d"], confidence=0.1)])] == [["a"], ["d"]]
    assert ordered.collisions([a, {**b}, wall(1, -1, 1, 1)])[0] == 1
    assert [w["thickness"] for w in ordered.keep_thicker([wall(0, 0, 1, 0, 100), wall(1, 0, 0, 0, 200), wall(0, 1, 1, 1, 50)], 0.01, 1.0)] == [200, 50]
    merged_walls = ordered.merge_until_stable([wall(0, 0, 1, 0, ids=[1]), wall(3, 0, 4, 0, ids=[2]), wall(1, 0, 3, 0, ids=[3])], 0.1, 0.01, 1.0)
    assert len(merged_walls) == 1 and (merged_walls[0]["x1"], merged_walls[0]["x2"]) == (0.0, 4.0)
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert ordered.convex_overlap(square, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]) == 1.0
    assert len(ordered.distinct_boxes([{"cx": 0, "cy": 0, "w": 500, "d": 500}, {"cx": 100, "cy": 0, "w": 600, "d": 500}, {"cx": 900, "cy": 0, "w": 500, "d": 500}])) == 2


def test_greedy():
    pairs = [{"a": 1, "b": 2, "distance": 0.2, "overlap": 2, "lo": 0, "hi": 2, "b_lo": 0, "b_hi": 2}, {"a": 1, "b": 3, "distance": 0.3, "overlap": 2, "lo": 2, "hi": 4, "b_lo": 0, "b_hi": 2}, {"a": 1, "b": 4, "distance": 0.4, "overlap": 2, "lo": 1, "hi": 3, "b_lo": 0, "b_hi": 2}]
    assert [p["b"] for p in ordered.consume_intervals(pairs, 0.0)] == [2, 3]
    assert ordered.opening_bridges([wall(0, 0, 1, 0), wall(2, 0, 3, 0), wall(3.1, 0.5, 3.1, 4)]) == [{"x1": 1.0, "y1": 0.0, "x2": 2.0, "y2": 0.0, "gap": 1.0}]
    s = ordered.shear_walls([wall(0, 0, 4, 0), wall(0, 0.3, 4, 0.3), wall(0, 5, 4, 5)])
    assert [(round(w["thickness"]), w["shear"]) for w in s] == [(300, True), (200, False)]
    assert ordered.axis_transforms([0.0, 1.0, 3.0], [10.0, 12.0, 16.0], 1.0)[0][:3] == (2.0, 10.0, 3)
    lines = [{"coord": 0.0, "lo": 0.0, "hi": 10.0}, {"coord": 2.0, "lo": 15.0, "hi": 25.0}, {"coord": 9.0, "lo": 0.0, "hi": 5.0}]
    assert [(m["coord"], m["lo"], m["hi"]) for m in ordered.merge_axis_lines(lines)] == [(1.0, 0.0, 25.0), (9.0, 0.0, 5.0)]
    centre = ordered.merge_centerlines([{"orientation": "h", "fixed": 0.0, "lo": 0.0, "hi": 1.0, "thickness": 0.2}, {"orientation": "h", "fixed": 0.01, "lo": 1.05, "hi": 2.0, "thickness": 0.3}])
    assert len(centre) == 1 and centre[0]["hi"] == 2.0 and centre[0]["fixed"] == 0.005
