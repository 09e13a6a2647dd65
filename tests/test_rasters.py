"""Centre lines, registered renders and verdicts against plain Python."""

import math
import random
from collections import defaultdict

import pytest

from girder.operators import rasters
from girder.plans import queries_rasters
from tests.conftest import DATA

EDGE = "g int, x1 double, y1 double, x2 double, y2 double"


def brute_lines(rows):
    """Axis lines by linking all pairs."""
    out = []
    for x1, y1, x2, y2 in rows:
        turn = abs(math.degrees(math.atan2(y2 - y1, x2 - x1))) % 180
        length = math.hypot(x2 - x1, y2 - y1)
        if min(turn, 180 - turn) <= 6:
            out.append(["H", (y1 + y2) / 2, min(x1, x2), max(x1, x2), length])
        elif abs(turn - 90) <= 6:
            out.append(["V", (x1 + x2) / 2, min(y1, y2), max(y1, y2), length])
    links = [(i, j) for i, a in enumerate(out) for j, b in enumerate(out[:i]) if a[0] == b[0] and abs(a[1] - b[1]) <= 3 and b[2] <= a[3] + 8 and a[2] <= b[3] + 8]
    group, before = list(range(len(out))), None
    while group != before:
        before = list(group)
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    members = defaultdict(list)
    for i, a in zip(group, out, strict=True):
        members[i].append(a)
    merged = []
    for m in members.values():
        weight = sum(a[4] for a in m)
        merged.append((m[0][0], sum(a[1] * a[4] for a in m) / weight if weight else sum(a[1] for a in m) / len(m), min(a[2] for a in m), max(a[3] for a in m)))
    return sorted(merged)


def brute_walls(lines, reuse):
    used, out = set(), []
    for i, a in enumerate(lines):
        if i in used and not reuse:
            continue
        near = []
        for j in range(i + 1, len(lines)):
            b = lines[j]
            t, lo, hi = b[1] - a[1], max(a[2], b[2]), min(a[3], b[3])
            if b[0] == a[0] and 3 <= t <= 24 and hi - lo >= 15 and (reuse or j not in used):
                near.append((t, lo - hi, j, lo, hi))
        if near:
            t, _, j, lo, hi = min(near)
            used |= {i, j}
            mid = (a[1] + lines[j][1]) / 2
            out.append((a[0], *((lo, mid, hi, mid) if a[0] == "H" else (mid, lo, mid, hi)), t))
    return sorted(out)


def alike(got, want):
    """Equal walls, to a hundredth of a pixel."""
    assert set(got) == set(want)
    for g in want:
        assert [w[0] for w in got[g]] == [w[0] for w in want[g]], g
        assert all(v == pytest.approx(u, abs=0.011) for a, b in zip(got[g], want[g], strict=True) for v, u in zip(a[1:], b[1:], strict=True)), g


def found(frame):
    out = defaultdict(list)
    for r in frame.collect():
        assert r.confidence == 0.85
        out[r[0]].append((r.axis, r.x1, r.y1, r.x2, r.y2, r.thickness))
    return {g: sorted(w) for g, w in out.items()}


@pytest.mark.parametrize("reuse", [True, False])
def test_centerlines_against_pairs(spark, reuse):
    rng = random.Random(3)
    rows = []
    for g in range(4):
        for _ in range(60):
            a, c, n = rng.randrange(0, 300) / 1.0, rng.randrange(0, 200) + rng.choice([0.0, 0.25]), rng.randrange(1, 120)
            lean = rng.choice([0.0, 0.0, 0.5, n * 0.2])
            line = (a, c, a + n, c + lean)
            line = line if rng.random() < 0.5 else (line[2], line[3], line[0], line[1])
            rows.append((g, *(line if rng.random() < 0.5 else (line[1], line[0], line[3], line[2]))))
    # Stacked edges: a hatch in which each choice hangs on the one before.
    rows += [(9, 0.0, 5.0 * i, 40.0 + i, 5.0 * i) for i in range(9)]
    got = found(rasters.centerlines(spark.createDataFrame(rows, EDGE), ["g"], reuse=reuse))
    want = {g: brute_walls(brute_lines([r[1:] for r in rows if r[0] == g]), reuse) for g in (0, 1, 2, 3, 9)}
    alike(got, want)
    assert len(want[9]) == (8 if reuse else 4)


def test_centerlines_limits(spark):
    """Distances of 3 and 24, an overlap of 15, lines 3 apart and gaps of 8 are within; nulls, slopes and empty tables give nothing."""
    wall = lambda g, t, n: [(g, 0.0, 0.0, 100.0, 0.0), (g, 100.0 - n, t, 200.0, t)]
    rows = wall(1, 24.0, 15.0) + wall(2, 24.1, 50.0) + wall(3, 24.0, 14.9) + [(4, 0.0, 0.0, 50.0, 50.0), (4, None, 0.0, 9.0, 0.0), (5, 1.0, 1.0, 1.0, 1.0)]
    rows += [(6, 0.0, 0.0, 30.0, 0.0), (6, 38.0, 3.0, 68.0, 3.0), (6, 0.0, 10.0, 68.0, 10.0)] * 2
    rows += [(7, 0.0, 0.0, 30.0, 0.0), (7, 38.1, 0.0, 68.1, 0.0), (7, 0.0, 10.0, 68.0, 10.0)]
    df = spark.createDataFrame(rows, EDGE)
    assert found(rasters.centerlines(df, ["g"])) == {1: [("H", 85.0, 12.0, 100.0, 12.0, 24.0)], 6: [("H", 0.0, 5.75, 68.0, 5.75, 8.5)], 7: [("H", 0.0, 5.0, 30.0, 5.0, 10.0), ("H", 38.1, 5.0, 68.0, 5.0, 10.0)]}
    for reuse in (True, False):
        assert rasters.centerlines(df.limit(0), ["g"], reuse=reuse).count() == 0
    assert found(rasters.centerlines(df.filter("g = 7"), ["g"], reuse=False)) == {7: [("H", 0.0, 5.0, 30.0, 5.0, 10.0)]}


def near(cells):
    return {(x + a, y + b) for x, y in cells for a in range(-4, 5) for b in range(-4, 5)}


def likeness(a, b):
    return (len(a & near(b)) / len(a), len(b & near(a)) / len(b)) if a and b else (0.0, 0.0)


def brute_register(width, height, t_width, t_height, source, target):
    """All turns, shifts and scales over sets of pixels."""
    if (width, height) == (t_width, t_height):
        cover, precise = likeness(source, target)
        return "identity", 0, 1.0, 1.0, 0.0, 0.0, min(cover, precise), cover, precise
    if not source or not target:
        return "canvas_scale_no_content", 0, width / t_width, height / t_height, 0.0, 0.0, 0.0, 0.0, 0.0
    box = lambda c: (min(x for x, _ in c), min(y for _, y in c), max(x for x, _ in c) - min(x for x, _ in c) + 1, max(y for _, y in c) - min(y for _, y in c) + 1)
    turns = {0: lambda x, y: (x, y), 90: lambda x, y: (t_height - 1 - y, x), 180: lambda x, y: (t_width - 1 - x, t_height - 1 - y), 270: lambda x, y: (y, t_width - 1 - x)}
    angles = (0, 180) if (width >= height) == (t_width >= t_height) else (0, 90, 180, 270)
    reach, best, wide = math.floor(max(4.0, min(16.0, 0.02 * min(width, height)))), None, near(source)
    for angle in angles:
        turned = {turns[angle](x, y) for x, y in target}
        s, t = box(source), box(turned)
        scale = s[2] / t[2], s[3] / t[3]
        move = s[0] + s[2] / 2 - scale[0] * (t[0] + t[2] / 2), s[1] + s[3] / 2 - scale[1] * (t[1] + t[3] / 2)
        for step, by in enumerate((-0.005, 0.0, 0.005)):
            f = [v * (1 + by) for v in scale]
            span = lambda v, i: range(math.ceil(move[i] + f[i] * (v - 0.5)), math.ceil(move[i] + f[i] * (v + 1 - 0.5)))  # noqa: B023, E731
            warped = {(a, b) for x, y in turned for a in span(x, 0) for b in span(y, 1)}
            grown = near(warped)
            for dx in range(-reach, reach + 1):
                for dy in range(-reach, reach + 1):
                    base = not dx and not dy and step == 1
                    if base or ((dx + reach) % 2 == 0 and (dy + reach) % 2 == 0):
                        score = min(sum((x - dx, y - dy) in grown for x, y in source) / len(source), sum((x + dx, y + dy) in wide for x, y in warped) / len(warped))
                        key = (-round(score, 9), angle, not base, dx, dy, step)
                        if best is None or key < best[0]:
                            best = key, f, (move[0] + dx, move[1] + dy), {(x + dx, y + dy) for x, y in warped}
    key, f, move, placed = best
    placed = {(x, y) for x, y in placed if 0 <= x < width and 0 <= y < height}
    return "content_bbox", key[1], f[0], f[1], move[0], move[1], -key[0], *likeness(source, placed)


def test_registration_against_all_shifts(spark):
    rng = random.Random(8)
    pages, rows = [], []
    for g, (w, h, tw, th) in enumerate([(44, 30, 44, 30), (44, 30, 52, 36), (44, 30, 52, 36), (44, 30, 36, 52), (44, 30, 30, 60), (44, 30, 50, 40), (44, 30, 50, 40), (44, 30, 36, 52), (30, 44, 20, 33)]):
        source = {(x, y) for _ in range(5) for x0, y0 in [(rng.randrange(w), rng.randrange(h))] for i in range(12) for x, y in [(x0 + i, y0) if rng.random() < 2 else (0, 0)] if x < w}
        source |= {(x0, y) for _ in range(4) for x0, y0 in [(rng.randrange(w), rng.randrange(h))] for y in range(y0, min(h, y0 + 9))}
        if g == 7:
            target = {(y + 3, tw and (th - 1 - (x + 4))) for x, y in source}
        elif g in (5, 6):
            target = set() if g == 5 else {(x, y) for x, y in source if x < 25}
        elif g in (0, 1):
            target = {(x + (3 if g else 0), y + (2 if g else 6)) for x, y in source if y + 6 < th}
        else:
            target = {(rng.randrange(tw), rng.randrange(th)) for _ in range(40)} | {(min(tw - 1, x + 2), min(th - 1, y)) for x, y in source}
        pages.append((g, w, h, tw, th))
        rows.append((source, target))
    df = lambda i: rasters.runs.union(spark.createDataFrame([(g, y, x, x + 1) for g, r in enumerate(rows) for x, y in r[i]], "g int, y long, lo long, hi long"), ["g"])
    images = spark.createDataFrame(pages, "g int, width int, height int, t_width int, t_height int")
    got = {r.g: (r.mode, r.angle, *(round(v, 3) for v in (r.scale_x, r.scale_y, r.move_x, r.move_y, r.search_iou, r.coverage, r.precision))) for r in rasters.register_renders(images, df(0), df(1), ["g"]).collect()}
    want = {g: tuple(round(v, 3) if isinstance(v, float) else v for v in brute_register(*page, *r)) for (g, *page), r in zip(pages, rows, strict=True)}
    assert got == want
    assert got[7][1] == 90 and got[7][6:] == (1.0, 1.0, 1.0)


def test_planted_turns_are_found(spark):
    out = {r.page: r for r in queries_rasters.render_registration(spark, DATA).collect()}
    for page, r in out.items():
        if page % 5 == 4:
            assert (r.mode, r.angle) == ("identity", 0)
        elif page % 3:
            assert (r.angle, r.scale_x, r.scale_y, r.move_x, r.move_y, r.edge_iou) == (page % 4 * 90, 1.0, 1.0, -7.0, -5.0, 1.0)
        else:
            assert r.angle == page % 4 * 90 and r.edge_iou < 1
    assert len(out) == 6 or len(out) == 5


def test_audit_verdicts(spark):
    """Each issue alone, by tier, and similarities at the limit."""
    good = {"model_sha256": "m", "result_model_sha256": "m", "tenant": "t", "result_tenant": "t", "project": "p", "result_project": "p", "approval": "approved", "status": "succeeded", "transaction_id": "x", "walls": 4, "read_walls": 4, "made_walls": 4, "columns": 0, "read_columns": None, "made_columns": None, "beams": 2, "read_beams": 2, "made_beams": 2, "source_sha256": "s", "view_sha256": "v", "recorded_view_sha256": "v"}
    cases = [({}, 0.95, "pass", []), ({}, 0.949, "fail", ["edge_iou_too_low", "coverage_too_low", "similarity_too_low"]), ({}, None, "fail", ["edge_iou_too_low", "coverage_too_low", "precision_too_low", "similarity_too_low"]), ({"result_model_sha256": None}, 1.0, "blocked", ["other_model"]), ({"result_project": "q"}, 1.0, "blocked", ["other_project"]),
             ({"approval": None}, 1.0, "blocked", ["not_approved"]), ({"status": "failed", "read_walls": None}, 1.0, "blocked", ["not_succeeded"]), ({"transaction_id": None}, 1.0, "blocked", ["no_transaction"]), ({"read_walls": None}, 1.0, "blocked", ["walls_not_read_back"]), ({"read_walls": 3, "made_walls": 3}, 1.0, "blocked", ["walls_read_back_differ", "walls_made_differ"]),
             ({"columns": 1}, 1.0, "blocked", ["columns_read_back_differ", "columns_made_differ"]), ({"read_beams": 1}, 1.0, "blocked", ["beams_read_back_differ"]), ({"source_sha256": None, "view_sha256": None}, 1.0, "blocked", ["source_render_missing", "view_missing"]), ({"recorded_view_sha256": "w"}, 0.1, "blocked", ["view_hash_differs"]), ({"source_sha256": "v"}, 1.0, "blocked", ["renders_not_independent"]), ({"approval": "draft", "source_sha256": "v"}, 1.0, "blocked", ["not_approved"])]
    schema = "g int, " + ", ".join(f"{n} {'int' if isinstance(v, int) or v is None else 'string'}" for n, v in good.items())
    results = spark.createDataFrame([(g, *(good | c[0]).values()) for g, c in enumerate(cases)], schema)
    registered = spark.createDataFrame([(g, c[1], c[1], 1.0) for g, c in enumerate(cases) if c[1] is not None], "g int, edge_iou double, coverage double, precision double")
    out = {r.g: (r.status, r.issues) for r in rasters.audit_verdicts(registered, results, ["g"], coverage=0.5).collect()}
    assert out == {g: (c[2], c[3]) for g, c in enumerate(cases)}
    with pytest.raises(ValueError, match="precision"):
        rasters.audit_verdicts(registered, results, ["g"], precision=1.5)


def test_walls_once_against_order(spark):
    edges = queries_rasters.raster_edges(spark, DATA).collect()
    by = defaultdict(list)
    for r in edges:
        by[r.drawing].append((r.x1, r.y1, r.x2, r.y2))
    got = found(queries_rasters.raster_walls_once(spark, DATA))
    alike(got, {d: w for d, rows in by.items() if (w := brute_walls(brute_lines(rows), False))})
