"""Run-length rasters against sets of cells in plain Python."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from girder.operators import runs
from girder.plans import fixtures as X
from girder.plans import queries_plans
from tests.conftest import DATA


def thick(x1, y1, x2, y2, width):
    """Cells whose centres are within half the width of a segment."""
    out, n2, r = set(), (x2 - x1) ** 2 + (y2 - y1) ** 2, width / 2
    for y in range(math.floor(min(y1, y2) - r), math.ceil(max(y1, y2) + r) + 1):
        for x in range(math.floor(min(x1, x2) - r), math.ceil(max(x1, x2) + r) + 1):
            t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n2)) if n2 else 0
            if math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)) <= r + 1e-9:
                out.add((x, y))
    return out


def cells(rows):
    out = defaultdict(set)
    for r in rows:
        new = {(x, r.y) for x in range(r.lo, r.hi)}
        assert r.lo < r.hi and not new & out[r.g]
        out[r.g] |= new
    return out


def parts(taken, diagonal=False):
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (diagonal or not (dx and dy))]
    left, out = set(taken), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            x, y = todo.pop()
            for dx, dy in steps:
                if (p := (x + dx, y + dy)) in left:
                    left.remove(p)
                    part.add(p)
                    todo.append(p)
        out.append(part)
    return out


def test_runs_are_sets_of_cells(spark):
    rng = random.Random(4)
    lines = [(g, *(float(rng.randrange(40)) for _ in range(4)), float(rng.choice([1, 1, 2, 3, 5]))) for g in range(5) for _ in range(7)] + [(5, 3.0, 3.0, 3.0, 3.0, 4.0), (6, 0.0, 0.0, 200.0, 3.0, 1.0)]
    df = runs.line_runs(spark.createDataFrame(lines, "g int, x1 double, y1 double, x2 double, y2 double, width double"), ["g"]).cache()
    want = defaultdict(set)
    for g, *line in lines:
        want[g] |= thick(*line)
    assert cells(df.collect()) == want
    frames = spark.createDataFrame([(g, -10, -10, 60, 60) for g in range(6)] + [(7, 0, 0, 2, 2)], "g int, left long, top long, right long, bottom long")
    left = runs.free(df.filter("g < 6"), frames, ["g"])
    whole = {(x, y) for x in range(-10, 60) for y in range(-10, 60)}
    assert cells(left.collect()) == {g: whole - want[g] for g in range(6)} | {7: {(0, 0), (1, 0), (0, 1), (1, 1)}}
    for diagonal in (False, True):
        got = defaultdict(list)
        for r in runs.labelled(df, ["g"], diagonal).collect():
            got[r.g, r.region] += [(x, r.y) for x in range(r.lo, r.hi)]
        assert sorted((g, sorted(c)) for (g, _), c in got.items()) == sorted((g, sorted(p)) for g in want for p in parts(want[g], diagonal))
    assert cells(runs.grown(df, ["g"], 2).collect()) == {g: {(x + a, y + b) for x, y in c for a in range(-2, 3) for b in range(-2, 3)} for g, c in want.items()}
    other = spark.createDataFrame([(g, 5, 30, 30, 33) for g in range(5)], "g int, left long, top long, right long, bottom long")
    hole = {(x, y) for x in range(5, 30) for y in range(30, 33)}
    boxes = runs.box_runs(other, ["g"])
    assert cells(runs._without(df, boxes, ["g"]).collect()) == {g: c - hole if g < 5 else c for g, c in want.items() if c - hole}
    met = runs.meeting(df, boxes, ["g"]).groupBy("g").agg(F.sum(F.least("hi", "b_hi") - F.greatest("lo", "b_lo")).alias("n")).collect()
    assert {r.g: r.n for r in met} == {g: len(want[g] & hole) for g in range(5) if want[g] & hole}


def test_polygons(spark):
    shapes = {0: [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)], 1: [(0, 0), (9, 3), (3, 9)], 2: [(5, 0), (10, 5), (5, 10), (0, 5)]}
    df = spark.createDataFrame([(g, [(float(x), float(y)) for x, y in p]) for g, p in shapes.items()], "g int, points array<struct<x:double,y:double>>")

    def holds(p, x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    assert cells(runs.polygon_runs(df, ["g"]).collect()) == {g: {(x, y) for x in range(-1, 12) for y in range(-1, 12) if holds(p, x, y)} for g, p in shapes.items()}


def test_enclosed_regions_limits(spark):
    box = lambda g, x, y, w, h, t=100.0: [(g, a, b, c, d, t) for a, b, c, d in ((x, y, x + w, y), (x + w, y, x + w, y + h), (x + w, y + h, x, y + h), (x, y + h, x, y))]
    rows = box(1, 0.0, 0.0, 2.1, 2.1) + box(2, 0.0, 0.0, 2.0, 2.0) + box(3, 0.0, 0.0, 5.0, 5.0)[:3] + box(4, 0.0, 0.0, 5.0, 5.0, None)
    df = spark.createDataFrame(rows, "g int, x1 double, y1 double, x2 double, y2 double, thickness double")
    # Of 2.1 m and walls of a cell, 20 x 20 cells are left: 4.0 square metres, which is enough; of 2.0 m 19 x 19 are not.
    assert sorted((r.g, r.cells, r.area) for r in runs.enclosed_regions(df, ["g"]).collect()) == [(1, 400, 4.0), (4, 2401, 24.01)]
    assert runs.enclosed_regions(df.limit(0), ["g"]).count() == 0


def test_enclosed_regions_against_flood_fill(spark):
    rows = [r for r in X.segments(spark, DATA).collect() if r.drawing < 3]
    want, near = [], lambda v: round(v)
    for d in {r.drawing for r in rows}:
        mine = [r for r in rows if r.drawing == d]
        bx, by2 = min(r.x1 for r in mine), max(r.y2 for r in mine)
        w, h = math.ceil((max(r.x2 for r in mine) - bx) / 0.1) + 11, math.ceil((by2 - min(r.y1 for r in mine)) / 0.1) + 11
        taken = set()
        for r in mine:
            taken |= thick(near((r.x1 - bx) / 0.1) + 5, near((by2 - r.y1) / 0.1) + 5, near((r.x2 - bx) / 0.1) + 5, near((by2 - r.y2) / 0.1) + 5, max(1, round(r.thickness / 1000 / 0.1)))
        for p in parts({(x, y) for x in range(w) for y in range(h)} - taken):
            if len(p) * 0.1 * 0.1 >= 4 and not any(x in (0, w - 1) or y in (0, h - 1) for x, y in p):
                want.append((d, len(p)))
    got = queries_plans.enclosed_regions(spark, DATA).filter("drawing < 3").collect()
    assert sorted((r.drawing, r.cells) for r in got) == sorted(want) and want


def brute_quality(boxes, mask, width, height):
    near = {(x + a, y + b) for x, y in mask for a in range(-5, 6) for b in range(-5, 6)}
    region = {p: i for i, part in enumerate(parts(mask, True)) for p in part}
    size, good, seen = defaultdict(int), [], set()
    for i in region.values():
        size[i] += 1
    for b in boxes:
        x1, y1 = max(0, min(width, math.floor(b.x1))), max(0, min(height, math.floor(b.y1)))
        x2, y2 = max(0, min(width, math.ceil(b.x2))), max(0, min(height, math.ceil(b.y2)))
        inside = [(x, y) for x in range(x1, x2) for y in range(y1, y2)]
        count = defaultdict(int)
        for p in inside:
            if p in region:
                count[region[p]] += 1
        exact = sum(count.values())
        if inside and exact and sum(p in near for p in inside) / len(inside) >= 0.08 and max(count.values()) / exact >= 0.25:
            seen |= set(inside)
            good.append((b.confidence, exact))
    covered = defaultdict(int)
    for p in seen & set(mask):
        covered[region[p]] += 1
    if not seen or not mask:
        return 0.0, 0.0, 0.0, len(good), len(size), 0, 0.0, 0.0, False, "REVIEW"
    total = sum(covered.values())
    n = sum(covered[i] / size[i] >= 0.5 for i in size)
    single = max(e / total for _, e in good)
    diverse = len(size) <= 1 or (len(good) >= 2 and single <= 0.8)
    recall, precision, most = total / len(mask), len(seen & near) / len(seen), max(c for c, _ in good)
    ok = recall >= 0.5 and precision >= 0.08 and most >= 0.25 and n / len(size) >= 0.5 and diverse
    return round(recall, 4), round(precision, 4), round(most, 4), len(good), len(size), n, round(n / len(size), 4), round(single, 4), diverse, "PASS" if ok else "REVIEW"


def test_detection_quality_against_masks(spark):
    boxes, reference, images = queries_plans.detection_input(spark, DATA)
    masks, by = defaultdict(set), defaultdict(list)
    for r in reference.collect():
        masks[r.drawing] |= {(x, r.y) for x in range(r.lo, r.hi)}
    for b in boxes.collect():
        by[b.drawing].append(b)
    got = {r.drawing: tuple(r)[1:] for r in queries_plans.detection_quality(spark, DATA).collect()}
    assert got == {r.drawing: brute_quality(by[r.drawing], masks[r.drawing], 260, 260) for r in images.collect()}


def test_detection_gates(spark):
    """Each gate at its limit: half of the mask seen is enough, one cell less is not."""
    mask = spark.createDataFrame([(g, y, 0, 20) for g in range(5) for y in range(10)], "g int, y long, lo long, hi long")
    box = lambda g, i, x1, x2, c: (g, i, float(x1), 0.0, float(x2), 10.0, c)
    boxes = [box(0, 1, 0, 10, 0.25), box(1, 1, 0, 9, 0.25), box(2, 1, 0, 10, 0.2499), box(3, 1, 40, 50, 0.9)]
    images = spark.createDataFrame([(g, 60, 60) for g in range(6)], "g int, width long, height long")
    out = {r.g: (r.status, r.recall, r.boxes) for r in runs.detection_quality(spark.createDataFrame(boxes, "g int, box_id int, x1 double, y1 double, x2 double, y2 double, confidence double"), mask, images, ["g"]).collect()}
    assert out == {0: ("PASS", 0.5, 1), 1: ("REVIEW", 0.45, 1), 2: ("REVIEW", 0.5, 1), 3: ("REVIEW", 0.0, 0), 4: ("REVIEW", 0.0, 0), 5: ("REVIEW", 0.0, 0)}


def test_profiles_find_planted_shifts(spark):
    """Two groups drawn beside their walls by known shifts; the larger one is placed first, and its walls are gone for the other."""
    walls = [(1, 0.0, 0.0, 3000.0, 0.0, 200.0), (1, 0.0, 0.0, 0.0, 3000.0, 200.0), (1, 20000.0, 0.0, 20000.0, 2000.0, 200.0), (2, 0.0, 0.0, 100.0, 0.0, 50.0)]
    bar = lambda w, h: [(0.0, 0.0), (w, 0.0), (w, h), (0.0, h)]
    dx, dy = 1500.0, -700.0
    profiles = [(1, 1, -100.0 - dx, -100.0 - dy, bar(2000.0, 200.0)), (1, 2, -100.0 - dx, 500.0 - dy, bar(200.0, 1500.0)), (1, 3, 19900.0 + 300.0, 200.0 + 250.0, bar(200.0, 1200.0)), (2, 4, 0.0, 9000.0, bar(4000.0, 4000.0)), (1, 5, 60000.0, 0.0, [(0.0, 0.0)])]
    df = spark.createDataFrame(profiles, "g int, column_id int, x double, y double, points array<struct<x:double,y:double>>")
    w = spark.createDataFrame(walls, "g int, x1 double, y1 double, x2 double, y2 double, thickness double")
    out = {r.column_id: r for r in runs.register_profiles(df, w, ["g"], max_shift=2500.0).collect()}
    assert set(out) == {1, 2, 3}
    # The ends of walls are round, so a square corner may miss a cell of theirs.
    assert {(out[i].dx, out[i].dy) for i in (1, 2)} == {(dx, dy)} and out[1].group == out[2].group != out[3].group
    assert out[3].dx == -300.0 and min(r.overlap for r in out.values()) > 0.98
    assert (out[1].x, out[1].y, out[1].group_size, out[3].group_size) == (-100.0, -100.0, 2, 1)
    assert runs.register_profiles(df.limit(0), w, ["g"]).count() == 0


def test_shifts_against_all(spark):
    rng = random.Random(9)
    cell_rows = lambda n, size: [(0, y, a, a + rng.randint(1, 6)) for y in rng.sample(range(size), n) for a in (rng.randrange(size),)]
    wall, template = cell_rows(18, 30), cell_rows(6, 12)
    make = lambda rows: spark.createDataFrame(rows, "g int, y long, lo long, hi long")
    (got,) = runs.best_shifts(make(template).withColumn("group", F.lit(7)), make(wall), ["g"], 10, 0.2).collect()
    taken = {(x, y) for _, y, lo, hi in wall for x in range(lo, hi)}
    mine = {(x, y) for _, y, lo, hi in template for x in range(lo, hi)}
    worth = {}
    for dy in range(-10, 11):
        for dx in range(-10, 11):
            share = sum((x + dx, y + dy) in taken for x, y in mine) / len(mine)
            if share >= 0.2:
                worth[-round(share - 0.08 * math.hypot(dx, dy) / 10, 9), dy, dx] = share
    best = min(worth)
    assert (got.dy, got.dx, round(got.overlap, 9)) == (*best[1:], round(worth[best], 9))
