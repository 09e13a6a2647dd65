"""Cases of the fourth round's findings: what a step does, and that its results stay."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from girder.operators import graph, planar, rasters, runs, short_walls, specs
from girder.plans import queries_plans
from tests.conftest import DATA


def test_renders_are_scored_at_the_tried_shifts_only(spark):
    """Every second shift within a page's reach, none of others, and no shift on a page of odd reach: counts as sets of cells have them."""
    rng = random.Random(3)
    runs = lambda n: [(g, y, lo, lo + rng.randint(1, 9)) for g in (1, 2) for y in range(12) for lo in range(rng.randint(0, 5), 160, n)]
    template, other, reach = runs(23), runs(31), {1: 4, 2: 5}
    make = lambda rows: spark.createDataFrame(rows, "g long, y long, lo long, hi long")
    fit = spark.createDataFrame([(g, s, r) for g, r in reach.items() for s in (0, 1)], "g long, step int, reach long")
    both = make(template).withColumn("step", F.explode(F.array(F.lit(0), F.lit(1))))
    got = {(r.g, r.step, r.dy, r.dx): r.n for r in rasters._shared(both, make(other), fit, ["g"], ["g", "step"], "n").collect()}
    cells = lambda rows, g: {(y, x) for k, y, lo, hi in rows if k == g for x in range(lo, hi)}
    want = {}
    for g, r in reach.items():
        a, b = cells(template, g), cells(other, g)
        grid = [(dy, dx) for dy in range(-r, r + 1, 2) for dx in range(-r, r + 1, 2)]
        for step in (0, 1):
            for dy, dx in grid + [(0, 0)] * (r % 2 and step):
                if n := sum((y + dy, x + dx) in b for y, x in a):
                    want[g, step, dy, dx] = n
    assert got == want


def test_profiles_take_their_turn_in_few_rounds(spark, monkeypatch):
    """Groups laid all at once, again only where earlier ones took cells, and in pieces: as one after the other does it."""
    rng = random.Random(8)
    most, least, rounds = 5, 0.3, []
    settle = runs.settle
    monkeypatch.setattr(runs, "PIECE", 4)
    monkeypatch.setattr(runs, "settle", lambda df, name, since: (rounds.append(name), settle(df, name, since))[1])
    lines, template = [], {}
    for g in (1, 2):
        for _ in range(30):
            x, y, n = rng.randrange(60), rng.randrange(60), rng.randint(4, 25)
            lines.append((g, float(x), float(y), *((x + n, y) if rng.random() < 0.5 else (x, y + n)), 1.0))
        for i in range(14):
            x, y, w, h = rng.randrange(50), rng.randrange(50), rng.randint(2, 9), rng.randint(2, 6)
            template[g, i] = [(y + j, x, x + (w if j < 2 else 2)) for j in range(h)]
    lines = [tuple(map(float, r[1:])) for r in lines], [r[0] for r in lines]
    wall_rows = spark.createDataFrame([(g, *r) for g, r in zip(lines[1], lines[0], strict=True)], "g int, x1 double, y1 double, x2 double, y2 double, r double")
    rows = spark.createDataFrame([(g, i, *r) for (g, i), rs in template.items() for r in rs], "g int, group long, y long, lo long, hi long")
    order = spark.createDataFrame([(g, i, 14 - i) for g, i in template], "g int, group long, turn int")
    got = {(r.g, r.group): (r.dx, r.dy, round(r.overlap, 9)) for r in runs._placed(rows, wall_rows, order, ["g"], most, least).collect()}
    want, waited = {}, 0
    for g in (1, 2):
        mine = np.array([r for k, r in zip(lines[1], lines[0], strict=True) if k == g]).T
        _, y, lo, hi = runs._drawn(*mine)
        left = {(b, x) for b, a, z in zip(y, lo, hi, strict=True) for x in range(a, z)}
        whole = set(left)
        for i in reversed(range(14)):
            cells = {(b, x) for b, a, z in template[g, i] for x in range(a, z)}

            def best(of, cells=cells):
                found = [(-round(n - 0.08 * math.hypot(dx, dy) / most, 9), dy, dx, n) for dy in range(-most, most + 1) for dx in range(-most, most + 1) if (n := sum((b + dy, x + dx) in of for b, x in cells) / len(cells)) >= least]
                return min(found, default=None)

            now = best(left)
            waited += now != best(whole)
            if now:
                want[g, i] = now[2], now[1], round(now[3], 9)
                left -= {(b + now[1], x + now[2]) for b, x in cells}
    assert got == want and waited > 3
    assert len(rounds) < 10, "rounds are as many as groups wait for each other, not as there are groups"


def test_repeated_specifications_of_a_mark_meet_its_elements_once(spark):
    """They are summed up before the join; the best source of each signature stays, two signatures are a conflict."""
    elements = spark.createDataFrame([(i, 1, "wall", ("A", "B", None)[i % 3], 100.0 * i, 0.0) for i in range(9)], "element_id int, f int, kind string, mark string, x double, y double")
    row = lambda mark, source, thickness: (2, "wall", mark, source, (None, None, thickness), -50.0, 0.0)
    many = [row("A", s, 100.0) for s in ("annotation", "legend", "schedule") * 20] + [row("B", "detail", t) for t in (100.0, 150.0) * 20]
    rows = spark.createDataFrame(many, "f int, kind string, mark string, source_kind string, dims struct<width:double,depth:double,thickness:double>, x double, y double")
    out = specs.resolve_specs(elements, rows, ["f"], 3.0)
    got = {r.element_id: (r.spec_status, r.spec and r.spec.source_kind) for r in out.collect()}
    assert got == {i: (("matched", "schedule"), ("conflict", "detail"), ("missing", None))[i % 3] for i in range(9)}
    assert re.search(r"Aggregate \[(s_)?kind#\d+, (s_)?mark#\d+, dims", out._jdf.queryExecution().optimizedPlan().toString())


def ringed(spark, rng):
    """Half-edges in rings of many lengths, far apart or not, and the smallest of each ring."""
    rows, want, h = [], {}, 0
    names = rng.sample(range(10**6), 400)
    for n in (1, 2, 3, 40, 5, 200, 4, 4):
        ring, h = names[h:h + n], h + n
        rows += [(1, a, b, *(rng.randrange(200) * planar.GRID for _ in "xyxy")) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
        want |= {a: min(ring) for a in ring}
    return spark.createDataFrame(rows, "g int, h long, next long, ux long, uy long, vx long, vy long"), want


def test_rings_through_many_slices(spark, monkeypatch):
    half, want = ringed(spark, random.Random(4))
    monkeypatch.setattr(planar, "SLICE", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {r.h: r.label for r in planar.traced(half, ["g"]).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rooms_of_a_place_are_followed_without_rounds(spark, monkeypatch):
    """A grid of 12 x 12 rooms and a large one about it: no round over all edges is needed."""
    def never(*_):
        raise AssertionError("a round over all edges")

    monkeypatch.setattr(planar, "settle", never)
    lines = [(1, 10 * i, float(i), 0.0, float(i), 12.0) for i in range(13)] + [(1, 10 * i + 1, 0.0, float(i), 12.0, float(i)) for i in range(13)]
    lines += [(1, 1000 + i, *map(float, r)) for i, r in enumerate(((-1, -1, 14, -1), (14, -1, 14, 14), (14, 14, -1, 14), (-1, 14, -1, -1)))]
    lines = [(*r[:2], *(v + 2 for v in r[2:])) for r in lines]
    rows = spark.createDataFrame(lines, "g int, seg_id long, x1 double, y1 double, x2 double, y2 double").coalesce(1)
    got = sorted((r.area, r.edges) for r in planar.rooms(rows, ["g"]).collect())
    assert got == [(1.0, 4)] * 144 + [(81.0, 4)]


def test_components_through_slices(spark, monkeypatch):
    """Slices of three edges, numbers and texts: the smallest node of each component, in the order of bytes."""
    rng = random.Random(6)
    monkeypatch.setattr(graph, "SLICE", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    try:
        for name, kind in ((lambda n: n, "long"), (lambda n: ("z", "墙", "é")[n % 3] + str(n), "string")):
            low = {name(n): name(n) for p in pairs for n in p}
            for _ in low:
                for p, q in pairs:
                    low[name(p)] = low[name(q)] = min(low[name(p)], low[name(q)], key=lambda v: v if kind == "long" else v.encode())
            alone = {name(p) for p, q in pairs if p == q} - {name(n) for p, q in pairs if p != q for n in (p, q)}
            rows = spark.createDataFrame([(name(p), name(q)) for p, q in pairs], f"a {kind}, b {kind}")
            assert {r.node: r.label for r in graph.components(rows).collect()} == {n: v for n, v in low.items() if n not in alone}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_components_are_matched_many_at_once(spark, monkeypatch):
    """Not a group each: 300 components of a known matching in few calls."""
    calls = spark.sparkContext.accumulator(0)
    solve = graph.max_matching

    def counted(edges):
        calls.add(1)
        return solve(edges)

    monkeypatch.setattr(graph, "max_matching", counted)
    edges = [e for i in range(0, 900, 3) for e in ((i, i), (i, i + 1), (i + 1, i))]
    out = graph.matching(spark.createDataFrame(edges, "left long, right long")).collect()
    assert {(r.left, r.right) for r in out} == {e for i in range(0, 900, 3) for e in ((i, i + 1), (i + 1, i))}
    assert len({r.component for r in out}) == 300 and all(r.component == f"l:{min(f'{3 * (r.left // 3)}', f'{3 * (r.left // 3) + 1}')}" for r in out)
    assert 0 < calls.value < 100


def test_short_pairs_are_walked_with_their_lines_only(spark, monkeypatch):
    """What is repeated for every cell holds no whole face."""
    plans = []
    tied = graph.with_components
    monkeypatch.setattr(graph, "with_components", lambda nodes, edges, key: (plans.append(edges._jdf.queryExecution().optimizedPlan().toString()), tied(nodes, edges, key))[1])
    short_walls.grouped(short_walls.face_pairs(short_walls.eligible(queries_plans._units(spark, DATA))))
    assert "thickness" in plans[0] and not re.search(r"face_[ab]#\d+ AS [lr]_face_", plans[0])
