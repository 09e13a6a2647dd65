"""Every registered query of the library against its SQL on the smallest tables."""

from collections import defaultdict

import pytest

from girder.plans import fixtures as X
from girder.plans.catalogue import ORACLE_SQL, QUERIES
from tests.conftest import DATA, same_rows
from tests.test_plans import flood


def by(rows, *keys):
    groups = defaultdict(list)
    for r in rows:
        groups[tuple(r[k] for k in keys)].append(r)
    return groups


def brute_nms(spark, frame):
    kept = {(r.image, r.class_id, r.box_id) for r in frame.collect()}
    want = set()
    for (image, cls), boxes in by([r.asDict() | {"class_id": r.seg_id % 3} for r in X.segments(spark, DATA).collect()], "drawing", "class_id").items():
        mine = []
        for b in sorted(boxes, key=lambda b: (-(b["seg_id"] * 7 % 101 / 101), b["seg_id"])):
            over = lambda c: max(0.0, 3 - abs(b["lo"] - c["lo"])) * max(0.0, 3 - abs(b["fixed"] - c["fixed"]))  # noqa: B023, E731
            if all(over(c) / (18 - over(c)) < 0.5 for c in mine):
                mine.append(b)
        want |= {(image, cls, b["seg_id"]) for b in mine}
    assert kept == want


def _values(spark):
    return {k: sorted(r.fixed for r in rows) for k, rows in by(X.segments(spark, DATA).collect(), "drawing", "upright").items()}


def brute_cluster_1d(spark, frame):
    want = set()
    for (d, u), values in _values(spark).items():
        groups = []
        for v in values:
            if groups and abs(v - sum(groups[-1]) / len(groups[-1])) <= 0.3:
                groups[-1].append(v)
            else:
                groups.append([v])
        want |= {(d, u, i, round(sum(g) / len(g), 9), len(g)) for i, g in enumerate(groups)}
    assert {(r.drawing, r.upright, r.cluster, round(r["mean"], 9), r.n) for r in frame.collect()} == want


def brute_cluster_pairwise(spark, frame):
    want = set()
    for (d, u), values in _values(spark).items():
        centres = []
        for v in values:
            if centres and abs(v - centres[-1]) < 0.3:
                centres[-1] = (centres[-1] + v) / 2
            else:
                centres.append(v)
        want |= {(d, u, i, c) for i, c in enumerate(centres)}
    assert {(r.drawing, r.upright, r.cluster, r.centre) for r in frame.collect()} == want


def brute_breaker(spark, frame):
    got = {r.event_id: (r.before, r.after) for r in frame.collect()}
    events = spark.read.parquet(f"{DATA}/events.parquet").collect()
    assert len(got) == len(events)
    for mine in by(events, "user_id").values():
        state, fails, opened = "closed", 0, None
        for e in sorted(mine, key=lambda e: (e.ts, e.event_id)):
            if state == "open" and (e.ts - opened).total_seconds() >= 7200:
                state = "half_open"
            before = state
            if state != "open" and e.event_type not in ("error", "view"):
                state, fails = "closed", 0
            elif state != "open":
                fails += 1
                if state == "half_open" or fails >= 3:
                    state, fails, opened = "open", 0, e.ts
            assert got[e.event_id] == (before, state)


def brute_matching(spark, frame):
    """A valid matching of the size that plain augmenting paths reach."""
    from girder.plans import queries_geometry

    edges = {(r.left, r.right) for r in queries_geometry._sides(spark, DATA).collect()}
    got = [(r.left, r.right) for r in frame.collect()]
    assert set(got) <= edges and len({a for a, _ in got}) == len(got) == len({b for _, b in got})
    near, held = defaultdict(list), {}
    for a, b in edges:
        near[a].append(b)

    def augment(a, seen):
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in held or augment(held[b], seen):
                    held[b] = a
                    return True
        return False

    assert len(got) == sum(augment(a, set()) for a in list(near))


def brute_collinear(spark, frame):
    """Merged walls use each wall once and cover what their members cover."""
    walls = {r.seg_id: r for r in X.segments(spark, DATA).collect()}
    rows = frame.collect()
    assert sorted(i for r in rows for i in r.ids) == sorted(walls)
    for r in rows:
        mine = [walls[i] for i in r.ids]
        assert len({w.upright for w in mine}) == 1 and len({w.drawing for w in mine}) == 1
        assert abs(max(r.x1, r.x2, r.y1, r.y2) - max(max(w.x1, w.x2, w.y1, w.y2) for w in mine)) < 0.5
        assert abs(r.x2 - r.x1) + abs(r.y2 - r.y1) >= max(w.hi - w.lo for w in mine) - 1e-6


def brute_bridges(spark, frame):
    """Each bridge spans a gap on a whole-metre line, from the end of one wall to the start of another."""
    ends = defaultdict(set)
    for r in X.segments(spark, DATA).collect():
        ends[r.drawing, r.upright, float(int(r.fixed))] |= {r.lo, r.hi}
    rows = frame.collect()
    assert rows
    for r in rows:
        up = int(r.x1 == r.x2)
        lo, hi = sorted((r.y1, r.y2) if up else (r.x1, r.x2))
        assert abs(hi - lo - r.gap) < 1e-9 and {lo, hi} <= ends[r.drawing, up, r.x1 if up else r.y1]


def brute_junctions(spark, frame):
    """Members are places in the drawing's list; each of them passes the junction at the tolerance of healing and of joining."""
    drawings = {d: sorted(rows, key=lambda r: r.seg_id) for (d,), rows in by(X.segments(spark, DATA).collect(), "drawing").items()}
    rows = frame.collect()
    assert {r.kind for r in rows} <= {"L", "T", "X", "straight"} and {r.drawing for r in rows} == set(drawings)
    for r in rows:
        assert len(set(r.members)) == len(r.members) >= 2
        for m in r.members:
            w = drawings[r.drawing][m]
            away = max(w.x1 - r.x, r.x - w.x2, 0.0), max(w.y1 - r.y, r.y - w.y2, 0.0)
            assert (away[0] ** 2 + away[1] ** 2) ** 0.5 <= 0.61


def brute_rooms(spark, frame):
    """Areas by a flood fill over eighths."""
    eighth = lambda v: round(8 * v)
    rows = [(r.drawing, *map(eighth, (r.x1, r.y1, r.x2, r.y2))) for r in X.segments(spark, DATA).collect()]
    got = {d: sorted(r.area for r in rs) for (d,), rs in by(frame.collect(), "drawing").items()}
    assert got == {d: sorted(round(a / 64, 6) for a in areas) for d, areas in flood(rows, 8 * 40).items()}


def brute_elsewhere(spark, frame):
    """tests/test_runs.py and tests/test_rasters.py compare these with rasters of cells and with all shifts."""
    assert frame.count() > 0


BRUTE = {"enclosed_regions": brute_elsewhere, "detection_quality": brute_elsewhere, "profile_registration": brute_elsewhere, "raster_walls_once": brute_elsewhere, "render_registration": brute_elsewhere, "render_audit": brute_elsewhere, "rooms": brute_rooms, "nms": brute_nms, "cluster_1d": brute_cluster_1d, "cluster_pairwise": brute_cluster_pairwise, "breaker_trace": brute_breaker, "max_matching": brute_matching, "collinear_merge": brute_collinear, "opening_bridges": brute_bridges, "junctions": brute_junctions}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    frame = QUERIES[name](spark, DATA)
    if name in ORACLE_SQL:
        same_rows(frame, oracle.execute(ORACLE_SQL[name]).df())
    else:
        BRUTE[name](spark, frame)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
