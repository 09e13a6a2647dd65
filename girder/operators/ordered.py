"""Operators whose result depends on order: clustering folds, suppression, greedy pairing, merging and healing.

Each works on one small group at a time (a drawing's frame, a class in an image,
a component of a coarse join), given an explicit order.  Groups come from
``groupBy().applyInPandas``; the rules inside are plain functions over lists, which
the tests call directly.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cluster_fold(values: Column, tolerance: float) -> Column:
    """Sorted values; within the tolerance of the last centre the centre becomes the mean of both. An array of centres."""

    def step(acc: Column, v: Column) -> Column:
        near = (F.size(acc) > 0) & (F.abs(v - F.try_element_at(acc, F.lit(-1))) < tolerance)
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(near, F.concat(head, F.array((F.try_element_at(acc, F.lit(-1)) + v) / 2))).otherwise(F.concat(acc, F.array(v)))

    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), step)


def cluster_running_mean(values: list[float], tolerance: float) -> list[list[float]]:
    """Ascending values join the last group while within the tolerance of its mean."""
    groups: list[list[float]] = []
    for v in sorted(values):
        if groups and abs(v - math.fsum(groups[-1]) / len(groups[-1])) <= tolerance:
            groups[-1].append(v)
        else:
            groups.append([v])
    return groups


def cluster_first_fit(values: list[float], tolerance: float) -> list[float]:
    """Ascending values join the first group within the tolerance of its running mean; means rounded to 1 place."""
    means: list[list[float]] = []
    for v in sorted(values):
        home = next((g for g in means if abs(v - g[0]) <= tolerance), None)
        if home is None:
            means.append([v, 1.0])
        else:
            home[0], home[1] = (home[0] * home[1] + v) / (home[1] + 1), home[1] + 1
    return [round(m, 1) for m, _ in means]


def by_group(rows: DataFrame, keys: list[str], order: list[str], rule: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a rule to each group, sorted; the group's keys are put back in front."""
    types = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = rule(pdf.sort_values(order, kind="stable").reset_index(drop=True))
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), schema]))


def clusters(rows: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """W05 per group: cluster number, mean, count."""

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = cluster_running_mean(pdf[value].tolist(), tolerance)
        return pd.DataFrame({"cluster": range(len(groups)), "mean": [math.fsum(g) / len(g) for g in groups], "n": [len(g) for g in groups]})

    return by_group(rows, keys, [value], rule, "cluster int, mean double, n int")


def iou(a, b) -> float:
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = sum(max(0.0, s[2] - s[0]) * max(0.0, s[3] - s[1]) for s in (a, b)) - inter
    return inter / union if union > 0 else 0.0


def suppress(boxes: np.ndarray, threshold: float) -> list[int]:
    """Places of the boxes kept, best first: a box goes if it overlaps a kept one by the threshold or more."""
    kept: list[int] = []
    alive = np.ones(len(boxes), dtype=bool)
    area = np.clip(boxes[:, 2] - boxes[:, 0], 0, None) * np.clip(boxes[:, 3] - boxes[:, 1], 0, None)
    for i in range(len(boxes)):
        if not alive[i]:
            continue
        kept.append(i)
        w = np.clip(np.minimum(boxes[i, 2], boxes[:, 2]) - np.maximum(boxes[i, 0], boxes[:, 0]), 0, None)
        h = np.clip(np.minimum(boxes[i, 3], boxes[:, 3]) - np.maximum(boxes[i, 1], boxes[:, 1]), 0, None)
        union = area[i] + area - w * h
        alive &= ~(np.where(union > 0, w * h / np.where(union > 0, union, 1), 0.0) >= threshold)
    return kept


def nms(boxes: DataFrame, threshold: float, keys: list[str] = ["image", "class_id"], order: str = "box_id") -> DataFrame:  # noqa: B006
    """(keys, box id, confidence) that survive; equal confidences in order of id."""
    types = dict(boxes.dtypes)

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", order], ascending=[False, True], kind="stable")
        return pdf.iloc[suppress(pdf[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float), threshold)][[order, "confidence"]].reset_index(drop=True)

    return by_group(boxes, keys, [order], rule, f"{order} {types[order]}, confidence double")


def take_greedy(pairs: list[tuple], left_used: set | None = None, right_used: set | None = None) -> list[tuple]:
    """Pairs (left, right, ...) in order; each side serves once.  One set for both sides means one kind of member."""
    left_used = set() if left_used is None else left_used
    right_used = set() if right_used is None else right_used
    out = []
    for p in pairs:
        if p[0] in left_used or p[1] in right_used:
            continue
        left_used.add(p[0])
        right_used.add(p[1])
        out.append(p)
    return out


def greedy_pairs(pairs: DataFrame, keys: list[str], left: str, right: str, distance: str, same_side: bool = False) -> DataFrame:
    """Nearest pairs first, each member once; ties by left, then right."""
    types = dict(pairs.dtypes)

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([distance, left, right], kind="stable")
        used: set = set()
        kept = take_greedy(list(zip(pdf[left], pdf[right], pdf[distance], strict=True)), used, used if same_side else None)
        return pd.DataFrame(kept, columns=[left, right, distance])

    return by_group(pairs, keys, [distance], rule, f"{left} {types[left]}, {right} {types[right]}, {distance} double")


# --- segments as dicts: x1, y1, x2, y2, thickness, and what else the caller carries ---


def record(w: dict) -> dict | None:
    dx, dy = w["x2"] - w["x1"], w["y2"] - w["y1"]
    n = math.hypot(dx, dy)
    if n <= 1e-9:
        return None
    p, q, u = (w["x1"], w["y1"]), (w["x2"], w["y2"]), (dx / n, dy / n)
    if u[0] < -1e-9 or abs(u[0]) <= 1e-9 and u[1] < 0:
        p, q, u = q, p, (-u[0], -u[1])
    return {"p": p, "q": q, "u": u, "n": (-u[1], u[0]), "angle": math.degrees(math.atan2(u[1], u[0])) % 180.0, "length": n}


def angle_apart(a: float, b: float) -> float:
    d = abs(a - b) % 180.0
    return min(d, 180.0 - d)


def along(rec: dict, point) -> float:
    return (point[0] - rec["p"][0]) * rec["u"][0] + (point[1] - rec["p"][1]) * rec["u"][1]


def across(rec: dict, point) -> float:
    return (point[0] - rec["p"][0]) * rec["n"][0] + (point[1] - rec["p"][1]) * rec["n"][1]


def to_segment(point, w: dict) -> float:
    dx, dy = w["x2"] - w["x1"], w["y2"] - w["y1"]
    sq = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((point[0] - w["x1"]) * dx + (point[1] - w["y1"]) * dy) / sq)) if sq > 1e-12 else 0.0
    return math.hypot(point[0] - w["x1"] - t * dx, point[1] - w["y1"] - t * dy)


def segments_apart(a: dict, b: dict) -> float:
    """Distance of two segments; 0 if they cross."""
    if crossing(a, b) is not None:
        return 0.0
    return min(to_segment((a["x1"], a["y1"]), b), to_segment((a["x2"], a["y2"]), b), to_segment((b["x1"], b["y1"]), a), to_segment((b["x2"], b["y2"]), a))


def lines_cross(a: dict, b: dict):
    """Where the infinite lines cross; None if parallel."""
    ax, ay, bx, by = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    det = ax * by - ay * bx
    if abs(det) <= 1e-9:
        return None
    t = ((b["x1"] - a["x1"]) * by - (b["y1"] - a["y1"]) * bx) / det
    return a["x1"] + t * ax, a["y1"] + t * ay


def crossing(a: dict, b: dict):
    """Where the segments cross; None if they do not."""
    point = lines_cross(a, b)
    if point is None:
        return None
    for s in (a, b):
        sq = (s["x2"] - s["x1"]) ** 2 + (s["y2"] - s["y1"]) ** 2
        t = ((point[0] - s["x1"]) * (s["x2"] - s["x1"]) + (point[1] - s["y1"]) * (s["y2"] - s["y1"])) / sq
        if not -1e-12 <= t <= 1 + 1e-12:
            return None
    return point


class Cells:
    """Numbered points in square cells; those that are not finite are near nothing."""

    def __init__(self, side: float) -> None:
        self.side, self.held = side, {}

    def add(self, i: int, x: float, y: float) -> None:
        if math.isfinite(x) and math.isfinite(y):
            self.held.setdefault((math.floor(x / self.side), math.floor(y / self.side)), []).append(i)

    def near(self, x: float, y: float, reach: float) -> list[int]:
        """All points within ``reach`` and some beyond, in order."""
        if not (math.isfinite(x) and math.isfinite(y)):
            return []
        reach += 1e-6
        xs, ys = (range(math.floor((v - reach) / self.side), math.floor((v + reach) / self.side) + 1) for v in (x, y))
        return sorted(i for cx in xs for cy in ys for i in self.held.get((cx, cy), ()))


class Boxes:
    """Walls by their places in a list, in square cells that their boxes cover; one that covers very many, or is not finite, is always looked at."""

    MANY = 4096

    def __init__(self, walls: list[dict], reach: float) -> None:
        spans = [d for w in walls if math.isfinite(d := max(abs(w["x2"] - w["x1"]), abs(w["y2"] - w["y1"])))]
        self.side = max(2 * reach, sum(spans) / len(spans) / 4 if spans else 0.0, 1e-3)
        self.held, self.long, self.all = {}, set(), range(len(walls))
        for i, w in enumerate(walls):
            self.add(i, w)

    def _cells(self, *box: float) -> list[tuple[int, int]] | None:
        if not all(map(math.isfinite, box)):
            return None
        xs, ys = (range(math.floor((lo - 1e-6) / self.side), math.floor((hi + 1e-6) / self.side) + 1) for lo, hi in (box[::2], box[1::2]))
        return [(cx, cy) for cx in xs for cy in ys] if len(xs) * len(ys) <= self.MANY else None

    def _of(self, w: dict) -> list[tuple[int, int]] | None:
        return self._cells(min(w["x1"], w["x2"]), min(w["y1"], w["y2"]), max(w["x1"], w["x2"]), max(w["y1"], w["y2"]))

    def _among(self, cells: list[tuple[int, int]] | None) -> list[int]:
        return list(self.all) if cells is None else sorted(self.long.union(*(self.held.get(c, ()) for c in cells)))

    def add(self, i: int, w: dict) -> None:
        """A wall, or one that has moved: it stays in its earlier cells too."""
        cells = self._of(w)
        if cells is None:
            self.long.add(i)
        for c in cells or ():
            self.held.setdefault(c, set()).add(i)

    def near(self, x: float, y: float, reach: float) -> list[int]:
        """All walls within ``reach`` of a point and some beyond, in order."""
        return self._among(self._cells(x - reach, y - reach, x + reach, y + reach))

    def meeting(self, w: dict) -> list[int]:
        """All walls whose boxes meet that of ``w`` and some beyond, in order."""
        return self._among(self._of(w))


def merge_collinear(walls: list[dict], gap: float = 0.35, offset: float = 0.06, angle: float = 1.0, thickness: float = 20.0) -> list[dict]:
    """Walls join the first group whose first member they match; each group's runs become walls.

    Out: x1, y1, x2, y2 (rounded to 3), thickness of the first member, ids of the members in axis order.
    """
    groups: list[list[tuple[dict, dict]]] = []
    for w in walls:
        rec = record(w)
        if rec is None:
            continue
        own, thick = set(w.get("layers") or ()), w.get("thickness") or 0
        (px, py), (qx, qy), turned = rec["p"], rec["q"], rec["angle"]
        for g in groups:
            first, base = g[0]
            (fx, fy), (nx, ny) = first["p"], first["n"]
            # The line first: it rules out most groups.
            if not (abs((px - fx) * nx + (py - fy) * ny) <= offset and abs((qx - fx) * nx + (qy - fy) * ny) <= offset):
                continue
            layers = set(base.get("layers") or ())
            if abs(thick - (base.get("thickness") or 0)) <= thickness and not (layers and own and layers.isdisjoint(own)) and angle_apart(turned, first["angle"]) <= angle:
                g.append((rec, w))
                break
        else:
            groups.append([(rec, w)])
    out = []
    for g in groups:
        first, base = g[0]
        spans = sorted(((min(along(first, r["p"]), along(first, r["q"])), max(along(first, r["p"]), along(first, r["q"])), i, w) for i, (r, w) in enumerate(g)), key=lambda s: s[:3])
        runs: list[list] = []
        for lo, hi, _, w in spans:
            if runs and lo <= runs[-1][1] + gap:
                runs[-1][1] = max(runs[-1][1], hi)
                runs[-1][2].append(w["id"])
            else:
                runs.append([lo, hi, [w["id"]]])
        at = lambda t, first=first: (round(first["p"][0] + t * first["u"][0], 3), round(first["p"][1] + t * first["u"][1], 3))
        for lo, hi, ids in runs:
            (x1, y1), (x2, y2) = at(lo), at(hi)
            out.append({"x1": x1, "y1": y1, "x2": x2, "y2": y2, "thickness": base.get("thickness"), "ids": ids})
    return out


def merge_centerlines(walls: list[dict], fixed_tolerance: float = 0.02, gap: float = 0.06) -> list[dict]:
    """Axis lines (orientation, fixed, lo, hi, thickness) grouped by the running median of their fixed coordinate, then by gaps; medians out."""
    out = []
    for orientation in sorted({w["orientation"] for w in walls}):
        groups: list[list[dict]] = []
        for w in sorted((w for w in walls if w["orientation"] == orientation), key=lambda w: (w["fixed"], w["lo"])):
            if groups and abs(w["fixed"] - statistics.median(x["fixed"] for x in groups[-1])) <= fixed_tolerance:
                groups[-1].append(w)
            else:
                groups.append([w])
        for g in groups:
            runs: list[list[dict]] = []
            for w in sorted(g, key=lambda w: (w["lo"], w["hi"])):
                if runs and w["lo"] <= max(x["hi"] for x in runs[-1]) + gap:
                    runs[-1].append(w)
                else:
                    runs.append([w])
            out += [{"orientation": orientation, "fixed": statistics.median(x["fixed"] for x in r), "lo": min(x["lo"] for x in r), "hi": max(x["hi"] for x in r), "thickness": statistics.median(float(x.get("thickness") or 0.0) for x in r), "n": len(r)} for r in runs]
    return sorted(out, key=lambda w: (w["orientation"], w["fixed"], w["lo"], w["hi"]))


def merge_axis_lines(lines: list[dict], coord_tolerance: float = 3.0, gap: float = 8.0) -> list[dict]:
    """Sorted by coordinate and start; a line joins the latest one near it, whose coordinate becomes the length-weighted mean."""
    out: list[dict] = []
    for l in sorted(lines, key=lambda l: (l["coord"], l["lo"])):
        home = next((m for m in reversed(out) if abs(l["coord"] - m["coord"]) <= coord_tolerance and l["lo"] <= m["hi"] + gap and l["hi"] >= m["lo"] - gap), None)
        if home is None:
            out.append(dict(l))
            continue
        a, b = home["hi"] - home["lo"], l["hi"] - l["lo"]
        home["coord"] = (home["coord"] * a + l["coord"] * b) / (a + b) if a + b else home["coord"]
        home["lo"], home["hi"] = min(home["lo"], l["lo"]), max(home["hi"], l["hi"])
    return out


def opening_bridges(walls: list[dict], low: float = 0.30, high: float = 2.20, angle: float = 3.0) -> list[dict]:
    """Facing ends of collinear walls a door's width apart, nearest first, each end once."""
    ends = [(i, (w[x], w[y]), rec) for i, w in enumerate(walls) if (rec := record(w)) for x, y in (("x1", "y1"), ("x2", "y2"))]
    found, cells = [], Cells(high)
    for j, (wj, q, rj) in enumerate(ends):
        for i in cells.near(*q, high):
            wi, p, ri = ends[i]
            d = math.dist(p, q)
            if wi == wj or not low <= d <= high or angle_apart(ri["angle"], rj["angle"]) > angle:
                continue
            bridge = record({"x1": p[0], "y1": p[1], "x2": q[0], "y2": q[1]})
            if bridge and max(angle_apart(bridge["angle"], ri["angle"]), angle_apart(bridge["angle"], rj["angle"])) <= angle:
                found.append((i, j, d))
        cells.add(j, *q)
    used: set[int] = set()
    return [{"x1": round(ends[i][1][0], 3), "y1": round(ends[i][1][1], 3), "x2": round(ends[j][1][0], 3), "y2": round(ends[j][1][1], 3), "gap": round(d, 3)} for i, j, d in take_greedy(sorted(found, key=lambda f: (f[2], f[0], f[1])), used, used)]


def heal_axis_junctions(walls: list[dict], most: float = 0.80, shortest: float = 0.5) -> list[dict]:
    """Ends of level and upright walls are moved along their own wall to the nearest line of the other kind; later walls see earlier moves."""
    walls = [dict(w) for w in walls]

    def kind(w: dict) -> str | None:
        rec = record(w)
        if rec is None:
            return None
        return "H" if angle_apart(rec["angle"], 0.0) <= 2.0 else "V" if angle_apart(rec["angle"], 90.0) <= 2.0 else None

    for i, w in enumerate(walls):
        own = kind(w)
        if own is None:
            continue
        for end, far in (("1", "2"), ("2", "1")):
            move, hold = ("x", "y") if own == "H" else ("y", "x")
            best = None
            for j, o in enumerate(walls):
                if j == i or kind(o) in (None, own):
                    continue
                reach = min(most, max(0.20, ((w.get("thickness") or 0) + (o.get("thickness") or 0)) / 2000 + 0.40))
                target = record(o)["p"][0 if move == "x" else 1]
                lo, hi = sorted((o[f"{hold}1"], o[f"{hold}2"]))
                d = abs(target - w[f"{move}{end}"])
                far_point = (w[f"x{far}"], w[f"y{far}"])
                new = (target, w[f"y{end}"]) if move == "x" else (w[f"x{end}"], target)
                if lo - reach <= w[f"{hold}{end}"] <= hi + reach and math.dist(new, far_point) >= shortest and d <= reach and (best is None or d < best[0]):
                    best = d, new
            if best is not None:
                w[f"x{end}"], w[f"y{end}"] = round(best[1][0], 3), round(best[1][1], 3)
    return [w for w in walls if math.dist((w["x1"], w["y1"]), (w["x2"], w["y2"])) >= shortest]


def heal_junctions(walls: list[dict], tolerance: float) -> list[dict]:
    """Each end snaps to the best crossing or facing end within half the walls' widths, projected on its own line; in order. Thickness in metres."""
    walls = [dict(w) for w in walls]
    records = [record(w) for w in walls]
    thickest = max((w["thickness"] for w in walls), default=0.0)
    # A wall that a point may snap to lies within twice the reach of it: the target is as near, and its place on the own line too.
    boxes = Boxes(walls, tolerance)
    for i, w in enumerate(walls):
        base = (w["x1"], w["y1"])
        n = math.dist(base, (w["x2"], w["y2"]))
        if n <= 1e-9:
            continue
        u = ((w["x2"] - w["x1"]) / n, (w["y2"] - w["y1"]) / n)
        most = 2 * max(tolerance, (w["thickness"] + thickest) / 2 + 0.02) + 1e-6
        for end in ("1", "2"):
            point, best = (w[f"x{end}"], w[f"y{end}"]), None
            for j in boxes.near(*point, most):
                o, own, other = walls[j], records[i], records[j]
                if j == i or own is None or other is None:
                    continue
                reach = max(tolerance, (w["thickness"] + o["thickness"]) / 2 + 0.02)
                target = lines_cross(w, o)
                if target is None:
                    if angle_apart(own["angle"], other["angle"]) > 2.0 or abs(across(other, point)) > min(tolerance, 0.05 * min(w["thickness"], o["thickness"])):
                        continue
                    target = min(((o["x1"], o["y1"]), (o["x2"], o["y2"])), key=lambda e: math.dist(point, e))
                d = math.dist(point, target)
                if d > reach:
                    continue
                t = (target[0] - base[0]) * u[0] + (target[1] - base[1]) * u[1]
                on_line = (base[0] + t * u[0], base[1] + t * u[1])
                if to_segment(on_line, o) <= reach and (best is None or d < best[0]):
                    best = d, on_line
            if best is not None:
                w[f"x{end}"], w[f"y{end}"] = best[1]
                records[i] = record(w)
                boxes.add(i, w)
    return walls


def unique_directions(vectors: list[tuple[float, float]], tolerance: float = 8.0) -> list[tuple[float, float]]:
    """Unit vectors, dropping those within the tolerance of an earlier one."""
    out: list[tuple[float, float]] = []
    for x, y in vectors:
        n = math.hypot(x, y)
        u = (x / n, y / n)
        if all(math.degrees(math.acos(max(-1.0, min(1.0, u[0] * v[0] + u[1] * v[1])))) > tolerance for v in out):
            out.append(u)
    return out


def classify_junctions(walls: list[dict], tolerance: float) -> list[dict]:
    """Ends and crossings clustered (first match within half the tolerance), then by directions: X, T, straight or L; members are places in the list."""
    points = [(w[f"x{e}"], w[f"y{e}"]) for w in walls for e in "12"]
    boxes = Boxes(walls, tolerance)
    points += [p for i, a in enumerate(walls) for j in boxes.meeting(a) if j > i and (p := crossing(a, walls[j])) is not None]
    centres: list[tuple[float, float]] = []
    seen = Cells(max(tolerance / 2, 1e-3))
    for p in points:
        if all(math.dist(p, centres[c]) > tolerance / 2 for c in seen.near(*p, tolerance / 2)):
            seen.add(len(centres), *p)
            centres.append(p)
    out = []
    for c in centres:
        members = [i for i in boxes.near(*c, tolerance) if to_segment(c, walls[i]) <= tolerance]
        if len(members) < 2:
            continue
        vectors = []
        for i in members:
            s, e = ((walls[i][f"x{k}"] - c[0], walls[i][f"y{k}"] - c[1]) for k in "12")
            vectors += [e] if math.hypot(*s) <= tolerance else [s] if math.hypot(*e) <= tolerance else [s, e]
        d = unique_directions([v for v in vectors if math.hypot(*v) > 1e-9])
        if len(d) >= 2:
            straight = len(d) == 2 and d[0][0] * d[1][0] + d[0][1] * d[1][1] < -0.95
            out.append({"kind": "X" if len(d) >= 4 else "T" if len(d) == 3 else "straight" if straight else "L", "x": round(c[0], 6), "y": round(c[1], 6), "members": members})
    return out


def trim_junctions(walls: list[dict], junctions: list[dict], tolerance: float, clearance: float = 0.0) -> list[dict]:
    """At L, T and X each end there moves in by half the other wall's width, measured along its own direction."""
    cut: dict[tuple[int, str], float] = {}
    for j in junctions:
        if j["kind"] not in ("L", "T", "X"):
            continue
        for i in j["members"]:
            w = walls[i]
            for end, far in (("1", "2"), ("2", "1")):
                p, q = (w[f"x{end}"], w[f"y{end}"]), (w[f"x{far}"], w[f"y{far}"])
                n = math.dist(p, q)
                if n <= 1e-9 or math.dist(p, (j["x"], j["y"])) > tolerance:
                    continue
                inward = ((q[0] - p[0]) / n, (q[1] - p[1]) / n)
                for k in j["members"]:
                    other = record(walls[k]) if k != i else None
                    if other and (sine := abs(inward[0] * other["u"][1] - inward[1] * other["u"][0])) > 0.2:
                        cut[i, end] = max(cut.get((i, end), 0.0), walls[k]["thickness"] / (2 * sine) + clearance)
    out = [dict(w) for w in walls]
    for (i, end), d in cut.items():
        w, far = out[i], "2" if end == "1" else "1"
        p, q = (w[f"x{end}"], w[f"y{end}"]), (w[f"x{far}"], w[f"y{far}"])
        n = math.dist(p, q)
        d = min(d, max(0.0, n - 1e-6))
        if n > 1e-9 and d > 1e-9:
            w[f"x{end}"], w[f"y{end}"] = p[0] + (q[0] - p[0]) / n * d, p[1] + (q[1] - p[1]) / n * d
    return out


def keep_reachable_junctions(walls: list[dict], junctions: list[dict], tolerance: float) -> list[dict]:
    """Junctions of which a pair of walls is still within reach; repeats of (kind, members) go."""
    seen, out = set(), []
    for j in junctions:
        near = any(segments_apart(walls[a], walls[b]) <= max(tolerance, math.sqrt(2.0) * (walls[a]["thickness"] + walls[b]["thickness"]) / 2 + 0.02) for n, a in enumerate(j["members"]) for b in j["members"][n + 1:])
        sign = (j["kind"], tuple(sorted(j["members"])))
        if near and sign not in seen:
            seen.add(sign)
            out.append(j)
    return out


def hausdorff(a: dict, b: dict) -> float:
    """Of two segments: the largest distance of an end of one to the other."""
    return max(to_segment((a["x1"], a["y1"]), b), to_segment((a["x2"], a["y2"]), b), to_segment((b["x1"], b["y1"]), a), to_segment((b["x2"], b["y2"]), a))


def dedupe_and_merge(walls: list[dict], dedupe: float, angle: float, gap: float, thickness: float = 0.02) -> list[dict]:
    """Equal walls become one (ids joined, best confidence); then collinear neighbours merge until nothing changes (least confidence)."""
    out: list[dict] = []
    for w in walls:
        same = next((o for o in out if abs(o["thickness"] - w["thickness"]) <= thickness and hausdorff(o, w) <= dedupe), None)
        if same is None:
            out.append({**w, "ids": list(w["ids"])})
        else:
            same["ids"] += [i for i in w["ids"] if i not in same["ids"]]
            same["confidence"] = max(same["confidence"], w["confidence"])
    while True:
        for i, a in enumerate(out):
            ra = record(a)
            j = next((j for j in range(i + 1, len(out)) if ra and (rb := record(out[j])) and abs(a["thickness"] - out[j]["thickness"]) <= thickness and angle_apart(ra["angle"], rb["angle"]) <= angle and segments_apart(a, out[j]) <= gap), None)
            if j is None:
                continue
            b = out.pop(j)
            n = math.dist((a["x1"], a["y1"]), (a["x2"], a["y2"]))
            u = ((a["x2"] - a["x1"]) / n, (a["y2"] - a["y1"]) / n)
            ts = [(x - a["x1"]) * u[0] + (y - a["y1"]) * u[1] for x, y in ((a["x1"], a["y1"]), (a["x2"], a["y2"]), (b["x1"], b["y1"]), (b["x2"], b["y2"]))]
            x, y = a["x1"], a["y1"]
            a.update(x1=x + min(ts) * u[0], y1=y + min(ts) * u[1], x2=x + max(ts) * u[0], y2=y + max(ts) * u[1], confidence=min(a["confidence"], b["confidence"]), ids=a["ids"] + [k for k in b["ids"] if k not in a["ids"]])
            break
        else:
            return out


def footprint(w: dict) -> list[tuple[float, float]]:
    """Corners of a wall's plan rectangle."""
    rec, h = record(w), w["thickness"] / 2
    if rec is None:
        return []
    (px, py), (qx, qy), (nx, ny) = rec["p"], rec["q"], rec["n"]
    return [(px - nx * h, py - ny * h), (qx - nx * h, qy - ny * h), (qx + nx * h, qy + ny * h), (px + nx * h, py + ny * h)]


def area(points: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2 if points else 0.0


def convex_overlap(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """Area shared by two convex polygons given counter-clockwise: one is cut by the sides of the other."""
    if not a or not b:
        return 0.0
    out = a
    for (x1, y1), (x2, y2) in zip(b, b[1:] + b[:1], strict=True):
        side = lambda p, x1=x1, y1=y1, x2=x2, y2=y2: (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)
        nxt = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                nxt.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                nxt.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = nxt
        if not out:
            return 0.0
    return area(out)


def remove_parallel_overlaps(walls: list[dict]) -> list[dict]:
    """Of two parallel walls whose plans overlap the weaker goes: by confidence, number of ids, length, then identity."""
    out = list(walls)
    rank = lambda w: (w["confidence"], len(w["ids"]), record(w)["length"], "|".join(sorted(w["ids"])))
    i = 0
    while i < len(out):
        a = out[i]
        j = next((j for j in range(i + 1, len(out)) if angle_apart(record(a)["angle"], record(out[j])["angle"]) <= 2.0 and convex_overlap(footprint(a), footprint(out[j])) > 1e-7), None)
        if j is None:
            i += 1
        else:
            out.pop(j if rank(a) >= rank(out[j]) else i)
    return out


def collisions(walls: list[dict]) -> tuple[int, float]:
    """Count and largest area of plan overlaps, leaving out true crossings of more than 2 degrees."""
    found = []
    for i, a in enumerate(walls):
        for b in walls[i + 1:]:
            shared = convex_overlap(footprint(a), footprint(b))
            crossed = angle_apart(record(a)["angle"], record(b)["angle"]) > 2.0 and crossing(a, b) is not None
            if shared > 1e-5 and not crossed:
                found.append(shared)
    return len(found), max(found, default=0.0)


def keep_thicker(walls: list[dict], snap: float, angle: float) -> list[dict]:
    """Of equal walls, drawn either way, the thicker takes the first one's place."""
    out: list[dict] = []
    for w in walls:
        rec = record(w)
        if rec is None:
            continue

        def same(o: dict, w=w, rec=rec) -> bool:
            other = record(o)
            ends = lambda s: ((s["x1"], s["y1"]), (s["x2"], s["y2"]))
            (p, q), (r, s) = ends(w), ends(o)
            return abs(rec["length"] - other["length"]) <= snap and angle_apart(rec["angle"], other["angle"]) <= angle and min(max(math.dist(p, r), math.dist(q, s)), max(math.dist(p, s), math.dist(q, r))) <= snap

        at = next((i for i, o in enumerate(out) if same(o)), None)
        if at is None:
            out.append(w)
        elif (w.get("thickness") or 0) > (out[at].get("thickness") or 0):
            out[at] = w
    return out


def merge_until_stable(walls: list[dict], gap: float, offset: float, angle: float, thickness: float = 1.0) -> list[dict]:
    """Each wall absorbs every earlier one on its line within the gap, starting over after each."""
    out: list[dict] = []

    def fits(a: dict, b: dict) -> bool:
        ra, rb = record(a), record(b)
        if ra is None or rb is None or abs((a.get("thickness") or 0) - (b.get("thickness") or 0)) > thickness or angle_apart(ra["angle"], rb["angle"]) > angle or max(abs(across(ra, rb[e])) for e in "pq") > offset:
            return False
        lo, hi = sorted((along(ra, rb["p"]), along(ra, rb["q"])))
        return lo <= ra["length"] + gap and hi >= -gap

    for w in walls:
        now = {**w, "ids": list(w["ids"])}
        while (at := next((i for i, o in enumerate(out) if fits(now, o)), None)) is not None:
            o = out.pop(at)
            rec = record(now)
            ts = [0.0, rec["length"], along(rec, (o["x1"], o["y1"])), along(rec, (o["x2"], o["y2"]))]
            (px, py), (ux, uy) = rec["p"], rec["u"]
            now.update(x1=px + ux * min(ts), y1=py + uy * min(ts), x2=px + ux * max(ts), y2=py + uy * max(ts), ids=o["ids"] + now["ids"])
        out.append(now)
    return out


def distinct_boxes(boxes: list[dict], tolerance: float = 300.0) -> list[dict]:
    """Boxes (cx, cy, w, d) in order, dropping those whose centre and sizes are near an earlier one."""
    out: list[dict] = []
    for b in boxes:
        if not any(math.dist((b["cx"], b["cy"]), (o["cx"], o["cy"])) < tolerance and abs(b["w"] - o["w"]) < tolerance and abs(b["d"] - o["d"]) < tolerance for o in out):
            out.append(b)
    return out


def consume_intervals(pairs: list[dict], min_left: float) -> list[dict]:
    """Pairs (a, b, distance, overlap, lo, hi, b_lo, b_hi) nearest first; a face may serve several pairs on stretches that do not overlap."""
    used: dict = {}
    out = []
    free = lambda key, lo, hi: all(min(hi, h) - max(lo, l) <= min_left for l, h in used.get(key, ()))
    for p in sorted(pairs, key=lambda p: (p["distance"], -p["overlap"], p["a"], p["b"])):
        if free(p["a"], p["lo"], p["hi"]) and free(p["b"], p["b_lo"], p["b_hi"]):
            used.setdefault(p["a"], []).append((p["lo"], p["hi"]))
            used.setdefault(p["b"], []).append((p["b_lo"], p["b_hi"]))
            out.append(p)
    return out


def shear_walls(lines: list[dict], shortest: float = 0.4, angle: float = 2.0, low: float = 0.1, high: float = 0.8) -> list[dict]:
    """Each line takes the nearest unused parallel one; alone it gets 200 mm; shear if longer than 3 m, at least 250 mm thick and three times as long as thick."""
    long = [l for l in lines if (r := record(l)) and r["length"] >= shortest]
    used: set[int] = set()
    out = []
    for i, l in enumerate(long):
        if i in used:
            continue
        rec, best = record(l), None
        for j in range(i + 1, len(long)):
            other = record(long[j])
            mid = ((other["p"][0] + other["q"][0]) / 2, (other["p"][1] + other["q"][1]) / 2)
            d = abs(across(rec, mid))
            if j not in used and angle_apart(rec["angle"], other["angle"]) <= angle and low < d < high and (best is None or d < best[0]):
                best = d, j
        used.add(i)
        thick = 0.2
        if best:
            used.add(best[1])
            thick = best[0]
        out.append({**l, "thickness": thick * 1000, "shear": rec["length"] > 3 and thick * 1000 >= 250 and rec["length"] / thick > 3})
    return out


def axis_transforms(reference: list[float], target: list[float], min_ratio: float, shown: int = 12) -> list[tuple[float, float, int, float]]:
    """(scale, offset, matched, rmse) of affine maps given by pairs of axes spanning at least 35 %, best first."""
    out = set()
    span_r, span_t = (max(x) - min(x) if x else 0.0 for x in (reference, target))
    need = max(2, math.ceil(min_ratio * len(reference)))
    for i, r1 in enumerate(reference):
        for r2 in reference[i + 1:]:
            if abs(r2 - r1) < 0.35 * span_r or r1 == r2:
                continue
            for t1 in target:
                for t2 in target:
                    k = (t2 - t1) / (r2 - r1)
                    if abs(t2 - t1) < 0.35 * span_t or not 0.05 <= abs(k) <= 20:
                        continue
                    b = t1 - k * r1
                    errors = [min(abs(k * r + b - t) for t in target) for r in reference]
                    good = [e for e in errors if e <= max(0.03, 0.03 * abs(k))]
                    if len(good) >= need:
                        out.add((round(k, 9), round(b, 9), len(good), math.sqrt(sum(e * e for e in good) / len(good))))
    return sorted(out, key=lambda c: (-c[2], c[3], abs(c[0]), c))[:shown]


def walls_by_group(rows: DataFrame, keys: list[str], rule: Callable[[list[dict]], list[dict]], schema: str, order: list[str]) -> DataFrame:
    """Any rule over a list of walls, per group and in order; ``schema`` names the columns of what it returns."""
    names = [part.strip().split(" ")[0] for part in schema.split(",") if " " in part.strip()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(rule(pdf.to_dict("records")), columns=names)

    return by_group(rows, keys, order, run, schema)
