"""Cases of the third round's findings: results at odd inputs, and what a step does as its input grows."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from girder.functions import text as T
from girder.functions import vectors as V
from girder.operators import clean, graph, lexical, ordered, rasters, retrieval, runs, spatial, stats
from girder.plans import fixtures as X
from girder.plans import queries_geometry, queries_text, tables
from girder.plans.catalogue import ORACLE_SQL
from girder.plans.staging import stage
from girder.sources import ifc
from tests.conftest import DATA, same_rows


def test_sparse_vectors_with_shared_numbers_and_without_tokens(spark, tmp_path):
    """Two tokens of one number, a text without tokens, and no text, as the SQL has them."""
    seen, pair = {}, None
    for i in range(1_000_000):
        number = hashlib.md5(f"w{i}".encode()).hexdigest()[:8]
        if number in seen:
            pair = seen[number], f"w{i}"
            break
        seen[number] = f"w{i}"
    rows = [(1, f"{pair[0]} {pair[1]} {pair[1]} other"), (2, "? !"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(queries_text.sparse_vectors(spark, str(tmp_path)), con.execute(ORACLE_SQL["sparse_vectors"]).df())


def profile_tables(spark, many=400):
    rng = random.Random(5)
    some = lambda: None if rng.random() < 0.1 else [rng.choice("abcdefgh") for _ in range(rng.randrange(6))]
    row = lambda i: (i, "t" if i % 5 else ("u" if i % 2 else None), some(), some(), rng.choice(["s1", "s2", None, f"own{i}"]))
    schema = "drawing_id long, tenant_id string, layers array<string>, blocks array<string>, signature string"
    drawings = spark.createDataFrame([row(i) for i in range(many)], schema)
    library = spark.createDataFrame([row(i) for i in range(60)], schema).withColumnRenamed("drawing_id", "profile_id").withColumn("ord", F.when(F.col("profile_id") != 7, F.col("profile_id")))
    return drawings, library


def test_profiles_meet_in_slices_and_blocks(spark, monkeypatch):
    """A tenant of most rows is dealt over many groups, and every pair is scored as the expression over whole arrays scores it."""
    monkeypatch.setattr(stats, "DRAWINGS", 50)
    monkeypatch.setattr(stats, "PROFILES", 16)
    monkeypatch.setattr(stats, "BATCH", 100)
    drawings, library = profile_tables(spark)
    sets = ("layers", "blocks")
    dealt = stats._profile_blocks(drawings, library, sets).filter("_side = 1 AND tenant_id = 't'").groupBy("_slice", "_block").count().collect()
    assert len(dealt) > 15 and max(r["count"] for r in dealt) < 100
    both = drawings.alias("c").join(library.alias("p"), "tenant_id")
    pair = lambda s: (F.array_distinct(F.coalesce(f"c.{s}", F.array())), F.array_distinct(F.coalesce(f"p.{s}", F.array())))
    plain = both.select("drawing_id", "profile_id", "ord", V.profile_similarity([pair(s) for s in sets]).alias("score"), (F.col("c.signature") == F.col("p.signature")).alias("same")).collect()
    got = sorted(tuple(r) for r in stats.profile_scores(drawings, library, sets).collect())
    assert got == sorted((r.drawing_id, r.profile_id, r.score) for r in plain)
    want = {}
    for r in plain:
        score = 1.0 if r.same else r.score
        rank = score, -math.inf if r.ord is None else -r.ord
        if score > 0 and (r.drawing_id not in want or rank > want[r.drawing_id][0]):
            want[r.drawing_id] = rank, r.profile_id
    best = {r.drawing_id: (r.profile_id, r.score) for r in stats.best_profile(drawings, library, 0.3, sets).collect()}
    assert best == {d: (p, round(rank[0], 4)) for d, (rank, p) in want.items() if round(rank[0], 4) >= 0.3}


def vector_rows(spark, n=300):
    """Small whole numbers, so that scores tie; null vectors and components, other lengths, NaN and infinity among them."""
    rng = random.Random(9)
    odd = {3: None, 5: [1.0, None, 2.0], 8: [1.0], 13: [], 21: [float("nan"), 1.0, 1.0], 34: [float("inf"), 1.0, 1.0], 55: [1.0, 1.0, 1.0, 9.0, None]}
    return spark.createDataFrame([(i, odd.get(i, [float(rng.randrange(-3, 4)) for _ in range(3)]), f"l{rng.randrange(4)}" if i % 11 else None) for i in range(n)], "vec_id long, embedding array<float>, label string")


def test_dense_top_k_in_slices_and_blocks(spark, monkeypatch):
    """What slices of rows and blocks of queries keep is what ranking all scores keeps, and few rows go on."""
    monkeypatch.setattr(retrieval, "SLICE", 40)
    monkeypatch.setattr(retrieval, "QUERIES", 20)
    rows = vector_rows(spark)
    asked = rows.filter("vec_id % 7 IN (0, 1) OR vec_id IN (3, 5, 55)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    for own in (True, False):
        every = retrieval.dense(rows, asked, "vec_id", "embedding")
        want = retrieval.top_k(every if own else every.filter("query_id <> doc_key"), 5).select("query_id", "rank", "doc_key", F.col("score").cast("string"))
        got = retrieval.dense_top_k(rows, asked, "vec_id", "embedding", 5, own=own).select("query_id", "rank", "doc_key", F.col("score").cast("string"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_label_metrics_count_as_lists_do(spark):
    rows = vector_rows(spark)
    asked = rows.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))
    got = retrieval.dense_top_k(rows, asked, "vec_id", "embedding", 10, own=False)
    listed = rows.join(asked.select("query_id", F.col("query_label").alias("label")), "label").filter("vec_id <> query_id").select("query_id", F.col("vec_id").alias("doc_key"), F.lit(1.0).alias("gain"))
    four = lambda df: sorted((r.query_id, round(r.recall, 9), round(r.rr, 9), round(r.ndcg, 9)) for r in df.collect())
    assert four(retrieval.label_metrics(got, rows, asked, "vec_id", "label", 10)) == four(retrieval.retrieval_metrics(got, listed, 10))


# --- rules over lists of walls, each wall compared with each ---


def plain_merge(walls: list[dict], gap: float = 0.35, offset: float = 0.06, angle: float = 1.0, thickness: float = 20.0) -> list[dict]:
    """Walls join the first group whose first member they match; each group's runs become walls.

    Out: x1, y1, x2, y2 (rounded to 3), thickness of the first member, ids of the members in axis order.
    """
    groups: list[list[tuple[dict, dict]]] = []
    for w in walls:
        rec = ordered.record(w)
        if rec is None:
            continue
        for g in groups:
            first, base = g[0]
            layers, own = set(base.get("layers") or ()), set(w.get("layers") or ())
            if abs((w.get("thickness") or 0) - (base.get("thickness") or 0)) <= thickness and not (layers and own and layers.isdisjoint(own)) and ordered.angle_apart(rec["angle"], first["angle"]) <= angle and max(abs(ordered.across(first, rec[e])) for e in "pq") <= offset:
                g.append((rec, w))
                break
        else:
            groups.append([(rec, w)])
    out = []
    for g in groups:
        first, base = g[0]
        spans = sorted(((min(ordered.along(first, r["p"]), ordered.along(first, r["q"])), max(ordered.along(first, r["p"]), ordered.along(first, r["q"])), i, w) for i, (r, w) in enumerate(g)), key=lambda s: s[:3])
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


def plain_opening(walls: list[dict], low: float = 0.30, high: float = 2.20, angle: float = 3.0) -> list[dict]:
    """Facing ends of collinear walls a door's width apart, nearest first, each end once."""
    ends = [(i, (w[x], w[y]), rec) for i, w in enumerate(walls) if (rec := ordered.record(w)) for x, y in (("x1", "y1"), ("x2", "y2"))]
    found = []
    for i, (wi, p, ri) in enumerate(ends):
        for j in range(i + 1, len(ends)):
            wj, q, rj = ends[j]
            d = math.dist(p, q)
            if wi == wj or not low <= d <= high or ordered.angle_apart(ri["angle"], rj["angle"]) > angle:
                continue
            bridge = ordered.record({"x1": p[0], "y1": p[1], "x2": q[0], "y2": q[1]})
            if bridge and max(ordered.angle_apart(bridge["angle"], ri["angle"]), ordered.angle_apart(bridge["angle"], rj["angle"])) <= angle:
                found.append((i, j, d))
    used: set[int] = set()
    return [{"x1": round(ends[i][1][0], 3), "y1": round(ends[i][1][1], 3), "x2": round(ends[j][1][0], 3), "y2": round(ends[j][1][1], 3), "gap": round(d, 3)} for i, j, d in ordered.take_greedy(sorted(found, key=lambda f: (f[2], f[0], f[1])), used, used)]


def plain_heal(walls: list[dict], tolerance: float) -> list[dict]:
    """Each end snaps to the best crossing or facing end within half the walls' widths, projected on its own line; in order. Thickness in metres."""
    walls = [dict(w) for w in walls]
    for i, w in enumerate(walls):
        base = (w["x1"], w["y1"])
        n = math.dist(base, (w["x2"], w["y2"]))
        if n <= 1e-9:
            continue
        u = ((w["x2"] - w["x1"]) / n, (w["y2"] - w["y1"]) / n)
        for end in ("1", "2"):
            point, best = (w[f"x{end}"], w[f"y{end}"]), None
            for j, o in enumerate(walls):
                own, other = ordered.record(w), ordered.record(o)
                if j == i or own is None or other is None:
                    continue
                reach = max(tolerance, (w["thickness"] + o["thickness"]) / 2 + 0.02)
                target = ordered.lines_cross(w, o)
                if target is None:
                    if ordered.angle_apart(own["angle"], other["angle"]) > 2.0 or abs(ordered.across(other, point)) > min(tolerance, 0.05 * min(w["thickness"], o["thickness"])):
                        continue
                    target = min(((o["x1"], o["y1"]), (o["x2"], o["y2"])), key=lambda e: math.dist(point, e))
                d = math.dist(point, target)
                if d > reach:
                    continue
                t = (target[0] - base[0]) * u[0] + (target[1] - base[1]) * u[1]
                on_line = (base[0] + t * u[0], base[1] + t * u[1])
                if ordered.to_segment(on_line, o) <= reach and (best is None or d < best[0]):
                    best = d, on_line
            if best is not None:
                w[f"x{end}"], w[f"y{end}"] = best[1]
    return walls


def plain_classify(walls: list[dict], tolerance: float) -> list[dict]:
    """Ends and crossings clustered (first match within half the tolerance), then by directions: X, T, straight or L; members are places in the list."""
    points = [(w[f"x{e}"], w[f"y{e}"]) for w in walls for e in "12"]
    points += [p for i, a in enumerate(walls) for b in walls[i + 1:] if (p := ordered.crossing(a, b)) is not None]
    centres: list[tuple[float, float]] = []
    for p in points:
        if all(math.dist(p, c) > tolerance / 2 for c in centres):
            centres.append(p)
    out = []
    for c in centres:
        members = [i for i, w in enumerate(walls) if ordered.to_segment(c, w) <= tolerance]
        if len(members) < 2:
            continue
        vectors = []
        for i in members:
            s, e = ((walls[i][f"x{k}"] - c[0], walls[i][f"y{k}"] - c[1]) for k in "12")
            vectors += [e] if math.hypot(*s) <= tolerance else [s] if math.hypot(*e) <= tolerance else [s, e]
        d = ordered.unique_directions([v for v in vectors if math.hypot(*v) > 1e-9])
        if len(d) >= 2:
            straight = len(d) == 2 and d[0][0] * d[1][0] + d[0][1] * d[1][1] < -0.95
            out.append({"kind": "X" if len(d) >= 4 else "T" if len(d) == 3 else "straight" if straight else "L", "x": round(c[0], 6), "y": round(c[1], 6), "members": members})
    return out


def some_walls(seed, n):
    """Level, upright and slanting walls, on whole lines and off them; one of no length, one of great length."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, d = rng.choice([rng.randrange(160) / 8, rng.uniform(0, 20)]), rng.choice([rng.randrange(20), rng.uniform(0, 20)]), 0.5 + rng.randrange(60) / 8
        dx, dy = rng.choice([(d, 0.0), (0.0, d), (-d, 0.0), (d, d * rng.uniform(-1, 1)), (d, 0.001)])
        out.append({"id": i, "x1": float(x), "y1": float(y), "x2": x + dx, "y2": y + dy, "thickness": rng.choice([0.1, 0.2, 0.3])})
    out[n // 2].update(x2=out[n // 2]["x1"], y2=out[n // 2]["y1"])
    out[n // 3].update(x2=out[n // 3]["x1"] + 1e5)
    return out


def test_rules_over_walls_in_cells():
    for seed in range(12):
        walls = some_walls(seed, 60)
        healed = plain_heal(walls, 0.3)
        assert ordered.heal_junctions(walls, 0.3) == healed
        for tolerance in (0.3, 0.05, 0.0):
            assert ordered.classify_junctions(healed, tolerance) == plain_classify(healed, tolerance)
        assert ordered.opening_bridges(walls) == plain_opening(walls)
        assert ordered.merge_collinear([w | {"thickness": 1000 * w["thickness"]} for w in walls]) == plain_merge([w | {"thickness": 1000 * w["thickness"]} for w in walls])


def test_rules_over_walls_look_at_few(monkeypatch):
    """Walls far apart are not compared: crossings and angles asked for grow with the walls, not with their pairs."""
    walls = [w | {k: w[k] + 40 * i for k in ("x1", "x2")} | {"id": 40 * i + w["id"]} for i in range(15) for w in some_walls(3, 40) if w["id"] != 13]
    asked = []
    for name in ("lines_cross", "to_segment", "angle_apart", "across"):
        monkeypatch.setattr(ordered, name, lambda *a, f=getattr(ordered, name): asked.append(1) or f(*a))
    ordered.classify_junctions(ordered.heal_junctions(walls, 0.3), 0.3)
    ordered.opening_bridges(walls)
    assert len(asked) < 100 * len(walls)


# --- runs: lines as expressions, regions as one graph ---


def plain_line_runs(segments, keys, width="width"):
    """Runs of segments (x1, y1, x2, y2 in cells) of a width in cells: all cells whose centre is within half of it."""
    x1, y1, x2, y2, r = *(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col(width) / 2
    n = F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    rows = segments.withColumns({"_r": r, "_n": n, "_ux": F.when(n > 0, (x2 - x1) / n).otherwise(1.0), "_uy": F.when(n > 0, (y2 - y1) / n).otherwise(0.0)})
    rows = rows.withColumn("y", F.explode(F.sequence(F.ceil(F.least(y1, y2) - F.col("_r")), F.floor(F.greatest(y1, y2) + F.col("_r")))))
    dy, ux, uy, r, n = F.col("y") - y1, F.col("_ux"), F.col("_uy"), F.col("_r"), F.col("_n")

    def disc(cx, cy):
        rest = r * r - (F.col("y") - cy) * (F.col("y") - cy)
        half = F.sqrt(F.when(rest >= 0, rest))
        return cx - half, cx + half

    inf = float("inf")
    # Across the line: |-(x - x1) uy + dy ux| <= r; along it: 0 <= (x - x1) ux + dy uy <= n.
    a, b = (dy * ux - r) / uy, (dy * ux + r) / uy
    across = F.when(uy != 0, F.least(a, b)).when(F.abs(dy * ux) <= r, F.lit(-inf)), F.when(uy != 0, F.greatest(a, b)).when(F.abs(dy * ux) <= r, F.lit(inf))
    c, d = -dy * uy / ux, (n - dy * uy) / ux
    on = (dy * uy).between(0, n)
    along = F.when(ux != 0, F.least(c, d)).when(on, F.lit(-inf)), F.when(ux != 0, F.greatest(c, d)).when(on, F.lit(inf))
    lo, hi = F.when(across[0].isNotNull() & along[0].isNotNull(), F.greatest(across[0], along[0])), F.when(across[1].isNotNull() & along[1].isNotNull(), F.least(across[1], along[1]))
    body = F.when(lo <= hi, lo), F.when(lo <= hi, hi)
    first, last = disc(x1, y1), disc(x2, y2)
    left, right = F.least(x1 + body[0], first[0], last[0]), F.greatest(x1 + body[1], first[1], last[1])
    out = rows.select(*keys, "y", F.ceil(left - 1e-9).alias("lo"), (F.floor(right + 1e-9) + 1).alias("hi"))
    return runs.union(out.filter("lo < hi"), keys)


def plain_labelled(some, keys, diagonal=False):
    """The runs with ``region``: the smallest run of those that hang together through cells side by side, or corner to corner too."""
    rows = stage(some.withColumn("run", F.monotonically_increasing_id()), "runs")
    below = rows.select(*keys, (F.col("y") - 1).alias("y"), "lo", "hi", F.col("run").alias("b_run"))
    edges = runs.meeting(rows, below, keys, int(diagonal)).select(F.col("run").alias("a"), F.col("b_run").alias("b"))
    return graph.with_components(rows, edges, "run").withColumnRenamed("component", "region")


def some_lines(spark):
    rng = random.Random(2)
    at = lambda: rng.choice([float(rng.randrange(60)), rng.randrange(120) / 2, rng.uniform(0, 60)])
    rows = [(i % 7, at(), at(), at(), at(), rng.choice([0.0, 1.0, 2.0, 3.5])) for i in range(150)]
    rows += [(i % 7, x, y, *rng.choice([(x, at()), (at(), y), (x, y)]), w) for i in range(150) for x, y, w in [(at(), at(), rng.choice([0.0, 1.0, 2.0]))]]
    return spark.createDataFrame([*rows, (1, 1.0, 1.0, 2.0, 3.0, None)], "k int, x1 double, y1 double, x2 double, y2 double, width double")


def test_line_runs_in_matrices(spark, monkeypatch):
    monkeypatch.setattr(runs, "CELLS", 500)
    rows = some_lines(spark)
    assert sorted(map(tuple, runs.line_runs(rows, ["k"]).collect())) == sorted(map(tuple, plain_line_runs(rows, ["k"]).collect()))


def test_regions_over_tiles(spark, monkeypatch):
    """Parts of tiles are put together as one graph of all runs is, and few of them make the graph."""
    monkeypatch.setattr(runs, "TILE_ROWS", 8)
    monkeypatch.setattr(runs, "TILE_COLUMNS", 16)
    drawn = stage(runs.line_runs(some_lines(spark).filter("x1 + y1 < 60"), ["k"]), "drawn")
    groups = lambda df: sorted(sorted(v) for v in df.groupBy("region").agg(F.collect_list(F.struct("k", "y", "lo", "hi")).alias("v")).toPandas()["v"].map(lambda v: [tuple(r) for r in v]))
    for diagonal in (False, True):
        asked, was = [], graph.components
        monkeypatch.setattr(graph, "components", lambda e, f=was, a=asked: a.append(e.count()) or f(e))
        got = groups(runs.labelled(drawn, ["k"], diagonal))
        monkeypatch.setattr(graph, "components", was)
        assert got == groups(plain_labelled(drawn, ["k"], diagonal))
        assert asked[0] < drawn.count() / 2


# --- documents counted in slices ---


def plain_lexical(spark, docs, asked):
    """Sparse and dense scores by the expressions over whole texts, each query's token against each text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.lower(text).alias("low"), T.lexical_tokens(text).alias("tokens"), F.transform(T.hash_grams(text), lambda g: T.hash_bin(g)).alias("bins")).collect()
    queries = asked.select("query_id", F.array_sort(F.array_distinct(T.lexical_tokens("query"))).alias("tokens"), F.transform(T.hash_grams(F.col("query")), lambda g: T.hash_bin(g)).alias("bins")).collect()
    mean = sum(max(1, len(r.tokens)) for r in rows) / len(rows)
    df = {t: sum(t in r.tokens for r in rows) for q in queries for t in q.tokens}
    sparse, dense = {}, {}
    for q in queries:
        for r in rows:
            total = 0.0
            for t in q.tokens:
                tf = r.low.count(t)
                if tf and df[t]:
                    total += (2.0 if len(t) >= 3 else 1.0) * math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(1, len(r.tokens)) / mean)))
            if total:
                sparse[q.query_id, r.doc_id] = total
            a, b = Counter(r.bins), Counter(q.bins)
            if dot := sum(a[x] * b[x] for x in b):
                dense[q.query_id, r.doc_id] = dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sparse, dense


def test_lexical_scores_in_slices(spark, monkeypatch):
    """Latin and CJK runs, copies, stop words, a text without runs and none at all; few rows leave a slice."""
    monkeypatch.setattr(lexical, "DOCS", 16)
    monkeypatch.setattr(lexical, "ASKED", 3)
    rng = random.Random(3)
    words = ["wall", "walls", "aaaa", "aaaaa", "b", "x1", "slab", "混凝土", "钢筋混凝", "什么", "土钢", "规", "?", "-", "Beam", "beams"]
    some = lambda n: "".join(rng.choice(words) + rng.choice(["", " ", "\n", "，"]) for _ in range(n))
    texts = [some(rng.randrange(30)) for _ in range(100)] + [None, "", "? !"] + ["wall slab 混凝土"] * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([("q1", "wall aa slab"), ("q2", "混凝土 钢筋"), ("q3", "什么 beam 土钢"), ("q4", "?"), ("q5", "absent"), ("q6", "x1 b 规")], "query_id string, query string")
    sparse, dense = plain_lexical(spark, docs, asked)
    got = lambda df: {(r.query_id, r.doc_key): r.score for r in df.collect()}
    near = lambda a, b: a.keys() == b.keys() and all(math.isclose(a[x], b[x], rel_tol=1e-12) for x in a)
    assert near(got(retrieval.bm25(docs, asked, "doc_id")), sparse)
    assert near(got(retrieval.hash_dense(docs, asked, "doc_id")), dense)
    top = {q: max(v for (p, _), v in sparse.items() if p == q) for q, _ in sparse}
    both = {x: 0.7 * dense.get(x, 0.0) + 0.3 * (sparse[x] / top[x[0]] if x in sparse else 0.0) for x in dense | sparse}
    kept = retrieval.hybrid_search(docs, asked, "doc_id", k=4)
    assert kept.count() < len(both) / 2
    best = {}
    for (q, d), score in both.items():
        best.setdefault(q, []).append((-round(score, 9), d))
    want = {(q, i + 1, d) for q, rows in best.items() for i, (_, d) in enumerate(sorted(rows)[:4])}
    assert {(r.query_id, r["rank"], r.doc_key) for r in retrieval.top_k(kept.withColumn("score", F.round("score", 9)), 4).collect()} == want


def test_gram_counts_leave_slices_counted(spark):
    """A row for each key and bin, null keys too, as grams counted one by one."""
    rows = spark.createDataFrame([("a", "Wall 混凝 x"), ("b", None), (None, "wall"), ("a", "walls"), ("c", "?")], "lang string, text string")
    plain = rows.select("lang", F.explode(T.hash_grams(F.col("text"))).alias("g")).groupBy("lang", T.hash_bin(F.col("g")).alias("bin")).count()
    assert sorted(map(str, retrieval.gram_counts(rows, "lang", "text").select("lang", "bin", F.col("n").alias("count")).collect())) == sorted(map(str, plain.collect()))


# --- statements of models ---


def test_model_statements_are_spread_and_cut_once(spark):
    """A part's twenty statements are made and read on all cores, though the parts are one small file; odd statements are cut as the expression has them."""
    cores = spark.sparkContext.defaultParallelism
    parts = X.step_statements(spark, DATA).filter("statement like '#1%IFC%'").groupBy(F.spark_partition_id()).count()
    assert parts.count() >= cores
    odd = ["#7 = ifcWall ('a''(b',$,(#1,#2)) ; ", "/* #1=IFCA(); */\n#12=IFCB(\n#1,'x\x01y')\n", "#5=IFCC()", "HEADER", "#x=IFCD(1)", "", None, "#9=IFCE(.T.,IFCREAL(3.))x", "#123=IFCF($);\n"]
    got = ifc.instances(spark.createDataFrame([(f"f{i}", s) for i, s in enumerate(odd)], "file string, statement string")).collect()
    want = {f"f{i}": m for i, s in enumerate(odd) if s is not None and (m := re.match(ifc.STATEMENT, s))}
    assert {r.file: (r.id, r["class"]) for r in got} == {f: (int(m[1]), m[2].upper()) for f, m in want.items()} and len(want) == 4
    args = {r.file: r.args for r in got}
    assert args["f0"] == ["'a''(b'", "$", "(#1,#2)"] and args["f1"][1] == "'x\x01y'" and args["f2"] == [] and args["f8"] == ["$"]


# --- prices ---


def test_prices_of_one_name_do_not_meet_in_one_task(spark):
    """Rows go to the few names by a broadcast; before, all rows of a name were shuffled to one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select(F.col("id").alias("ord"), F.when(F.col("id") % 10 > 0, "HRB400 钢筋").alias("material"), F.concat(F.lit("s"), (F.col("id") % 50).cast("string")).alias("spec"), F.lit("m").alias("market"), F.lit(4000.0).alias("price_low"), F.lit(4100.0).alias("price_high"), F.lit("元/吨").alias("unit"), F.lit("05-01").alias("price_date"), F.lit("a").alias("source"), F.lit(1).alias("updated_at"))
        out = clean.clean_prices(rows, "2001-06-15")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted((r.ord, r.spec, r.material) for r in out.collect()) == [(i, f"s{i}", "螺纹钢" if i % 10 else "") for i in range(50)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_covered_segments_are_spread(spark, monkeypatch):
    """The pairs of a small file of segments are scored on all cores, not by the task that reads it."""
    seen, plain = [], spatial.covered_intervals
    monkeypatch.setattr(spatial, "covered_intervals", lambda a, b, *rest: seen.extend((a, b)) or plain(a, b, *rest))
    queries_geometry.length_recall(spark, DATA)
    assert len(seen) == 2 and min(df.rdd.getNumPartitions() for df in seen) >= spark.sparkContext.defaultParallelism


def stacked_edges(spark, n=120):
    rng = random.Random(17)
    rows = [(g, float(x), float(y), float(x + w), float(y)) for g in range(2) for x, y, w in ((rng.randrange(1500), 6 * rng.randrange(40), rng.randrange(10, 700)) for _ in range(n))]
    return spark.createDataFrame(rows, "g int, x1 double, y1 double, x2 double, y2 double")


def test_rounds_of_walls_once_carry_numbers(spark, monkeypatch):
    """What a round writes again of an edge pair is four numbers (F17); each edge serves once."""
    seen, keep = {}, rasters.stage
    monkeypatch.setattr(rasters, "stage", lambda df, name: seen.setdefault(name, df.dtypes) and keep(df, name))
    out = rasters.centerlines(stacked_edges(spark), ["g"], reuse=False)
    assert [t for _, t in seen["edge-pairs"]] == ["bigint", "bigint", "double", "double"]
    assert out.count() > 20


def test_grid_join_in_wide_cells(spark):
    """Cells need not be squares, and no corner of a box is shuffled with its cells."""
    rng = random.Random(25)
    box = lambda i: (i, i % 3, *(v for lo, w in ((rng.randrange(-90, 90), rng.choice([0, 5, 70])), (rng.randrange(-20, 20), rng.choice([0, 1, 9]))) for v in (lo / 2, (lo + w) / 2)))
    a, b = [box(i) for i in range(90)], [box(i) for i in range(90)]
    df = lambda rows, p: spark.createDataFrame(rows, f"{p} int, g int, {p}x0 double, {p}x1 double, {p}y0 double, {p}y1 double")
    at = lambda p: tuple(F.col(p + n) for n in ("x0", "y0", "x1", "y1"))
    met = spatial.grid_join(df(a, "a"), df(b, "b"), ["g"], at("a"), at("b"), (40.0, 3.0))
    span = lambda r, cell, i: range(math.floor(r[i] / cell), math.floor(r[i + 1] / cell) + 1)
    share = lambda p, q: all(set(span(p, cell, i)) & set(span(q, cell, i)) for cell, i in ((40.0, 2), (3.0, 4)))
    got = [(r.a, r.b) for r in met.select("a", "b").collect()]
    assert sorted(got) == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and share(p, q))
    assert set(met.columns) == {"g", *(p + n for p in "ab" for n in ("", "x0", "x1", "y0", "y1"))}


def test_long_edges_take_few_cells(spark):
    """An edge of 400 pixels is in a few cells, not in one of each 64 pixels along it."""
    width, height = rasters.CELL
    edges = spark.range(50).select("id", (F.col("id") * 30.0).alias("lo"), (F.col("id") * 6.0).alias("at")).withColumn("hi", F.col("lo") + 400)
    assert spatial._celled(edges, (F.col("lo"), F.col("at") + 3, F.col("hi"), F.col("at") + 24), (width, height)).count() < 4 * 50


def test_stars_are_counted_not_searched(spark, monkeypatch):
    """Stars against components put together in plain Python, and no component is searched for."""
    rng = random.Random(26)
    rows = [(f"s{rng.randrange(60)}", f"a{rng.randrange(90)}") for _ in range(60)] + [("s70", f"b{i}") for i in range(9)] + [(f"t{i}", "b70") for i in range(9)]
    rows += [("s80", "b80"), ("s80", "b81"), ("s80", "b81"), ("s81", "b82"), ("s81", None), ("s81", "b83"), (None, "b84"), ("s82", "b84"), ("s83", "b84"), ("s84", "b85"), ("s84", None), ("s85", "b85"), ("s86", None), ("s86", None)]
    monkeypatch.setattr(graph, "components", None)
    got = sorted(tuple(r) for r in graph.stars(spark.createDataFrame(rows, "left string, right string")).select("label", "left", "right", "single").collect())
    label = {n: n for left, right in rows if left for n in (f"l:{left}", f"r:{right}") if n != "r:None"}
    for _ in label:
        for left, right in rows:
            if left and right:
                label[f"l:{left}"] = label[f"r:{right}"] = min(label[f"l:{left}"], label[f"r:{right}"])
    want = []
    for at in set(label.values()):
        mine = [e for e in rows if e[0] and label[f"l:{e[0]}"] == at]
        lefts, rights = {e[0] for e in mine}, {e[1] for e in mine} - {None}
        if (len(lefts) == 1 and len(rights) >= 2 and len(mine) == len(rights)) or (len(rights) == 1 and len(lefts) >= 2 and len(mine) == len(lefts)):
            want += [(at, *e, "left" if len(lefts) == 1 else "right") for e in mine]
    assert got == sorted(want) and {r[3] for r in got} == {"left", "right"} and ("l:s82", "s82", "b84", "right") in got


def test_rerank_deals_items_before_it_counts_them(spark, tmp_path):
    """No partial aggregate holds a file's split, and partitions grow with the table."""
    from girder.plans import queries_records, tables

    plan = queries_records.rerank_legacy(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "Exchange hashpartitioning(query_id" in plan
    df = spark.range(1000).select("id", F.lit("x").alias("t"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert [tables.dealt(df, "id", share=s).rdd.getNumPartitions() for s in (size, size // 40)] == [4, -(-size // (size // 40))]


def test_fused_floors_are_not_gathered(spark, monkeypatch):
    """No join of the fusion of floors broadcasts what grows with them (F28), and rows are dealt before they are looked up."""
    from girder.operators import fusion
    from girder.plans import queries_rasters, staging

    plans, keep = [], staging.stage
    see = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(staging, "stage", lambda df, name: see(df) or keep(df, name))
    verdicts, elements = fusion.fuse_floors(*queries_rasters.floor_input(spark, DATA), ["floor"])
    see(elements)
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)
    assert any("REPARTITION_BY_NUM" in p for p in plans)


def test_lines_of_a_page_are_dealt_once_and_meet_in_one_shuffle(spark, monkeypatch):
    """Edges are dealt once before they are staged, and both sides of the pairs read one shuffle."""
    plans, keep = {}, rasters.stage
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rasters, "stage", lambda df, name: plans.setdefault(name, plan(df)) and keep(df, name))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        last = plan(rasters.centerlines(stacked_edges(spark), ["g"]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plans["axis-lines"].count("Exchange") == 1
    assert last.count("- ReusedExchange") == 1 and last.count("- Exchange") == 2


def test_lines_near_the_end_of_a_band_are_joined(spark):
    """Lines that meet over the end of a band, with a tie at their place, below zero: as with all pairs."""
    from tests.test_rasters import brute_lines

    height = rasters.CELL[1]
    rng = random.Random(26)
    rows = [(g, x, y, x + w, y) for g in range(3) for x, y, w in ((float(rng.randrange(400)), height * rng.randrange(-1, 3) + rng.choice([-3, -2.75, -1.5, 0, 0.25, 3, 20, 23.25]), float(rng.randrange(1, 60))) for _ in range(70))]
    rows += [(3, 0.0, y, 30.0, y) for y in (height - 1.5, height + 1.5, -1.0, 2.0, 30.0, 33.5)] + [(3, 500.0, 30.0, 520.0, 30.0), (3, 500.0, 32.0, 520.0, 32.0)]
    got = rasters.axis_lines(spark.createDataFrame(rows, "g int, x1 double, y1 double, x2 double, y2 double"), ["g"]).collect()
    for g in range(4):
        want = brute_lines([r[1:] for r in rows if r[0] == g])
        mine = sorted((r.axis, r.coord, r.lo, r.hi) for r in got if r.g == g)
        near = lambda lines: sorted((a, round(y, 6), lo, hi) for a, y, lo, hi in lines)
        assert near(mine) == near(want) and len(want) > 4


def test_edges_are_dealt_over_partitions_that_grow_with_them(spark, monkeypatch, tmp_path):
    """What a task sorts of a table of edges does not grow with it; rows of unknown size are dealt as Spark does."""
    plans, keep = [], rasters.stage
    monkeypatch.setattr(rasters, "stage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    edges = stacked_edges(spark)
    edges.write.parquet(str(tmp_path / "edges"))
    rasters.axis_lines(spark.read.parquet(str(tmp_path / "edges")), ["g"])
    assert "REPARTITION_BY_NUM" in plans[0]
    many = tables.dealt(spark.read.parquet(str(tmp_path / "edges")), "g", share=100)
    assert many.rdd.getNumPartitions() > 40
    assert tables.dealt(edges, "g").count() == edges.count()
