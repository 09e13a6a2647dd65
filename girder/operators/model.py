"""Assembling and checking building models: filters, audits, lineage, calibration, connectivity and union of floors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girder.functions import geometry as G
from girder.operators import interval, ordered, spatial


def with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document on (doc_id, tenant_id); chunks without one stay."""
    return chunks.join(documents, ["doc_id", "tenant_id"], "left")


def project_levels(levels: DataFrame, projects: DataFrame, tenant: str) -> DataFrame:
    """The levels of a tenant's projects by elevation."""
    return levels.join(projects.filter(F.col("tenant_id") == tenant).select("project_id"), "project_id").orderBy("project_id", "elevation")


def frames_interact(a: Column, b: Column, cross_frame: bool = False) -> Column:
    """Frame-id sets must meet unless crossing is registered."""
    return F.lit(True) if cross_frame else F.arrays_overlap(a, b)


def first_seen(refs: Column) -> Column:
    """Distinct members of an array of arrays, in order of first sight."""
    return F.array_distinct(F.flatten(refs))


def shared(a: Column, b: Column) -> Column:
    """G03."""
    return F.array_intersect(a, b)


def first_present(*paths: Column) -> Column:
    """The first of several places a value may stand."""
    return F.coalesce(*paths)


def exclude_layers(rows: DataFrame, patterns: list[str], layers: Column) -> tuple[DataFrame, DataFrame]:
    """rows none of whose layers holds a pattern (case does not matter), and counts per excluded layer and pattern."""
    low = F.transform(layers, F.lower)
    hits = F.array_compact(F.array(*[F.when(F.exists(low, _holds(p)), F.lit(p)) for p in patterns]))
    marked = rows.withColumn("_hits", hits)
    report = marked.filter(F.size("_hits") > 0).select(F.get(layers, F.lit(0)).alias("layer"), F.explode("_hits").alias("pattern")).groupBy("layer", "pattern").agg(F.count("*").alias("n"))
    return marked.filter(F.size("_hits") == 0).drop("_hits"), report


def _holds(pattern: str) -> Callable[[Column], Column]:
    return lambda x: F.contains(x, F.lit(pattern.lower()))


def beam_lines(lines: DataFrame, keys: list[str], shortest: float = 500.0, frame: float = 2_000_000.0) -> DataFrame:
    """lines of at least the length with both ends inside the frame."""
    inside = reduce(lambda a, b: a & b, [F.abs(c) <= frame for c in ("x1", "y1", "x2", "y2")])
    return lines.filter((G.length(G.segment()) >= shortest) & inside)


def slab_outlines(outlines: DataFrame, points: str = "points", smallest: float = 1.0) -> DataFrame:
    """outlines of 4 and more points and an area, with their vertex mean as centre."""
    out = outlines.filter(F.size(points) >= 4).withColumn("area", G.polygon_area(F.col(points))).filter(F.col("area") >= smallest)
    return out.withColumn("centre", G.vertex_mean(F.col(points)))


def standard_violations(kinds: dict[str, tuple[DataFrame, dict[str, Column]]], key: str = "element_id") -> DataFrame:
    """(kind, ord, id, rule) for each kind's rules in order, and repeated ids across all kinds."""
    rows, ids = [], []
    for i, (kind, (df, checks)) in enumerate(kinds.items()):
        broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.struct(F.lit(j).alias("rule_ord"), F.lit(n).alias("rule"))) for j, (n, c) in enumerate(checks.items())]))
        rows.append(df.select(F.lit(i).alias("kind_ord"), F.lit(kind).alias("kind"), F.col(key), F.explode(broken).alias("r")).select("kind_ord", "kind", key, "r.*"))
        ids.append(df.select(F.lit(i).alias("kind_ord"), F.lit(kind).alias("kind"), F.col(key)))
    every = reduce(DataFrame.unionByName, ids).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("kind_ord")))
    rows.append(every.filter("_n > 1").select("kind_ord", "kind", key, F.lit(999).alias("rule_ord"), F.lit("duplicate_id").alias("rule")))
    return reduce(DataFrame.unionByName, rows)


def payload_issues(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with the names of the checks they fail; what the checks are is the caller's contract."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return rows.withColumn("issues", failed)


def traceability(walls: DataFrame, keys: list[str], drawing: Column, occurrence: Column, refs: str = "refs", declared: str = "ref_ids") -> DataFrame:
    """per wall (or column) whether its refs are present, complete, of one drawing and occurrence, and in the declared order.

    refs: array<struct<id, drawing, occurrence>>.
    """
    all_ = lambda f: F.forall(refs, f)
    checks = {"present": F.size(refs) > 0, "complete": all_(lambda r: r["id"].isNotNull()), "same_drawing": all_(lambda r: r["drawing"].eqNullSafe(drawing)), "same_occurrence": all_(lambda r: r["occurrence"].eqNullSafe(occurrence)), "declared": F.transform(refs, lambda r: r["id"]) == F.col(declared)}
    return walls.select(*keys, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])


def provenance(columns: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """The placed segments of each column through its placement key: complete with exactly four, else a limitation."""
    per = segments.groupBy(*keys).agg(F.array_sort(F.collect_list("segment_id")).alias("segment_ids"), F.count("*").alias("n"))
    return columns.join(per, keys, "left").withColumn("limitation", F.when(F.col("n").isNull(), "NO_SEGMENTS").when(F.col("n") != 4, "NOT_FOUR_SEGMENTS")).drop("n")


def door_vectors(ends: DataFrame, vectors: DataFrame, keys: list[str], tolerance: float, end_id: str = "end_id", vector_id: str = "vector_id") -> DataFrame:
    """The one vector with an end within the tolerance of each reviewed end; none or several leave it open."""
    v = spatial.segment_ends(vectors, keys, vector_id).select(*keys, vector_id, F.col("x").alias("rx"), F.col("y").alias("ry"))
    hit = spatial.near_points(ends, v, keys, tolerance).groupBy(end_id).agg(F.count_distinct(vector_id).alias("n"), F.min(vector_id).alias(vector_id))
    return ends.join(hit, end_id, "left").withColumn(vector_id, F.when(F.col("n") == 1, F.col(vector_id))).withColumn("vectors", F.coalesce("n", F.lit(0))).drop("n")


def match_built(model: DataFrame, built: DataFrame, keys: list[str], thickness: float = 25.0, reach: float = 2.0) -> DataFrame:
    """Model walls with their built wall: by id, else the nearest unused one of near thickness, longest first.

    Both: keys, id, x1, y1, x2, y2, thickness.
    """
    same = model.select(*keys, "id").join(built.select(*keys, "id"), [*keys, "id"])
    m, b = model.join(same, [*keys, "id"], "left_anti"), built.join(same, [*keys, "id"], "left_anti")
    box = spatial.grid_join(spatial.renamed(m, "m_", keys), spatial.renamed(b, "b_", keys), keys, spatial.segment_box("m_", reach), spatial.segment_box("b_"), 4 * reach)
    d = lambda p, q: G.hypot(F.col(f"m_x{p}") - F.col(f"b_x{q}"), F.col(f"m_y{p}") - F.col(f"b_y{q}"))
    error = F.least(F.greatest(d(1, 1), d(2, 2)), F.greatest(d(1, 2), d(2, 1)))
    near = box.withColumn("error", error).withColumn("length", G.length(G.segment("m_"))).filter((F.col("error") <= reach) & (F.abs(F.col("m_thickness") - F.col("b_thickness")) <= thickness))
    types = dict(model.dtypes)

    def rule(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["length", "m_id", "error", "b_id"], ascending=[False, True, True, True], kind="stable")
        kept = ordered.take_greedy(list(zip(pdf["m_id"], pdf["b_id"], pdf["error"], strict=True)))
        return pd.DataFrame(kept, columns=["id", "built_id", "error"])

    extra = ordered.by_group(near.select(*keys, "m_id", "b_id", "error", "length"), keys, ["m_id"], rule, f"id {types['id']}, built_id {types['id']}, error double")
    return same.select(*keys, "id", F.col("id").alias("built_id"), F.lit(0.0).alias("error")).unionByName(extra)


def split_by_columns(walls: DataFrame, columns: DataFrame, keys: list[str], shortest: float, wall_id: str = "wall_id") -> DataFrame:
    """What of each axis-parallel wall is outside the columns it runs through; the column keeps its volume.

    walls: keys, id, x1, y1, x2, y2, thickness (m).  columns: cx, cy, w, d.  Returns keys, id, piece, lo, hi along the wall.
    """
    w = walls.withColumn("rec", G.line_record(G.segment())).filter(F.col("rec").isNotNull())
    pairs = spatial.grid_join(spatial.renamed(w, "s_", keys), spatial.renamed(columns, "c_", keys), keys, spatial.segment_box("s_", 2.0), spatial.point_box(F.col("c_cx"), F.col("c_cy")), 8.0)
    r = F.col("s_rec")
    at = (F.col("c_cx") - r["x1"]) * r["ux"] + (F.col("c_cy") - r["y1"]) * r["uy"]
    off = F.abs((F.col("c_cx") - r["x1"]) * r["nx"] + (F.col("c_cy") - r["y1"]) * r["ny"])
    along = (F.abs(r["ux"]) * F.col("c_w") + F.abs(r["uy"]) * F.col("c_d")) / 2
    across = (F.abs(r["nx"]) * F.col("c_w") + F.abs(r["ny"]) * F.col("c_d")) / 2
    taken = pairs.filter(off < across + F.col("s_thickness") / 2).select(F.col(f"s_{wall_id}").alias(wall_id), (at - along).alias("lo"), (at + along).alias("hi"))
    base = w.select(wall_id, F.lit(0.0).alias("lo"), F.col("rec.length").alias("hi"))
    return interval.difference(base, taken, [wall_id], "lo", "hi", shortest)


def greedy_hosts(labels: DataFrame, boundaries: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Nearest free boundary or profile of each label within reach (one to one), with a confidence falling by distance."""
    b = boundaries.select(*keys, "boundary_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = spatial.near_points(labels, b, keys, reach).select(*keys, "label_id", "boundary_id", "distance")
    return ordered.greedy_pairs(near, keys, "label_id", "boundary_id", "distance").withColumn("confidence", G.distance_confidence(F.col("distance"), reach, 0.8, 0.2))


def beam_labels(beams: DataFrame, labels: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """The nearest label of each beam within reach; a label may serve several beams.  A beam without one gets a
    mark from a hash of its place and a confidence of at most 0.85.

    beams: keys, beam_id, x, y, confidence.  labels: keys, label_id, mark, x, y.
    """
    l = labels.select(*keys, "label_id", F.col("mark").alias("label_mark"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    best = spatial.near_points(beams, l, keys, reach).groupBy("beam_id").agg(F.min_by(F.struct("label_id", "label_mark"), F.struct("distance", "label_id")).alias("best"))
    place = F.substring(F.sha2(F.concat_ws(":", F.round("x", 3).cast("decimal(18,3)").cast("string"), F.round("y", 3).cast("decimal(18,3)").cast("string")), 256), 1, 8)
    named = F.col("best").isNotNull()
    return beams.join(best, "beam_id", "left").select(*keys, "beam_id", "best.label_id", F.when(named, F.col("best.label_mark")).otherwise(F.concat(F.lit("LL-"), place)).alias("mark"), F.when(named, F.col("confidence")).otherwise(F.least("confidence", F.lit(0.85))).alias("confidence"))


def label_openings(labels: DataFrame, boundaries: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Labels in input order (``ord``) each take the nearest boundary within reach that is still free."""
    b = boundaries.select(*keys, "boundary_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = spatial.near_points(labels, b, keys, reach).select(*keys, "ord", "label_id", "boundary_id", "distance")
    types = dict(near.dtypes)

    def rule(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["ord", "distance", "boundary_id"], kind="stable")
        return pd.DataFrame(ordered.take_greedy(list(zip(pdf["label_id"], pdf["boundary_id"], pdf["distance"], strict=True))), columns=["label_id", "boundary_id", "distance"])

    return ordered.by_group(near, keys, ["ord"], rule, f"label_id {types['label_id']}, boundary_id {types['boundary_id']}, distance double")


def ifc_grid(axes: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Axis values folded pairwise per direction (a value near the last centre moves it to their mean) and numbered in order."""
    centres = axes.groupBy(*keys, "direction").agg(ordered.cluster_fold(F.collect_list("v"), tolerance).alias("centres"))
    return centres.select(*keys, "direction", F.posexplode("centres").alias("pos", "at")).select(*keys, "direction", "at", F.concat(F.substring("direction", 1, 1), (F.col("pos") + 1).cast("string")).alias("label"))


def paired_evidence(segments: DataFrame, keys: list[str], declared: DataFrame | None = None, most: float = 0.60) -> DataFrame:
    """Wall evidence from paired faces, each stretch of a face used once, nearest pairs first; thicker pairs only
    where the frame declares one such thickness (declared: keys, thickness)."""
    pairs = spatial.pair_faces(segments, keys, high=2.0 if declared is not None else most)
    if declared is not None:
        one = declared.groupBy(*keys).agg(F.count_distinct("thickness").alias("_n"), F.min("thickness").alias("_t")).filter("_n = 1")
        pairs = pairs.join(one, keys, "left").filter((F.col("distance") <= most) | (F.abs(F.col("distance") - F.col("_t")) <= 0.025)).drop("_n", "_t")
    rows = pairs.withColumnsRenamed({"a_seg_id": "a", "b_seg_id": "b"})
    kind = dict(rows.dtypes)["a"]
    return ordered.walls_by_group(rows, keys, lambda ps: ordered.consume_intervals(ps, 1e-9), f"a {kind}, b {kind}, distance double, overlap double, x1 double, y1 double, x2 double, y2 double", ["a", "b"])


def grid_calibration(matches: DataFrame) -> DataFrame:
    """Control points per (drawing, axis): median target of each local value; status says if there are at least two.

    matches: drawing_id, axis, local, target.  Use functions.geometry.piecewise to map values.
    """
    points = matches.groupBy("drawing_id", "axis", F.col("local").alias("at")).agg(F.percentile("target", F.lit(0.5)).alias("to"))
    out = points.groupBy("drawing_id", "axis").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("controls"))
    return out.withColumn("status", F.when(F.size("controls") >= 2, "ok").otherwise("too_few_grids"))


def project_grid(axes: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Axis candidates clustered by running mean per direction and numbered in order."""
    return ordered.clusters(axes, [*keys, "direction"], "v", tolerance).withColumn("label", F.concat(F.substring("direction", 1, 1), (F.col("cluster") + 1).cast("string")))


def end_connectivity(walls: DataFrame, columns: DataFrame, keys: list[str], tolerance: float, wall_id: str = "wall_id") -> DataFrame:
    """Per drawing the share of ends that reach another wall (by both widths) or a column; no wall gives 1 (1.0 dangling).

    walls: thickness in metres.  columns: cx, cy.
    """
    ends = spatial.segment_ends(walls, keys, wall_id, "thickness")
    reach = F.greatest(F.lit(tolerance), F.sqrt(F.lit(2.0)) * (F.col("thickness") + F.col("s_thickness")) / 2 + 0.02)
    on_wall = spatial.supported_ends(ends, walls, keys, wall_id, wall_id, reach, 2.0)
    on_column = spatial.near_points(ends, columns.select(*keys, F.col("cx").alias("rx"), F.col("cy").alias("ry")), keys, tolerance).select(*keys, wall_id, "end")
    held = on_wall.unionByName(on_column).distinct().groupBy(*keys).agg(F.count("*").alias("connected"))
    total = walls.groupBy(*keys).agg((2 * F.count("*")).alias("ends"))
    return total.join(held, keys, "left").na.fill(0, ["connected"]).withColumn("dangling_ratio", F.when(F.col("ends") > 0, 1 - F.col("connected") / F.col("ends")).otherwise(1.0))


def classify_ends(ends: DataFrame, classes: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """The first class, in order of priority, whose table holds the end; else unresolved."""
    out, names = ends, []
    for i, (name, df) in enumerate(classes):
        out = out.join(df.select(*key).distinct().withColumn(f"_c{i}", F.lit(name)), key, "left")
        names.append(F.col(f"_c{i}"))
    return out.withColumn("support", F.coalesce(*names, F.lit("unresolved"))).drop(*[f"_c{i}" for i in range(len(classes))])


def merge_fragments(lines: DataFrame, keys: list[str], gap: float, angle: float = 0.05, offset: float = 0.001) -> DataFrame:
    """Fragments on one line within the gap joined, scoped to the keys (one source identity)."""
    kind = dict(lines.dtypes)["id"]
    return ordered.walls_by_group(lines, keys, lambda walls: ordered.merge_collinear(walls, gap, offset, angle), f"x1 double, y1 double, x2 double, y2 double, thickness double, ids array<{kind}>", ["id"])


def apply_if_unchanged(base: DataFrame, decisions: DataFrame, key: str = "wall_id", digest: str = "hash") -> DataFrame:
    """Approved changes (key, base_hash, patch columns x1..y2) applied only where the base hash still matches; the rest is reported."""
    d = decisions.select(key, "base_hash", F.struct("x1", "y1", "x2", "y2").alias("_p"))
    out = base.join(d, key, "left")
    ok = F.col("base_hash") == F.col(digest)
    moved = {c: F.when(ok, F.col(f"_p.{c}")).otherwise(F.col(c)) for c in ("x1", "y1", "x2", "y2")}
    return out.withColumn("replay", F.when(F.col("base_hash").isNull(), "none").when(ok, "applied").otherwise("stale")).withColumns(moved).drop("_p", "base_hash")


def fuse_floor(structure: DataFrame, architecture: DataFrame, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Structure elements, with the architecture id they match, and architecture elements that match none."""
    only = spatial.mutual_unique(pairs, left, right).select(left, right)
    fused = structure.join(only, left, "left").withColumn("origin", F.when(F.col(right).isNotNull(), "both").otherwise("structure"))
    rest = architecture.join(only.select(right), right, "left_anti").withColumn("origin", F.lit("architecture"))
    return fused.unionByName(rest, allowMissingColumns=True)


def verify_lineage(artifacts: DataFrame) -> DataFrame:
    """Artifacts (run_id, stage, sha256, parent_sha256) in stage order: each must name the hash of the one before."""
    w = Window.partitionBy("run_id").orderBy("stage")
    before = F.lag("sha256").over(w)
    return artifacts.withColumn("linked", F.when(before.isNull(), F.col("parent_sha256").isNull()).otherwise(F.coalesce(F.col("parent_sha256") == before, F.lit(False))))


def union_floors(floors: dict[str, DataFrame], kind: str) -> DataFrame:
    """Elements of all floors with ids floor_kind_n; floors without any are skipped."""
    parts = [df.withColumn("floor", F.lit(f)).withColumn("id", F.concat_ws("_", F.lit(f), F.lit(kind), F.row_number().over(Window.partitionBy("floor").orderBy("ord")).cast("string"))) for f, df in floors.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pixel_iou(source: DataFrame, target: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Edge pixels (keys, x, y: whole numbers) of two renders.

    A pixel is matched if the other render has one in the square of ``tolerance``
    pixels to each side.  Recall, precision, their minimum, and matched over union;
    0 where a side is empty.
    """
    s, t = source.select(*keys, "x", "y").distinct(), target.select(*keys, "x", "y").distinct()

    def matched(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        steps = F.sequence(F.lit(-tolerance), F.lit(tolerance))
        reached = b.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select(*keys, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).distinct()
        return a.join(reached, [*keys, "x", "y"], "left_semi").groupBy(*keys).agg(F.count("*").alias(name))

    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    out = n(s, "a").join(n(t, "b"), keys, "full").join(matched(s, t, "ma"), keys, "left").join(matched(t, s, "mb"), keys, "left").na.fill(0)
    share = lambda part, whole: F.when((F.col("a") > 0) & (F.col("b") > 0), F.col(part) / F.col(whole)).otherwise(0.0)
    both = (F.col("ma") + F.col("mb")) / 2
    out = out.withColumn("recall", share("ma", "a")).withColumn("precision", share("mb", "b")).withColumn("edge_iou", F.least("recall", "precision"))
    return out.withColumn("raw_iou", F.when((F.col("a") > 0) & (F.col("b") > 0), both / (F.col("a") + F.col("b") - both)).otherwise(0.0))


def pitfalls(reports: DataFrame) -> DataFrame:
    """The known pitfalls that a report of counts hits: more axes than labels, flipped orientations, a match
    rate below 0.9, columns out of range.  An absent or zero count says nothing, but a match rate of zero counts."""
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    hits = F.array_compact(F.array(
        F.when(some("axis_count") & some("axis_label_count") & (F.col("axis_count") > F.col("axis_label_count")), F.lit("PIT-01")),
        F.when(some("orient_flips"), F.lit("PIT-03")), F.when(F.col("main_match_rate") < 0.9, F.lit("PIT-06")), F.when(F.col("coord_outliers") > 0, F.lit("PIT-08"))))
    return reports.withColumn("pitfalls", hits)


def cached_by_digest(spark: SparkSession, root: str, digest: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result stored under its content digest, built and published once."""
    path = f"{root.rstrip('/')}/digest={digest}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Append-only log or object-store sink; any path Spark writes to."""
    df.write.mode("append").parquet(path)


class Registry:
    """Named handlers with an ordered fallback; the last one registered as fallback always runs."""

    def __init__(self, fallback: Callable):
        self.handlers: dict[str, Callable] = {}
        self.fallback = fallback

    def register(self, name: str, handler: Callable) -> None:
        self.handlers[name] = handler

    def call(self, names: list[str], *args, **more):
        for name in names:
            if name in self.handlers:
                return self.handlers[name](*args, **more)
        return self.fallback(*args, **more)


def scored(rows: DataFrame, text: str, score: Callable[[list[str]], list[float]], name: str = "score") -> DataFrame:
    """A column from any batch scorer or embedder of texts (cut to 1200 characters), Arrow batches, rounded to 4 places."""
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([round(float(x), 4) for x in score([(t or "")[:1200] for t in texts.to_pylist()])], pa.float64())

    return rows.withColumn(name, run(F.col(text)))


def poll_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that has arrived, once, in batches; a schedule calls it again."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
