"""The plane cut up by segments, as half-edges: crossings by grid join, faces by following next-edge pointers.

Points are kept on a grid of ``GRID`` of a unit, so that nodes are equal or not
and areas are exact.  A bounded face runs counter-clockwise; dangling edges and
bridges are walked both ways and add nothing to an area, so they need no
removing.  What lies inside a face without touching it is taken off its area.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions import geometry as G
from girder.operators import spatial
from girder.plans.staging import settle, stage, staged
from girder.plans.tables import dealt, spread

GRID = 1_000_000
#: How near to a segment, in units, a point counts as on it.
TOUCH = 1e-9
_ENDS = ("x1", "y1", "x2", "y2")
#: Side of the tiles, in units, by which edges are dealt to be followed, and how many are followed at once.
TILE, SLICE = 64, 1 << 17


def _on_grid(value: Column) -> Column:
    return F.round(value * GRID).cast("long")


def _meeting_points(a: G.Segment, b: G.Segment) -> Column:
    """Where two segments meet: their crossing, or the ends of one that lie on the other."""
    ax, ay, bx, by = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    cross = ax * by - ay * bx
    t, u = ((b[0] - a[0]) * by - (b[1] - a[1]) * bx) / cross, ((b[0] - a[0]) * ay - (b[1] - a[1]) * ax) / cross
    point = lambda x, y: F.struct(_on_grid(x).alias("x"), _on_grid(y).alias("y"))
    within = lambda v: (v >= -TOUCH) & (v <= 1 + TOUCH)
    crossing = F.when((F.abs(cross) > 1e-12) & within(t) & within(u), point(a[0] + t * ax, a[1] + t * ay))
    ends = [F.when(G.point_segment_distance((s[i], s[i + 1]), other) <= TOUCH, point(s[i], s[i + 1])) for s, other in ((a, b), (b, a)) for i in (0, 2)]
    return F.array_distinct(F.array_compact(F.array(crossing, *ends)))


def _boxes_touch(a: str, b: str) -> Column:
    """Whether two segments may meet: of those that share a cell most do not even come near."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = spatial.segment_box(a), spatial.segment_box(b)
    slack = 1e-6 + 2 * TOUCH * (ax2 - ax1 + ay2 - ay1 + bx2 - bx1 + by2 - by1)
    return (ax1 <= bx2 + slack) & (bx1 <= ax2 + slack) & (ay1 <= by2 + slack) & (by1 <= ay2 + slack)


def noded(segments: DataFrame, keys: list[str], cell: float = 4.0) -> DataFrame:
    """(keys, ux, uy, vx, vy): the pieces between crossings, each once, u before v."""
    lines = segments.select(*keys, "seg_id", *_ENDS)
    lines = spread(lines)  # a segment meets many
    pairs = spatial.segment_pairs(lines, keys, TOUCH, cell).filter(_boxes_touch("a_", "b_")).withColumn("p", F.explode(_meeting_points(G.segment("a_"), G.segment("b_"))))
    own = lines.select(*keys, "seg_id", F.explode(F.array(*(F.struct(_on_grid(F.col(f"x{i}")).alias("x"), _on_grid(F.col(f"y{i}")).alias("y")) for i in (1, 2)))).alias("p"))
    cuts = own.unionByName(pairs.select(*keys, F.explode(F.array("a_seg_id", "b_seg_id")).alias("seg_id"), "p"))
    # Along a segment the points keep the order of (x, y).
    along = Window.partitionBy(*keys, "seg_id").orderBy("p")
    pieces = cuts.distinct().withColumn("q", F.lead("p").over(along)).filter("q is not null")
    return pieces.select(*keys, F.col("p.x").alias("ux"), F.col("p.y").alias("uy"), F.col("q.x").alias("vx"), F.col("q.y").alias("vy")).distinct()


def half_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h, next, ux, uy, vx, vy): both directions of each edge, and the one that follows with the face on its left."""
    way = lambda n, *ends: F.struct((F.col("i") * 2 + n).alias("h"), *(F.col(c).alias(name) for c, name in zip(ends, ("ux", "uy", "vx", "vy"), strict=True)))
    both = edges.withColumn("i", F.monotonically_increasing_id()).select(*keys, F.explode(F.array(way(0, "ux", "uy", "vx", "vy"), way(1, "vx", "vy", "ux", "uy"))).alias("e")).select(*keys, "e.*")
    around = Window.partitionBy(*keys, "ux", "uy")
    clockwise = around.orderBy(F.desc(F.atan2(F.col("vy") - F.col("uy"), F.col("vx") - F.col("ux"))), F.desc("h"))
    whole = clockwise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = both.withColumn("next", F.coalesce(F.lead("h").over(clockwise), F.first("h").over(whole)))
    # An edge that comes in at v goes on with what lies clockwise after its own way back, whose number differs in the last bit.
    return turn.select(*keys, F.col("h").bitwiseXOR(F.lit(1).cast("long")).alias("h"), "next", F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy"))


def rings(pointers: DataFrame) -> DataFrame:
    """(h, label): the smallest member of the ring that each pointer (h, next) runs round.

    Each round looks twice as far ahead; a round that changes nothing has seen
    every ring whole.
    """
    return _rings(pointers.select("h", F.col("next").alias("to"), F.least("h", "next").alias("label")))


def _rings(paths: DataFrame) -> DataFrame:
    """As ``rings``, over paths: ``label`` is the smallest member from h up to ``to``."""
    since = staged()
    now = settle(paths, "rings", since)
    while True:
        ahead = now.select(F.col("h").alias("to"), F.col("to").alias("_to"), F.col("label").alias("_label"))
        now = settle(now.join(ahead, "to").select("h", F.col("_to").alias("to"), F.least("label", "_label").alias("label"), (F.col("_label") < F.col("label")).alias("moved")), "rings", since)
        if now.filter("moved").isEmpty():
            return now.select("h", "label")
        now = now.drop("moved")


def _followed(h: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(open, to, label, entry) of pointers among themselves: open ones lead out of them, to ``to``; label is the smallest
    member of the ring, or of the way out; no other leads to an entry."""
    order = np.argsort(h)
    at = np.minimum(np.searchsorted(h[order], ahead), len(h) - 1)
    here = h[order][at] == ahead
    jump = np.where(here, order[at], np.arange(len(h)))
    entry, label = np.ones(len(h), bool), h.copy()
    entry[jump[here]] = False
    for _ in range(len(h).bit_length()):
        label, jump = np.minimum(label, label[jump]), jump[jump]
    return ~here[jump], ahead[jump], label, entry


def traced(half: DataFrame, keys: list[str]) -> DataFrame:
    """half-edges with ``label``: the smallest edge of the ring that each runs round.

    Rings are short and lie in one place: edges are dealt by tiles and followed slice by slice.  Only the ways that
    lead out of a slice are followed for all, an entry for each.
    """
    tile = [F.floor(F.col(c) / (TILE * GRID)).alias(f"_{c}") for c in ("ux", "uy")]
    rows = dealt(half.select("*", *tile), *keys, "_ux", "_uy").sortWithinPartitions(*keys, "_ux", "_uy").drop("_ux", "_uy")

    most = SLICE

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(held)
            open_, to, label, entry = _followed(part["h"].to_numpy(), part["next"].to_numpy())
            for name, v in (("to", pa.array(to, mask=~open_)), ("label", pa.array(label)), ("entry", pa.array(entry & open_))):
                part = part.append_column(name, v)
            yield from part.to_batches()

        held, many = [], 0
        for batch in batches:
            held, many = [*held, batch], many + batch.num_rows
            if many >= most:
                yield from out(held)
                held, many = [], 0
        if many:
            yield from out(held)

    local = stage(rows.mapInArrow(follow, ", ".join([*(f"{n} {t}" for n, t in rows.dtypes), "to long, label long, entry boolean"])), "planar-followed")
    entries = local.filter("entry").select("h", "to", "label")
    closed = local.filter("to IS NULL").drop("to", "entry")
    if entries.isEmpty():
        return closed
    ring = _rings(entries).withColumnRenamed("h", "to")
    return closed.unionByName(local.filter("to IS NOT NULL").drop("label", "entry").join(ring, "to").drop("to"))


def faces(edges: DataFrame, keys: list[str], band: float = 1.0) -> DataFrame:
    """(keys, face, area, edges): bounded faces of noded edges, what lies inside a face without touching it taken off."""
    labelled = traced(half_edges(edges, keys), keys)
    exact = lambda a, b: F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")
    first = F.min(F.struct("ux", "uy")).alias("first")
    ring = stage(labelled.groupBy(*keys, "label").agg(F.sum(exact("ux", "vy") - exact("vx", "uy")).alias("twice"), F.count("*").alias("edges"), first), "planar-rings")
    found = ring.filter("twice > 0")
    # The outline of a part, run clockwise, may lie in a face of another: its leftmost point is tried against the edges left of it.
    outline = ring.filter("twice < 0").select(*keys, F.col("label").alias("hole"), F.col("first.ux").alias("px"), F.col("first.uy").alias("py"), F.col("twice").alias("hole_twice"))
    step = int(band * GRID)
    sides = labelled.join(found.select("label"), "label").filter(F.col("uy") != F.col("vy")).select(*keys, "label", "ux", "uy", "vx", "vy")
    sides = sides.withColumn("band", F.explode(F.sequence(F.floor(F.least("uy", "vy") / step), F.floor(F.greatest("uy", "vy") / step))))
    met = sides.join(outline.withColumn("band", F.floor(F.col("py") / step)), [*keys, "band"])
    left = (F.least("uy", "vy") <= F.col("py")) & (F.col("py") < F.greatest("uy", "vy"))
    side = exact("px", "vy") - exact("px", "uy") - exact("ux", "vy") + exact("ux", "uy") - (exact("py", "vx") - exact("py", "ux") - exact("uy", "vx") + exact("uy", "ux"))
    strictly_left = F.when(F.col("vy") > F.col("uy"), side > 0).otherwise(side < 0)
    inside = met.filter(left & strictly_left).groupBy(*keys, "hole", "hole_twice", "label").agg((F.count("*") % 2 == 1).alias("odd")).filter("odd")
    held = inside.join(found.select("label", "twice"), "label").groupBy(*keys, "hole", "hole_twice").agg(F.min_by("label", F.struct("twice", "label")).alias("label"))
    off = held.groupBy("label").agg(F.sum("hole_twice").alias("off"))
    net = F.col("twice") + F.coalesce(F.col("off"), F.lit(0))
    return found.join(off, "label", "left").select(*keys, F.col("label").alias("face"), (net.cast("double") / 2 / GRID / GRID).alias("area"), "edges")


def rooms(segments: DataFrame, keys: list[str], cell: float = 4.0) -> DataFrame:
    """(keys, face, area, edges) of the rooms that segments enclose."""
    return faces(stage(noded(segments, keys, cell), "planar-edges"), keys)


def topology_with_support(walls: DataFrame, keys: list[str], *, support: DataFrame | None = None, columns: DataFrame | None = None, bridges: DataFrame | None = None, tolerance: float = 0.30, margin: float = 0.30, widest: float = 5.0) -> DataFrame:
    """Per drawing how the ends of walls meet all walls, supports, opening bridges and columns, and the rooms of that network.

    walls, support and bridges: keys, wall_id, x1, y1, x2, y2, thickness (mm); columns: keys, cx, cy, w, d, at most ``widest``.
    """
    sides = [df.select(*keys, F.lit(i).alias("side"), F.col("wall_id").cast("string").alias("wall_id"), *_ENDS, F.coalesce("thickness", F.lit(0.0)).alias("thickness")) for i, df in enumerate((walls, support, bridges)) if df is not None]
    network = sides[0]
    for side in sides[1:]:
        network = network.unionByName(side)
    network = stage(network.withColumn("seg_id", F.concat_ws(":", "side", "wall_id")).drop("wall_id"), "topology-network")
    own = network.filter("side = 0")
    ends = spatial.segment_ends(own, keys, "seg_id", "thickness")
    reach = F.least(F.lit(0.8), F.greatest(F.lit(tolerance), (F.col("thickness") + F.col("s_thickness")) / 2000 + 0.05))
    hits = spatial.supported_ends(ends, network, keys, "seg_id", "seg_id", reach, 0.8)
    if columns is not None:
        hits = hits.unionByName(spatial.ends_on_columns(ends, columns, keys, "seg_id", margin, widest)).distinct()
    met = hits.groupBy(*keys, "seg_id").agg(F.count("*").alias("hits"))
    each = own.select(*keys, "seg_id").join(met, [*keys, "seg_id"], "left").na.fill(0, ["hits"])
    of_walls = each.groupBy(*keys).agg(F.count("*").alias("walls"), F.sum("hits").alias("connected_ends"), F.count(F.when(F.col("hits") == 2, 1)).alias("fully_connected"))
    sizes = network.groupBy(*keys).agg(F.count(F.when(F.col("side") == 1, 1)).alias("support_walls"), F.count(F.when(F.col("side") == 2, 1)).alias("opening_bridges"))
    enclosed = rooms(network, keys).groupBy(*keys).agg(F.count("*").alias("rooms"), F.round(F.sum("area"), 3).alias("room_area"))
    out = sizes.join(of_walls, keys, "left").join(enclosed, keys, "left").na.fill(0, ["walls", "connected_ends", "fully_connected", "rooms"]).na.fill(0.0, ["room_area"])
    share = lambda n, of: F.when(F.col("walls") > 0, F.col(n) / (of * F.col("walls"))).otherwise(0.0)
    return out.withColumn("endpoint_coverage", share("connected_ends", 2)).withColumn("fully_connected_rate", share("fully_connected", 1))
