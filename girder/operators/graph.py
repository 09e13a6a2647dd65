"""Graphs as edge tables: connected components and maximum matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.plans.staging import settle, stage, staged

#: About as many edges are tied together at once.
SLICE = 1 << 16


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's larger (or smaller) neighbours to the smallest node next to it.

    The smallest neighbour is a partial aggregate joined back, so a hub's edges
    are never gathered in one group and a skewed join can be split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _smallest(a: np.ndarray, b: np.ndarray, many: int) -> np.ndarray:
    """The smallest number of what edges between numbers below ``many`` tie together, for each number."""
    low = np.arange(many)
    while True:
        p, q = low[a], low[b]
        if np.array_equal(p, q):
            return low
        # The root of the greater side goes to the smaller one, then all look to their roots.
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := low[low], low):
            low = up


def _tied(edges: DataFrame) -> DataFrame:
    """The same components in fewer edges: each slice's nodes tied to the smallest of what hangs together in it."""
    kind, most = dict(edges.dtypes)["a"], SLICE

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(held)
            ends = pa.chunked_array([*part["a"].chunks, *part["b"].chunks])
            nodes = ends.unique()
            nodes = nodes.take(pa.compute.array_sort_indices(nodes))
            at = pa.compute.index_in(ends, value_set=nodes).to_numpy()
            low = _smallest(at[:part.num_rows], at[part.num_rows:], len(nodes))
            led = np.flatnonzero(low < np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(led)), nodes.take(pa.array(low[led]))], names=["a", "b"])

        held, many = [], 0
        for batch in batches:
            held, many = [*held, batch], many + batch.num_rows
            if many >= most:
                yield from out(held)
                held, many = [], 0
        if many:
            yield from out(held)

    return edges.mapInArrow(tie, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component.  edges: (a, b) of one comparable type.

    What hangs together in a slice of the edges is tied there, as they come and
    again dealt by their smaller ends.  What is left goes through alternating
    large-star and small-star steps, written to the shared folder each round; it
    ends when a round changes nothing.
    """
    since = staged()
    edges = edges.select("a", "b").filter("a <> b")
    if dict(edges.dtypes)["a"] in ("bigint", "int", "string"):
        edges = _tied(_tied(edges).repartition("b"))
    now = stage(edges.distinct(), "edges")
    mark = None
    while True:
        now = settle(_star(_star(now, True), False), "edges", since)
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (new.n, new.h) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        mark = (new.n, new.h)


def with_components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """nodes with their component: the smallest node reachable, itself included."""
    comp = components(edges)
    return nodes.join(comp.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("label", key)).drop("label")


def max_matching(edges: pd.DataFrame) -> list[tuple]:
    """Hopcroft-Karp over edges (left, right) in order: pairs of a maximum matching."""
    out: dict = {}
    for left, right in zip(edges["left"], edges["right"], strict=True):
        out.setdefault(left, []).append(right)
    of_left: dict = {}
    of_right: dict = {}
    while True:
        level, frontier, found = {u: 0 for u in out if u not in of_left}, [u for u in out if u not in of_left], False
        while frontier:
            nxt = []
            for u in frontier:
                for v in out[u]:
                    w = of_right.get(v)
                    if w is None:
                        found = True
                    elif w not in level:
                        level[w] = level[u] + 1
                        nxt.append(w)
            frontier = nxt
        if not found:
            return [(u, v) for u, v in of_left.items()]
        at = {u: iter(out[u]) for u in out}
        for root in [u for u in out if u not in of_left]:
            path = [root]
            while path:
                u = path[-1]
                step = next(at[u], None)
                if step is None:
                    path.pop()
                    level.pop(u, None)
                    continue
                w = of_right.get(step)
                if w is None:
                    v = step
                    for x in reversed(path):  # flip the path
                        before = of_left.get(x)
                        of_left[x], of_right[v] = v, x
                        v = before
                    break
                if level.get(w) == level[u] + 1:
                    path.append(w)


def matching(edges: DataFrame) -> DataFrame:
    """(component, left, right) of a maximum matching; components are dealt and solved many at once, each by itself."""
    edges = stage(edges.select("left", "right"), "matching-edges")
    sides = edges.select(F.concat(F.lit("l:"), F.col("left").cast("string")).alias("a"), F.concat(F.lit("r:"), F.col("right").cast("string")).alias("b"))
    comp = components(sides)
    shares = 4 * max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // SLICE))
    tagged = edges.withColumn("node", F.concat(F.lit("l:"), F.col("left").cast("string"))).join(comp, "node").select(F.col("label").alias("component"), "left", "right")
    tagged = tagged.withColumn("_share", F.pmod(F.xxhash64("component"), F.lit(shares))).repartition(shares, "_share")
    types = dict(edges.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        # No path leads from one component to another, so each is matched as it would be alone.
        pairs = max_matching(pdf.sort_values(["left", "right"]))
        of = dict(zip(pdf["left"], pdf["component"], strict=True))
        return pd.DataFrame({"component": [of[p[0]] for p in pairs], "left": [p[0] for p in pairs], "right": [p[1] for p in pairs]})

    return tagged.groupBy("_share").applyInPandas(solve, f"component string, left {types['left']}, right {types['right']}")


def stars(edges: DataFrame) -> DataFrame:
    """Components with one node on one side and at least two on the other, each tied to it alone: (label, left, right, single).

    edges: (left, right) as text keys of two sides.  Two rounds of counting tell
    such a component, so none is searched: all edges of its centre lead to nodes
    that have no other edge.
    """
    edges = stage(edges.filter("left IS NOT NULL").select("left", "right"), "star-edges")

    def around(side: str, other: str) -> DataFrame:
        """Edges of centres on ``side``: (left, right, single)."""
        leaves = edges.groupBy(other).agg(F.count("*").alias("_n"), F.min(side).alias(side)).filter(F.col(other).isNotNull() & (F.col("_n") == 1)).select(side, other)
        led, all_ = leaves.groupBy(side).agg(F.count("*").alias("_led")), edges.groupBy(side).agg(F.count("*").alias("_all"))
        return leaves.join(led.join(all_, side).filter("_led = _all AND _led >= 2").select(side), side).select("left", "right", F.lit(side).alias("single"))

    one, other = around("left", "right"), around("right", "left")
    first = other.join(other.groupBy("right").agg(F.min("left").alias("_first")), "right").select("left", "right", "single", "_first")
    out = one.withColumn("_first", F.col("left")).unionByName(first)
    return out.select(F.concat(F.lit("l:"), F.col("_first")).alias("label"), "left", "right", "single")
