"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources that hold
them).  Token capacity flows from patterns to source quotas; the k-th reading
of a pattern's tokens costs more than the one before (convex repetition cost),
so no pattern is repeated while a fresh one can serve.  What flows through a
pattern is then turned into whole documents in a seeded order.

Rows of one id, text and membership are alike; they are counted in slices and
taken one by one, so neither null or repeated ids nor many copies put rows into
one task or make them one piece.

Edge cases: null text has size 0; a null member is a source of its own, ordered
last; a null id counts as a text of its own; of rows that are alike any may be
the one that is taken; an empty table gives an empty mix; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girder.llm.common import stage, table, word_count

#: Cost of a pattern's first, second, ... reading: convex.
REPEAT_COST = lambda k: k * k
#: Patterns and sources are gathered on the driver up to this many; beyond, the operator refuses.
MAX_PATTERNS = 100_000
SEED = 17
#: Times that open documents are taken in order for what is left of a flow.
ROUNDS = 3
#: Parts into which rows that are alike are dealt.
SLICES = 1024
FILLS = "fills array<struct<rest: long, cut: string, at_cut: long>>"


def _filled() -> Column:
    """How many open documents of a slice the fills take: all that fit before a fill's cut, some at the cut."""
    more = lambda got, f: F.when(F.col("size") > f["rest"], F.lit(0)).when(F.col("key") < f["cut"], F.col("open") - got).when(F.col("key") == f["cut"], F.least(f["at_cut"], F.col("open") - got)).otherwise(F.lit(0))
    return F.aggregate("fills", F.lit(0).cast("long"), lambda got, f: got + more(got, f).cast("long"))


def _fitting(start: Column, size: Column, room: Column, n: Column) -> Column:
    """How many of n pieces of one size, laid end to end from ``start``, end within ``room``."""
    return F.when(size == 0, F.when(start <= room, n).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(n, F.floor((room - start) / F.nullif(size, F.lit(0)))))).cast("long")


def share_targets(sizes: dict, weights: dict, cap: int = 3) -> dict:
    """Share all words among sources by weight; none gets above ``cap`` times its size.

    The excess of capped sources is shared again by weight until none is above.
    Integers until one last division, so that any engine finds the same doubles.
    """
    total, rest_w = sum(sizes.values()), sum(weights.values())
    rest, out = total, {}
    ranked = sorted(sizes, key=lambda s: (cap * sizes[s] / weights[s], weights[s]))
    while ranked and rest * weights[ranked[0]] > cap * sizes[ranked[0]] * rest_w:
        s = ranked.pop(0)
        out[s] = float(cap * sizes[s])
        rest -= cap * sizes[s]
        rest_w -= weights[s]
    return out | {s: float(rest * weights[s]) / rest_w for s in ranked}


def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = 3) -> list[dict]:
    """Min-cost flow: words of each pattern given to each of its sources.

    patterns: (sources, words); quotas: words wanted by each source.  Successive
    shortest paths: all arcs but a pattern's readings are free, so the cheapest
    pattern that reaches a source with quota left starts a shortest path, and a
    path may take words back from one source to give another.  What a pattern
    reaches in vain stays closed for good and is not searched again.
    """
    flows: list[dict] = [{} for _ in patterns]
    left, used, closed = dict(quotas), [0] * len(patterns), set()
    #: movers[s][t]: patterns that give s words and can give them to t.
    movers: dict = {s: {} for s in quotas}

    def tier(i: int) -> tuple[int, int]:
        """Cost and room of the next reading of pattern i."""
        words = patterns[i][1]
        k = used[i] // words if words else repeats
        return (REPEAT_COST(k), (k + 1) * words - used[i]) if k < repeats else (-1, 0)

    def give(p: int, s, n: int) -> None:
        before = flows[p].get(s, 0)
        flows[p][s] = before + n
        if not before or not flows[p][s]:
            for t in patterns[p][0]:
                if t != s:
                    if flows[p][s]:
                        movers[s].setdefault(t, {})[p] = True
                    else:
                        movers[s][t].pop(p)

    heap = [(tier(i)[0], i) for i in range(len(patterns)) if tier(i)[1]]
    heapq.heapify(heap)
    while heap:
        _, root = heapq.heappop(heap)
        came, end = {s: None for s in patterns[root][0] if s not in closed}, None
        todo = deque(came)
        while todo:
            s = todo.popleft()
            if left[s] > 0:
                end = s
                break
            for t, who in movers[s].items():
                if who and t not in came and t not in closed:
                    came[t] = (s, next(iter(who)))
                    todo.append(t)
        if end is None:
            closed.update(came)
            continue
        hops, s = [], end
        while came[s] is not None:
            hops.append((came[s][1], came[s][0], s))
            s = came[s][0]
        push = min(left[end], tier(root)[1], *(flows[q][a] for q, a, _ in hops))
        give(root, s, push)
        for q, a, b in hops:
            give(q, b, push)
            give(q, a, -push)
        used[root] += push
        left[end] -= push
        if tier(root)[1]:
            heapq.heappush(heap, (tier(root)[0], root))
    return flows


def mix(docs: DataFrame, members: F.Column, *, id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """How often each document is taken so that sources meet their target weights.

    members: array<string> of the sources that hold the document.  Weights go to
    the sources by code point, repeating, null last.  Returns a row per document:
    id, members, size, copies (0 to ``repeats``), taken = copies * size, targets
    and source_sizes (arrays along members), ``by_source`` (copies per member), and ``row_col`` of docs, if given.

    Positions along the seeded order come from 4096 hash buckets per pattern and
    a window inside each bucket over distinct documents, so a hot source is spread
    over thousands of groups; only sums per pattern reach the driver.
    """
    spark = docs.sparkSession
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    carried = [row_col] if row_col else []
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    base = docs.select(
        F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), F.array_sort(F.array_distinct(members)).alias("members"),
        F.md5(F.concat(F.lit(f"{seed}:"), ident, F.lit(":"), text).cast("binary")).alias("ord"), *carried,
    ).withColumn("pattern", F.to_json("members", {"ignoreNullFields": "false"})).withColumn("bucket", F.substring("ord", 1, 3)).withColumn("at_row", F.monotonically_increasing_id())
    base = stage(base.withColumn("key", F.concat("ord", F.lpad(F.pmod(F.xxhash64("at_row"), F.lit(SLICES)).cast("string"), 4, "0"))).drop("ord"), "mix-base")
    sums = base.groupBy("pattern", "members").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; group the sources first")
    sizes: dict = defaultdict(int)
    for r in sums:
        for s in r.members:
            sizes[s] += r.words
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ranked)}
    targets = share_targets(sizes, weight, repeats)
    flows = route([(tuple(r.members), r.words) for r in sums], {s: math.floor(t + 0.5) for s, t in targets.items()}, repeats)
    plan_rows = []
    for r, f in zip(sums, flows, strict=True):
        ends, at = [], 0
        for s in r.members:
            at += f.get(s, 0)
            ends.append(at)
        plan_rows.append((r.pattern, r.words, at, min(repeats, at // r.words) if r.words else repeats, ends, [targets[s] for s in r.members], [sizes[s] for s in r.members]))
    plan = spark.createDataFrame(plan_rows, "pattern string, words long, flow long, level int, ends array<long>, targets array<double>, source_sizes array<long>")

    # Slices of like documents in order; each document of a pattern is taken ``level`` times, the first ones once more.
    def started(df: DataFrame, n: str) -> DataFrame:
        """df with ``start``: words of all slices before, from ``n`` documents a slice."""
        length = F.col(n) * F.col("size")
        offsets = df.groupBy("pattern", "bucket").agg(F.sum(length).alias("in_bucket")).withColumn(
            "before", F.coalesce(F.sum("in_bucket").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inside = F.coalesce(F.sum(length).over(Window.partitionBy("pattern", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return df.withColumn("inside", inside).join(offsets.select("pattern", "bucket", "before"), ["pattern", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")

    slices = started(base.groupBy("pattern", "bucket", "key").agg(F.first("size").alias("size"), F.count("*").alias("n")), "n").join(plan.select("pattern", "words", "flow", "level"), "pattern")
    full = F.col("level") == repeats
    slices = slices.withColumn("held", F.when(full, F.lit(0).cast("long")).otherwise(_fitting(F.col("start"), F.col("size"), F.col("flow") - F.col("level") * F.col("words"), F.col("n"))))
    slices = stage(slices.withColumn("open", F.when(full, F.lit(0).cast("long")).otherwise(F.col("n") - F.col("held"))).drop("words", "flow"), "mix-slices")

    # Whole documents leave a rest below the flow.  Open documents that fit it are taken in order, a few times over ...
    got = {r.pattern: r.got for r in slices.groupBy("pattern").agg(F.sum((F.col("level") * F.col("n") + F.col("held")) * F.col("size")).alias("got")).collect()}
    level = {p: lev for p, _, _, lev, *_ in plan_rows}
    rest = {p: f - got.get(p, 0) for p, _, f, *_ in plan_rows}
    fills: dict = {p: [] for p in rest}

    def openings() -> DataFrame:
        """Slices with documents at their pattern's level that no fill takes, with the rest."""
        now = spark.createDataFrame([(p, rest[p], fills[p]) for p in rest if rest[p] > 0 and level[p] < repeats], f"pattern string, rest long, {FILLS}")
        return slices.filter("open > 0").join(now, "pattern").withColumn("left", F.col("open") - _filled()).filter(F.col("left") > 0)

    for _ in range(ROUNDS):
        fit = started(openings().filter(F.col("size") <= F.col("rest")), "left").withColumn("take", _fitting(F.col("start"), F.col("size"), F.col("rest"), F.col("left")))
        taken = fit.filter("take > 0").groupBy("pattern").agg(F.max(F.struct("key", "take")).alias("cut"), F.sum(F.col("take") * F.col("size")).alias("got")).collect()
        for r in taken:
            fills[r.pattern].append((rest[r.pattern], r.cut.key, r.cut["take"]))
            rest[r.pattern] -= r.got
        if not taken:
            break
    # ... and the one that then comes nearest fills what is left.
    gap = F.abs(F.col("size") - F.col("rest"))
    picks = {r.pattern: r.pick.key for r in openings().filter(gap < F.col("rest")).groupBy("pattern").agg(F.min(F.struct(gap.alias("gap"), "key")).alias("pick")).collect()}
    last = spark.createDataFrame([(p, fills[p], picks.get(p)) for p in rest], f"pattern string, {FILLS}, pick string")
    slices = slices.join(last, "pattern").withColumn("more", F.col("held") + _filled() + F.coalesce(F.col("key") == F.col("pick"), F.lit(False)).cast("long"))

    nth = F.row_number().over(Window.partitionBy("pattern", "bucket", "key").orderBy("at_row"))
    placed = base.withColumn("nth", nth).join(slices.select("pattern", "bucket", "key", "start", "level", "more"), ["pattern", "bucket", "key"]).join(plan.drop("level"), "pattern")
    placed = placed.withColumn("at", F.col("start") + (F.col("nth") - 1) * F.col("size")).withColumn("copies", F.col("level") + (F.col("nth") <= F.col("more")).cast("int"))
    # The tape of a pattern is cut at its sources' ends; a reading goes to the source that holds its middle.
    middle = lambda k: F.least(k.cast("long") * F.col("words") + F.col("at") + F.floor(F.col("size") / 2), F.col("flow") - 1)
    owner = lambda k: F.size(F.filter("ends", lambda e: e <= middle(k)))
    owners = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), owner)).otherwise(F.array().cast("array<int>"))
    by_source = F.transform("members", lambda s, i: F.size(F.filter("owners", lambda o: o == i)))
    return placed.withColumn("owners", owners).select(
        F.col("id").alias(id_col), "members", "size", "source_sizes", "targets", "copies", (F.col("copies") * F.col("size")).alias("taken"), by_source.alias("by_source"), *carried)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the mix of all documents by their source."""
    mixed = mix(table(spark, sf_dir, "documents"), F.array("source"))
    return mixed.select("doc_id", "size", F.element_at("source_sizes", 1).alias("source_size"), F.element_at("targets", 1).alias("target"), "taken", F.element_at("members", 1).alias("source"), F.col("copies").cast("long").alias("copies"))


ORACLE = r"""
WITH b AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS words,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w
  FROM b GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY words * 6 / w, w, source) AS i,
         sum(words) OVER () - coalesce(sum(3 * words) OVER (ORDER BY words * 6 / w, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY words * 6 / w, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w
  FROM s),
cut AS (SELECT min_by(rest, i) AS rest, min_by(rest_w, i) AS rest_w, min(i) AS i FROM r WHERE rest * w <= 3 * words * rest_w),
t AS (
  SELECT source, words::BIGINT AS words,
         CASE WHEN r.i < cut.i THEN (3 * words)::DOUBLE ELSE (cut.rest * w)::DOUBLE / cut.rest_w::DOUBLE END AS target
  FROM r, cut),
f AS (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * words) AS flow FROM t),
p AS (
  SELECT b.*, h || lpad((row_number() OVER (PARTITION BY b.source, h))::VARCHAR, 12, '0') AS ord, f.words, f.target, f.flow
  FROM b JOIN f ON b.source IS NOT DISTINCT FROM f.source),
p2 AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ord)::BIGINT AS reach, size AS unit
  FROM p),
q AS (
  SELECT *, (reach <= flow)::INT + (words + reach <= flow)::INT + (2 * words + reach <= flow)::INT AS n,
         CASE WHEN words = 0 THEN 3 ELSE least(3, flow // words) END AS level
  FROM p2),
o0 AS (SELECT source, ord, size, unit FROM q WHERE n = level AND level < 3),
rest0 AS (SELECT source, any_value(flow) - sum(n * size)::BIGINT AS rest FROM q GROUP BY source),
""" + "".join(f"""
fit{k} AS (SELECT o.*, rest, sum(size) OVER (PARTITION BY o.source ORDER BY ord) AS reach FROM o{k} o JOIN rest{k} r ON o.source IS NOT DISTINCT FROM r.source WHERE unit <= rest),
take{k} AS (SELECT source, ord, size FROM fit{k} WHERE reach <= rest),
o{k + 1} AS (SELECT o.* FROM o{k} o WHERE NOT EXISTS (SELECT 1 FROM take{k} t WHERE t.source IS NOT DISTINCT FROM o.source AND t.ord = o.ord)),
rest{k + 1} AS (SELECT r.source, rest - coalesce(got, 0) AS rest FROM rest{k} r LEFT JOIN (SELECT source, sum(size)::BIGINT AS got FROM take{k} GROUP BY source) t ON r.source IS NOT DISTINCT FROM t.source),""" for k in range(ROUNDS)) + f"""
pick AS (
  SELECT source, ord FROM (
    SELECT o.source, ord, row_number() OVER (PARTITION BY o.source ORDER BY abs(unit - rest), ord) AS k
    FROM o{ROUNDS} o JOIN rest{ROUNDS} r ON o.source IS NOT DISTINCT FROM r.source WHERE abs(unit - rest) < rest)
  WHERE k = 1),
more AS (SELECT DISTINCT source, ord FROM (""" + " UNION ALL ".join(f"SELECT source, ord FROM take{k}" for k in range(ROUNDS)) + """ UNION ALL SELECT source, ord FROM pick))
SELECT q.doc_id, q.size, q.words AS source_size, q.target, ((n + (m.ord IS NOT NULL)::INT) * q.size)::BIGINT AS taken,
       q.source, (n + (m.ord IS NOT NULL)::INT)::BIGINT AS copies
FROM q LEFT JOIN more m ON q.source IS NOT DISTINCT FROM m.source AND q.ord = m.ord
"""
