"""Aggregates: call statistics, modes, medians, fits, percentiles, histograms, gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions import geometry as G
from girder.functions import text as T
from girder.plans.staging import stage
from girder.plans.tables import fit_for_broadcast


def call_stats(calls: DataFrame, as_of: Column, hours: int, at: str = "start_ts") -> DataFrame:
    """Count, sums and cost of the calls of the last hours; sums of nothing are 0."""
    recent = calls.filter(F.col(at) > as_of - F.make_interval(hours=F.lit(hours)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return recent.agg(F.count("*").alias("calls"), total("input_chars"), total("output_chars"), total("duration_ms"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"))


def mode_first(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value per group, first seen on ties."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), (-F.col("first")).alias("neg"))).alias("mode"), F.max("n").alias("n"))


def axis_pitch(axes: DataFrame, keys: list[str], value: str = "v", low: float = 3000.0, high: float = 15000.0, default: float = 9000.0) -> DataFrame:
    """The mode of gaps between distinct coordinates (rounded to 0.1) within bounds; the default without any."""
    distinct = axes.select(*keys, F.round(value, 1).alias("v")).distinct()
    w = Window.partitionBy(*keys).orderBy("v")
    gaps = distinct.withColumn("gap", F.col("v") - F.lag("v").over(w)).filter((F.col("gap") > low) & (F.col("gap") < high))
    pitch = mode_first(gaps.select(*keys, F.round("gap", 0).alias("gap"), (F.col("v") * 10).cast("long").alias("at")), keys, "gap", "at")
    return axes.select(*keys).distinct().join(pitch.select(*keys, "mode"), keys, "left").select(*keys, F.coalesce("mode", F.lit(default)).alias("pitch"))


def remainder_mode(axes: DataFrame, keys: list[str], pitch: DataFrame, value: str, order: str) -> DataFrame:
    """The mode of the rounded remainders by the group's pitch."""
    rows = axes.join(pitch, keys).select(*keys, F.round(F.pmod(F.col(value), F.col("pitch")), 0).alias("rem"), order)
    return mode_first(rows, keys, "rem", order)


def size_histogram(columns: DataFrame, keys: list[str], width: str, depth: str, top: int = 3) -> DataFrame:
    """Counts of sizes rounded to 2 places, the most frequent ones per group with their place."""
    counts = columns.groupBy(*keys, F.round(width, 2).alias("w"), F.round(depth, 2).alias("d")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "w", "d")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def low_confidence_share(rows: DataFrame, keys: list[str], confidence: str = "confidence", limit: float = 0.7, most: float = 0.2) -> DataFrame:
    """Share below the limit (null and 0 count as 1) and whether it warns."""
    value = F.when(F.coalesce(F.col(confidence), F.lit(0.0)) == 0, 1.0).otherwise(F.col(confidence))
    return rows.groupBy(*keys).agg(F.avg((value < limit).cast("double")).alias("share")).withColumn("warns", F.col("share") > most)


def dominant_rotation(segments: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """Length-weighted median of folded angles, sign flipped; lengths weigh 1 to 100; short ones are skipped."""
    s = G.segment()
    n = G.length(s) * scale
    rows = segments.select(*keys, G.folded_angle(s).alias("angle"), G.clamp(F.bround(n, 0), 1, 100).cast("long").alias("w"), n.alias("n")).filter("n > 0.5")
    return rows.groupBy(*keys).agg((-F.percentile("angle", F.lit(0.5), F.col("w"))).alias("rotation"))


def line_fit(samples: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Slope and intercept; null with fewer than two samples or no spread."""
    return samples.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Minimum, p50, p95 and maximum by linear interpolation, rounded to 9 places.

    Values are counted first; a running sum over the distinct ones finds the ranks, so no group is held in memory.
    """
    said = F.col(value).isNotNull()
    counts = rows.groupBy(*keys, value).agg(F.count(value).alias("_c"))
    whole = Window.partitionBy(*keys)
    counts = counts.withColumns({"_upto": F.sum("_c").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_n": F.sum("_c").over(whole)})

    def at(rank: Column) -> Column:
        return F.max(F.when(said & (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col(value)))

    def share(p: float) -> Column:
        place = (F.col("_n") - 1) * p
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        return F.round(low + (high - low) * part, 9)

    return counts.groupBy(*keys).agg(F.max("_n").alias("n"), *(share(p).alias(name) for name, p in (("min", 0.0), ("p50", 0.5), ("p95", 0.95), ("max", 1.0))))


def label_medians(samples: DataFrame, keys: list[str]) -> DataFrame:
    """First local value and median page value per label."""
    return samples.groupBy(*keys).agg(F.min_by("local", "ord").alias("local"), F.percentile("page", F.lit(0.5)).alias("page"))


def bounds(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Extent of both ends."""
    return segments.groupBy(*keys).agg(F.min(F.least("x1", "x2")).alias("xmin"), F.min(F.least("y1", "y2")).alias("ymin"), F.max(F.greatest("x1", "x2")).alias("xmax"), F.max(F.greatest("y1", "y2")).alias("ymax"))


LENGTH_BINS = (0.5, 1.0, 3.0, 6.0)


def length_bin(length: Column, cuts: tuple[float, ...] = LENGTH_BINS) -> Column:
    """0 below the first cut, and so on up to the number of cuts."""
    out = F.lit(0)
    for c in cuts:
        out = out + (length >= c).cast("int")
    return out


def recall_by_bin(rows: DataFrame, keys: list[str], length: str = "length", covered: str = "covered") -> DataFrame:
    """Counts, lengths and covered shares per group and length bin."""
    return rows.groupBy(*keys, length_bin(F.col(length)).alias("bin")).agg(F.count("*").alias("n"), F.sum(length).alias("length"), F.sum(F.least(covered, length)).alias("covered"), F.count(F.when(F.col(covered) >= 0.5 * F.col(length), 1)).alias("half_covered"))


def thickness_counts(rows: DataFrame, keys: list[str], value: str = "thickness") -> DataFrame:
    """Labels of the value rounded to 1 place, or unknown; by count, then label."""
    label = F.when(F.col(value).isNull(), "unknown").otherwise(T.general_number(F.round(value, 1)))
    out = rows.groupBy(*keys, label.alias("label")).agg(F.count("*").alias("n"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "label")))


def paired_totals(rows: DataFrame, keys: list[str], paired: str = "paired", length: str = "length") -> DataFrame:
    """Counts and lengths, paired and not."""
    yes = F.coalesce(F.col(paired), F.lit(False))
    return rows.groupBy(*keys).agg(F.count(F.when(yes, 1)).alias("paired_n"), F.count(F.when(~yes, 1)).alias("unpaired_n"), F.coalesce(F.sum(F.when(yes, F.col(length))), F.lit(0.0)).alias("paired_length"), F.coalesce(F.sum(F.when(~yes, F.col(length))), F.lit(0.0)).alias("unpaired_length"))


def delta(old: DataFrame, new: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Measures of two versions and their differences; an absent side counts 0."""
    o = old.select(*keys, *[F.col(m).alias(f"old_{m}") for m in measures])
    n = new.select(*keys, *[F.col(m).alias(f"new_{m}") for m in measures])
    out = o.join(n, keys, "full").na.fill(0)
    return out.withColumns({f"delta_{m}": F.col(f"new_{m}") - F.col(f"old_{m}") for m in measures})


#: Profiles in a block, drawings in a slice, and rows of a batch that goes out.
PROFILES, DRAWINGS, BATCH = 8192, 4096, 1 << 16


def _profile_blocks(current: DataFrame, profiles: DataFrame, sets: tuple[str, ...]) -> DataFrame:
    """Both sides in one table, by tenant, slice of its drawings and block of its profiles: a tenant of any size is many groups, the profiles of a group first."""
    count = lambda df, name: df.filter("tenant_id IS NOT NULL").groupBy("tenant_id").agg(F.count("*").alias(name))
    sizes = fit_for_broadcast(stage(count(current, "_n").join(count(profiles, "_m"), "tenant_id"), "profile-sizes"))
    part = lambda key, n, size: F.pmod(F.xxhash64(key), F.ceil(F.col(n) / size))
    each = lambda n, size: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / size) - 1))
    types = dict(profiles.dtypes) | dict(current.dtypes)
    own = lambda side: [F.array_distinct(F.coalesce(s, F.array().cast(types[s]))).alias(s) for s in sets]
    none = lambda *names: [F.lit(None).cast(types[n]).alias(n) for n in names]
    c = current.join(sizes, "tenant_id").select("tenant_id", part("drawing_id", "_n", DRAWINGS).alias("_slice"), each("_m", PROFILES).alias("_block"), F.lit(1).alias("_side"), "drawing_id", *none("profile_id", "ord"), "signature", *own(1))
    p = profiles.join(sizes, "tenant_id").select("tenant_id", each("_n", DRAWINGS).alias("_slice"), part("profile_id", "_m", PROFILES).alias("_block"), F.lit(0).alias("_side"), *none("drawing_id"), "profile_id", "ord", "signature", *own(0))
    group = ["tenant_id", "_slice", "_block"]
    return p.unionByName(c).repartition(*group).sortWithinPartitions(*group, "_side")


class _Profiles:
    """The profiles of a group: for each set the places of those that hold a member."""

    def __init__(self, sets: tuple[str, ...]) -> None:
        self.sets, self.ids, self.ords, self.signatures = sets, [], [], {}
        self.sizes, self.held = [[] for _ in sets], [{} for _ in sets]

    def add(self, row: dict) -> None:
        at = len(self.ids)
        self.ids.append(row["profile_id"])
        self.ords.append(row["ord"])
        self.signatures.setdefault(row["signature"], []).append(at)
        for s, sizes, held in zip(self.sets, self.sizes, self.held, strict=True):
            sizes.append(len(row[s]))
            for member in row[s]:
                held.setdefault(member, []).append(at)

    def close(self, kinds: list[pa.DataType]) -> None:
        self.columns = [pa.array(v, type=k) for v, k in zip((self.ids, self.ords), kinds, strict=True)]
        self.sizes = [np.array(n, dtype=np.int64) for n in self.sizes]
        self.held = [{k: np.array(v, dtype=np.int32) for k, v in h.items()} for h in self.held]

    def scores(self, row: dict, signed: bool) -> np.ndarray:
        """A21 of a drawing with each profile; with ``signed`` equal signatures score 1."""
        total, parts = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for s, sizes, held in zip(self.sets, self.sizes, self.held, strict=True):
            places = [held[m] for m in row[s] if m in held]
            shared = np.bincount(np.concatenate(places), minlength=len(self.ids)) if places else np.zeros(len(self.ids), dtype=np.int64)
            union = sizes + len(row[s]) - shared
            total += np.divide(shared, union, out=np.zeros(len(self.ids)), where=union > 0)
            parts += union > 0
        out = np.divide(total, parts, out=np.zeros(len(self.ids)), where=parts > 0)
        if signed and row["signature"] is not None:
            out[self.signatures.get(row["signature"], [])] = 1.0
        return out


def _profile_pairs(current: DataFrame, profiles: DataFrame, sets: tuple[str, ...], best: bool) -> DataFrame:
    """(drawing_id, profile_id, ord, score) of all pairs of a tenant, or of the best of each drawing in each block."""
    types = dict(profiles.dtypes) | dict(current.dtypes)
    schema = f"drawing_id {types['drawing_id']}, profile_id {types['profile_id']}, ord {types['ord']}, score double"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, opened = None, None, False
        kinds, out, n = None, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(column) for column in zip(*out, strict=True)], names=["drawing_id", "profile_id", "ord", "score"])

        for batch in batches:
            kinds = kinds or [batch.schema.field(c).type for c in ("drawing_id", "profile_id", "ord")]
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    now = row["tenant_id"], row["_slice"], row["_block"]
                    if now != group:
                        group, held, opened = now, _Profiles(sets), False
                    if row["_side"] == 0:
                        held.add(row)
                        continue
                    if not opened:
                        held.close(kinds[1:])
                        opened = True
                    if not held.ids:
                        continue
                    scores = held.scores(row, best)
                    if best:
                        top = scores.max()
                        if not top > 0:
                            continue
                        at = int(min(np.flatnonzero(scores == top), key=lambda i: (held.ords[i] is None, held.ords[i] or 0)))
                        columns, scores = [c.slice(at, 1) for c in held.columns], scores[at:at + 1]
                    else:
                        columns = held.columns
                    out.append((pa.repeat(pa.scalar(row["drawing_id"], type=kinds[0]), len(scores)), *columns, pa.array(scores)))
                    n += len(scores)
                    if n >= BATCH:
                        yield flush()
                        out, n = [], 0
        if out:
            yield flush()

    return _profile_blocks(current, profiles, sets).mapInArrow(meet, schema)


def profile_scores(current: DataFrame, profiles: DataFrame, sets: tuple[str, ...]) -> DataFrame:
    """(drawing_id, profile_id, score) of each drawing with each profile of its tenant."""
    return _profile_pairs(current, profiles, sets, best=False).select("drawing_id", "profile_id", "score")


def best_profile(current: DataFrame, profiles: DataFrame, threshold: float = 0.65, sets: tuple[str, ...] = ("layers", "blocks", "active_layers", "type_names")) -> DataFrame:
    """Per drawing the best saved profile: equal signatures score 1; strictly greater wins; a minimum score.

    Each drawing meets each of its tenant's profiles, in slices and blocks; only the best of a block goes on.
    """
    scored = _profile_pairs(current, profiles, sets, best=True)
    best = scored.groupBy("drawing_id").agg(F.max_by(F.struct("profile_id", "score"), F.struct(F.col("score"), (-F.col("ord")).alias("o"))).alias("b"))
    return best.select("drawing_id", "b.profile_id", F.round("b.score", 4).alias("score")).filter(F.col("score") >= threshold)


def fingerprint(entities: DataFrame, key: str = "drawing_id", top: int = 20) -> DataFrame:
    """Layer and block sets, digit bands of entity counts, the most used layers, and a hash of it all."""
    rows = entities.select(key, T.layer_token(F.coalesce("layer", F.lit(""))).alias("layer"), T.layer_token(F.coalesce("block", F.lit(""))).alias("block"), "entity_type", "ord")
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(F.nullif("layer", F.lit("")))).alias("layers"), F.array_sort(F.collect_set(F.nullif("block", F.lit("")))).alias("blocks"))
    bands = rows.groupBy(key, "entity_type").agg(F.count("*").alias("n")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("entity_type", T.count_band(F.col("n")).alias("band")))).alias("bands"))
    used = rows.filter("layer <> ''").groupBy(key, "layer").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    ranked = used.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))).filter(F.col("place") <= top)
    active = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "layer"))), lambda x: x["layer"]).alias("active_layers"))
    out = sets.join(bands, key).join(active, key, "left")
    body = F.to_json(F.struct("active_layers", "blocks", F.col("bands").alias("entity_type_bands"), "layers"))
    return out.withColumn("type_names", F.transform("bands", lambda b: b["entity_type"])).withColumn("signature", F.substring(F.sha2(body.cast("binary"), 256), 1, 32))


def geometry_gate(stats: DataFrame) -> DataFrame:
    """Rows with attach_rate, n_x, n_y, extracted, inserted: fail, warn or pass."""
    fail = (F.col("n_x") < 3) | (F.col("n_y") < 3)
    warn = (F.col("attach_rate") < 0.70) | ((F.col("inserted") > 0) & (F.col("extracted") / F.greatest(F.col("inserted"), F.lit(1)) < 0.5))
    return stats.withColumn("verdict", F.when(F.coalesce(fail, F.lit(False)), "fail").when(F.coalesce(warn, F.lit(False)), "warn").otherwise("pass"))


def structure_gate(stats: DataFrame, older: bool = False) -> DataFrame:
    """Attach share at least 0.7; floating share below 0.3 (the older form lets it equal 0.3)."""
    floating = (F.col("floating_rate") <= 0.30) if older else (F.col("floating_rate") < 0.30)
    return stats.withColumn("gate", F.when((F.col("attach_rate") >= 0.70) & floating, "PASS").otherwise("FAIL"))


def risk_report(steps: DataFrame, key: str = "model_id") -> DataFrame:
    """Counts of step statuses, mean quality and the model's status."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s.lower()}")
    out = steps.groupBy(key).agg(n("PASS"), n("WARN"), n("FAIL"), F.avg("quality").alias("quality"), F.sum("risks").alias("risks"))
    return out.withColumn("status", F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_warn") > 0, "WARN").otherwise("PASS"))


def counters(rows: DataFrame, keys: list[str], value: str | None = None, buckets: tuple[int, ...] = (0, 1, 2, 4, 8, 16, 32)) -> DataFrame:
    """Counts per label set, and how many values are at most each bucket."""
    extra = [F.count(F.when(F.col(value) <= b, 1)).alias(f"le_{b}") for b in buckets] if value else []
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *extra)


def evidence_rollup(rows: DataFrame, keys: list[str], reason: Column) -> DataFrame:
    """Per layer and unordered ends (rounded to 4 places): first attributes, distinct evidence ids, any support, a hash id and a status."""
    a, b = F.struct(F.round("x1", 4).alias("x"), F.round("y1", 4).alias("y")), F.struct(F.round("x2", 4).alias("x"), F.round("y2", 4).alias("y"))
    out = rows.withColumn("ends", F.array_sort(F.array(a, b))).groupBy(*keys, "ends").agg(F.min_by(F.struct("kind", "ord"), "ord").alias("first"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.bool_or("supported").alias("supported"))
    out = out.withColumn("candidate_id", F.substring(F.sha2(F.to_json(F.struct(*keys, "ends")).cast("binary"), 256), 1, 16)).withColumn("reason", reason)
    return out.withColumn("status", F.when(F.col("reason").isNotNull(), "rejected").when(F.col("supported"), "supported").otherwise("review"))
