"""Event logs in batch form: sequences, cursors, leases, state machines, windows, conversations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions import domain as D
from girder.functions import text as T

# Which task status may follow which.
TRANSITIONS = {
    "queued": ("running", "canceled", "failed"),
    "running": ("waiting_human", "succeeded", "failed", "canceled"),
    "waiting_human": ("resumed", "canceled"),
    "resumed": ("running", "succeeded", "failed", "canceled"),
    "succeeded": (), "failed": (), "canceled": (),
}


def next_sequence(new: DataFrame, stored: DataFrame | None, key: str, order: list[str], seq: str = "seq") -> DataFrame:
    """COALESCE(MAX(seq), 0) + 1 and up per key, in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if stored is None:
        return new.withColumn(seq, n)
    top = stored.groupBy(key).agg(F.max(seq).alias("_top"))
    return new.join(top, key, "left").withColumn(seq, F.coalesce("_top", F.lit(0)) + n).drop("_top")


def events_after(events: DataFrame, cursor: Column, key: str = "run_id", seq: str = "seq") -> DataFrame:
    """Rows beyond the cursor, ascending."""
    return events.filter(F.col(seq) > cursor).orderBy(key, seq)


def latest_page(rows: DataFrame, key: str, seq: str, n: int, after: Column | None = None) -> DataFrame:
    """The newest n per key beyond the cursor (1 to 100), given ascending as ``place``."""
    n = max(1, min(n, 100))
    rows = rows.filter(F.col(seq) > after) if after is not None else rows
    newest = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).filter(F.col("_n") <= n)
    return newest.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(seq))).drop("_n")


def check_transitions(rows: DataFrame, key: str, order: list[str], status: str = "status", allowed: dict[str, tuple[str, ...]] = TRANSITIONS, start: str = "queued") -> DataFrame:
    """Each row with the status before it and whether the step is allowed; the first must be the start."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    table = F.create_map(*(x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    ok = F.when(F.col("previous").isNull(), F.col(status) == start).otherwise(F.coalesce(F.array_contains(F.try_element_at(table, F.col("previous")), F.col(status)), F.lit(False)))
    return rows.withColumn("previous", before).withColumn("legal", ok)


def claim_outbox(rows: DataFrame, now: Column, limit: int = 10, lease_seconds: int = 60) -> DataFrame:
    """Due pending rows and those whose lease is over, oldest first, with attempts and version one up."""
    expired = now - F.make_interval(secs=F.lit(max(10, lease_seconds)))
    due = ((F.col("status") == "pending") & (F.col("available_at") <= now)) | ((F.col("status") == "processing") & (F.col("published_at") < expired))
    taken = rows.filter(due).orderBy("created_at", "id").limit(max(1, min(limit, 100)))
    return taken.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "version": F.col("version") + 1, "published_at": now})


def settle_outbox(rows: DataFrame, acks: DataFrame, now: Column) -> DataFrame:
    """Acks (id, claim_version, claim_attempts, ok, error, delay_seconds): only with a matching token.

    A good one publishes; a bad one goes back after its delay, or is dead at the fifth attempt.
    """
    a = acks.select("id", "claim_version", "claim_attempts", "ok", "error", "delay_seconds")
    joined = rows.join(a, "id", "left")
    token = F.when(F.col("claim_version").isNotNull(), F.col("claim_version") == F.col("version")).when(F.col("claim_attempts").isNotNull(), F.col("claim_attempts") == F.col("attempts")).otherwise(False)
    mine = F.coalesce((F.col("status") == "processing") & token, F.lit(False))
    status = F.when(mine & F.col("ok"), "published").when(mine & (F.col("attempts") >= 5), "dead").when(mine, "pending").otherwise(F.col("status"))
    available = F.when(mine & ~F.col("ok"), now + F.make_interval(secs=F.greatest(F.lit(1), F.coalesce("delay_seconds", F.lit(5))))).otherwise(F.col("available_at"))
    new = {
        "status": status, "available_at": available, "version": F.when(mine, F.col("version") + 1).otherwise(F.col("version")),
        "last_error": F.when(mine & F.col("ok"), None).when(mine, F.substring("error", 1, 1000)).otherwise(F.col("last_error")), "published_at": F.when(mine & F.col("ok"), now).otherwise(F.col("published_at")),
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])  # at once: each reads the old values


def last_attempts(steps: DataFrame, key: str = "run_id", position: str = "position", order: str = "ord") -> DataFrame:
    """The last row per (run, position)."""
    packed = F.max_by(F.struct(*steps.columns), F.col(order))
    return steps.groupBy(F.col(key).alias("_k"), F.col(position).alias("_p")).agg(packed.alias("_r")).select("_r.*")


def resume_position(steps: DataFrame, resuming: Column, key: str = "run_id") -> DataFrame:
    """One more than the last waiting position when resuming, else 1."""
    return steps.groupBy(key).agg((F.coalesce(F.max(F.when(resuming & (F.col("status") == "waiting_human"), F.col("position"))), F.lit(0)) + 1).alias("position"))


def steps_to_run(plan: DataFrame, log: DataFrame, start: DataFrame, key: str = "run_id") -> DataFrame:
    """Planned positions from the resume position on that have not succeeded."""
    done = log.filter(F.col("status") == "succeeded").select(key, "position").distinct()
    return plan.join(start.select(key, F.col("position").alias("_from")), key).filter(F.col("position") >= F.col("_from")).join(done, [key, "position"], "left_anti").drop("_from")


def changes(rows: DataFrame, key: str, order: list[str], value: str, when: str, ttl_days: int = 30) -> DataFrame:
    """First, changed or unchanged against the hash before, which is forgotten after its time to live."""
    w = Window.partitionBy(key).orderBy(*order)
    before, at = F.lag(value).over(w), F.lag(when).over(w)
    gone = before.isNull() | (F.timestamp_diff("SECOND", at, F.col(when)) > ttl_days * 86400)
    return rows.withColumn("change", F.when(gone, "first").when(before == F.col(value), "unchanged").otherwise("changed"))


def live_values(reads: DataFrame, writes: DataFrame, key: str, ttl_seconds: int, at: str = "ts") -> DataFrame:
    """The value each read finds: that of the last write before it, unless now > its expiry.

    As-of join by union and a running last value, one sort per key.
    """
    rows = writes.select(key, at, F.lit(0).alias("_kind"), F.struct("value", F.col(at).alias("t")).alias("_w"), F.lit(None).cast("long").alias("read_id")).unionByName(reads.select(key, at, F.lit(1).alias("_kind"), F.lit(None).cast("struct<value:string,t:timestamp_ntz>").alias("_w"), "read_id"))
    last = F.last("_w", ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "_kind", "read_id").rowsBetween(Window.unboundedPreceding, 0))
    seen = rows.withColumn("_w", last).filter("_kind = 1")
    alive = F.timestamp_diff("MICROSECOND", F.col("_w.t"), F.col(at)) <= ttl_seconds * 1_000_000
    return seen.select(key, at, "read_id", F.when(alive, F.col("_w.value")).alias("value"))


def fixed_window_counts(rows: DataFrame, key: str, at: str, order: str, window_seconds: int) -> DataFrame:
    """Count within the key's current window, which starts at the first event after the last one ended.

    Windows follow from the events before, so each key is folded in order; the
    fold streams over sorted partitions and holds one key's state at a time.
    """
    wanted = rows.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), F.col(order).alias("_o"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, count = None, 0, 0
        for pdf in batches:
            counts, starts = [], []
            for k, t in zip(pdf[key], pdf["_t"], strict=True):
                if k != now or t - start >= window_seconds * 1_000_000:
                    now, start, count = k, t, 0
                count += 1
                counts.append(count)
                starts.append(start)
            yield pd.DataFrame({key: pdf[key], order: pdf["_o"], "count": counts, "window_start_us": starts})

    types = dict(wanted.dtypes)
    dealt = wanted.repartition(key).sortWithinPartitions(key, "_t", "_o")
    return dealt.mapInPandas(fold, f"{key} {types[key]}, {order} {types['_o']}, count long, window_start_us long")


def breaker_trace(rows: DataFrame, key: str, at: str, order: str, failed: Column, threshold: int = 5, cooldown_seconds: float = 30.0) -> DataFrame:
    """The breaker's state before each call and after it; a call while open is not made."""
    wanted = rows.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), F.col(order).alias("_o"), failed.alias("_failed"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, fails, opened = None, "closed", 0, 0
        for pdf in batches:
            before, after = [], []
            for k, t, bad in zip(pdf[key], pdf["_t"], pdf["_failed"], strict=True):
                if k != now:
                    now, state, fails, opened = k, "closed", 0, 0
                if state == "open" and t - opened >= cooldown_seconds * 1e6:
                    state = "half_open"
                before.append(state)
                if state != "open":
                    if not bad:
                        state, fails = "closed", 0
                    else:
                        fails += 1
                        if state == "half_open" or fails >= threshold:
                            state, fails, opened = "open", 0, t
                after.append(state)
            yield pd.DataFrame({key: pdf[key], order: pdf["_o"], "before": before, "after": after})

    types = dict(wanted.dtypes)
    dealt = wanted.repartition(key).sortWithinPartitions(key, "_t", "_o")
    return dealt.mapInPandas(fold, f"{key} {types[key]}, {order} {types['_o']}, before string, after string")


def stage_machine(rows: DataFrame, stages: list[str], key: str = "conv_id", order: str = "turn", ready: str = "ready") -> DataFrame:
    """A stage lasts two rounds at least and until a decision; the last always ends after two.

    The stage is a fold over a conversation's rounds, which are few; it runs as an array aggregate.
    """
    last = len(stages) - 1
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ready).alias("ready")))).alias("rounds"))

    def step(acc: Column, r: Column) -> Column:
        n = acc["n"] + 1
        move = (n >= 2) & (acc["stage"] <= last) & (r["ready"] | (acc["stage"] == last))
        stage = F.when(move, acc["stage"] + 1).otherwise(acc["stage"])
        return F.struct(stage.alias("stage"), F.when(move, 0).otherwise(n).alias("n"), F.concat(acc["out"], F.array(stage)).alias("out"))

    start = F.struct(F.lit(0).alias("stage"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    names = F.array(*map(F.lit, [*stages, "done"]))
    out = packed.select(key, F.explode(F.arrays_zip(F.transform("rounds", lambda r: r["o"]).alias("o"), F.aggregate("rounds", start, step, lambda acc: acc["out"]).alias("stage"))).alias("x"))
    return out.select(key, F.col("x.o").alias(order), F.get(names, F.col("x.stage")).alias("stage"))


def last_turns(rows: DataFrame, n: int = 10, key: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """System messages first, then the last 2n others, in order; ``place`` from 1."""
    system = F.col(role) == "system"
    back = F.row_number().over(Window.partitionBy(key, system).orderBy(F.desc(order)))
    kept = rows.withColumn("_back", back).filter(system | (F.col("_back") <= 2 * n)).drop("_back")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.when(system, 0).otherwise(1), order)))


def summary_due(rows: DataFrame, threshold: int = 10, key: str = "conv_id", role: str = "role") -> DataFrame:
    """Rounds of dialogue and whether a summary is due: at every multiple of the threshold."""
    out = rows.groupBy(key).agg(F.floor(F.count(F.when(F.col(role).isin("user", "assistant"), 1)) / 2).cast("long").alias("rounds"))
    return out.withColumn("due", (F.col("rounds") >= threshold) & (F.col("rounds") % threshold == 0))


def rolling_digest(turns: DataFrame, key: str = "conv_id", seq: str = "seq", question: str = "user_text", answer: str = "answer") -> DataFrame:
    """For each turn the digest of the 20 turns that end ten before it, cut to 100, 180 and 6000 characters."""
    line = F.concat(F.lit("用户："), F.substring(question, 1, 100), F.lit("；历史回复（未复核）："), F.substring(answer, 1, 180))
    frame = Window.partitionBy(key).orderBy(seq).rowsBetween(-29, -10)
    return turns.withColumn("_line", line).withColumn("digest", F.substring(F.array_join(F.collect_list("_line").over(frame), "\n"), 1, 6000)).drop("_line")


def follow_ups(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """P23 over a log: each question with the one before it where it refers back."""
    previous = F.lag(text).over(Window.partitionBy(key).orderBy(order))
    return turns.withColumn("contextual", T.follow_up(F.col(text), previous))


def clause_runs(rows: DataFrame, key: list[str], text: str = "text", terms=None, route_of=None) -> DataFrame:
    """Clauses with their intents; runs of neighbours of one intent and route are joined.

    More than 20 clauses is an error, reported as ``too_many``.
    """
    split = rows.select(*key, T.clauses(F.coalesce(F.col(text), F.lit(""))).alias("_c")).withColumn("too_many", F.size("_c") > 20)
    each = split.filter(~F.col("too_many")).select(*key, F.posexplode("_c").alias("pos", "clause"))
    each = each.withColumn("intent", (D.best_intent(F.col("clause"), terms) if terms else D.best_intent(F.col("clause")))["intent"])
    each = each.withColumn("route", route_of(F.col("intent")) if route_of else F.col("intent"))
    w = Window.partitionBy(*key).orderBy("pos")
    starts = F.when(F.lag("intent").over(w).eqNullSafe(F.col("intent")) & F.lag("route").over(w).eqNullSafe(F.col("route")), 0).otherwise(1)
    runs = each.withColumn("_s", starts).withColumn("run", F.sum("_s").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "clause"))), lambda x: x["clause"]), "；")
    return runs.groupBy(*key, "run", "intent", "route").agg(F.count("*").alias("n_clauses"), joined.alias("query"))


def composite_children(plans: DataFrame, steps: str = "steps", key: str = "idempotency_key") -> DataFrame:
    """A child run per step of a plan, with an idempotent key of its own."""
    out = plans.select("*", F.posexplode(steps).alias("_pos", "step")).drop(steps)
    return out.withColumn("position", F.col("_pos") + 1).withColumn("child_key", F.concat_ws(":", F.col(key), F.lit("step"), (F.col("_pos") + 1).cast("string"))).drop("_pos")
