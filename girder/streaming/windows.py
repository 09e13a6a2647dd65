"""Streaming forms: event-time windows with watermarks, and keyed state machines.

Each takes a streaming DataFrame with an event time; ``availableNow`` runs over
stored events give what the batch forms give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums per fixed window and key."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sliding(events: DataFrame, at: str, width: str, slide: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.window(at, width, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


class FixedWindow(StatefulProcessor):
    """Counts within windows that start at a key's first event after the last one ended."""

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", StructType([StructField("start", LongType()), StructField("count", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, count = self.state.get() if self.state.exists() else (None, 0)
        pdf = pd.concat(list(rows)).sort_values(["t", "id"])
        counts = []
        for t in pdf["t"].tolist():
            if start is None or t - start >= self.micros:
                start, count = t, 0
            count += 1
            counts.append(count)
        self.state.update((start, count))
        yield pd.DataFrame({"key": key[0], "id": pdf["id"].tolist(), "count": counts})

    def close(self) -> None:
        pass


class Breaker(StatefulProcessor):
    """The breaker's state after each call of a key; failures in a row open it, time half-opens it."""

    def __init__(self, threshold: int = 5, cooldown_seconds: float = 30.0):
        self.threshold, self.cooldown = threshold, int(cooldown_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", StructType([StructField("state", StringType()), StructField("fails", LongType()), StructField("opened", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, fails, opened = self.state.get() if self.state.exists() else ("closed", 0, 0)
        pdf = pd.concat(list(rows)).sort_values(["t", "id"])
        after = []
        for t, failed in zip(pdf["t"].tolist(), pdf["failed"].tolist(), strict=True):
            if state == "open" and t - opened >= self.cooldown:
                state = "half_open"
            if state != "open":
                if not failed:
                    state, fails = "closed", 0
                else:
                    fails += 1
                    if state == "half_open" or fails >= self.threshold:
                        state, fails, opened = "open", 0, t
            after.append(state)
        self.state.update((state, fails, opened))
        yield pd.DataFrame({"key": key[0], "id": pdf["id"].tolist(), "state": after})

    def close(self) -> None:
        pass


class Transitions(StatefulProcessor):
    """Whether each status of a run may follow the one before."""

    def __init__(self, allowed: dict[str, tuple[str, ...]], start: str = "queued"):
        self.allowed, self.start = allowed, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", StructType([StructField("status", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.state.get()[0] if self.state.exists() else None
        pdf = pd.concat(list(rows)).sort_values(["t", "id"])
        legal = []
        for s in pdf["status"].tolist():
            legal.append(s == self.start if before is None else s in self.allowed.get(before, ()))
            before = s
        self.state.update((before,))
        yield pd.DataFrame({"key": key[0], "id": pdf["id"].tolist(), "legal": legal})

    def close(self) -> None:
        pass


def keyed(events: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Run a keyed state machine over a stream with columns key, t (microseconds), id and what it reads."""
    return events.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def once_per_batch(path: str, name: str = "batch_id"):
    """A foreachBatch writer of Parquet that may be asked again for a batch, after a restart too.

    The batch's id goes with the data: each batch owns a folder ``name=id`` below
    ``path`` and writes it whole, so a replayed batch takes its own place.
    """

    def run(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}={batch_id}")

    return run
