import pytest
from pyspark.sql import functions as F

from girder.operators import log
from girder.streaming import windows
from tests.conftest import DATA

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def stream(spark):
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark.readStream.schema(schema).parquet(f"{DATA}/event[s].parquet")
    spark.conf.unset(STORE)


def run(frame, name, mode, tmp_path):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_tumbling_equals_batch(spark, stream, tmp_path):
    events = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(windows.tumbling(events(stream), "ts", "1 day", ["event_type"], "1 hour"), "tumbling", "complete", tmp_path)
    want = windows.tumbling(events(spark.read.parquet(f"{DATA}/events.parquet")), "ts", "1 day", ["event_type"])
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(got) == key(want)


def test_fixed_window_equals_batch(spark, stream, tmp_path):
    keyed = stream.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"))
    got = run(windows.keyed(keyed, "key", windows.FixedWindow(86400), "key long, id long, count long"), "fixed", "append", tmp_path)
    want = log.fixed_window_counts(spark.read.parquet(f"{DATA}/events.parquet"), "user_id", "ts", "event_id", 86400)
    assert {(r.key, r.id): r["count"] for r in got.collect()} == {(r.user_id, r.event_id): r["count"] for r in want.collect()}


def test_breaker_equals_batch(spark, stream, tmp_path):
    bad = F.col("event_type").isin("error", "view")
    keyed = stream.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"), bad.alias("failed"))
    got = run(windows.keyed(keyed, "key", windows.Breaker(3, 7200), "key long, id long, state string"), "breaker", "append", tmp_path)
    want = log.breaker_trace(spark.read.parquet(f"{DATA}/events.parquet"), "user_id", "ts", "event_id", bad, 3, 7200)
    assert {(r.key, r.id): r.state for r in got.collect()} == {(r.user_id, r.event_id): r.after for r in want.collect()}


def test_batches_survive_a_restart(spark, stream, tmp_path):
    """A stream that lost its last commit writes the batch again; the rows are there once."""
    out, marks = tmp_path / "out", tmp_path / "marks"

    def go():
        q = stream.select("event_id").writeStream.foreachBatch(windows.once_per_batch(str(out))).option("checkpointLocation", str(marks)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.event_id for r in spark.read.parquet(str(out)).collect())

    first = go()
    assert first == sorted(r.event_id for r in spark.read.parquet(f"{DATA}/events.parquet").collect())
    (marks / "commits" / "0").unlink()
    (marks / "commits" / ".0.crc").unlink(missing_ok=True)
    assert go() == first and [p.name for p in out.iterdir() if p.is_dir()] == ["batch_id=0"]
