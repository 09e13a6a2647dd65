"""Tables written to the folder that all executors share, to cut lineage between the rounds of a loop."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder in the warehouse where that is unset.

    Executors of a cluster do not see the driver's folders: a warehouse that nobody set is refused there.
    """
    conf = spark.sparkContext.getConf()
    if own := conf.get("spark.checkpoint.dir"):
        return own
    if not spark.sparkContext.master.startswith("local") and not conf.contains("spark.sql.warehouse.dir"):
        raise ValueError("set spark.checkpoint.dir (or spark.sql.warehouse.dir) to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back; the files outlive executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str, since: int) -> DataFrame:
    """Stage ``df``; what was staged after ``since`` (see ``staged``) only led to it and goes."""
    out = stage(df, name)
    spent = _staged[since:-1]
    del _staged[since:-1]
    _delete(spent)
    return out


def staged() -> int:
    """How many tables are staged now."""
    return len(_staged)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            return


def clear() -> None:
    _delete(_staged[::-1])
    _staged.clear()


atexit.register(clear)
