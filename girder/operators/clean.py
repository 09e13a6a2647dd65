"""Price rows: cleaning, latest rows, lookups, and merges into stored tables.

Input order is an explicit ordinal column ("ord"); first-wins rules go by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions import domain as D
from girder.plans.staging import stage
from girder.plans.tables import fit_for_broadcast

PRICE_KEY = ("material", "spec", "market", "source", "price_date")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given total order.

    min_by is a partial aggregate, so a hot key is reduced before the shuffle.
    """
    columns = df.columns
    packed = F.min_by(F.struct(*columns), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(packed.alias("_r")).select("_r.*")


def clean_prices(rows: DataFrame, as_of: str) -> DataFrame:
    """W20 with P11-P14: alias, unit, date, cast, validate, then the first row per five-column key."""
    # Each distinct name is normalised once and joined back.  Written, so that its size is known: rows of few names would meet in as few tasks.
    names = stage(rows.select(F.col("material").alias("_raw")).distinct().withColumn("_standard", D.material(F.col("_raw"))), "price-names")
    out = rows.join(fit_for_broadcast(names), F.col("material").eqNullSafe(F.col("_raw")), "left").withColumn("material", F.col("_standard")).drop("_raw", "_standard")
    out = out.withColumn("unit", D.unit(F.col("unit"))).withColumn("price_date", D.full_date(F.col("price_date"), as_of))
    out = out.withColumn("price_low", F.col("price_low").try_cast("double")).withColumn("price_high", F.col("price_high").try_cast("double"))
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in ("spec", "market", "source")}
    return keep_first(out.withColumns(blank).filter(D.plausible_price(F.col("material"), F.col("price_low"), F.col("price_high"))), list(PRICE_KEY), [F.col("ord")])


def latest(rows: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """The newest row per key; ``newest`` is a total order, newest first when descending."""
    columns = rows.columns
    packed = F.max_by(F.struct(*columns), F.struct(*(n.alias(f"o{i}") for i, n in enumerate(newest))))
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(packed.alias("_r")).select("_r.*")


def prices_like(rows: DataFrame, material_hint: str = "", market_hint: str = "") -> DataFrame:
    """material contains the hint; market is LIKE the hint as it stands; newest first."""
    out = rows.filter(F.contains("material", F.lit(material_hint))) if material_hint else rows
    out = out.filter(F.col("market").like(market_hint)) if market_hint else out
    return out.orderBy(F.desc("updated_at"), F.desc("price_date"))


def lookup_price(items: DataFrame, prices: DataFrame, item_key: str = "item_id", name: str = "material_name") -> DataFrame:
    """For each item the newest price whose material contains its name; mid price, null if not positive.

    Distinct names, not items, meet the distinct materials, and only those that
    hold the name's first two characters (or its one): an equi join, like the rest.
    """
    names = items.select(F.col(name).alias("name")).filter(F.col("name") != "").distinct()
    newest = latest(prices, ["material"], [F.col("updated_at"), F.col("price_date"), F.col("ord")])
    starts = F.sequence(F.lit(1), F.greatest(F.length("material"), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(F.substr(F.col("material"), i, F.lit(1)), F.substr(F.col("material"), i, F.lit(2))))))
    found = names.withColumn("_gram", F.substring("name", 1, 2)).join(newest.withColumn("_gram", F.explode(grams)), "_gram").filter(F.contains("material", "name")).drop("_gram")
    best = latest(found, ["name"], [F.col("updated_at"), F.col("price_date"), F.col("ord")])
    mid = F.when((F.col("price_low") > 0) & (F.col("price_high") > 0), F.round((F.col("price_low") + F.col("price_high")) / 2, 2))
    return items.join(best.select(F.col("name").alias(name), mid.alias("market_price"), F.col("unit").alias("market_unit"), "material"), name, "left")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], mutable: list[str], order: list[Column] | None = None) -> DataFrame:
    """On a key conflict the mutable columns change and the others (id, created_at) survive.

    Of several new rows per key the last in ``order`` counts.
    """
    if order:
        new = latest(new, keys, order)
    o = old.withColumn("_old", F.lit(True)).alias("o")
    n = new.withColumn("_new", F.lit(True)).alias("n")
    on = None
    for k in keys:
        test = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = test if on is None else on & test

    def pick(c: str) -> Column:
        kept = F.col(f"n.{c}") if c in mutable else F.col(f"o.{c}")
        return F.when(F.col("_new") & F.col("_old"), kept).when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return o.join(n, on, "full").select(*map(pick, old.columns))


def upsert_counted(old: DataFrame, new: DataFrame, key: str, summary: str = "summary", version: str = "version") -> DataFrame:
    """Summary becomes the new one unless null; the version goes up by one on a conflict, and starts at 1."""
    n = new.select(F.col(key), F.col(summary).alias("_summary")).withColumn("_new", F.lit(True))
    joined = old.join(n, key, "full")
    return joined.select(key, F.coalesce("_summary", summary).alias(summary), F.when(F.col("_new") & F.col(version).isNotNull(), F.col(version) + 1).otherwise(F.coalesce(F.col(version), F.lit(1))).alias(version))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not stored yet, one per key."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def earliest_same(rows: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The earliest stored row with the same (null-safe) key as each new row."""
    first = keep_first(rows, keys, order)
    on = None
    for k in keys:
        test = new[k].eqNullSafe(first[k])
        on = test if on is None else on & test
    return new.join(first, on, "left").select(*[new[c] for c in new.columns], *[first[c].alias(f"stored_{c}") for c in first.columns if c not in keys])


def update_keeping(old: DataFrame, changes: DataFrame, key: str, columns: list[str], status: str = "status", terminal: tuple[str, ...] = ("succeeded", "failed", "canceled"), now: Column | None = None) -> DataFrame:
    """COALESCE(new, old) per column; finished_at is set only by a terminal state."""
    n = changes.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    out = old.join(n, key, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns})
    if now is not None:
        out = out.withColumn("finished_at", F.when(F.col(f"_{status}").isin(*terminal), now).otherwise(F.col("finished_at")))
    return out.drop(*[f"_{c}" for c in columns])


def merge_by_confidence(old: DataFrame, new: DataFrame, key: str = "element_id", confidence: str = "confidence", order: str = "ord") -> DataFrame:
    """The new row wins if its confidence is at least the old one's; whatever meets or comes in is 'merged'.

    Several new rows of a key act in turn; the last of those that are not beaten
    by an earlier one wins: that is the one of the highest confidence, the later on ties.
    Blank ids go.
    """
    present = lambda df: df.filter(F.coalesce(F.col(key), F.lit("")) != "")
    olds = latest(present(old), [key], [F.col(order)])
    news = latest(present(new), [key], [F.coalesce(F.col(confidence), F.lit(0.0)), F.col(order)])
    columns = [c for c in olds.columns if c != key]
    n = news.select(key, F.struct(*columns).alias("n"))
    o = olds.select(key, F.struct(*columns).alias("o"))
    both = o.join(n, key, "full")
    wins = F.col("o").isNull() | (F.coalesce(F.col(f"n.{confidence}"), F.lit(0.0)) >= F.coalesce(F.col(f"o.{confidence}"), F.lit(0.0)))
    row = F.when(F.col("n").isNotNull() & wins, F.col("n")).otherwise(F.col("o"))
    return both.select(key, row.alias("r"), F.col("n").isNotNull().alias("met")).select(key, *[F.when(F.col("met"), "merged").otherwise(F.col("r.source")).alias(c) if c == "source" else F.col(f"r.{c}").alias(c) for c in columns])


def snapshot(old: DataFrame, new_rows: DataFrame, stale: bool) -> DataFrame:
    """The cleaned rows replace the stored ones when stale; without any cleaned row the old snapshot stays."""
    return new_rows if stale and not new_rows.isEmpty() else old


def is_stale(rows: DataFrame, as_of: Column, hours: int = 24, column: str = "updated_at") -> DataFrame:
    """One row (stale): no row or the newest at least so many hours old."""
    newest = F.max(column)
    return rows.agg(F.coalesce(F.timestamp_diff("SECOND", newest, as_of) >= hours * 3600, F.lit(True)).alias("stale"))


def register_levels(levels: DataFrame, new: DataFrame, project: str = "project_id", code: str = "floor_code", elevation: str = "elevation") -> DataFrame:
    """New levels with a status: existing, created, or which rule they break."""
    same_code = levels.select(project, code, F.col(elevation).alias("_old_elevation"))
    same_elev = levels.select(project, elevation, F.col(code).alias("_old_code"))
    out = new.join(same_code, [project, code], "left").join(same_elev, [project, elevation], "left")
    status = F.when(F.col("_old_elevation") == F.col(elevation), "existing").when(F.col("_old_elevation").isNotNull(), "code_has_other_elevation").when(F.col("_old_code").isNotNull(), "elevation_has_other_code").otherwise("created")
    return out.withColumn("status", status).drop("_old_elevation", "_old_code")


def save_versioned(df: DataFrame, root: str, version: str) -> str:
    """Publish a whole version: write it to its own folder under Spark's commit protocol; readers follow the newest committed."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def newest_version(spark, root: str) -> str | None:
    """The newest version that was committed (has _SUCCESS)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    done = [s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(done, default=None)
