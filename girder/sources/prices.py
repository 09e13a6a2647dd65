"""Price feeds: tables in web pages and delimited quotes, as column expressions over fetched text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.text import strip

# Fixed value: a row of the price table.
ROW = r'<td class="t3">([^<]+)</td>\s*<td class="t2">([^<]+)</td>\s*<td class="t3">\s*([\d.\s\-～~—]+)\s*</td>\s*<td class="t2">\s*([\d-]+)\s*</td>'


def page_prices(pages: DataFrame, html: str, channel_material: Column, unit: Column, source: str) -> DataFrame:
    """A row per table row: lowest and highest number of the price cell; spec is blank where it repeats the material."""
    parts = [F.regexp_extract_all(F.col(html), F.lit(ROW), F.lit(g)) for g in (1, 2, 3, 4)]
    rows = pages.withColumn("_u", unit).withColumn("_m", channel_material).select("*", F.posexplode(F.arrays_zip(*[p.alias(f"p{i}") for i, p in enumerate(parts)])).alias("ord", "r"))
    numbers = F.transform(F.regexp_extract_all(F.col("r.p2"), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    rows = rows.withColumn("_n", numbers).filter(F.size("_n") > 0)
    name = strip(F.col("r.p0"))
    return rows.select(*[c for c in pages.columns if c != html], "ord", F.col("_m").alias("material"), F.when(name != F.col("_m"), name).otherwise("").alias("spec"), strip(F.col("r.p1")).alias("market"), F.array_min("_n").alias("price_low"), F.array_max("_n").alias("price_high"), F.col("_u").alias("unit"), strip(F.col("r.p3")).alias("price_date"), F.lit(source).alias("source"))


def quotes(feeds: DataFrame, text: str, as_of: str, suffix: str = "连续") -> DataFrame:
    """Quotes split at ";" and ","; fewer than 18 fields or an empty payload go; field 8 is the price, else field 2."""
    lines = feeds.select(*[c for c in feeds.columns if c != text], F.posexplode(F.split(F.col(text), ";")).alias("ord", "line")).withColumn("line", strip(F.col("line")))
    lines = lines.filter(F.startswith("line", F.lit("var hq_str_nf_")) & ~F.contains("line", F.lit('=""')))
    fields = F.split(F.regexp_extract("line", r'="(.*)"', 1), ",")
    rows = lines.withColumn("f", fields).filter(F.size("f") >= 18)
    at = lambda i: F.get("f", F.lit(i))
    latest = F.coalesce(at(8).try_cast("double"), F.lit(0.0))
    price = F.when(latest > 0, latest).otherwise(F.coalesce(at(2).try_cast("double"), F.lit(0.0)))
    bare = lambda c: strip(F.replace(c, F.lit(suffix), F.lit("")))
    return rows.select(*[c for c in lines.columns if c != "line"], F.coalesce(F.nullif(bare(at(16)), F.lit("")), bare(at(0))).alias("material"), price.alias("price_low"), price.alias("price_high"), F.when(at(17).rlike(r"^\d{4}-\d{2}-\d{2}$"), at(17)).otherwise(as_of).alias("price_date"))


def links(pages: DataFrame, html: str, key: str) -> DataFrame:
    """Hyperlinks of a page in order: (key, pos, href, label)."""
    pattern = r'<a href="([^"]*)">([^<]*)</a>'
    both = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(2)).alias("label"))
    return pages.select(key, F.posexplode(both).alias("pos", "l")).select(key, "pos", "l.href", "l.label")
