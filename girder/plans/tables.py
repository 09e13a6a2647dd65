"""Tables, their visibility guards and key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tenant_rows(df: DataFrame, tenant: str | None) -> DataFrame:
    """rows of one tenant; an empty tenant sees nothing."""
    return df.filter(F.col("tenant_id") == F.lit(tenant)) if tenant else df.filter(F.lit(False))


def scope_visible(scope: str, project: str | None, status: Column) -> Column:
    """global sees global; tenant sees global and tenant; project adds its own project's rows.

    A row whose document is missing stays visible, one whose document is not active is hidden.
    """
    seen = {"global": ["global"], "tenant": ["global", "tenant"], "project": ["global", "tenant"]}[scope]
    visible = F.col("scope").isin(*seen)
    if scope == "project":
        visible = visible | ((F.col("scope") == "project") & (F.col("project_id") == F.lit(project)))
    return visible & (status.isNull() | (status == "active"))


def project_strict(project: str | None) -> Column:
    """no project means project_id is null, never any."""
    return F.col("project_id").eqNullSafe(F.lit(project).cast("string"))


def project_lenient(project: str | None) -> Column:
    """rows without a project are always visible."""
    return F.col("project_id").isNull() | (F.col("project_id") == F.lit(project).cast("string"))


def metadata_matches(props: Column, filters: dict[str, object]) -> Column:
    """every key of ``filters`` equal in the JSON object; a missing key is null; types must agree."""
    parsed = F.try_parse_json(props)
    out = F.lit(True)
    for key, want in filters.items():
        path = f"$.{key}"
        if want is None:
            out = out & F.try_variant_get(parsed, path, "string").isNull()
        else:
            kind = "boolean" if isinstance(want, bool) else "bigint" if isinstance(want, int) else "double" if isinstance(want, float) else "string"
            typed = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
            same_kind = typed == "STRING" if kind == "string" else typed == "BOOLEAN" if kind == "boolean" else ~typed.isin("STRING", "BOOLEAN")
            out = out & F.coalesce(same_kind & (F.try_variant_get(parsed, path, kind) == F.lit(want)), F.lit(False))
    return out


def json_or(value: Column, schema: str, default: Column) -> Column:
    """Null or invalid JSON gives the default."""
    return F.coalesce(F.when(F.try_parse_json(value).isNotNull(), F.from_json(value, schema)), default)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: Spark does not enforce uniqueness, so it is checked."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unknown_references(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """rows whose reference is not among the known keys."""
    return df.join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def fit_for_broadcast(df: DataFrame, max_bytes: int = 8 << 20) -> DataFrame:
    """Hint a broadcast only if the optimiser's own size bound for ``df`` is below the limit; else leave the join to Spark."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer partitions than there are: for costly work on small files; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


MOST = 20_000


def dealt(df: DataFrame, *keys: str, share: int = 2 << 20) -> DataFrame:
    """``df`` hashed by ``keys`` over a number of partitions that grows with the optimiser's size of it, at least one a core.

    For groups that hardly repeat: before they are dealt, a partial aggregate would hold every row of a file's split.
    A size beyond ``MOST`` partitions is no estimate (rows that came from no file, or a product of sizes): Spark chooses.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    number = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // share))
    return df.repartition(number, *keys) if number <= MOST else df.repartition(*keys)
