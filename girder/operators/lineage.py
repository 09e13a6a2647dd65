"""The lineage of a model over four artifacts: digests of their rows in a chain, and references from each to the one before.

A table's digest adds up the words of its rows' SHA-256, so that it is reduced
before the shuffle and does not depend on the order of rows, and hashes the sums
together with their number.  An artifact's digest covers its header, the digest
it claims of the artifact before, and its rows: a changed row breaks every claim
after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.plans.staging import stage

KINDS = ("manifest", "entities", "evidence", "model")
#: The checks in the order in which they are named.
ISSUES = (
    "artifact_missing", "project_mismatch", "entities_not_of_manifest", "evidence_not_of_entities", "model_not_of_evidence",
    "duplicate_source", "unknown_source", "duplicate_entity", "duplicate_evidence", "unknown_entity", "unknown_evidence",
)


def table_digest(rows: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, digest) of the rows of each key, whatever their order."""
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns) if c != key)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    words = [F.sum(F.conv(F.substring("_row", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"_{i}") for i in range(4)]
    sums = rows.select(key, row.alias("_row")).groupBy(key).agg(F.count("*").cast("string").alias("_n"), *words)
    return sums.select(key, F.sha2(F.concat_ws(":", "_n", *(f"_{i}" for i in range(4))).cast("binary"), 256).alias("digest"))


def _digest(kind: str, rows_digest: Column) -> Column:
    parts = [F.lit(kind), *(F.coalesce(F.col(c), F.lit("")) for c in ("tenant_id", "project_id", "claims")), F.coalesce(rows_digest, F.lit(""))]
    return F.sha2(F.to_json(F.array(*parts)).cast("binary"), 256)


def digests(artifacts: DataFrame, contents: dict[str, DataFrame]) -> DataFrame:
    """(run_id, kind, digest) of artifacts (run_id, kind, tenant_id, project_id, claims)."""
    parts = [artifacts.filter(F.col("kind") == k).join(table_digest(contents[k]), "run_id", "left").select("run_id", "kind", _digest(k, F.col("digest")).alias("digest")) for k in KINDS]
    return reduce(DataFrame.unionByName, parts)


def sealed(headers: DataFrame, contents: dict[str, DataFrame]) -> DataFrame:
    """artifacts of headers (run_id, tenant_id, project_id), each claiming the digest of the one before."""
    out, before = [], None
    for k in KINDS:
        rows = headers.select("run_id", F.lit(k).alias("kind"), "tenant_id", "project_id")
        rows = rows.withColumn("claims", F.lit(None).cast("string")) if before is None else rows.join(before.withColumnRenamed("digest", "claims"), "run_id", "left")
        rows = stage(rows, "lineage-sealed")
        out.append(rows)
        before = rows.join(table_digest(contents[k]), "run_id", "left").select("run_id", _digest(k, F.col("digest")).alias("digest"))
    return reduce(DataFrame.unionByName, out)


def issues(artifacts: DataFrame, contents: dict[str, DataFrame]) -> DataFrame:
    """(run_id, issue, item) of all that is broken.

    contents: manifest (run_id, source_id, ...), entities (run_id, source_id, entity_id, locator, ...), evidence (run_id,
    evidence_id, refs: array of source_id, entity_id, locator, ...), model (run_id, wall_id, evidence_ids, ...).
    """
    found = []

    def say(issue: str, rows: DataFrame, item: Column) -> None:
        found.append(rows.select("run_id", F.lit(issue).alias("issue"), item.cast("string").alias("item")))

    runs = artifacts.groupBy("run_id").agg(F.collect_set("kind").alias("kinds"), F.count_distinct(F.struct("tenant_id", "project_id")).alias("owners"))
    missing = runs.select("run_id", F.explode(F.array_except(F.array(*map(F.lit, KINDS)), "kinds")).alias("kind"))
    say("artifact_missing", missing, F.col("kind"))
    say("project_mismatch", runs.filter("owners > 1"), F.lit(None))
    held = stage(digests(artifacts, contents), "lineage-digests")
    for before, kind, issue in zip(KINDS, KINDS[1:], ISSUES[2:5], strict=False):
        of = held.filter(F.col("kind") == before).select("run_id", "digest")
        claimed = artifacts.filter(F.col("kind") == kind).join(of, "run_id")
        say(issue, claimed.filter(~F.col("claims").eqNullSafe(F.col("digest"))), F.col("claims"))
    again = lambda rows, *key: rows.groupBy("run_id", *key).count().filter("count > 1")
    whole = ("source_id", "entity_id", "locator")
    say("duplicate_source", again(contents["manifest"], "source_id"), F.col("source_id"))
    say("unknown_source", contents["entities"].join(contents["manifest"].select("run_id", "source_id").distinct(), ["run_id", "source_id"], "left_anti"), F.col("entity_id"))
    say("duplicate_entity", again(contents["entities"], *whole), F.col("entity_id"))
    say("duplicate_evidence", again(contents["evidence"], "evidence_id"), F.col("evidence_id"))
    refs = contents["evidence"].select("run_id", "evidence_id", F.explode("refs").alias("r")).select("run_id", "evidence_id", *(F.col(f"r.{c}").alias(c) for c in whole))
    say("unknown_entity", refs.join(contents["entities"].select("run_id", *whole).distinct(), ["run_id", *whole], "left_anti"), F.col("evidence_id"))
    asked = contents["model"].select("run_id", "wall_id", F.explode("evidence_ids").alias("evidence_id"))
    say("unknown_evidence", asked.join(contents["evidence"].select("run_id", "evidence_id").distinct(), ["run_id", "evidence_id"], "left_anti"), F.col("wall_id"))
    return reduce(DataFrame.unionByName, found)


def verdicts(artifacts: DataFrame, contents: dict[str, DataFrame]) -> DataFrame:
    """(run_id, status, first_issue, item, n): the first broken link of each run, and how many there are."""
    rank = F.array_position(F.array(*map(F.lit, ISSUES)), F.col("issue"))
    broken = issues(artifacts, contents).groupBy("run_id").agg(F.min(F.struct(rank.alias("rank"), F.coalesce("item", F.lit("")).alias("item"), "issue")).alias("first"), F.count("*").alias("n"))
    out = artifacts.select("run_id").distinct().join(broken, "run_id", "left")
    return out.select("run_id", F.when(F.col("first").isNull(), "verified").otherwise("broken").alias("status"), F.col("first.issue").alias("first_issue"), F.nullif(F.col("first.item"), F.lit("")).alias("item"), F.coalesce("n", F.lit(0)).alias("n"))
