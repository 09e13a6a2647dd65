"""Five stages over documents: toxicity, exact dedup, SimHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents.  run() writes each stage as
Parquet to the shared folder and reads it back.

Edge cases: decisions are made by row, so rows with a null or repeated doc_id are
told apart; null texts count as empty; extra columns pass through all stages but
the last, whatever their names; empty tables give empty results; ties go to the
smaller doc_id, then to the earlier row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm import bpe, dedup, mixing, simhash, toxicity
from girder.llm.common import fresh, named, stage, table
from girder.plans.staging import settle, staged



def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), fresh("score", docs)
    graded = docs.withColumn(score, toxicity.severity(model, F.col("text")))
    return graded.filter(F.col(score)["p_toxic"] < toxicity.REJECT_AT).drop(score)


def _tagged(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written to the shared folder so that it stays (ids may be null or repeated), and its name."""
    row = fresh("row", docs)
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-tagged"), row


def _only(docs: DataFrame, kept: DataFrame, row: str) -> DataFrame:
    """The rows of tagged docs that are in ``kept``."""
    return docs.join(kept.select(row), row, "left_semi").drop(row)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    tagged, row = _tagged(docs)
    return _only(tagged, dedup.exact_groups(tagged, row_col=row).filter("kept").select(F.col("rid").alias(row)), row)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that of the smallest doc_id; texts link from 0.8 of common five-word shingles."""
    tagged, row = _tagged(docs)
    return _only(tagged, simhash.near_groups(tagged, index=simhash.texts_alike(), row_col=row).filter("kept"), row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    tagged, row = _tagged(docs)
    n = fresh("copies", tagged)
    mixed = mixing.mix(tagged, F.array("source"), row_col=row).filter("copies > 0").select(row, F.col("copies").alias(n))
    return tagged.join(mixed, row).withColumn(row, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*(named(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of each row."""
    return bpe.encode_docs(docs, bpe.vocabulary(), keep=False)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("simhash_near_dedup", drop_near), ("mix_sources", mix_sources), ("bpe", encode)]

#: The severity model and the fingerprints are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), staged()
    for name, step in STAGES:
        docs = settle(step(spark, docs, sf_dir), f"pipeline-{name}", since)
    return docs
