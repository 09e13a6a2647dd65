"""Centroid clustering by weighted deduplication: Lloyd's rounds run on distinct quantised vectors with multiplicities.

Vectors become integers and equal ones are grouped, reduced before the shuffle;
each round assigns the distinct vectors and adds up weighted integer sums per
cluster, so that centroids are exact and do not depend on the order of rows;
assignments are joined back to the ids.  A vector that holds a thousandth of all
rows or more (at most a thousand of them) is joined by broadcast, so that no task
gets a hot vector's rows; the others by a shuffle.

Edge cases: vectors of another length, null ones, and those with a null or
non-finite component take no part; a null id counts as the empty string in the
seeding hash; rows of one hash are ordered by their vector; repeated rows are
vectors of their own; with fewer vectors than centroids each is a seed; an empty
table gives an empty result; extra columns are ignored.  Integers beyond 2^25 in
size are refused with an error: their squared distances may not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import lean, stage, table

DIM = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
LARGEST = 1 << 25
#: A vector with one of this many parts of all rows is hot; there can be no more hot ones than this.
HOT_PARTS = 1000


def quantised(rows: DataFrame, vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """The rows with a whole, finite vector, and ``q``, its components as integers."""
    v = F.col(vector_col)
    whole = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.coalesce(whole, F.lit(False))).withColumn("q", F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def seeding_hash(ident: Column, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    q = column.flatten().to_numpy().reshape(-1, dim)
    if q.size and np.abs(q).max() > LARGEST:
        raise ValueError(f"a quantised component is beyond {LARGEST}: squared distances may not fit a long")
    return q


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (the smaller number on ties) and its squared distance, in integers."""
    d = (q * q).sum(axis=1)[:, None] - 2 * (q @ centroids.T) + (centroids * centroids).sum(axis=1)[None, :]
    best = d.argmin(axis=1)
    return best, d[np.arange(len(q)), best]


def _sums(centroids: np.ndarray):
    """Weighted sums per cluster of a task's distinct vectors."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            q, m = _matrix(b.column(0), dim), b.column(1).to_numpy()
            best, _ = nearest(q, centroids)
            np.add.at(n, best, m)
            np.add.at(total, best, q * m[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(list(total), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, distance = nearest(_matrix(b.column(0), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best.astype(np.int32)), pa.array(distance)], ["q", "m", "cluster", "distance"])

    return run


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the exact floor of each cluster's mean; empty ones stay.  One sum per cluster and component reaches the driver."""
    parts = distinct.mapInArrow(lean(_sums(centroids)), "cluster int, n long, total array<long>")
    sums = parts.filter("n > 0").select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"], r["at"]] = r["x"] // r["n"]
    return out


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector."""
    spark = rows.sparkSession
    vectors = quantised(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v", dim, scale).select("id", "q")
    distinct = stage(vectors.groupBy("q").agg(F.count("*").alias("m")), "distinct-vectors")
    seeds = vectors.select(seeding_hash(F.col("id"), seed).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    centroids = np.array([r["q"] for r in seeds], dtype=np.int64).reshape(-1, dim)
    for _ in range(rounds if len(seeds) else 0):
        centroids = moved(distinct, centroids)
    assigned = stage(distinct.mapInArrow(lean(_assigned(centroids)), "q array<long>, m long, cluster int, distance long") if len(seeds) else distinct.select("q", "m", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "assigned-vectors")
    inertia = {r["cluster"]: (r["of"], r["n"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("m") * F.col("distance")).alias("of"), F.sum("m").alias("n")).collect()}
    total, n = sum(of for of, _ in inertia.values()), sum(n for _, n in inertia.values())
    sha = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = spark.createDataFrame([(c, of, total, sha(centroids[c])) for c, (of, _) in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    assigned = assigned.withColumn("hot", F.col("m") * HOT_PARTS >= n).drop("m")
    hot = F.broadcast(assigned.filter("hot").drop("hot"))  # at most HOT_PARTS rows
    met = vectors.join(hot, "q").unionByName(vectors.join(hot.select("q"), "q", "left_anti").join(assigned.filter("not hot").drop("hot"), "q"))
    return met.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: clusters of all whole vectors."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    assign = """a{r} AS (
  SELECT rid, arg_min(c.k, (list_sum([(q[i] - c[i]) * (q[i] - c[i]) FOR i IN range(1, 65)])::BIGINT, c.k)) AS k,
         min(list_sum([(q[i] - c[i]) * (q[i] - c[i]) FOR i IN range(1, 65)])::BIGINT) AS distance
  FROM v CROSS JOIN c{r} c GROUP BY rid),"""
    move = """s{r} AS (
  SELECT k, list(floor_mean ORDER BY i) AS c FROM (
    SELECT k, i, ((sum(q[i])::BIGINT - ((sum(q[i])::BIGINT % count(*) + count(*)) % count(*))) // count(*))::BIGINT AS floor_mean
    FROM v JOIN a{r} USING (rid) CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i) GROUP BY k),
c{n} AS (SELECT c.k, coalesce(s.c, c.c) AS c FROM c{r} c LEFT JOIN s{r} s USING (k)),"""
    rounds = "\n".join(assign.format(r=r) + "\n" + move.format(r=r, n=r + 1) for r in range(ROUNDS)) + "\n" + assign.format(r=ROUNDS)
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [floor(x::DOUBLE * 64)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1)::INT AS k, q AS c FROM v QUALIFY k < 16),
{rounds}
f AS (SELECT a.rid, a.k, a.distance, sum(a.distance) OVER (PARTITION BY a.k)::BIGINT AS of, sum(a.distance) OVER ()::BIGINT AS total FROM a{ROUNDS} a)
SELECT vec_id, f.k AS cluster, distance, of AS cluster_inertia, total AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM f JOIN v USING (rid) JOIN c{ROUNDS} c ON c.k = f.k
"""


ORACLE = _oracle()
