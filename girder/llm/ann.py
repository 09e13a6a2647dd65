"""Approximate nearest neighbours: a robust-pruned directed graph per shard, beam search on each shard.

Rows are dealt to shards by a hash of id and vector.  A shard's distinct vectors are
the nodes of its graph, equal vectors share one, so many copies of a vector
neither crowd a graph nor a task.  Nodes enter in batches: a greedy search from
the medoid proposes neighbours, relaxed distance pruning keeps diverse edges, and
back edges are pruned alike.  Each query runs a beam search on every shard; what it
finds is scored in double precision on the original vectors and merged.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components and rows without an id take no part; only vectors of equal length meet; ties go to the smaller
id; repeated rows are candidates of their own and queries of their own, but no row of a query's id is among what
it finds; fewer candidates than asked for are all returned; an empty table gives an empty result; extra columns
are ignored.  Of like rows only as many as a query may return are dealt, and like queries are asked once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girder.llm.common import lean, table

DEGREE = 24
BUILD_BEAM = 40
SEARCH_BEAM = 128
RELAX = 1.2
BATCH = 256
#: A dozen shards; fewer while they would hold less than the lower, more once they would hold more than the upper number of rows.
SHARDS = 12
SHARD_ROWS = (4_000, 16_000)


class Graph:
    """Directed graph over unit vectors; squared distances are 2 - 2 cos."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 7):
        self.x, self.degree, n = x, min(degree, max(1, len(x) - 1)), len(x)
        rng = np.random.default_rng(seed)
        self.medoid = int(np.argmax(x @ x.mean(axis=0)))
        self.entries = np.unique(np.append(rng.integers(0, n, min(n, 7)), self.medoid))
        self.out = np.full((n, self.degree), -1, dtype=np.int32)
        start = min(self.degree // 2, n - 1)
        if start:
            self.out[:, :start] = (np.arange(n)[:, None] + rng.integers(1, n, (n, start))) % n
        if n > 1:
            for slack in (1.0, relax):
                for at in range(0, n, BATCH):
                    self._insert(rng.permutation(n)[:BATCH] if n <= BATCH else self._batch(rng, n, at), beam, slack)

    def _batch(self, rng, n: int, at: int) -> np.ndarray:
        if at == 0:
            self._order = rng.permutation(n)
        return self._order[at:at + BATCH]

    def search(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances) of each query's beam, nearest first; -1 where fewer were found."""
        b, deg = len(q), self.degree
        ids = np.full((b, beam), -1, dtype=np.int64)
        dist = np.full((b, beam), np.inf, dtype=np.float32)
        done = np.zeros((b, beam), dtype=bool)
        k = min(beam, len(self.entries))
        ids[:, :k] = self.entries[:k]
        dist[:, :k] = 2 - 2 * q @ self.x[self.entries[:k]].T
        rows = np.arange(b)[:, None]
        while True:
            open_ = np.where(done | (ids < 0), np.inf, dist)
            pick = np.argpartition(open_, min(width, beam - 1), axis=1)[:, :width]
            live = np.isfinite(open_[rows, pick])
            if not live.any():
                break
            nodes = np.where(live, ids[rows, pick], -1)
            done[rows, pick] |= live
            near = np.where(nodes[:, :, None] >= 0, self.out[nodes], -1).reshape(b, width * deg).astype(np.int64)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near[:, :, None] == ids[:, None, :]).any(axis=2)] = -1
            d = np.where(near >= 0, 2 - 2 * np.einsum("bkd,bd->bk", self.x[near], q), np.inf).astype(np.float32)
            all_ids, all_dist = np.concatenate([ids, near], axis=1), np.concatenate([dist, d], axis=1)
            all_done = np.concatenate([done, np.zeros_like(near, dtype=bool)], axis=1)
            best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
            ids, dist, done = all_ids[rows, best], all_dist[rows, best], all_done[rows, best]
            ids[~np.isfinite(dist)] = -1
        order = np.argsort(dist, axis=1, kind="stable")
        return ids[rows, order], dist[rows, order]

    def prune(self, own: np.ndarray, cand: np.ndarray, slack: float) -> np.ndarray:
        """Each node's nearest candidates, dropping those that a kept one is nearer to by the factor ``slack``."""
        cand = np.where(cand == own[:, None], -1, cand)
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        rows = np.arange(len(own))
        vec = self.x[cand]
        dist = np.where(cand >= 0, 2 - 2 * np.einsum("bcd,bd->bc", vec, self.x[own]), np.inf)
        alive = np.isfinite(dist)
        out = np.full((len(own), self.degree), -1, dtype=np.int32)
        for k in range(self.degree):
            now = np.where(alive, dist, np.inf)
            at = now.argmin(axis=1)
            ok = np.isfinite(now[rows, at])
            if not ok.any():
                break
            out[ok, k] = cand[rows, at][ok]
            apart = 2 - 2 * np.einsum("bcd,bd->bc", vec, vec[rows, at])
            alive &= ~(slack * slack * apart <= dist) & ok[:, None]
            alive[rows, at] = False
        return out

    def _insert(self, batch: np.ndarray, beam: int, slack: float) -> None:
        found, _ = self.search(self.x[batch], beam)
        self.out[batch] = self.prune(batch, np.concatenate([found, self.out[batch]], axis=1), slack)
        src = np.repeat(batch, self.degree)
        dst = self.out[batch].ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        heads, first, n = np.unique(dst, return_index=True, return_counts=True)
        for at in range(0, len(heads), BATCH):
            h, f, c = heads[at:at + BATCH], first[at:at + BATCH], n[at:at + BATCH]
            new = np.full((len(h), c.max()), -1, dtype=np.int64)
            inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            new[np.repeat(np.arange(len(h)), c), inner] = src[f[0]:f[-1] + c[-1]]
            self.out[h] = self.prune(h, np.concatenate([self.out[h].astype(np.int64), new], axis=1), slack)


def _least(ids: np.ndarray, k: int) -> np.ndarray:
    """Of the sorted ids of equal vectors, which score alike: k rows besides those of any one id, the smallest."""
    which, first, n = np.unique(ids, return_index=True, return_counts=True)
    return np.concatenate([ids[f:f + min(c, k)] for f, c in zip(first[:k + 1].tolist(), n[:k + 1].tolist(), strict=True)])


class Shard:
    """The vectors of a shard, its graph over distinct ones, and exact scores of what a beam finds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.x, node = np.unique(vectors, axis=0, return_inverse=True)
        by_node = np.argsort(node.ravel(), kind="stable")
        starts = np.searchsorted(node.ravel()[by_node], np.arange(len(self.x)))
        self.ids = [_least(ids[part], k) for part in np.split(by_node, starts[1:])]
        x = self.x.astype(np.float64)
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.k = k
        self.graph = Graph((x / self.norm[:, None]).astype(np.float32))

    def answer(self, ids: np.ndarray, q: np.ndarray, tags: list[int]) -> list[tuple]:
        q = q.astype(np.float64)
        norm = np.sqrt((q * q).sum(axis=1))
        found, _ = self.graph.search((q / norm[:, None]).astype(np.float32), SEARCH_BEAM)
        out = []
        for i, own in enumerate(ids.tolist()):
            nodes = found[i][found[i] >= 0]
            score = (self.x[nodes].astype(np.float64) * q[i]).sum(axis=1) / (self.norm[nodes] * norm[i])
            rows = [(-s, v) for s, node in zip(score.tolist(), nodes.tolist(), strict=True) for v in self.ids[node].tolist() if v != own]
            out += [(own, tags[i], v, -s) for s, v in sorted(rows)[:self.k]]
        return out


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, asks, id, embedding, tag) by shard, vectors before queries."""
        now, ids, vectors, built = None, [], [], None

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            q, t, v, s = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(t, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "tag", "vec_id", "score"])

        for b in batches:
            shard, asks = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(shard)]
            for s, e in zip(cuts, cuts[1:]):  # noqa: B905
                if s == e:
                    continue
                part = b.slice(s, e - s)
                own = part.column(2).to_numpy()
                lists = part.column(3)
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
                if shard[s] != now:
                    now, ids, vectors, built = shard[s], [], [], None
                if not asks[s]:
                    ids.append(own)
                    vectors.append(x)
                    continue
                if not ids:
                    continue
                if built is None:
                    built = Shard(np.concatenate(ids), np.concatenate(vectors), k)
                    vectors = []
                tags = part.column(4).to_pylist()
                for at in range(0, e - s, BATCH):
                    yield emit(built.answer(own[at:at + BATCH], x[at:at + BATCH], tags[at:at + BATCH]))

    return run


def shard_count(rows: int) -> int:
    least, most = SHARD_ROWS
    return max(1, min(SHARDS, math.ceil(rows / least)), math.ceil(rows / most))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, its own id left out."""
    finite = ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull())
    base = clean(rows.filter(finite)).groupBy("id", "v").count().withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k)).cast("int"))))
    asked = clean(queries.filter(finite)).groupBy("id", "v").agg(F.count("*").alias("n")).withColumn("tag", F.xxhash64("v"))
    shards = shard_count(base.count())
    part = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    length = F.size("v") * shards  # vectors of another length are of other shards
    kept = base.select((length + part).alias("shard"), F.lit(0).alias("asks"), "id", "v", F.lit(0).cast("long").alias("tag"))
    asks = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select((length + F.col("part")).alias("shard"), F.lit(1).alias("asks"), "id", "v", "tag")
    both = kept.unionByName(asks)
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks", "id")
    found = dealt.mapInArrow(lean(_search(k)), "query_id long, tag long, vec_id long, score double")
    best = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    times = asked.select(F.col("id").alias("query_id"), "tag", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_time"))
    return ranked.join(times, ["query_id", "tag"]).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the 5 nearest of each vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))
