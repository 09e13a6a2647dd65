"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are word and word-prefix counts that speak for or against toxicity beyond
chance, counted by different words before them so that copies of a document do not
add up.  Labels say toxic or not; toxic documents are graded 1 to 3 by terciles of
how often telling words occur in them, words that the other half of the labelled
documents told.  One weight vector serves all thresholds:
P(grade > k) = sigmoid(w.x - theta_k), theta rising; the expected severity is the
sum over k.

Edge cases: null or blank text has no feature and the severity of the intercept;
labels that are null or name no document are left out; of documents that share a
labelled id one is learned from; without toxic labels all documents have severity
0; tied and repeated rows are scored alike; empty tables give empty results; extra
columns pass through, but those named severity, p_toxic or toxic are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import fresh, lean, slices, stage, table, utf8

#: The model is fitted on at most so many labelled documents (those of smallest hash), with so many features.
SAMPLE = 20_000
FEATURES = 4096
GRADES = 3
#: Share of a feature's contexts that must be toxic.
PURITY = 0.9
#: From this probability of any grade above 0 a document is toxic: one telling word is enough.
REJECT_AT = 0.15
PREFIX = 5
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(data: bytes) -> list[bytes]:
    return data.translate(_CLEAN).split()


def contexts(data: bytes) -> set[tuple[bytes, bytes]]:
    """(feature, word before it) pairs of lower-case words and of the prefixes of longer ones (marked by ^)."""
    mine = words(data)
    out = set(zip(mine, [b"", *mine], strict=False))
    return out | {(b"^" + w[:PREFIX], before) for w, before in out if len(w) > PREFIX}


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mark, text -> (feature, hash of the word before, mark) of each document once."""
    for b in batches:
        for part in slices(b, 50):
            names, befores, marks = [], [], []
            for mark, data in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                mine = contexts(data)
                names.extend(f for f, _ in mine)
                befores.extend(zlib.crc32(w) for _, w in mine)
                marks.extend([mark] * len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(befores, pa.int64()), pa.array(marks, pa.int32())], ["feature", "before", "mark"])


def sparse(data: bytes, index: dict[bytes, int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for w, n in Counter(words(data)).items():
        for f in (w, b"^" + w[:PREFIX]) if len(w) > PREFIX else (w,):
            if (i := index.get(f)) is not None:
                out[i] = out.get(i, 0) + n
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, n_features: int, grades: int = GRADES, l2: float = 1e-4, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds that maximise the cumulative-link likelihood (Adam on the sparse matrix)."""
    n = len(grade)
    w, theta0, gaps = np.zeros(n_features), 1.0, np.zeros(grades - 1)  # theta_k = theta0 + sum exp(gaps)
    state = [np.zeros(n_features + grades), np.zeros(n_features + grades)]
    for t in range(1, steps + 1):
        theta = theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        z = np.bincount(rows, vals * w[cols], n)
        up = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - theta[None, :]), np.zeros((n, 1))], axis=1)  # P(grade > k - 1)
        p = np.maximum(np.take_along_axis(up, grade[:, None], 1) - np.take_along_axis(up, grade[:, None] + 1, 1), 1e-12)[:, 0]
        slope = up * (1 - up)
        lo, hi = np.take_along_axis(slope, grade[:, None], 1)[:, 0], np.take_along_axis(slope, grade[:, None] + 1, 1)[:, 0]
        g_z = -(lo - hi) / p / n
        g_theta = np.array([-(np.where(grade == k, hi, 0) - np.where(grade == k + 1, lo, 0)) @ (1 / p) / n for k in range(grades)])
        grad = np.concatenate([np.bincount(cols, vals * g_z[rows], n_features) + l2 * w, [g_theta.sum()], [g_theta[k + 1:].sum() * np.exp(gaps[k]) for k in range(grades - 1)]])
        state = [0.9 * state[0] + 0.1 * grad, 0.999 * state[1] + 0.001 * grad**2]
        move = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w, theta0, gaps = w - move[:n_features], theta0 - move[n_features], gaps - move[n_features + 1:]
    return w, theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


class Model:
    """Weights by feature and thresholds; small enough to travel with the scoring function."""

    def __init__(self, names: list[bytes], w: np.ndarray, theta: np.ndarray):
        self.index, self.w, self.theta = {f: i for i, f in enumerate(names)}, w, theta

    def above(self, data: bytes) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return sigmoid(sum(math.log1p(n) * self.w[i] for i, n in sparse(data, self.index).items()) - self.theta)


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, toxic, text of at most ``sample`` labelled documents, one of each id."""
    chosen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    both = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return both.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))


def telling(seen: DataFrame, toxic: str, clean: str, share: float, features: int) -> list[bytes]:
    """The features whose contexts are toxic (or clean) beyond chance, most telling first."""
    t, n = F.col(toxic).cast("double"), (F.col(toxic) + F.col(clean)).cast("double")
    part = lambda k, of: F.when(k > 0, k * F.log(k / (n * of))).otherwise(0.0)
    gain = part(t, share) + part(n - t, 1 - share)
    one_sided = (t >= PURITY * n) | (t <= (1 - PURITY) * share * n)
    best = seen.filter((n >= 3) & one_sided).select("feature", gain.alias("gain")).filter(F.col("gain") > math.log(max(2, seen.filter(n >= 3).count())))
    return [bytes(r.feature) for r in best.orderBy(F.desc("gain"), "feature").limit(features).collect()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fit on at most ``sample`` labelled documents; only counts of features and short sparse rows reach the driver."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    rows = stage(labelled(docs, labels, sample).select(F.col("toxic").alias("toxic"), (2 * half + F.col("toxic")).alias("mark"), "text"), "toxic-sample")
    counts = {r.mark: r["count"] for r in rows.groupBy("mark").count().collect()}
    n_toxic, n_all = counts.get(1, 0) + counts.get(3, 0), sum(counts.values())
    if not n_toxic or n_toxic == n_all:
        return Model([], np.zeros(0), np.full(GRADES, 40.0 if not n_toxic else -40.0))
    # Copies repeat a word with the word before it; a telling word comes after many different ones.
    held = [F.max((F.col("mark") == k).cast("int")).alias(f"m{k}") for k in range(4)]
    seen = rows.select("mark", "text").mapInArrow(lean(_seen), "feature binary, before long, mark int").groupBy("feature", "before").agg(*held)
    seen = stage(seen.groupBy("feature").agg(*(F.sum(f"m{k}").alias(f"m{k}") for k in range(4)), F.sum(F.greatest("m1", "m3")).alias("t"), F.sum(F.greatest("m0", "m2")).alias("c")).filter("t + c >= 3"), "toxic-features")
    share = n_toxic / n_all
    used = telling(seen, "t", "c", share, features)
    spoken = [telling(seen.filter(F.col(t) >= PURITY * (F.col(t) + F.col(c))), t, c, share, features) for t, c in (("m1", "m0"), ("m3", "m2"))]
    names = list(dict.fromkeys(used + spoken[0] + spoken[1]))
    index = {f: i for i, f in enumerate(names)}

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sparse(x, index) for part in slices(b.column(1)) for x in utf8(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[*x] for x in found], pa.list_(pa.int32())), pa.array([[*x.values()] for x in found], pa.list_(pa.int32()))], ["mark", "cols", "vals"])

    got = rows.select("mark", "text").mapInArrow(lean(matrix), "mark int, cols array<int>, vals array<int>").collect()
    mark = np.array([r.mark for r in got])
    where = np.repeat(np.arange(len(got)), [len(r.cols) for r in got])
    cols = np.array([c for r in got for c in r.cols], dtype=np.int64)
    vals = np.array([v for r in got for v in r.vals], dtype=float)
    grade = mark % 2
    for k in (0, 1):  # a half's documents are graded by the words that the other half told
        mine = np.flatnonzero(mark == 2 * k + 1)
        if len(mine):
            tells = np.isin(cols, [index[f] for f in spoken[1 - k]])
            hits = np.bincount(where[tells], vals[tells], len(got))[mine]
            grade[mine] += sum((hits > cut).astype(int) for cut in np.quantile(hits, [1 / 3, 2 / 3]))
    kept = cols < len(used)  # the model's features come first
    return Model(used, *fit_ordinal(where[kept], cols[kept], np.log1p(vals[kept]), grade, len(used)))


def severity(model: Model, text: Column) -> Column:
    """struct(severity, p_toxic) of a text."""

    @F.arrow_udf("struct<severity: double, p_toxic: double>")
    def score(texts: pa.Array) -> pa.Array:
        ps = [model.above(x) for part in slices(texts) for x in utf8(part)]
        return pa.StructArray.from_arrays([pa.array([float(p.sum()) for p in ps], pa.float64()), pa.array([float(p[0]) for p in ps], pa.float64())], ["severity", "p_toxic"])

    return score(text)


def grade_docs(docs: DataFrame, labels: DataFrame, threshold: float = REJECT_AT) -> DataFrame:
    """docs with severity (0 to 3), p_toxic and toxic."""
    model = fit(docs, labels)
    score = fresh("score", docs)
    out = docs.withColumn(score, severity(model, F.col("text")))
    return out.withColumns({"severity": F.col(score)["severity"], "p_toxic": F.col(score)["p_toxic"], "toxic": F.col(score)["p_toxic"] >= threshold}).drop(score)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: severity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade_docs(docs, table(spark, sf_dir, "labels")).select("doc_id", F.round("severity", 6).alias("severity"), F.round("p_toxic", 6).alias("p_toxic"), "toxic")
