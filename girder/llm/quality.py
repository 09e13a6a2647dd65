"""Quality by a weak-label model and a hashed linear scorer.

Overlapping heuristics vote good, bad or abstain on each document.  The counts
of all vote patterns over the corpus (at most 3**7) go to an expectation-
maximisation that estimates the prior and each labeller's accuracy; the posterior
of a pattern is a document's soft label.  A logistic scorer on hashed shape
features learns from soft labels and then scores all documents.

Edge cases: null or blank text is bad by its length alone; ties keep a document;
repeated rows get the same score; of documents that share an id (or have none) one
is learned from; an empty table gives an empty result; extra columns pass through,
but those named weak, quality or keep are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import fresh, slices, stage, table, utf8
from girder.llm.toxicity import sigmoid

#: The scorer is fitted on at most so many documents (those of smallest hash); features are hashed to so many places.
SAMPLE = 20_000
DIMENSIONS = 1 << 14
KEEP_AT = 0.5
LABELLERS = ("symbols", "top_word", "distinct", "pipes", "runs", "sentences", "length")
#: The first so many labellers look for defects; the others describe a document's form.
DEFECTS = 5
#: At most this share of good documents sets off a labeller of defects.
FALSE_ALARMS = 0.001
_SYMBOLS = b"#%*&$^~|<>{}[]\\_=+@"
_ODD = bytes(set(range(128)) - set(_SYMBOLS)) + bytes(range(128, 256))
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")
_DIGITS = re.compile(rb"[0-9]+")


def votes(data: bytes) -> int:
    """The labellers' votes as base-3 digits: 0 bad, 1 abstain, 2 good."""
    words = data.split()
    n = len(words)
    counts = Counter(words)
    odd = len(data.translate(None, _ODD)) / max(1, len(data))
    top = max(counts.values(), default=0) / max(1, n)
    runs = sum(map(bytes.__eq__, words, words[1:])) / max(1, n)
    lines = [x.rstrip() for x in data.split(b"\n") if x.strip()]
    ended = sum(x[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines))
    pipes = counts.get(b"|", 0) / max(1, n)
    cut = lambda bad, good: 0 if bad else 2 if good else 1
    found = (
        cut(odd > 0.03, odd < 0.005), cut(n >= 20 and top > 0.25, n >= 20 and top < 0.12), cut(n >= 50 and len(counts) / n < 0.25, n >= 20 and len(counts) / n > 0.45),
        cut(pipes > 0.1, pipes == 0), cut(n >= 10 and runs > 0.2, n >= 10 and runs < 0.02), cut(ended < 0.1 and n >= 20, ended > 0.6), cut(n < 3, n >= 30))
    return sum(v * 3**i for i, v in enumerate(found))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior of good, P(vote | class, not abstaining) per labeller, and the posterior of each pattern, by EM.

    An abstention says nothing.  It starts from the defects seen, and a defect's
    labeller is held to few false alarms, so that the classes keep their meaning.
    """
    v = np.stack([patterns // 3**i % 3 for i in range(len(LABELLERS))], axis=1)
    good = sigmoid(3.0 - 4.0 * (v[:, :DEFECTS] == 0).sum(axis=1))
    said = [(v == x).astype(float) for x in (0, 2)]
    for _ in range(rounds):
        prior = np.clip((good @ counts) / counts.sum(), 0.02, 0.98)
        rate = np.ones((len(LABELLERS), 2, 2))  # labeller, class, bad or good vote: one vote of each to begin with
        for x in (0, 1):
            rate[:, 1, x] += (good * counts) @ said[x]
            rate[:, 0, x] += ((1 - good) * counts) @ said[x]
        rate /= rate.sum(axis=2, keepdims=True)
        rate[:DEFECTS, 1, 0] = np.minimum(rate[:DEFECTS, 1, 0], FALSE_ALARMS)
        rate[:, 1, 1] = 1 - rate[:, 1, 0]
        evidence = np.log(rate[:, 1, :] / rate[:, 0, :])
        good = sigmoid(said[0] @ evidence[:, 0] + said[1] @ evidence[:, 1] + np.log(prior / (1 - prior)))
    return float(prior), rate, good


def shapes(data: bytes) -> tuple[list[int], list[float]]:
    """Hashed places and values: shares of word shapes, of repeats and of the most frequent word, and tenths of the plainest measures."""
    words = data.split()
    n = max(1, len(words))
    found = Counter(_DIGITS.sub(b"9", _LETTERS.sub(b"a", data)).split())
    rows = {zlib.crc32(w) % DIMENSIONS: c / n for w, c in found.items()}
    rows[zlib.crc32(b"repeats") % DIMENSIONS] = sum(map(bytes.__eq__, words, words[1:])) / n
    rows[zlib.crc32(b"top") % DIMENSIONS] = max(Counter(words).values(), default=0) / n
    rows[zlib.crc32(b"length") % DIMENSIONS] = min(1.0, n / 50)
    odd = len(data.translate(None, _ODD)) / max(1, len(data))
    distinct = len(set(words)) / n if len(words) >= 50 else 1.0
    for name, value in ((b"odd", min(odd * 10, 1.0)), (b"distinct", distinct), (b"top", rows[zlib.crc32(b"top") % DIMENSIONS] if len(words) >= 20 else 0.0)):
        rows[zlib.crc32(name + b"%d" % (10 * value)) % DIMENSIONS] = 1.0  # tenths, so that a linear scorer can bend
    return [*rows], [*rows.values()]


def fit_linear(rows, cols, vals, soft, dims: int = DIMENSIONS, steps: int = 300, rate: float = 0.1, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    n, w, b = len(soft), np.zeros(dims), 0.0
    m, s = np.zeros(dims + 1), np.zeros(dims + 1)
    for t in range(1, steps + 1):
        err = (sigmoid(np.bincount(rows, vals * w[cols], n) + b) - soft) / n
        grad = np.append(np.bincount(cols, vals * err[rows], dims) + l2 * w, err.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def grade_quality(docs: DataFrame, keep_at: float = KEEP_AT, sample: int = SAMPLE) -> DataFrame:
    """docs with weak (posterior of the labellers' votes), quality (score) and keep."""

    @F.arrow_udf("int")
    def vote(texts: pa.Array) -> pa.Array:
        return pa.array([votes(x) for part in slices(texts) for x in utf8(part)], pa.int32())

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [(votes(x), shapes(x)) for part in slices(b.column(0)) for x in utf8(part)]
            both = [x for _, x in seen]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in seen], pa.int32()), pa.array([x for x, _ in both], pa.list_(pa.int32())), pa.array([x for _, x in both], pa.list_(pa.float64()))], ["pattern", "cols", "vals"])

    tallied = docs.select(vote("text").alias("pattern")).groupBy("pattern").count().orderBy("pattern").collect()
    if not tallied:
        return docs.withColumn("weak", F.lit(0.0)).withColumn("quality", F.lit(0.0)).withColumn("keep", F.lit(True))
    patterns = np.array([r.pattern for r in tallied])
    _, _, good = estimate(patterns, np.array([r["count"] for r in tallied], dtype=float))
    weak = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    # An id threshold by hash would cut a corpus of any size; orderBy().limit() keeps the smallest hashes in each task.
    chosen = docs.select(F.xxhash64("doc_id").alias("h"), "doc_id").groupBy("h", "doc_id").agg(F.lit(1)).orderBy("h", "doc_id").limit(sample).select(F.col("doc_id").alias("chosen"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("chosen"))).groupBy("chosen").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = stage(texts.select("text").mapInArrow(shape, "pattern int, cols array<int>, vals array<double>"), "quality-sample").collect()
    rows = np.repeat(np.arange(len(got)), [len(r.cols) for r in got])
    cols, vals = np.array([c for r in got for c in r.cols], dtype=np.int64), np.array([x for r in got for x in r.vals])
    w, b = fit_linear(rows, cols, vals, np.array([weak[r.pattern] for r in got]))
    used = np.flatnonzero(w)
    weights = dict(zip(used.tolist(), w[used].tolist(), strict=True))

    @F.arrow_udf("struct<weak: double, quality: double>")
    def score(texts: pa.Array) -> pa.Array:
        z, posterior = [], []
        for x in (x for part in slices(texts) for x in utf8(part)):
            places, values = shapes(x)
            z.append(b + sum(weights.get(p, 0.0) * v for p, v in zip(places, values, strict=True)))
            posterior.append(weak[votes(x)])
        return pa.StructArray.from_arrays([pa.array(posterior, pa.float64()), pa.array(sigmoid(np.array(z, dtype=float)), pa.float64())], ["weak", "quality"])

    name = fresh("score", docs)
    out = docs.withColumn(name, score("text"))
    return out.withColumns({"weak": F.col(name)["weak"], "quality": F.col(name)["quality"], "keep": F.col(name)["quality"] >= keep_at}).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: quality of every document."""
    return grade_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.round("weak", 6).alias("weak"), F.round("quality", 6).alias("quality"), "keep")
