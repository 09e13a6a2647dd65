"""Exact dedup by composable polynomial fingerprints.

A chunk's fingerprint is its bytes read as a polynomial modulo four primes below
2**31; H(xy) = H(x) * B**len(y) + H(y), so chunks are hashed apart and combined
by length-shifted arithmetic.  Chunks of huge documents are dealt to all tasks.
Texts with equal fingerprints are then compared chunk by chunk, in two rounds
over salted groups, so that a group of any size is spread and streamed.

Edge cases: null text counts as empty; a null id sorts last; of repeated rows
exactly one stays; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import lean, slices, squeeze, stage, table, utf8

PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], dtype=np.int64)
BASES = np.array([911382323, 972663749, 357571093, 1291677323], dtype=np.int64)
#: Bytes of a chunk, and bytes from which a document's chunks are dealt to other tasks.
CHUNK = 1 << 14
HUGE = 1 << 16
FP = "array<long>"


def _powers(n: int) -> np.ndarray:
    out = np.ones((4, n), dtype=np.int64)
    for k in range(1, n):
        out[:, k] = out[:, k - 1] * BASES % PRIMES
    return np.ascontiguousarray(out[:, ::-1]).astype(np.float64)


_POW: list[np.ndarray] = []


def hash_chunk(data: bytes) -> np.ndarray:
    """Fingerprint of at most CHUNK bytes; each byte counts one more than its value, so that lengths tell.

    Sums stay below 2**31 * 2**8 * 2**14 = 2**53, so doubles hold them exactly.
    """
    if not _POW:
        _POW.append(_powers(CHUNK))
    x = np.frombuffer(data, dtype=np.uint8).astype(np.float64) + 1
    return (_POW[0][:, CHUNK - len(data):] @ x).astype(np.int64) % PRIMES


def shift(n: int) -> np.ndarray:
    """B**n for each prime."""
    return np.array([pow(int(b), n, int(p)) for b, p in zip(BASES, PRIMES, strict=True)], dtype=np.int64)


_SHIFT_CHUNK = shift(CHUNK)


def combine(left: np.ndarray, right: np.ndarray, right_shift: np.ndarray) -> np.ndarray:
    return (left * right_shift + right) % PRIMES


def chunks_of(data: bytes) -> Iterator[bytes]:
    for at in range(0, len(data), CHUNK):
        yield data[at:at + CHUNK]


def fingerprint(data: bytes) -> np.ndarray:
    out = np.zeros(4, dtype=np.int64)
    for part in chunks_of(data):
        out = combine(out, hash_chunk(part), _SHIFT_CHUNK if len(part) == CHUNK else shift(len(part)))
    return out


def _light(fingerprint_of):
    """rid, id, text -> rid, id, n_bytes, sha, fp or, of huge documents, their chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 200)):
            n, sha, fp, parts = [], [], [], []
            for raw in utf8(b.column(2)):
                data = squeeze(raw)
                n.append(len(data))
                sha.append(hashlib.sha256(data).hexdigest())
                huge = len(data) > HUGE
                fp.append(None if huge else fingerprint_of(data).tolist())
                parts.append([{"k": k, "data": x} for k, x in enumerate(chunks_of(data))] if huge else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(fp, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.struct([("k", pa.int64()), ("data", pa.binary())])))], ["rid", "id", "n_bytes", "sha", "fp", "parts"])

    return run


def _hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = b.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hash_chunk(x).tolist() for x in data], pa.list_(pa.int64())), pa.array([shift(len(x)).tolist() for x in data], pa.list_(pa.int64()))], ["rid", "k", "h", "s"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint_of=fingerprint, row_col: str | None = None) -> DataFrame:
    """rid, id, n_bytes, sha, fp of each row, staged; rid (``row_col`` of docs, if given) tells rows apart from then on."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    light = stage(rows.mapInArrow(lean(_light(fingerprint_of)), f"rid long, id {id_type}, n_bytes long, sha string, fp {FP}, parts array<struct<k: long, data: binary>>"), "dedup-light")
    parts = light.filter(F.col("fp").isNull()).select("rid", F.explode("parts").alias("p")).select("rid", "p.k", "p.data").repartition("rid", "k")
    hashed = parts.mapInArrow(_hash_parts, f"rid long, k long, h {FP}, s {FP}").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("k", "h", "s"))).alias("hs"))
    fold = lambda i: F.aggregate("hs", F.lit(0).cast("long"), lambda acc, x: (acc * x["s"][i] + x["h"][i]) % int(PRIMES[i]))
    folded = F.array(*map(fold, range(4)))
    huge = hashed.select("rid", folded.alias("whole"))
    return light.drop("parts").join(huge, "rid", "left").select("rid", "id", "n_bytes", "sha", F.coalesce("fp", "whole").alias("fp"))


def _keep_marked(bits, fingerprint_of):
    """Rows whose fingerprint is marked in the filter of repeated fingerprints, with their squeezed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_bits = bits.value
        m = len(table_bits) * 64
        for b in (part for whole in batches for part in slices(whole, 200)):
            rows = [[], [], [], [], []]
            for ident, raw in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                data = squeeze(raw)
                fp = fingerprint_of(data)
                at = int(fp[0]) % m
                if int(table_bits[at >> 6]) >> (at & 63) & 1:
                    for col, v in zip(rows, (ident, fp.tolist(), len(data), hashlib.sha256(data).hexdigest(), data), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.column(0).type), pa.array(rows[1], pa.list_(pa.int64())), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.large_binary())], ["id", "fp", "n_bytes", "sha", "data"])

    return run


def same_stream(a: bytes, b: bytes) -> bool:
    """Chunkwise comparison that stops at the first chunk that differs."""
    return len(a) == len(b) and all(a[i:i + CHUNK] == b[i:i + CHUNK] for i in range(0, len(a), CHUNK))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, via, sha, data): each is compared with its group's leaders; new texts lead."""
    group, leaders = None, []
    for b in (part for whole in batches for part in slices(whole, 200)):
        out = [[], [], [], []]
        for key, sha, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if key != group:
                group, leaders = key, []
            cls = next((i for i, x in enumerate(leaders) if same_stream(x, data)), None)
            if new := cls is None:
                cls = len(leaders)
                leaders.append(data)
            if new:
                for col, v in zip(out, (key, sha, cls, data), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.large_binary())], ["key", "sha", "cls", "data"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint_of=fingerprint, row_col: str | None = None) -> DataFrame:
    """A row per row of docs: id, keep_id, group_size, kept, text_sha256, n_bytes, rid (``row_col`` of docs, if given).

    What crosses the network with its text is only rows that share a fingerprint
    with another; a bit filter of at most 16 MB finds them in a second scan.
    """
    spark = docs.sparkSession
    light = stage(fingerprints(docs, id_col, text_col, fingerprint_of, row_col).withColumn("key", F.concat_ws(":", F.transform("fp", lambda x: x.cast("string")), F.col("n_bytes").cast("string"))), "dedup-fp")
    groups = light.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("fp")).filter("n > 1")
    size = groups.agg(F.count("*").alias("groups"), F.max("n").alias("most")).first()
    classes = None
    if size.groups:
        words = 1 << min(21, max(10, math.ceil(math.log2(size.groups))))  # 64 bits a group, until 16 MB
        bit = F.element_at("fp", 1) % (words * 64)
        marks = groups.groupBy(F.floor(bit / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(element_at(fp, 1) % 64 as int))")).alias("bits")).toArrow()
        bits = np.zeros(words, dtype=np.int64)
        bits[marks.column("w").to_numpy()] = marks.column("bits").to_numpy()
        id_type = docs.schema[id_col].dataType.simpleString()
        marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(_keep_marked(spark.sparkContext.broadcast(bits.view(np.uint64)), fingerprint_of)), f"id {id_type}, fp {FP}, n_bytes long, sha string, data binary")
        key = F.concat_ws(":", F.transform("fp", lambda x: x.cast("string")), F.col("n_bytes").cast("string"))
        salts = max(1, math.isqrt(size.most))
        first = marked.select(F.concat_ws("#", key, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))).alias("key"), "sha", "data")
        first = first.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_classes), "key string, sha string, cls int, data binary")
        second = first.select(F.substring_index("key", "#", 1).alias("key"), "sha", "data")
        second = second.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_classes), "key string, sha string, cls int, data binary")
        classes = stage(second.select("key", "sha", "cls").filter("cls > 0"), "dedup-classes")  # a leader per text; more than one only where fingerprints collide
    if classes is not None:
        light = light.join(classes, ["key", "sha"], "left").withColumn("cls", F.coalesce("cls", F.lit(0)))
    else:
        light = light.withColumn("cls", F.lit(0))
    first_row = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("first")
    # Written apart, so that the join has a shuffle on either side and a hot group's rows can be split.
    sizes = stage(light.groupBy("key", "cls").agg(first_row, F.count("*").alias("group_size")).filter("group_size > 1"), "dedup-sizes")
    first_rid = F.coalesce("first.rid", "rid")
    return light.join(sizes, ["key", "cls"], "left").select(
        F.col("id").alias(id_col), F.when(F.col("first.rid").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (F.col("rid") == first_rid).alias("kept"), F.col("sha").alias("text_sha256"), "n_bytes", "rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: exact-duplicate groups of all documents."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("rid", "n_bytes")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS k FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM g
"""
