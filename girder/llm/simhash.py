"""SimHash near-dedup: byte-position inverted index with count filtering.

A fingerprint of 64-bit words is posted under sets of its positional bytes: two
fingerprints meet in a posting if they share all bytes of a set.  Pairs that meet
are tallied (shared positional bytes), kept from the guaranteed minimum on, and
verified by their differing bits.

Single (position, byte) postings would hold 1/256 of all rows each and give every
pair that shares one byte.  With one word and 4 bits, fingerprints that link share
at least 4 of their 8 bytes; the 70 sets of 4 bytes hold together exactly the pairs
whose tally reaches that minimum, so the count filter is the index itself.  Wider
fingerprints for a lower similarity (``texts_alike``) have their 32 positions in
three parts and are posted under the 155 pairs of positions within a part: four
shared bytes always hold such a pair, two or three mostly do.  Of pairs that
differ in as many of 256 bits as the bound of 45 allows, 0.991 meet, at 40 bits
0.999, at 35 all that were tried.

A posting is streamed in key order and only a spanning forest of its links leaves.
One longer than BLOCK is cut into blocks by a hash, and every two blocks of it meet
in a group of their own, so no posting is held whole and no link is lost.

Edge cases: null or blank text has fingerprint zero and links like any other;
repeated rows link to each other; a null id is never the smallest while another
is there; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import lean, slices, stage, table, utf8
from girder.operators.graph import components

#: Shingles hashed at a time, and members of a posting compared in memory.
CHUNK = 1 << 15
BLOCK = 4096
#: Postings up to this length are compared by shifting the rows against themselves.
SHORT = 32
#: Rows of a longer posting compared with all others at a time; links a row, beyond which only a spanning forest is kept.
ROWS, DENSE = 64, 4


@dataclass(frozen=True)
class Index:
    """How texts become fingerprints, where these are posted, and which link."""

    width: int
    #: 64-bit words of a fingerprint; whether a shingle counts once.
    words: int
    distinct: bool
    #: Sets of byte positions; the least tally of shared bytes; the most differing bits.
    sets: tuple[tuple[int, ...], ...]
    least: int
    bits: int


#: Shingles of 4 words and at most 4 of 64 bits.
FOUR_BITS = Index(4, 1, False, tuple(combinations(range(8), 4)), 4, 4)


def texts_alike(similarity: float = 0.8, width: int = 5, slack: float = 1.25) -> Index:
    """256 bits for texts whose sets of shingles have at least this Jaccard similarity.

    A bit differs with probability acos(cosine) / pi, where the cosine is 2s / (1 + s)
    for sets of like size; ``slack`` standard errors are allowed above its mean.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    pairs = tuple(pair for part in np.array_split(np.arange(32), 3) for pair in combinations(part.tolist(), 2))
    return Index(width, 4, True, pairs, 2, math.floor(256 * p + slack * math.sqrt(256 * p * (1 - p))))


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash (multiply and shift)."""
    if not k:
        return h
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def simhash(data: bytes, width: int = 4, n_words: int = 1, distinct: bool = False) -> bytes:
    """Majority bits of the XXH64 (seed 42) of word shingles, big-endian; zero without words."""
    import xxhash

    words = data.lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return bytes(8 * n_words)
    hashed, parts = xxhash.xxh64_intdigest, []
    if len(words) < width:
        parts.append(np.array([hashed(b" ".join(words), 42)], dtype=np.uint64))
    for at in range(0, len(words) - width + 1, CHUNK):
        part = words[at:at + CHUNK + width - 1]
        joined = b" ".join(part)
        ends = (np.cumsum([*map(len, part)]) + np.arange(len(part))).tolist()
        starts = [0, *(e + 1 for e in ends)]
        parts.append(np.array([hashed(joined[s:e], 42) for s, e in zip(starts, ends[width - 1:])], dtype=np.uint64))  # noqa: B905
    if distinct:
        parts = [np.unique(np.concatenate(parts))]
    total, out = sum(map(len, parts)), []
    for k in range(n_words):
        ones = sum(np.unpackbits(_spread(h, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for h in parts)
        out.append(np.packbits(2 * ones > total).tobytes())
    return b"".join(out)


def _fingerprint(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [simhash(x, index.width, index.words, index.distinct) for part in slices(b.column(1)) for x in utf8(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary()), b.column(2)], ["id", "fp", "rid"])

    return run


def _octets(column: pa.Array, words: int) -> np.ndarray:
    """Fingerprints as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 8 * words)


def _names(index: Index) -> list[str]:
    return [f"f{i}" for i in range(index.words)]


def _post(index: Index):
    """fp -> (set and its bytes, fp as longs), a row per set."""
    sets = np.array(index.sets)
    scale = 256 ** np.arange(sets.shape[1])[::-1]
    numbers = np.arange(len(sets), dtype=np.int64) << 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                octets = _octets(b.column(0).slice(at, 500), index.words)
                keys = (octets[:, sets].astype(np.int64) @ scale + numbers).ravel()
                longs = np.repeat(octets.view(">u8").astype(np.uint64).view(np.int64), len(sets), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(longs[:, i])) for i in range(index.words))], ["key", *_names(index)])

    return run


def linked(a: np.ndarray, b: np.ndarray, index: Index) -> np.ndarray:
    """Count filter on shared bytes, then differing bits; rows of 64-bit words."""
    apart = np.bitwise_xor(a, b)
    same = (apart.view(np.uint8).reshape(*apart.shape[:-1], 8 * index.words) == 0).sum(axis=-1)
    return (same >= index.least) & (np.bitwise_count(apart).sum(axis=-1) <= index.bits)


def forest(fps: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Positions (node, its parent) of a spanning forest of the links among distinct fingerprints."""
    left, todo, nodes, parents = np.arange(len(fps)), [], [], []
    while len(left):
        if todo:
            p = todo.pop()
        else:
            p, left = left[0], left[1:]
        hit = linked(fps[left], fps[p], index)
        new, left = left[hit], left[~hit]
        todo.extend(new.tolist())
        nodes.append(new)
        parents.append(np.full(len(new), p))
    none = np.array([], dtype=np.int64)
    return np.concatenate(nodes) if nodes else none, np.concatenate(parents) if parents else none


def long_links(fps: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all links of a long run, or of a spanning forest of them where they are many."""
    found_a, found_b, n = [], [], 0
    for at in range(0, len(fps) - 1, ROWS):
        a, b = np.nonzero(linked(fps[at:at + ROWS, None, :], fps[None, at:, :], index))
        keep = a < b
        found_a.append(a[keep] + at)
        found_b.append(b[keep] + at)
        n += int(keep.sum())
        if n > DENSE * len(fps):
            return forest(fps, index)
    return np.concatenate(found_a), np.concatenate(found_b)


def links(groups: np.ndarray, fps: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links within runs of equal ``groups`` (rows of numbers)."""
    cuts = np.flatnonzero((groups[1:] != groups[:-1]).any(axis=1)) + 1
    starts, ends = np.append(0, cuts), np.append(cuts, len(groups))
    last = np.repeat(ends, ends - starts)
    found_a, found_b = [], []
    at = np.flatnonzero(np.repeat(ends - starts <= SHORT, ends - starts))
    for off in range(1, SHORT):
        at = at[at + off < last[at]]
        if not len(at):
            break
        ok = linked(fps[at], fps[at + off], index)
        found_a.append(at[ok])
        found_b.append(at[ok] + off)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s > SHORT:
            a, b = long_links(fps[s:e], index)
            found_a.append(a + s)
            found_b.append(b + s)
    none = np.array([], dtype=np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _bytes(fps: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in fps.astype(">u8")]


def _meet(index: Index, block: int, keys: int):
    """Rows sorted by their first ``keys`` columns, then fingerprints -> links (key null, a, b).

    With one key column, the rows of a run longer than ``block`` leave as (key, a, null).
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, fps, long = np.empty((0, keys), dtype=np.int64), np.empty((0, index.words), dtype=np.uint64), None

        def emit(key: list, a: list, b: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["key", "a", "b"])

        def close(upto: int) -> pa.RecordBatch:
            a, b = links(groups[:upto], fps[:upto], index)
            return emit([None] * len(a), _bytes(fps[a]), _bytes(fps[b]))

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            more, new = np.stack(cols[:keys], axis=1), np.ascontiguousarray(np.stack(cols[keys:], axis=1)).view(np.uint64)
            if long is not None:
                n = int(np.searchsorted(more[:, 0], long, side="right"))
                yield emit([long] * n, _bytes(new[:n]), [None] * n)
                more, new = more[n:], new[n:]
                if not len(more):
                    continue
                long = None
            groups, fps = np.concatenate([groups, more]), np.concatenate([fps, new])
            other = np.flatnonzero((groups != groups[-1]).any(axis=1))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                if keys == 1:  # long runs leave as they are
                    cuts = np.append(0, np.flatnonzero(groups[1:last, 0] != groups[:last - 1, 0]) + 1)
                    sizes = np.diff(np.append(cuts, last))
                    wide = np.repeat(sizes > block, sizes)
                    yield emit(groups[:last, 0][wide].tolist(), _bytes(fps[:last][wide]), [None] * int(wide.sum()))
                    groups, fps = np.concatenate([groups[:last][~wide], groups[last:]]), np.concatenate([fps[:last][~wide], fps[last:]])
                    last -= int(wide.sum())
                yield close(last)
                groups, fps = groups[last:], fps[last:]
            if keys == 1 and len(groups) > block:
                long = int(groups[0, 0])
                yield emit([long] * len(groups), _bytes(fps), [None] * len(groups))
                groups, fps = groups[:0], fps[:0]
        if len(groups):
            yield close(len(groups))

    return stream


def _longs(fp, index: Index) -> list:
    return [F.conv(F.hex(F.substring(fp, 8 * i + 1, 8)), 16, -10).cast("long").alias(name) for i, name in enumerate(_names(index))]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index = FOUR_BITS, block: int = BLOCK, row_col: str | None = None) -> DataFrame:
    """A row per row of docs: id, fingerprint (hex), component_id (smallest id reachable through links).

    With ``row_col``, a long that tells rows apart, also that column and ``kept``:
    true for one row of each component, that of the smallest id, null last.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    row = F.col(row_col) if row_col else F.lit(None)
    rows = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row.cast("long").alias("rid")).mapInArrow(lean(_fingerprint(index)), f"id {id_type}, fp binary, rid long"), "simhash-fp")
    low = F.struct(F.col("id").isNull().alias("no_id"), "id", "rid") if row_col else F.col("id")
    distinct = rows.groupBy("fp").agg(F.min(low).alias("low"))
    names = _names(index)
    longs = ", ".join(f"{n} long" for n in names)
    posted = distinct.select("fp").mapInArrow(lean(_post(index)), f"key long, {longs}").repartition("key").sortWithinPartitions("key", *names)
    met = stage(posted.mapInArrow(lean(_meet(index, block, 1)), "key long, a binary, b binary"), "simhash-links")
    edges = met.filter(F.col("key").isNull()).select("a", "b").distinct()
    # Postings longer than a block: every two blocks meet in a group of their own.
    long = met.filter(F.col("key").isNotNull()).select("key", F.col("a").alias("fp"))
    blocks = long.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cut = long.join(blocks, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("key", F.least("mine", "other").cast("long").alias("i"), F.greatest("mine", "other").cast("long").alias("j"), *_longs(F.col("fp"), index))
    crossed = cut.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", *names).mapInArrow(lean(_meet(index, block, 3)), "key long, a binary, b binary")
    comp = components(edges.unionByName(crossed.select("a", "b")))
    labelled = distinct.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    # Written, so that the join below shuffles both sides and a large component can be split: an aggregate in its stage would forbid that.
    lows = stage(labelled.groupBy("label").agg(F.min("low").alias("first")), "simhash-lows")
    by_fp = labelled.join(lows, "label").select("fp", "first")
    out = [F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), F.col("first.id" if row_col else "first").alias("component_id")]
    if row_col:
        out += [F.col("rid").alias(row_col), (F.col("rid") == F.col("first.rid")).alias("kept")]
    return rows.join(by_fp, "fp").select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: near-duplicate components of all documents."""
    return near_groups(table(spark, sf_dir, "documents"))
