"""WARC archives: a writer of one gzip member per record, and a salvage reader.

The reader checks each record (gzip CRC, version line, Content-Length, closing
blank lines, block and payload digests).  After a failed check it searches for
the next valid member or version line, goes on from there, and logs the bytes
between as a quarantined gap.  Inside a gzip member it searches the inflated
bytes, of a damaged member those that come before the damage.

Edge cases: null html is an empty payload; a null page id sorts last and is left
out of the header; repeated rows of the smallest page id of a payload are all
responses; an empty table writes and reads no record; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import lean, new_path, stage, table, utf8

DATE = "2024-01-01T00:00:00Z"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
_FEED = 1 << 16
#: Pages below so many bytes come so many to a file, which so stays within 1 GB (of pages up to 128 MB).
FILES = ((1 << 16, 16_000), (1 << 22, 250), (1 << 31, 8))


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page:{page_id}'.encode()).digest())}>"


def record(kind: str, page_id, url, block: bytes, payload_digest: str, payload_bytes: int, refers_to=None) -> bytes:
    """A record in the standard's layout; Page-Id and Payload-Bytes are headers of our own."""
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id(page_id if kind == "response" else f"{page_id}:{kind}"), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    if page_id is not None:
        head["Page-Id"] = page_id
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to), "Refers-To-Page": refers_to}
    head |= {"WARC-Payload-Digest": f"sha1:{payload_digest}", "Payload-Bytes": payload_bytes, "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def http_block(n: int, payload: bytes = b"") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + payload


def member(raw: bytes) -> bytes:
    """A gzip member that ends in a zero byte: the last byte of its length, or that of an empty member after it."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(raw) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, html -> page_id, url, sha, digest, n, member of the response."""
    for b in batches:
        for at in range(0, b.num_rows, 256):  # compressed pages in small batches
            part = b.slice(at, 256)
            out = [[], [], [], []]
            for page, url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)), strict=True):
                d = digest(html)
                for col, v in zip(out, (hashlib.sha1(html).hexdigest(), d, len(html), member(record("response", page, url, http_block(len(html), html), d, len(html)))), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["page_id", "url", "sha", "digest", "n", "member"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with `first`, the page of the response -> the record's member without its last byte."""
    for b in batches:
        out = []
        for page, url, d, n, m, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if first is not None and first != page:
                m = member(record("revisit", page, url, http_block(n), d, n, first))
            out.append(m[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_warc(pages: DataFrame, path: str, *, min_revisit_bytes: int = 0, files: tuple[tuple[int, int], ...] = FILES) -> None:
    """Write a record per row of pages(page_id, url, html) under ``path``.

    Of equal payloads of at least ``min_revisit_bytes`` bytes the one with the
    smallest page id is the response and others revisit it.  Members reach the
    files through Spark's text writer, whose separator is the zero byte that
    each member ends in: commits, retries and any store work as for other tables.
    ``files``: pages are written by size, (below so many bytes, so many to a file).
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    firsts = pages.select("page_id", F.sha1(html).alias("sha"), F.length(html).alias("n")).filter(F.col("n") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.max("n").alias("n"))
    firsts = stage(firsts, "warc-firsts")
    longest = pages.agg(F.max(F.length(html))).first()[0] or 0
    low = 0
    for below, per_file in files:
        if longest < low:
            break
        mine = pages.select("page_id", "url", "html").filter((F.length(html) >= low) & (F.length(html) < below))
        made = mine.mapInArrow(lean(_responses), "page_id long, url string, sha string, digest string, n long, member binary")
        rows = made.join(firsts.filter((F.col("n") >= low) & (F.col("n") < below)).drop("n"), "sha", "left").select("page_id", "url", "digest", "n", "member", "first").mapInArrow(lean(_finish), "value binary")
        rows.select(F.col("value").cast("string")).write.mode("append").option("lineSep", "\u0000").option("maxRecordsPerFile", per_file).text(path)
        low = below


class Marks:
    """Places of a byte string, each found once however often it is asked for."""

    def __init__(self, data: bytes, mark: bytes):
        self.data, self.mark, self.known = data, mark, None

    def after(self, at: int) -> int:
        """First place from ``at`` on, or -1."""
        if self.known is None or not (self.known[0] <= at and (at <= self.known[1] or self.known[1] < 0)):
            self.known = (at, self.data.find(self.mark, at))
        return self.known[1]


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The member at ``at``, where it ends and None; if it is damaged or cut off, what comes before the damage, ``at`` and why."""
    z, out, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        if pos >= len(data):
            return b"".join(out), at, "cut off"
        piece, before = data[pos:pos + _FEED], z.copy()
        try:
            out.append(z.decompress(piece))
        except zlib.error as why:
            try:  # byte by byte up to the damage
                for i in range(len(piece)):
                    out.append(before.decompress(piece[i:i + 1]))
            except zlib.error:
                pass
            return b"".join(out), at, str(why)
        pos += len(piece)
    return b"".join(out), pos - len(z.unused_data), None


def parse_record(data, at: int, lines: Marks) -> tuple[dict, bytes, int]:
    """Header, block and end of the record at ``at``; raises ValueError if a check fails."""
    if not data.startswith(VERSION, at):
        raise ValueError("no header")
    later = lines.after(at + 1)  # a header of any length ends before the next version line
    head_end = data.find(b"\r\n\r\n", at, later + 1 if later >= 0 else len(data))
    if head_end < 0:
        raise ValueError("no header")
    named = data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in named)}
    if not head.get("content-length", "").isdigit():
        raise ValueError("no length")
    start = head_end + 4
    end = start + int(head["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("wrong length")
    block = data[start:end]
    if (want := head.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != digest(block):
        raise ValueError("block digest differs")
    if head.get("warc-type") == "response" and (want := head.get("warc-payload-digest", "")).startswith("sha1:") and want[5:] != digest(block.partition(b"\r\n\r\n")[2]):
        raise ValueError("payload digest differs")
    return head, block, end + 4


def _inside(raw: bytes) -> list[tuple]:
    """(start, end, header, block, None) of each good record of a member's bytes; (start, end, None, None, reason) of each gap."""
    out, at, gap, reason, lines = [], 0, None, "", Marks(raw, b"\n" + VERSION)
    while at < len(raw):
        try:
            head, block, end = parse_record(raw, at, lines)
        except ValueError as why:
            if gap is None:
                gap, reason = at, str(why)
            at = lines.after(at) + 1 or len(raw)
            continue
        if gap is not None:
            out.append((gap, at, None, None, reason))
            gap = None
        out.append((at, end, head, block, None))
        at = end
    if gap is not None:
        out.append((gap, len(raw), None, None, reason))
    return out


def salvage(data: bytes) -> Iterator[tuple]:
    """(start, end, header, block, None) of each good record; (start, end, None, None, reason) of each gap.

    What lies inside a gzip member has the member's start and end; the reason of
    a gap in it says which of its inflated bytes are lost.
    """
    view, at, gap, reason = memoryview(data), 0, None, ""
    lines, magics = Marks(data, b"\n" + VERSION), Marks(data, MAGIC)

    def following(at: int) -> int:
        """Where the next member or version line may start."""
        nexts = [x for x in (magics.after(at + 1), lines.after(at) + 1) if x > at]
        return min(nexts, default=len(data))

    while at < len(data):
        found, end, damage = [], at, None
        try:
            if data.startswith(MAGIC, at):
                raw, end, damage = _inflate(view, at)
                found = _inside(raw)
                if damage or found and not any(x[2] for x in found):
                    if not any(x[2] for x in found):
                        raise ValueError(damage or found[0][4])
                    lost = len(raw)
                    if found[-1][2] is None:
                        lost = found.pop()[0]
                    found.append((lost, "", None, None, damage))
            else:
                head, block, end = parse_record(data, at, lines)
                found.append((at, end, head, block, None))
        except ValueError as why:
            if gap is None:
                gap, reason = at, str(why)
            at = end if end > at else following(at)
            continue
        if gap is not None:
            yield gap, at, None, None, reason
            gap = None
        if damage:
            end = following(at)
        for start, stop, head, block, why in found:
            yield at, end, head, block, why and f"{why} (inflated bytes {start} to {stop})"
        at = end
    if gap is not None:
        yield gap, len(data), None, None, reason


_READ = "path string, start long, stop long, gap string, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _read(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None
        for b in batches:
            for i in range(b.num_rows):
                path, data, rows = b.column(0)[i].as_py(), b.column(1)[i].as_py(), []
                for start, stop, head, block, gap in salvage(data):
                    row = dict.fromkeys(schema.names) | {"path": path, "start": start, "stop": stop, "gap": gap}
                    if gap is None:
                        full = head.get("warc-type") == "response"
                        payload = block.partition(b"\r\n\r\n")[2] if full else None
                        row |= {"record_type": head.get("warc-type"), "page_id": number(head.get("page-id")), "url": head.get("warc-target-uri"), "refers_to": number(head.get("refers-to-page")), "payload_bytes": len(payload) if full else number(head.get("payload-bytes")), "payload_digest": digest(payload) if full else head.get("warc-payload-digest", "").removeprefix("sha1:"), "payload": payload if keep_payload else None}
                    rows.append(row)
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps (``gap`` says why) of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lean(_read(keep_payload)), _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all pages written as WARC and read back."""
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, keep_payload=False).filter(F.col("gap").isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _b32(hexed: str) -> str:
    """SQL for the base32 form of 40 hex digits: 32 groups of 5 bits."""
    digit = lambda i: f"strpos('0123456789abcdef', substr({hexed}, {i}, 1)) - 1"
    out = []
    for g in range(32):
        first, off = divmod(g * 5, 4)
        both = f"(({digit(first + 1)}) * 16 + {digit(first + 2)})" if first + 2 <= 40 else f"(({digit(first + 1)}) * 16)"
        out.append(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({both} // {2 ** (3 - off)}) % 32 + 1, 1)")
    return " || ".join(out)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes, {_b32('s')} AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""
