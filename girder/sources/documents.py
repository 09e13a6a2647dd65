"""Document readers: text, Markdown, DOCX and IFC through binary files; unreadable ones go to a quarantine."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARSER_VERSION = "1"
MAX_CHARS = 5_000_000
#: Products of an IFC file that are read.
MAX_PRODUCTS = 20_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs that are not blank, then table rows with cells joined by " | "."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out = [line for p in body.findall(f"{_W}p") if (line := text(p).strip())]
    for row in body.iter(f"{_W}tr"):
        cells = [text(c).strip() for c in row.findall(f"{_W}tc")]
        if any(cells):
            out.append(" | ".join(cells))
    return "\n".join(out)


_ENTITY = re.compile(r"#\d+\s*=\s*(IFC[A-Z0-9]+)\s*\(\s*'([^']*)'\s*,\s*[^,]*,\s*(?:'((?:[^']|'')*)'|\$)\s*,\s*(?:'((?:[^']|'')*)'|\$)", re.I)
_PRODUCTS = re.compile(r"^IFC(?:WALL|COLUMN|BEAM|SLAB|DOOR|WINDOW|STAIR|ROOF|MEMBER|PLATE|RAILING|FOOTING|PILE|COVERING|FURNISH|SPACE|SITE|BUILDING|OPENING|CURTAIN|RAMP|FLOW|DISTRIBUTION|PROXY)", re.I)


def ifc_products(data: bytes) -> list[tuple[str, str, str, str]]:
    """(type, id, name, description) of product entities of a STEP file, in order."""
    out = []
    for m in _ENTITY.finditer(data.decode("utf-8", "replace")):
        if _PRODUCTS.match(m[1]):
            out.append((m[1].upper(), m[2], (m[3] or "").replace("''", "'"), (m[4] or "").replace("''", "'")))
            if len(out) == MAX_PRODUCTS:
                break
    return out


def pdf_text(data: bytes) -> str:
    """The pages of a PDF as text.  Needs the optional pypdf."""
    from pypdf import PdfReader

    return page_sections([p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages])


def page_sections(pages: list[str]) -> str:
    """A section per page that has text, headed "# Page n" and a blank line."""
    return "\n\n".join(f"# Page {n}\n\n{t.strip()}" for n, t in enumerate(pages, 1) if t.strip())


def read_one(path: str, data: bytes) -> str:
    """By suffix; raises ValueError for an empty or oversized text and for unknown suffixes."""
    suffix = path.rpartition(".")[2].lower()
    if suffix in ("txt", "md"):
        text = data.decode("utf-8", "replace")
    elif suffix == "docx":
        text = docx_text(data)
    elif suffix == "ifc":
        text = "\n".join(" | ".join(p) for p in ifc_products(data))
    elif suffix == "pdf":
        text = pdf_text(data)
    else:
        raise ValueError(f"no reader for .{suffix}")
    text = text.strip()
    if not text or len(text) > MAX_CHARS:
        raise ValueError("empty text" if not text else "text too long")
    return text


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content, parser_version, error); rows with an error are the quarantine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                try:
                    row = {"path": name, "content": read_one(name, data), "parser_version": PARSER_VERSION, "error": None}
                except Exception as why:  # a bad file must not stop the scan: it is reported as a row
                    row = {"path": name, "content": None, "parser_version": PARSER_VERSION, "error": f"{type(why).__name__}: {why}"[:500]}
                yield pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.string()) for c in ("path", "content", "parser_version", "error")]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, content string, parser_version string, error string")


def good(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("error").isNull())


def quarantine(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("error").isNotNull())
