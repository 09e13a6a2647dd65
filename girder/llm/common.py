"""What the training-data operators share: tables, staging, byte-level text helpers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.plans.staging import new_path, stage
from girder.plans.tables import table

__all__ = ["fresh", "lean", "named", "new_path", "slices", "squeeze", "stage", "table", "utf8", "word_count"]

#: Words are maximal runs without ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"

_TO_SPACE = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_RE)).cast("long")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def squeeze(data: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    data = data.translate(_TO_SPACE)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


def lean(run):
    """A batch function that hands memory back when its task ends: Python workers live on, and their pools with them."""

    @functools.wraps(run)
    def lean_run(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return lean_run


def slices(part, rows: int = 500):
    """A batch or column in pieces, so that only one piece's texts are Python objects at a time."""
    for at in range(0, len(part), rows):
        yield part.slice(at, rows)


def utf8(column) -> list[bytes]:
    """The bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
