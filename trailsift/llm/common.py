"""Helpers the operators of this subpackage share: reading, held-out folds, Arrow byte buffers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailsift.session import ensure_checkpoint_dir, materialize

__all__ = ["fold", "materialize", "read_table", "prepare", "releasing", "row_blocks", "string_bytes", "word_starts",
           "SPACE", "WORD", "lower_ascii"]

#: A word, everywhere in the contracts: a run of code points that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Which bytes are ASCII white space. UTF-8 continuation and lead bytes are all >= 0x80.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def prepare(spark: SparkSession) -> None:
    """Shared settings of every query of the subpackage."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, buckets: int = 5) -> Column:
    """crc32 of the id as text, modulo ``buckets`` (null for a null id)."""
    return F.crc32(doc_id.cast("string")) % F.lit(buckets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte (every other byte stays)."""
    return _LOWER[data]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets in them, without copying.

    A null row has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type)
                                  or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer row is a block of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in ``data``, and how many words each row (``offsets``) has."""
    inside = ~SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, counts


def releasing(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """``run`` for ``mapInArrow``, giving memory back when a task ends.

    Spark reuses Python workers for the stages that follow; what the allocators keep for later, and what
    ``forget`` drops, would stand beside those stages' own needs.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim is not None:
                trim(0)
    return task
