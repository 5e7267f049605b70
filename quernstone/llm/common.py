"""What the operators share: reading a table, intermediate tables, joins of checked size, and slices of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import worker_path
from quernstone.storage import discard, stored

__all__ = ["bounded", "discard", "read", "stored", "text_slices", "tidied"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    worker_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """rows, a written table of few and narrow columns, marked for broadcast if it has at most so many rows; beyond that
    it is shuffled, and Spark's own filter of join keys keeps what doesn't match out of the shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def tidied(batches: Iterator) -> Iterator:
    """The batches; behind the last the worker's free memory goes back to the machine, as Spark keeps idle workers."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def text_slices(column: pa.Array, size: int) -> Iterator[list[str]]:
    """The texts of an Arrow column in order, null as empty, in lists of at most so many bytes; a longer text is alone.

    Only one list is held as Python strings at a time, whatever the size of Spark's batches.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield [t or "" for t in column.slice(at, end - at).to_pylist()]
        at = end
