"""Word splitting shared by the operators.

A word is a maximal run of characters other than the six ASCII white-space characters.
``bytes.split`` without arguments splits UTF-8 at exactly those, and ``bytes.lower`` changes
only A-Z, so both work on encoded text.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WHITE_SPACE = " \t\n\x0b\x0c\r"
WHITE_SPACE_RUN = r"[ \t-\r]+"
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def words(text: Column) -> Column:
    """The words of ``text`` as an array; none for null, empty or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, WHITE_SPACE_RUN))


def lower_words(text: str | None) -> list[bytes]:
    """The words of one text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_arrays(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ``lower_words`` of all texts one after the other, and how many each text has."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(trimmed)
    found, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    # A blank text is split into one empty word, others hold none.
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    if blank.any():
        sizes[blank] = 0
        found = found.filter(pc.greater(pc.binary_length(found), 0))
    return found.cast(pa.binary()), sizes


def release() -> None:
    """Gives memory that is free in this worker back to the system; it would otherwise keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library


def worker_state(key: object, make: Callable[[], object]) -> object:
    """A value kept in this Python worker across tasks, until another one is asked for.

    Functions reach the workers by value, so their own module globals last one task only. One
    value at a time bounds what a worker holds when it serves the stages of a pipeline in turn.
    """
    name = "_corpusmill_worker_state"
    holder = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if holder.get("key") != key:
        holder["value"] = None
        holder["value"], holder["key"] = make(), key
    return holder["value"]


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for the jobs inside: whole texts pass in them, twice per worker."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)
