"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.session import materialize

# The word of every contract here: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

__all__ = ["WORD", "SPACES", "SHINGLE_WORDS", "SIMILARITY", "table", "n_words", "fresh", "materialize", "release", "small_batches", "without_collector"]

# Word shingles and near-duplicate similarity of the package, unless a caller says otherwise.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(name: str) -> str:
    """A column name that no input column can have, for work columns beside unknown extra ones."""
    return f"__{name}_{uuid.uuid4().hex[:12]}"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Rows go to Python by at most so many and about so many bytes at a time from now on: ten thousand whole texts a batch,
    or a thousand packs, would by Spark's settings be held by the JVM's buffers and by the worker at once."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).rstrip("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:  # a size with a unit was chosen by the caller
            spark.conf.set(key, most)


def release() -> None:
    """Gives freed memory back to the system. Python workers live on between tasks, and what an allocator
    keeps of a past peak counts against the executor's memory in every later stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def without_collector(batches: Iterator) -> Iterator:
    """The batches; while they last, the cycle collector is off, which would look through large tables of small objects
    again and again. Afterwards memory is given back."""
    gc.disable()
    try:
        yield from batches
    finally:
        gc.enable()
        release()
