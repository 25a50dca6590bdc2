"""Checks that live in the plan (B8, B34, C7): a frame either fails when it is
run, with a message from the row at fault, or lists its violations as rows.

The reference asserts such things one call at a time ("exactly one log group",
"a physical id"); here a check is a column of the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(value: Column, ok: Column, message: Column) -> Column:
    """``value``; running a frame that uses it fails with ``message`` at the first row for which ``ok`` is not true.

    The check is part of the value, so no filter can be moved in front of it."""
    return F.when(ok, value).otherwise(F.raise_error(message))


def matches(wanted: DataFrame, candidates: DataFrame, keys: list[str], *measures: Column) -> DataFrame:
    """``wanted`` with ``n_matches``, the number of ``candidates`` of equal ``keys`` (0: none), and the given aggregates over them.

    Candidates are reduced to one row per key before the join, so a key that many share costs one row."""
    per_key = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matches"), *measures)
    return wanted.join(per_key, on=keys, how="left").withColumn("n_matches", F.coalesce(F.col("n_matches"), F.lit(0)))
