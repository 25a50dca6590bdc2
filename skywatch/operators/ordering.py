"""Positions in a global order, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skywatch.session import materialize


def numbered(df: DataFrame, order: list[str], out: str = "line_number") -> DataFrame:
    """``df`` with each row's place (from 1) in ascending ``order``; rows that tie in all of it get any of their places.

    Rows are dealt out by ranges of the order, sorted and written once; a row's place is its place in its partition
    plus the rows of the partitions before, a prefix sum over one row per partition."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(placed, "ordered")
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(before, part == F.col("_part")).withColumn(out, within + F.col("_before") + 1).drop("_place", "_part", "_before")
