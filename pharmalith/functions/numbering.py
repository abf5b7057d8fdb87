"""Row numbers over a whole table without putting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import written


def number_rows(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the given order over all rows.

    Rows are dealt by ranges of the order and sorted there; a number is the
    place in its range plus the rows of all ranges before.  The sorted rows
    are a written table, so both passes see the same ranges, and only a count
    per range comes to the driver.  Rows that tie are in any order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "numbered")
    ranges = sorted(tuple(r) for r in placed.groupBy("_range").agg(F.count("*"), F.min("_row")).collect())
    shifts, before = [], 0
    for at, n, first in ranges:
        shifts += [F.lit(at), F.lit(before - first + 1)]
        before += n
    if not shifts:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_range", "_row")
    return placed.withColumn(name, F.col("_row") + F.create_map(*shifts)[F.col("_range")]).drop("_range", "_row")
