"""Gapless ranks within groups of any size, by DataFrame functions.

A window over a group would sort the whole group in one task.  Here groups are split in buckets, the
buckets' counts give each bucket's first rank, and only rows of one bucket are ranked together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, group: list[str], bucket: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `name`: 0, 1, 2, ... within each group, by bucket and then by order. Keys must not be null."""
    keys = [*group, *bucket]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.join(first, keys).select(*rows.columns, (F.col("__first") + within - 1).cast("long").alias(name))
