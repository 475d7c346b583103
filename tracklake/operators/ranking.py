"""Global ranks and neighbours without gathering all rows in one task.

``bucket`` is a column that never decreases along the order (an hour, a block of frames).
Only one row per bucket meets in a single task; ranks are taken within buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, bucket: Column, order: list[str], name: str) -> DataFrame:
    """Adds the row number (from 1) in the order, whose first column the bucket follows."""
    rows = df.withColumn("bucket", bucket)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).select("bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return rows.join(starts, "bucket").withColumn(name, (F.col("start") + rank).cast("int")).drop("bucket", "start")


def next_value(df: DataFrame, column: str, block: int, name: str) -> DataFrame:
    """Adds the next larger value of a column of distinct whole numbers (null for the last)."""
    rows = df.withColumn("bucket", F.floor(F.col(column) / block))
    firsts = rows.groupBy("bucket").agg(F.min(column).alias("first"))
    after = firsts.select("bucket", F.lead("first").over(Window.orderBy("bucket")).alias("beyond"))
    inside = F.lead(column).over(Window.partitionBy("bucket").orderBy(column))
    return rows.join(after, "bucket").withColumn(name, F.coalesce(inside, F.col("beyond"))).drop("bucket", "beyond")
