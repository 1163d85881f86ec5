"""Running totals over an order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unionlog.sources.shared import written


def dealt_in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """Deals rows into ordered ranges, numbers these as `part` and writes them.

    Each exchange draws its own sample for the ranges' bounds, and readers that need different columns do not share an
    exchange. So the numbers are written: else a row is counted in one range and ordered in another.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))


def totals_before(ranged: DataFrame, **sums: Column) -> DataFrame:
    """For each part, each sum over all parts before it: one row a partition."""
    totals = ranged.groupBy("part").agg(*(c.alias(k) for k, c in sums.items()))
    over = Window.orderBy("part")
    return totals.select("part", *((F.sum(k).over(over) - F.col(k)).alias(k) for k in sums))
