"""Counts, ratios and footprints of a set."""

from __future__ import annotations

import os
import resource

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unionlog.operators.ranges import dealt_in_ranges, totals_before


def shard_count(generations: DataFrame) -> DataFrame:
    return generations.select(F.coalesce(F.max("gen").cast("bigint") + 1, F.lit(0).cast("bigint")).alias("shards"))


def claimed_slots(observations: DataFrame, gen: str = "gen") -> DataFrame:
    """Sum of the distinct elements of each generation, and the exact number of distinct elements.

    One exchange on `element`: the distinct (generation, element) pairs are counted per element.
    """
    pairs = observations.where(F.col("element").isNotNull()).select(gen, "element").distinct()
    per_element = pairs.groupBy("element").agg(F.count("*").alias("n"))
    return per_element.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("claimed"), F.count("*").alias("distinct_elements")
    )


def dedup_ratio(observations: DataFrame) -> DataFrame:
    """Observations, distinct elements and their ratio (NULL for an empty input).

    Counted through a grouped pre-aggregation, so a hot element is one row per task in the exchange.
    """
    per_element = observations.where(F.col("element").isNotNull()).groupBy("element").agg(F.count("*").alias("n"))
    totals = per_element.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("events"), F.count("*").alias("distinct_elements"))
    return totals.withColumn(
        "ratio", F.when(F.col("distinct_elements") > 0, F.col("events").cast("double") / F.col("distinct_elements").cast("double"))
    )


def nearest_rank(df: DataFrame, value: str, numerator: int = 99, denominator: int = 100) -> DataFrame:
    """The element at index min(n-1, n*numerator div denominator) of the sorted values, 0 if there are none.

    Values are counted first and the running count goes over distinct values dealt into ranges:
    each range is ordered in its own task, so no single task sees all rows.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranged = dealt_in_ranges(counted, "v")
    before = totals_before(ranged, before=F.sum("n"))
    total = counted.agg(F.sum("n").alias("total"))
    within = Window.partitionBy("part").orderBy("v")
    positioned = (
        ranged.join(F.broadcast(before), "part")
        .crossJoin(F.broadcast(total))
        .withColumn("upto", F.col("before") + F.sum("n").over(within))
        .withColumn("wanted", F.least(F.col("total") - 1, F.expr(f"total * {numerator}L div {denominator}L")))
    )
    hit = positioned.where((F.col("wanted") < F.col("upto")) & (F.col("wanted") >= F.col("upto") - F.col("n")))
    return hit.agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("p"))


def footprint(files: DataFrame, prefix: str = "") -> DataFrame:
    """Bytes of the files whose name begins with the prefix; `files` has `name` and `size`."""
    return files.where(F.startswith(F.col("name"), F.lit(prefix))).agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def dir_bytes(directory: str, prefix: str = "") -> int:
    """Bytes of the plain files directly in a local directory whose name begins with the prefix."""
    with os.scandir(directory) as entries:
        return sum(e.stat().st_size for e in entries if e.is_file() and e.name.startswith(prefix))


def process_metrics() -> dict[str, float]:
    """Peak resident KB and CPU seconds of this process (the driver's Python)."""
    use = resource.getrusage(resource.RUSAGE_SELF)
    return {"peak_rss_kb": float(use.ru_maxrss), "cpu_s": use.ru_utime + use.ru_stime}
