"""Zero loss and zero phantom, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_oracle(intended: DataFrame, got: DataFrame) -> DataFrame:
    """One row: expected, got, loss, phantom (counts of distinct elements).

    One exchange: both sides are tagged, folded by element and counted.
    """
    tagged = intended.select("element", F.lit(1).alias("want"), F.lit(0).alias("have")).unionByName(
        got.select("element", F.lit(0).alias("want"), F.lit(1).alias("have"))
    )
    folded = tagged.where(F.col("element").isNotNull()).groupBy("element").agg(F.max("want").alias("want"), F.max("have").alias("have"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return folded.agg(
        count(F.col("want")).alias("expected"),
        count(F.col("have")).alias("got"),
        count(F.col("want") * (1 - F.col("have"))).alias("loss"),
        count(F.col("have") * (1 - F.col("want"))).alias("phantom"),
    )


def monotone_losses(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Elements of an earlier snapshot that a later one lacks: none in a grow-only set."""
    return earlier.select("element").distinct().join(later.select("element"), "element", "left_anti")


def chain_gaps(generations: DataFrame, key: str = "run") -> DataFrame:
    """Per run: generations found, highest number + 1, and whether they form a prefix 0..max."""
    per = generations.groupBy(key).agg(F.countDistinct("gen").alias("found"), (F.max("gen").cast("bigint") + 1).alias("span"))
    return per.withColumn("contiguous", F.col("found") == F.col("span"))


def stored_lengths(records: DataFrame) -> DataFrame:
    """Records whose stored length differs from their element's: none in a sound run."""
    return records.where(~F.col("len").eqNullSafe(F.octet_length("element").cast("bigint")))
