"""Probe-storm workloads and colliding elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlog.functions.elements import home_slot, used_fingerprint


def dep_name(i: Column) -> Column:
    return F.concat(F.lit("dep-"), i.cast("string"), F.lit(".h"))


def dep_id(name: Column) -> Column:
    return F.regexp_extract(name, r"^dep-([0-9]+)\.h$", 1).try_cast("bigint")


def probe_storm(spark: SparkSession, producers: int = 6, distinct: int = 5000, rounds: int = 40) -> DataFrame:
    """producers x distinct x rounds observations, made on the executors; each producer covers every id."""
    total = producers * distinct * rounds
    i = F.col("id")
    ranged = spark.range(total).select(
        i.alias("seq"), F.expr(f"id div {distinct * rounds}").alias("producer"), F.expr(f"id div {distinct} % {rounds}").alias("round"), (i % distinct).alias("dep")
    )
    # A bijection of 0..distinct-1 for each producer: only its coverage matters.
    shuffled = (F.col("dep") + F.col("producer") * 7919) % distinct
    return ranged.select("seq", "producer", "round", F.encode(dep_name(shuffled), "UTF-8").alias("element"))


def colliding(elements: DataFrame, capacity: int) -> DataFrame:
    """Home slots that two or more distinct elements share: slot, elements there, the smallest and the largest."""
    placed = elements.where(F.col("element").isNotNull()).select("element").distinct().withColumn("slot", home_slot(used_fingerprint(F.col("element")), capacity))
    pairs = placed.groupBy("slot").agg(F.count("*").alias("elements"), F.min("element").alias("first"), F.max("element").alias("last"))
    return pairs.where(F.col("elements") > 1)
