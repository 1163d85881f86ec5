"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for a driver that runs everything itself.
LOCAL = "file:///tmp/unionlog-checkpoints"


def fresh_folder(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir; on a cluster without that setting an error, as no local folder would do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not f"{spark.sparkContext.master}[".startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read back: computed once, and a plain side of a join, which adaptive execution can split."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
