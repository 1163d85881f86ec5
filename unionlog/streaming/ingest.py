"""Streaming inserts. No watermark anywhere: a watermark would forget elements and let them in twice.

State is one row per distinct element and is kept in RocksDB, so it is bounded by disk, not heap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from unionlog.operators.sets import CONSUMER_GONE, EXISTS, INSERTED

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rocksdb(spark: SparkSession) -> None:
    """State of the queries started from now on is kept in RocksDB, unless the session names another store than Spark's default."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def distinct_stream(observations: DataFrame) -> DataFrame:
    _rocksdb(observations.sparkSession)
    return observations.where(F.col("element").isNotNull()).dropDuplicates(["element"])


class _FirstSeen(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.seen.exists()
        for batch in rows:
            n = len(batch)
            if not n:
                continue
            yield pd.DataFrame({"element": [key[0]] * n, "status": [INSERTED if fresh and i == 0 else EXISTS for i in range(n)]})
            if fresh:
                self.seen.update((True,))
                fresh = False

    def close(self) -> None:
        pass


def status_stream(observations: DataFrame) -> DataFrame:
    """(element, status) for every observation; the first one that arrives is inserted."""
    _rocksdb(observations.sparkSession)
    kind = observations.schema["element"].dataType.simpleString()
    keyed = observations.where(F.col("element").isNotNull()).select("element")
    return keyed.groupBy("element").transformWithStateInPandas(
        statefulProcessor=_FirstSeen(), outputStructType=f"element {kind}, status string", outputMode="Append", timeMode="None"
    )


def finish_aware_writer(consumer_alive: Callable[[], bool], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows that arrive after the consumer has finished are labelled, not inserted."""

    def run(batch: DataFrame, epoch: int) -> None:
        write(batch if consumer_alive() else batch.withColumn("status", F.lit(CONSUMER_GONE)))

    return run


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs over all input there is, then stops; exactly once into Parquet across restarts."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def read_events(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
