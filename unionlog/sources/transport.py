"""Host and producers: the facade that checks size and liveness before an insert."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlog.functions.elements import oversize
from unionlog.operators.sets import CONSUMER_GONE, OVERSIZE, UNAVAILABLE
from unionlog.sources import store

DEFAULT_APP_ID = "default"


@dataclass
class Producer:
    raw: store.RunSet
    max_element_bytes: int = 0

    @classmethod
    def attach(cls, spark: SparkSession, path: str, max_element_bytes: int = 0, boot: int | None = None) -> Producer:
        return cls(store.attach(spark, path, boot), max_element_bytes)

    @property
    def available(self) -> bool:
        return self.raw.available

    def emit(self, elements: DataFrame) -> dict[str, int]:
        """Counts by status. Order of tests: availability, size, liveness, insert; refused whole, never torn."""
        elements = elements.where(F.col("element").isNotNull())
        if not self.raw.available:
            return {UNAVAILABLE: elements.count()}
        too_long = oversize(F.col("element"), self.max_element_bytes)
        counts = {OVERSIZE: elements.where(too_long).count()} if self.max_element_bytes > 0 else {}
        accepted = elements.where(~too_long)
        if not self.raw.consumer_alive():
            return counts | {CONSUMER_GONE: accepted.count()}
        return counts | self.raw.insert(accepted)

    def emit_one(self, element: bytes) -> str:
        """The status of a single element."""
        counts = self.emit(self.raw.spark.createDataFrame([(bytearray(element),)], "element binary"))
        return next(status for status, n in counts.items() if n)

    def detach(self) -> None:
        self.raw.detach()


@dataclass
class Host:
    raw: store.RunSet

    @classmethod
    def start(cls, spark: SparkSession, root: str, run_id: str, app_id: str = DEFAULT_APP_ID, pid: int | None = None, boot: int | None = None, **layout) -> Host:
        return cls(store.create(spark, root, app_id, run_id, os.getpid() if pid is None else pid, boot, **layout))

    @property
    def available(self) -> bool:
        return self.raw.available

    @property
    def path(self) -> str:
        """Handed to producers."""
        return self.raw.path

    def items(self):
        return self.raw.items()

    def snapshot(self) -> DataFrame:
        return self.raw.snapshot()

    def shard_count(self) -> int:
        return self.raw.shard_count()

    def claimed_slots(self) -> int:
        return self.raw.claimed_slots()

    def growth_failures(self) -> int:
        return self.raw.growth_failures()

    def finish(self) -> None:
        """Late producers are told that the consumer has gone; the data stay."""
        self.raw.mark_consumer_gone()
        self.raw.detach()
