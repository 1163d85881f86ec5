"""A run of a grow-only set as a folder of immutable Parquet batches.

    {root}/{app}~{run}.{boot}.{pid}.run/
        _control/run.json            written last by create(): the run exists once it does
        _control/finished            the consumer has gone
        _control/refused-*.json      one file per signalled refusal
        _staging/{uuid}/             batches being written; hidden from readers
        gen={k}/batch={uuid}/*.parquet

Decisions: a generation counts only if it holds a published batch (stray files do not raise
the count); one discovery rule serves all reads; unreadable batches raise; creating a run that
exists is refused, so old generations are never adopted; paths inside manifests are relative,
so a copied run reads the same. The folder may be on any store that Hadoop's FileSystem API
reaches: all file work goes through it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlog.functions.elements import FNV_BASIS, FNV_PRIME
from unionlog.functions.names import valid_app_id_value
from unionlog.operators.sets import EXISTS, INSERTED, SATURATED, UNAVAILABLE

FORMAT_VERSION = 1
SCHEMA = "element binary, len bigint"
FAULT_POINTS = ("before_stage_write", "after_stage_write", "before_publish", "after_publish", "before_manifest")
FaultHook = Callable[[str], None]


def _no_fault(point: str) -> None:
    """The default hook does nothing."""


def hash_bytes(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = (h ^ b) * FNV_PRIME % 2**64
    return h


def boot_id() -> int:
    """Identifies this boot of the driver's machine; wall-clock seconds where the system has none."""
    try:
        with open("/proc/sys/kernel/random/boot_id") as f:
            return hash_bytes(f.read().strip().replace("-", "").encode()) | 1
    except OSError:
        return int(time.time()) | 1


def segment_path(root: str, app_id: str, run_id: str, boot: int, pid: int) -> str:
    return f"{root.rstrip('/')}/{app_id}~{run_id}.{boot}.{pid}"


class Files:
    """The few file operations needed, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, base: str):
        jvm, sc = spark._jvm, spark.sparkContext
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(base).getFileSystem(sc._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def mkdirs(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def create(self, path: str, text: str) -> bool:
        """Writes a new file; False if there is one already."""
        try:
            out = self._fs.create(self._path(path), False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))] if self.exists(path) else []

    def rename(self, source: str, target: str) -> bool:
        return self._fs.rename(self._path(source), self._path(target))

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    def bytes(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0


@dataclass
class RunSet:
    """A handle on one run. An unavailable or detached handle answers empty, and never raises."""

    spark: SparkSession
    path: str
    available: bool
    manifest: dict = field(default_factory=dict)
    fault: FaultHook = _no_fault

    @property
    def files(self) -> Files:
        return Files(self.spark, self.path)

    def detach(self) -> None:
        self.available = False

    # reads

    def generations(self) -> list[int]:
        """Numbers of the generations that hold a published batch."""
        if not self.available:
            return []
        files = self.files
        found = (n[4:] for n in files.names(self.path) if n.startswith("gen="))
        return sorted(int(n) for n in found if n.isdigit() and any(b.startswith("batch=") for b in files.names(f"{self.path}/gen={n}")))

    def observations(self) -> DataFrame:
        """All published rows with their generation; duplicates across batches are still there."""
        gens = self.generations()
        if not gens:
            return self.spark.createDataFrame([], f"{SCHEMA}, gen int")
        paths = [f"{self.path}/gen={g}" for g in gens]
        return self.spark.read.schema(f"{SCHEMA}, gen int, batch string").option("basePath", self.path).parquet(*paths).drop("batch")

    def snapshot(self) -> DataFrame:
        return self.observations().select("element").distinct()

    def items(self):
        return (bytes(r.element) for r in self.snapshot().toLocalIterator())

    def contains(self, element: bytes) -> bool:
        return self.available and bool(self.observations().where(F.col("element") == F.lit(bytearray(element))).take(1))

    def shard_count(self) -> int:
        return max(self.generations(), default=-1) + 1

    def claimed_slots(self) -> int:
        """Derived from the data, never from a counter."""
        return self.observations().groupBy("gen").agg(F.countDistinct("element").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def refusals(self) -> list[dict]:
        if not self.available:
            return []
        files, control = self.files, f"{self.path}/_control"
        return [json.loads(files.read(f"{control}/{n}")) for n in files.names(control) if n.startswith("refused-")]

    def growth_failures(self) -> int:
        """Failed attempts to open a generation, whether or not the elements got in."""
        return sum(r["growth_failed"] for r in self.refusals())

    def saturated(self) -> int:
        """Elements refused."""
        return sum(r["saturated"] for r in self.refusals())

    def footprint(self) -> int:
        return self.files.bytes(self.path) if self.available else 0

    # liveness

    def mark_consumer_gone(self) -> None:
        if self.available:
            self.files.create(f"{self.path}/_control/finished", "")

    def consumer_alive(self) -> bool:
        return self.available and not self.files.exists(f"{self.path}/_control/finished")

    # writes

    def insert(self, elements: DataFrame, gen: int | None = None, max_bytes: int = 0) -> dict[str, int]:
        """Adds the elements not yet in the set; counts by status, over the distinct elements given.

        max_bytes > 0 models a store that is full: the batch is refused whole, signalled in
        _control and counted, and nothing of it becomes visible. Staged first and published by a
        single rename; a crash before the rename leaves nothing visible.
        """
        if not self.available:
            return {UNAVAILABLE: elements.count()}
        gen = max(self.shard_count() - 1, 0) if gen is None else gen
        batch = uuid.uuid4().hex
        staged, target = f"{self.path}/_staging/{batch}", f"{self.path}/gen={gen}/batch={batch}"
        wanted = elements.select(F.col("element").cast("binary").alias("element")).where(F.col("element").isNotNull()).distinct()
        fresh = wanted.join(self.observations().select("element"), "element", "left_anti")
        self.fault("before_stage_write")
        fresh.withColumn("len", F.octet_length("element").cast("bigint")).write.parquet(staged)
        self.fault("after_stage_write")
        new = self.spark.read.schema(SCHEMA).parquet(staged).count()
        given = wanted.count()
        files = self.files
        if max_bytes > 0 and files.bytes(f"{self.path}/gen={gen}") + files.bytes(staged) > max_bytes:
            return self._refuse(staged, new, given)
        if new:
            files.mkdirs(f"{self.path}/gen={gen}")
            self.fault("before_publish")
            if not files.rename(staged, target):
                return self._refuse(staged, new, given)
            self.fault("after_publish")
        else:
            files.delete(staged)
        return {INSERTED: new, EXISTS: given - new}

    def _refuse(self, staged: str, new: int, given: int) -> dict[str, int]:
        files = self.files
        files.delete(staged)
        files.create(f"{self.path}/_control/refused-{uuid.uuid4().hex}.json", json.dumps({"growth_failed": 1, "saturated": new}))
        return {SATURATED: new, EXISTS: given - new}

    def grow(self) -> int:
        """The number of the next generation: one above those published. Racing growers agree."""
        return self.shard_count()

    def bad_records(self) -> DataFrame:
        return self.observations().where(~F.col("len").eqNullSafe(F.octet_length("element").cast("bigint")))


def create(spark: SparkSession, root: str, app_id: str, run_id: str, pid: int, boot: int | None = None, cap0: int = 1024, arena0: int = 262144, fault: FaultHook = _no_fault) -> RunSet:
    """A new run. Unavailable for a bad app id, a capacity that is no power of two, or an existing run."""
    boot = boot_id() if boot is None else boot
    path = f"{segment_path(root, app_id, run_id, boot, pid)}.run"
    manifest = {"format_version": FORMAT_VERSION, "app_id": app_id, "run_id": run_id, "boot": str(boot), "pid": pid, "cap0": cap0, "arena0": arena0}
    refused = RunSet(spark, path, False, manifest, fault)
    if not valid_app_id_value(app_id) or cap0 <= 0 or cap0 & (cap0 - 1):
        return refused
    files = Files(spark, root)
    if files.names(path):
        return refused
    files.mkdirs(f"{path}/_control")
    fault("before_manifest")
    return RunSet(spark, path, True, manifest, fault) if files.create(f"{path}/_control/run.json", json.dumps(manifest)) else refused


def attach(spark: SparkSession, path: str, boot: int | None = None, fault: FaultHook = _no_fault) -> RunSet:
    """An existing run; unavailable if there is none, or its version or boot differ."""
    refused = RunSet(spark, path, False, {}, fault)
    try:
        files = Files(spark, path)
        if not files.exists(f"{path}/_control/run.json"):
            return refused
        manifest = json.loads(files.read(f"{path}/_control/run.json"))
    except ValueError:
        return refused
    sound = manifest.get("format_version") == FORMAT_VERSION and manifest.get("boot") == str(boot_id() if boot is None else boot)
    return RunSet(spark, path, True, manifest, fault) if sound else refused
