"""What the operators share: reading tables, cutting lineage, and rows by key across Python tasks."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these: space, tab, \n, \v, \f, \r.
SPACE_CLASS = r"[\x20\x09-\x0D]"
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/unionlog"
#: Spark's own setting for the files of a query's shuffles.
DELETE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: What a worker remembers at most, and what an entry takes besides its bytes.
REMEMBERED_BYTES, ENTRY_BYTES = 96 << 20, 150


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is in fewer pieces than half of them (one small file is one piece, and one task).

    Tables of many blocks, which is all that matters at scale, are left as they are: no exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(2 * cores) if 2 * pieces < cores else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name in the place that driver and executors share.

    The cluster names that place in spark.checkpoint.dir. Where it is unset, a driver that runs everything itself
    (local mode: tests, one machine) sets one of its own; on a cluster that is an error, as a folder of one machine would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_CHECKPOINTS
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: ends its lineage, survives lost executors.

    What the write shuffled is deleted as it ends, as nothing else can need it.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(DELETE_SHUFFLES)
    spark.conf.set(DELETE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DELETE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, for mapInArrow: its memory goes back to the system when a task ends, as Python workers wait for further tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library: no such call
            return

    return run


class Remembered(dict):
    """Results by key in a Python worker, of bounded bytes: emptied when over them."""

    def __init__(self, limit: int = REMEMBERED_BYTES):
        super().__init__()
        self.limit = self.left = limit

    def keep(self, key, value, size: int):
        """size: bytes of key and value, without what every entry takes."""
        self.left -= size + ENTRY_BYTES
        if self.left < 0:
            self.clear()
            self.left = self.limit - size - ENTRY_BYTES
        if self.left >= 0:
            self[key] = value
        return value


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")


def held(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text falls on remainder 1; ids that are null are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == 1, F.lit(False))


def is_held(doc_id: int | None, modulus: int) -> bool:
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == 1


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes, nulls as empty."""
    return [b or b"" for b in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]
