"""Shards of bounded size by extendible hashing.

A row's place in the directory is its hash's leading bits. A bucket over the byte limit is split on one more
bit, and only it; this goes on until each shard fits. So a shard is a prefix of bits, prefixes
are disjoint and complete, and a shard's depth is the first at which its rows fit.

The hash is the first 60 bits of the MD5 of the id's text. Only (hash, bytes) go through the splitting:
they are added up once by a fine prefix (map-side combined), and each fine cell finds the depth at which
its prefix fits, from sums over its ancestors. Cells that do not fit even there go on to the next, finer
round, so rounds follow the data and nothing is collected but a count of what is left.

A single row over the limit is a shard of its own that is marked `oversized`, as are rows that cannot be
told apart because their ids are equal. A null id is placed by the hash of an empty text. A null text has 0 bytes. An
empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlog.llm.common import cut, table, text_or_empty

HASH_BITS = 60
LIMIT = 256 << 10
#: Levels of the directory that one round looks at.
LEVELS = 20


def place(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def prefix(h: Column, depth: Column | int) -> Column:
    """The first `depth` bits of the hash."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", h, F.lit(HASH_BITS) - d)


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_docs, oversized): the shards of rows (h, n_bytes)."""
    spark = rows.sparkSession
    left = rows.select("h", "n_bytes")
    found, top = None, 0
    while True:
        low = min(top + LEVELS, HASH_BITS)
        cells = cut(left.groupBy(prefix(F.col("h"), low).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")))
        up = cells.select(F.explode(F.sequence(F.lit(top), F.lit(low))).alias("depth"), "cell", "bytes", "docs")
        at = F.call_function("shiftright", F.col("cell"), F.lit(low) - F.col("depth"))
        sums = up.groupBy("depth", at.alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == HASH_BITS)
        # A prefix is a shard if it fits and the one a bit shorter does not (at the round's top: if it fits).
        whole = sums.select("depth", "prefix", "shard_bytes", "shard_docs", fits.alias("fits"))
        parents = whole.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fitting = whole.where("fits").withColumn("parent", F.shiftright("prefix", 1))
        below = fitting.where(F.col("depth") > top).join(parents, ["depth", "parent"], "left_semi")
        shards = below.unionByName(fitting.where(F.col("depth") == top)).select("depth", "prefix", "shard_bytes", "shard_docs")
        done = cut(shards)
        found = done if found is None else found.unionByName(done)
        over = cut(whole.where((F.col("depth") == low) & ~F.col("fits")).select(F.col("prefix").alias("cell")))
        if not over.take(1):
            break
        left = cut(left.withColumn("cell", prefix(F.col("h"), low)).join(over, "cell", "left_semi").select("h", "n_bytes"))
        top = low
    return found.withColumn("oversized", F.col("shard_bytes") > limit)


def assign(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds its shard to each row that has h. The directory's depths are few, so each row looks up few prefixes."""
    known = cut(shards)
    depths = [r[0] for r in known.select("depth").distinct().collect()]  # at most 61
    candidates = F.array(*(F.struct(F.lit(d).alias("depth"), prefix(F.col("h"), d).alias("prefix")) for d in sorted(depths))) if depths else F.array().cast("array<struct<depth:int,prefix:bigint>>")
    return rows.withColumn("at", F.explode(candidates)).select("*", "at.depth", "at.prefix").drop("at").join(known, ["depth", "prefix"])


def name(depth: Column, bits: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.conv(bits.cast("string"), 10, 2), depth, F.lit("0")))


def sharded(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, oversized) of each row of docs (doc_id, text)."""
    rows = cut(docs.select("doc_id", F.octet_length(text_or_empty()).cast("bigint").alias("n_bytes"), place(F.col("doc_id")).alias("h")))
    out = assign(rows, directory(rows, limit))
    return out.select("doc_id", "n_bytes", name(F.col("depth"), F.col("prefix")).alias("shard"), "depth", "shard_bytes", "shard_docs", "oversized")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Writes docs as Parquet, a folder a shard; returns the directory. Many rows of one shard go to one task, bounded by the limit."""
    columns = docs.columns
    keyed = docs.withColumn("h", place(F.col("doc_id")))
    shards = cut(directory(docs.select(place(F.col("doc_id")).alias("h"), F.octet_length(text_or_empty()).cast("bigint").alias("n_bytes")), limit))
    placed = assign(keyed, shards).withColumn("shard", name(F.col("depth"), F.col("prefix")))
    placed.repartition("shard").select(*columns, F.concat(F.lit("s"), "shard").alias("shard")).write.partitionBy("shard").parquet(path)
    return shards


def op6_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents", "doc_id", "text"))


def oracle(limit: int = LIMIT, levels: int = 24) -> str:
    """Depths up to `levels`, enough wherever ids are unique and no shard is that deep."""
    return f"""WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HASH_BITS // 4}) AS BIGINT) AS h FROM documents),
    s AS (SELECT CAST(l.range AS INTEGER) AS depth, h >> CAST({HASH_BITS} - l.range AS INTEGER) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, CAST(count(*) AS BIGINT) AS shard_docs FROM d, range(0, {levels + 1}) l GROUP BY ALL),
    c AS (SELECT doc_id, n_bytes, depth, prefix, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS rn
          FROM d JOIN s ON d.h >> CAST({HASH_BITS} - s.depth AS INTEGER) = s.prefix WHERE shard_bytes <= {limit} OR shard_docs = 1)
    SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, shard_bytes, shard_docs, shard_bytes > {limit} AS oversized FROM c WHERE rn = 1"""


QUERIES = {"op6_extendible_sharding": op6_extendible_sharding}
ORACLES = {"op6_extendible_sharding": oracle()}
