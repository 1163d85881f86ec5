"""Set reads and the status of each observation.

Elements are never NULL: a NULL has no meaning as an observed element and is filtered at this
boundary. All operators take whole DataFrames and stay lazy; the only exchange each of them
needs is the one on `element`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unionlog.functions.elements import oversize
from unionlog.sources.shared import written

INSERTED, EXISTS, SATURATED, UNAVAILABLE = "inserted", "exists", "saturated", "unavailable"
CONSUMER_GONE, OVERSIZE = "consumer_gone", "oversize"
INSERT_STATUSES = (INSERTED, EXISTS, SATURATED, UNAVAILABLE)
EMIT_STATUSES = (INSERTED, EXISTS, CONSUMER_GONE, OVERSIZE, SATURATED, UNAVAILABLE)


def distinct_union(*shards: DataFrame) -> DataFrame:
    """The exact set union; each shard is folded before the exchange (partial aggregation)."""
    parts = [s.select("element").where(F.col("element").isNotNull()) for s in shards]
    return reduce(DataFrame.unionByName, parts).distinct()


def known(candidates: DataFrame, observed: DataFrame) -> DataFrame:
    """The candidates that were observed (bulk membership)."""
    return candidates.join(observed.select("element"), "element", "left_semi")


def absent(candidates: DataFrame, observed: DataFrame) -> DataFrame:
    """The candidates that were not observed."""
    return candidates.join(observed.select("element"), "element", "left_anti")


def contains(observed: DataFrame, element: bytes | str) -> bool:
    """Point membership; the equality filter reaches the Parquet scan."""
    literal = F.lit(bytearray(element)) if isinstance(element, (bytes, bytearray)) else F.lit(element)
    return bool(observed.where(F.col("element") == literal).limit(1).take(1))



def insert_status(observations: DataFrame, order: list[str], existing: DataFrame | None = None, scope: list[str] | None = None) -> DataFrame:
    """Adds `status`: the first observation of an element in `order` is inserted, others exist.

    `order` must be total (end it with a unique id). `existing` holds elements seen before.
    `scope` names further columns within which an element counts once (such as a generation);
    by default an element counts once globally.

    One element may hold a large part of all rows, so no window runs over them: the first
    observation is a map-side-combined min, written and joined back. Written, because adaptive
    execution splits a hot key only where both sides of the join are plain exchanges.
    """
    key = [*(scope or []), "element"]
    clean = observations.where(F.col("element").isNotNull())
    rank = F.struct(*order)
    first = clean.groupBy(*key).agg(F.min(rank).alias("_first"))
    if existing is not None:
        seen = existing.select("element").distinct().withColumn("_seen", F.lit(True))
        first = first.join(seen, "element", "left")
    else:
        first = first.withColumn("_seen", F.lit(None).cast("boolean"))
    is_new = F.col("_seen").isNull() & (rank == F.col("_first"))
    return clean.join(written(first), key).withColumn("status", F.when(is_new, INSERTED).otherwise(EXISTS)).drop("_first", "_seen")


def emit_status(
    observations: DataFrame,
    order: list[str],
    existing: DataFrame | None = None,
    max_element_bytes: int = 0,
    available: bool = True,
    consumer_alive: bool = True,
) -> DataFrame:
    """The facade's outcome for each observation.

    Precedence: unavailable, oversize, consumer gone, then the result of the insert. A refused
    observation is not part of the set and so never makes a later one "exist".
    """
    if not available:
        return observations.where(F.col("element").isNotNull()).withColumn("status", F.lit(UNAVAILABLE))
    clean = observations.where(F.col("element").isNotNull())
    too_long = oversize(F.col("element"), max_element_bytes)
    refused = clean.where(too_long).withColumn("status", F.lit(OVERSIZE))
    accepted = clean.where(~too_long)
    if not consumer_alive:
        return refused.unionByName(accepted.withColumn("status", F.lit(CONSUMER_GONE)))
    return refused.unionByName(insert_status(accepted, order, existing))
