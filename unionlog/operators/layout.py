"""Which generation each observation of a sequential trace lands in.

A generation holds `cap` slots and `arena` bytes; both grow fourfold. It is left after half of its
slots are claimed, or when a record does not fit. The number of generations is logarithmic in
the input, so a driver loop over generations runs a few jobs; each job is a distributed aggregate. The sequence is
written once and read by all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unionlog.functions.elements import GROWTH, record_bytes
from unionlog.operators.ranges import dealt_in_ranges, totals_before
from unionlog.sources.shared import written

#: The arena's bump pointer starts here.
ARENA_GUARD = 8


def _first_crossing(ranged: DataFrame, half: int, arena: int) -> tuple[int | None, int | None]:
    """seq at which `half` elements are claimed, and seq whose record no longer fits.

    ranged (part, seq, rec) is dealt in ranges of seq: totals per range are added up over one row a range.
    """
    before = totals_before(ranged, c0=F.count("*"), b0=F.sum("rec"))
    within = Window.partitionBy("part").orderBy("seq")
    running = ranged.join(F.broadcast(before), "part").select(
        "seq", (F.col("c0") + F.row_number().over(within)).alias("claimed"), (F.col("b0") + F.sum("rec").over(within) + ARENA_GUARD).alias("used")
    )
    row = running.agg(
        F.min(F.when(F.col("claimed") == half, F.col("seq"))).alias("slot_at"),
        F.min(F.when(F.col("used") > arena, F.col("seq"))).alias("arena_at"),
    ).first()
    return row["slot_at"], row["arena_at"]


def generation_layout(observations: DataFrame, cap0: int = 1024, arena0: int = 262144) -> DataFrame:
    """Rows (gen, cap, arena, start_seq, claimed) for observations (seq, element); seq is unique.

    An element that does not fit is retried in the next generation, so that generation starts at it.
    """
    spark = observations.sparkSession
    clean = written(observations.where(F.col("element").isNotNull()).select("seq", "element"))
    cap, arena, gen, rows = cap0, arena0, 0, []
    start = clean.agg(F.min("seq")).first()[0]
    while start is not None:
        firsts = clean.where(F.col("seq") >= start).groupBy("element").agg(F.min("seq").alias("seq")).select("seq", record_bytes(F.col("element")).alias("rec"))
        firsts = dealt_in_ranges(firsts, "seq")
        slot_at, arena_at = _first_crossing(firsts, (cap + 1) // 2, arena)
        if arena_at is not None and (slot_at is None or arena_at <= slot_at):
            end, nxt = arena_at, arena_at
        elif slot_at is not None:
            end, nxt = slot_at + 1, slot_at + 1
        else:
            end = nxt = None
        claimed = (firsts if end is None else firsts.where(F.col("seq") < end)).count()
        rows.append((gen, cap, arena, start, claimed))
        if nxt is not None:
            nxt = clean.where(F.col("seq") >= nxt).agg(F.min("seq")).first()[0]
        start, gen, cap, arena = nxt, gen + 1, cap * GROWTH, arena * GROWTH
    return spark.createDataFrame(rows, "gen int, cap bigint, arena bigint, start_seq bigint, claimed bigint")
