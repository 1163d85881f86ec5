"""Run and segment names: {app}~{run}.{boot}.{pid}.shard{K}."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: app up to the first '~'; run ids may hold dots and tildes, so boot and pid are taken from the right.
ANCHOR = r"^([^~]*)~(.*)\.([0-9]+)\.([0-9]+)\.shard0$"


def valid_app_id(app_id: Column) -> Column:
    """Non-empty, without '~' and '/'. NULL is invalid."""
    return F.coalesce((F.length(app_id) > 0) & ~F.contains(app_id, F.lit("~")) & ~F.contains(app_id, F.lit("/")), F.lit(False))


def valid_app_id_value(app_id: str | None) -> bool:
    return bool(app_id) and "~" not in app_id and "/" not in app_id


def parse_segment_name(name: Column) -> Column:
    """Struct (app_id, run_id, boot, pid) of an anchor name; NULL for anything that is no anchor."""
    part = lambda i: F.regexp_extract(name, ANCHOR, i)
    return F.when(
        name.rlike(ANCHOR),
        F.struct(
            part(1).alias("app_id"),
            part(2).alias("run_id"),
            part(3).try_cast("decimal(20,0)").alias("boot"),
            part(4).try_cast("bigint").alias("pid"),
        ),
    )


def shard_suffix(name: Column) -> Column:
    """The integer after '.shard', NULL where the suffix is no integer (temporary names)."""
    return F.regexp_extract(name, r"\.shard([0-9]+)$", 1).try_cast("bigint")


def segment_base(app_id: Column, run_id: Column, boot: Column, pid: Column) -> Column:
    return F.concat(app_id, F.lit("~"), run_id, F.lit("."), boot.cast("string"), F.lit("."), pid.cast("string"))
