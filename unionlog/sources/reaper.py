"""Cleanup of stale runs, scoped to one application.

Fails closed: a run whose lease cannot be read is kept. A run is first marked by a tombstone and its
control folder is deleted last, so a crash midway leaves an anchor from which to resume.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlog.functions.names import parse_segment_name
from unionlog.sources.store import Files, boot_id


def pid_alive(pid: int) -> bool:
    if pid <= 0:
        return False
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except OSError:
        return True
    return True


def plan_reap(names: DataFrame, app_id: str, boot: str, live: DataFrame, leased: DataFrame | None = None) -> DataFrame:
    """Adds app_id, run_id, boot, pid and reap to anchor names.

    live(pid) lists live owners; leased(name) the runs some holder has locked. The application
    is tested first: names of others, or without one, are never candidates.
    """
    parsed = names.withColumn("_p", parse_segment_name(F.col("name"))).select("name", "_p.*")
    alive = live.select(F.col("pid").cast("bigint").alias("pid")).distinct().withColumn("_alive", F.lit(True))
    held = (leased.select("name").distinct() if leased is not None else names.select("name").where(F.lit(False))).withColumn("_held", F.lit(True))
    joined = parsed.join(alive, "pid", "left").join(held, "name", "left")
    stale = (F.col("boot") != F.lit(boot).cast("decimal(20,0)")) | F.col("_alive").isNull()
    mine = F.col("app_id").eqNullSafe(F.lit(app_id))
    return joined.select("name", "app_id", "run_id", "boot", "pid", (mine & F.coalesce(stale, F.lit(False)) & F.col("_held").isNull()).alias("reap"))


def _lease_held(files: Files, run: str, now: float) -> bool:
    lease = f"{run}/_control/lease.json"
    if not files.exists(lease):
        return False
    try:
        return json.loads(files.read(lease))["expires"] > now
    except Exception:  # whatever is wrong with the lease, the run is kept
        return True


def hold_lease(spark: SparkSession, run: str, holder: str, seconds: float) -> bool:
    return Files(spark, run).create(f"{run}/_control/lease.json", json.dumps({"holder": holder, "expires": time.time() + seconds}))


def reap(spark: SparkSession, root: str, app_id: str, boot: int | None = None, alive=pid_alive) -> int:
    """Deletes the stale runs of the application; returns the number of runs removed."""
    files, boot = Files(spark, root), boot_id() if boot is None else boot
    runs = [n for n in files.names(root) if n.endswith(".run")]
    if not runs:
        return 0
    anchors = spark.createDataFrame([(n.removesuffix(".run") + ".shard0",) for n in runs], "name string")
    pids = {int(p) for n in runs if (p := n.removesuffix(".run").rpartition(".")[2]).isdigit()}
    live = spark.createDataFrame([(p,) for p in pids if alive(p)], "pid bigint")
    now, removed = time.time(), 0
    # Names of run folders in one directory: metadata of bounded size, and deletion is a driver action.
    for row in plan_reap(anchors, app_id, str(boot), live).where("reap").collect():
        run = f"{root.rstrip('/')}/{row['name'].removesuffix('.shard0')}.run"
        if _lease_held(files, run, now):
            continue
        files.create(f"{run}/_control/tombstone", "")
        for name in files.names(run):
            if name != "_control":
                files.delete(f"{run}/{name}")
        removed += files.delete(run)
    return removed
