import pytest
from pyspark.sql import functions as F

from unionlog.sources import Host, Producer, attach, create, reap, segment_path
from unionlog.sources.reaper import hold_lease, pid_alive
from unionlog.sources.store import FAULT_POINTS, boot_id
from unionlog.streaming import distinct_stream, drain


def df(spark, *values):
    return spark.createDataFrame([(None if v is None else bytearray(v),) for v in values], "element binary")


def content(run):
    return {bytes(r.element) for r in run.snapshot().collect()}


def test_insert_is_idempotent_and_relocatable(spark, tmp_path):
    run = create(spark, str(tmp_path), "my.app", "v1.2~x", pid=10, boot=7)
    assert run.available and content(run) == set() and run.shard_count() == 0
    assert run.insert(df(spark, b"alpha", b"beta", b"alpha", b"", None)) == {"inserted": 3, "exists": 0}
    assert run.insert(df(spark, b"alpha", b"gamma"), gen=run.grow()) == {"inserted": 1, "exists": 1}
    assert content(run) == {b"alpha", b"beta", b"", b"gamma"} == set(run.items())
    assert run.generations() == [0, 1] and run.shard_count() == 2 and run.claimed_slots() == 4
    assert run.contains(b"") and not run.contains(b"delta") and run.bad_records().count() == 0 and run.footprint() > 0
    import shutil

    shutil.copytree(run.path, tmp_path / "moved.run")
    assert content(attach(spark, str(tmp_path / "moved.run"), boot=7)) == content(run)


def test_refusals_to_create_and_attach(spark, tmp_path):
    root = str(tmp_path)
    assert create(spark, root, "a", "r", 1, 7).available
    assert not create(spark, root, "a", "r", 1, 7).available
    assert not create(spark, root, "a~b", "r", 1, 7).available
    assert not create(spark, root, "a", "r2", 1, 7, cap0=48).available
    path = segment_path(root, "a", "r", 7, 1) + ".run"
    assert attach(spark, path, boot=7).available
    assert not attach(spark, path, boot=8).available
    assert not attach(spark, f"{root}/missing.run", boot=7).available
    gone = attach(spark, f"{root}/missing.run", boot=7)
    assert gone.insert(df(spark, b"a")) == {"unavailable": 1} and gone.shard_count() == 0 and gone.snapshot().count() == 0
    assert boot_id() & 1


def test_full_store_signals(spark, tmp_path):
    run = create(spark, str(tmp_path), "a", "r", 1, 7)
    run.insert(df(spark, b"kept"))
    assert run.insert(df(spark, b"kept", b"x", b"y"), max_bytes=1) == {"saturated": 2, "exists": 1}
    assert run.saturated() == 2 and run.growth_failures() == 1 and content(run) == {b"kept"}


@pytest.mark.parametrize("point", FAULT_POINTS)
def test_crash_points(spark, tmp_path, point):
    class Crash(Exception):
        pass

    def hook(at):
        if at == point:
            raise Crash

    if point == "before_manifest":
        with pytest.raises(Crash):
            create(spark, str(tmp_path), "a", "r", 1, 7, fault=hook)
        assert not attach(spark, segment_path(str(tmp_path), "a", "r", 7, 1) + ".run", boot=7).available
        return
    run = create(spark, str(tmp_path), "a", "r", 1, 7)
    run.insert(df(spark, b"committed"))
    run.fault = hook
    with pytest.raises(Crash):
        run.insert(df(spark, b"victim"))
    after = attach(spark, run.path, boot=7)
    assert content(after) == {b"committed"} | ({b"victim"} if point == "after_publish" else set())
    assert after.insert(df(spark, b"victim"))["inserted"] == (point != "after_publish")
    assert content(after) == {b"committed", b"victim"}


def test_stray_generation_does_not_count(spark, tmp_path):
    run = create(spark, str(tmp_path), "a", "r", 1, 7)
    run.insert(df(spark, b"a"))
    (tmp_path / run.path.split("/")[-1] / "gen=5").mkdir()
    assert run.shard_count() == 1


def test_transport(spark, tmp_path):
    host = Host.start(spark, str(tmp_path), "r", pid=1, boot=7)
    producer = Producer.attach(spark, host.path, max_element_bytes=8, boot=7)
    assert [producer.emit_one(x) for x in (b"tiny", b"tiny", b"this-is-way-too-long", b"12345678", b"")] == ["inserted", "exists", "oversize", "inserted", "inserted"]
    assert {bytes(r.element) for r in host.snapshot().collect()} == {b"tiny", b"12345678", b""}
    host.finish()
    assert producer.emit_one(b"late") == "consumer_gone" and producer.emit_one(b"this-is-way-too-long") == "oversize"
    producer.detach()
    assert producer.emit_one(b"x") == "unavailable" and not host.available


def test_reaper(spark, tmp_path):
    root = str(tmp_path)
    for app, boot, pid in (("my.app", 77, 123), ("my.app", 77, 10), ("my.app", 76, 10), ("other", 76, 1)):
        create(spark, root, app, "v1.2~x", pid, boot).insert(df(spark, b"a"))
    held = segment_path(root, "my.app", "v1.2~x", 76, 10) + ".run"
    assert hold_lease(spark, held, "me", 3600)
    alive = lambda pid: pid == 10
    assert reap(spark, root, "my.app", 77, alive) == 1
    names = {p.name for p in tmp_path.iterdir() if p.is_dir()}
    assert names == {"my.app~v1.2~x.77.10.run", "my.app~v1.2~x.76.10.run", "other~v1.2~x.76.1.run"}
    lease = tmp_path / "my.app~v1.2~x.76.10.run/_control/lease.json"
    lease.write_text("torn")
    assert reap(spark, root, "my.app", 77, alive) == 0
    lease.unlink()
    (lease.parent / ".lease.json.crc").unlink()
    assert hold_lease(spark, held, "me", -1)
    assert reap(spark, root, "my.app", 77, alive) == 1
    assert pid_alive(1) and not pid_alive(0)


def test_stream_restart_adds_nothing(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(1000).select((F.col("id") % 37).cast("string").alias("element"))
    rows.write.parquet(src)
    for _ in range(2):
        drain(distinct_stream(spark.readStream.schema("element string").parquet(src)), out, str(tmp_path / "ck"))
        rows.write.mode("append").parquet(src)
    assert spark.read.parquet(out).count() == 37
