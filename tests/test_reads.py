import duckdb
import pytest
from pyspark.sql import functions as F

from unionlog.functions import elements as E
from unionlog.functions.names import parse_segment_name, valid_app_id_value
from unionlog.operators import layout, metrics, sets, verify, workload
from unionlog.operators.ranges import dealt_in_ranges, totals_before
from unionlog.plans.catalog import ORACLES, QUERIES, sequenced
from unionlog.sources.store import hash_bytes

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
SLOW = {"generation_layout", "generation_layout_arena_bound"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=repr)


def elements(spark, values):
    return spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], "seq bigint, element binary")


GOLDEN = {b"": 1469598103934665603, b"alpha": 6542418319912364133, b"beta": 17583068548789615225, b"dep-0.h": 7849079717041287307, b"path/to/file-0.h": 2696253307566162960, b"\x00\xff\x80": 12148305303967886038}


def test_fingerprints(spark):
    df = elements(spark, GOLDEN)
    got = df.select("element", E.unsigned(E.fingerprint(F.col("element"))).alias("h"), E.unsigned(E.used_fingerprint(F.col("element"))).alias("u")).collect()
    assert {bytes(r.element): int(r.h) for r in got} == GOLDEN
    assert all(int(r.u) == int(r.h) | 1 for r in got)
    assert all(hash_bytes(k) == v for k, v in GOLDEN.items())


def test_nulls_and_empty_elements(spark):
    df = elements(spark, [b"alpha", b"beta", None, b"alpha", b"", b""])
    assert {bytes(r.element) for r in sets.distinct_union(df).collect()} == {b"alpha", b"beta", b""}
    status = {r.seq: r.status for r in sets.insert_status(df, ["seq"]).collect()}
    assert status == {0: "inserted", 1: "inserted", 3: "exists", 4: "inserted", 5: "exists"}
    assert sets.contains(df, b"") and not sets.contains(df, b"gamma")
    assert sets.distinct_union(df.limit(0)).count() == 0
    assert metrics.dedup_ratio(df.limit(0)).first() == (0, 0, None)


def test_emit_precedence(spark):
    df = elements(spark, [b"tiny", b"this-is-way-too-long", b"12345678", b"tiny"])
    run = lambda **k: {r.seq: r.status for r in sets.emit_status(df, ["seq"], max_element_bytes=8, **k).collect()}
    assert run() == {0: "inserted", 1: "oversize", 2: "inserted", 3: "exists"}
    assert run(consumer_alive=False) == {0: "consumer_gone", 1: "oversize", 2: "consumer_gone", 3: "consumer_gone"}
    assert set(run(available=False, consumer_alive=False).values()) == {"unavailable"}


def test_scope_by_generation(spark):
    df = elements(spark, [b"a", b"a", b"a"]).withColumn("gen", F.when(F.col("seq") < 2, 0).otherwise(1))
    assert {r.seq: r.status for r in sets.insert_status(df, ["seq"], scope=["gen"]).collect()} == {0: "inserted", 1: "exists", 2: "inserted"}


@pytest.mark.parametrize(
    ("cap", "arena", "n", "name", "claimed"),
    [(64, 2048, 1500, "elem-{}", [32, 128, 512, 828]), (32, 1024, 500, "dep-{}", [16, 64, 256, 164])],
)
def test_layout_traces(spark, cap, arena, n, name, claimed):
    df = elements(spark, [name.format(i).encode() for i in range(n)])
    assert [r.claimed for r in layout.generation_layout(df, cap, arena).orderBy("gen").collect()] == claimed


def test_layout_big_element(spark):
    big = bytes((31 * i + 7) & 255 for i in range(6281))
    df = elements(spark, [big, b"small-a", b"small-b"])
    got = layout.generation_layout(df, 64, 2048).orderBy("gen").collect()
    assert [r.claimed for r in got] == [0, 3]


def test_sequence_is_dense_on_a_sampled_table(spark):
    """sf0.1 has more rows than a range exchange samples, so two exchanges have different bounds."""
    seq = sequenced(spark, "/root/testdata/sf0.1").groupBy("seq").agg(F.max("element").alias("element"), F.count("*").alias("n"))
    assert seq.agg(F.count("*"), F.max("n"), F.min("seq"), F.max("seq"), F.count_distinct("element")).first() == (100_000, 1, 1, 100_000, 7_500)


def test_ranges_are_the_same_for_readers_of_different_columns(spark):
    rows = spark.range(0, 50_000, 1, 4).select(F.xxhash64("id").alias("v"), F.col("id").alias("w"))
    ranged = dealt_in_ranges(rows, "v")
    counted = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert {r.part: r.n for r in ranged.groupBy("part").agg(F.count_distinct("v", "w").alias("n")).collect()} == counted
    assert sorted(r.before for r in totals_before(ranged, before=F.count("*")).collect())[0] == 0


def test_storm_and_oracle(spark):
    storm = workload.probe_storm(spark, producers=4, distinct=90, rounds=8)
    assert metrics.dedup_ratio(storm).first()[:2] == (4 * 90 * 8, 90)
    assert verify.union_oracle(storm, sets.distinct_union(storm)).first() == (90, 90, 0, 0)
    assert storm.select(workload.dep_id(F.decode("element", "UTF-8")).alias("i")).agg(F.max("i")).first()[0] == 89
    lost = elements(spark, [b"a"])
    assert verify.union_oracle(elements(spark, [b"a", b"b"]), lost).first() == (2, 1, 1, 0)
    assert verify.union_oracle(lost, elements(spark, [b"a", b"b"])).first() == (1, 2, 0, 1)


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(250)], "v double")
    for n in (1, 2, 99, 100, 101, 250):
        assert metrics.nearest_rank(df.where(F.col("v") < n), "v").first()[0] == sorted(range(n))[min(n - 1, n * 99 // 100)]
    assert metrics.nearest_rank(df.limit(0), "v").first()[0] == 0


def test_names(spark):
    assert [valid_app_id_value(x) for x in ("my-app", "my.app", "", "a~b", "a/b", None)] == [True, True, False, False, False, False]
    big = f"a~r.{2**64 - 1}.5.shard0"
    assert int(spark.createDataFrame([(big,)], "n string").select(parse_segment_name(F.col("n")).boot).first()[0]) == 2**64 - 1


def test_snapshot_plan_prunes(spark):
    plan = QUERIES["snapshot_distinct"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema:")[1].splitlines()[0]
    assert "user_id" in schema and "event_type" in schema and "props" not in schema


def test_hot_element_is_split_among_tasks(spark):
    """Three quarters of the rows are one element: the join that marks its rows does not leave them to one task."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in small}
    rows = spark.range(0, 400_000, 1, 8).select(F.col("id").alias("seq"), F.when(F.col("id") % 4 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("element"))
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        marked = sets.insert_status(rows, ["seq"]).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("status") == "inserted", 1).otherwise(0)).alias("new")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in marked) == 400_000 and sum(r.new for r in marked) == 100_001
    assert max(r.n for r in marked) < 150_000
