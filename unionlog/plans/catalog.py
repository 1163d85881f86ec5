"""Queries over whole tables, each with its SQL equivalent.

Elements are text here, not bytes, so that results compare plainly. `seq` order is (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unionlog.functions import elements as E
from unionlog.functions import names as N
from unionlog.operators import layout, metrics, sets, verify, workload
from unionlog.operators.ranges import dealt_in_ranges, totals_before
from unionlog.sources.shared import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EV = "ev AS (SELECT event_id, ts, concat_ws('/', user_id, event_type) AS element FROM events)"
ORDER = ["ts", "event_id"]
OVERSIZE_BYTES = 8
SPLIT = "2024-01-03 00:00:00"
GEOMETRIES = {"generation_layout": (64, 8192), "generation_layout_wide": (1024, 262144), "generation_layout_arena_bound": (64, 512)}
LEVELS = 10


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("element"))


@query("snapshot_distinct", f"WITH {EV} SELECT DISTINCT element FROM ev")
def snapshot_distinct(spark, d):
    return sets.distinct_union(events(spark, d))


@query("insert_status", f"WITH {EV} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY element ORDER BY ts, event_id) = 1 THEN 'inserted' ELSE 'exists' END AS status FROM ev")
def insert_status(spark, d):
    return sets.insert_status(events(spark, d), ORDER).select("event_id", "status")


@query(
    "insert_against_existing",
    f"""WITH {EV}, old AS (SELECT DISTINCT element FROM ev WHERE ts < TIMESTAMP '{SPLIT}'),
    new AS (SELECT *, row_number() OVER (PARTITION BY element ORDER BY ts, event_id) AS rn FROM ev WHERE ts >= TIMESTAMP '{SPLIT}')
    SELECT event_id, CASE WHEN rn = 1 AND element NOT IN (SELECT element FROM old) THEN 'inserted' ELSE 'exists' END AS status FROM new""",
)
def insert_against_existing(spark, d):
    ev, at = events(spark, d), F.lit(SPLIT).cast("timestamp_ntz")
    return sets.insert_status(ev.where(F.col("ts") >= at), ORDER, existing=ev.where(F.col("ts") < at)).select("event_id", "status")


@query(
    "emit_status_counts",
    f"""WITH {EV}, fit AS (SELECT CASE WHEN row_number() OVER (PARTITION BY element ORDER BY ts, event_id) = 1 THEN 'inserted' ELSE 'exists' END AS status FROM ev WHERE octet_length(encode(element)) <= {OVERSIZE_BYTES}),
    every AS (SELECT status FROM fit UNION ALL SELECT 'oversize' FROM ev WHERE octet_length(encode(element)) > {OVERSIZE_BYTES})
    SELECT status, CAST(count(*) AS BIGINT) AS n FROM every GROUP BY status""",
)
def emit_status_counts(spark, d):
    return sets.emit_status(events(spark, d), ORDER, max_element_bytes=OVERSIZE_BYTES).groupBy("status").agg(F.count("*").alias("n"))


#: Every user up to beyond the last one, with every type of event.
CANDIDATES = "cand AS (SELECT u.range || '/' || t.event_type AS element FROM range(0, (SELECT max(user_id) + 51 FROM events)) u, (SELECT DISTINCT event_type FROM events) t)"


def candidates(spark, d):
    every = table(spark, d, "events")
    last = every.agg(F.coalesce(F.max("user_id"), F.lit(-51))).first()[0]
    types = [r.event_type for r in every.select("event_type").distinct().collect()]  # the kinds of events: a handful
    numbered = spark.range(0, last + 51).select(F.col("id").alias("u"), F.explode(F.array(*map(F.lit, types)) if types else F.array().cast("array<string>")).alias("event_type"))
    return numbered.select(F.concat_ws("/", F.col("u").cast("string"), "event_type").alias("element"))


@query("contains_probe", f"WITH {EV}, {CANDIDATES} SELECT element, element IN (SELECT element FROM ev) AS found FROM cand")
def contains_probe(spark, d):
    seen = sets.distinct_union(events(spark, d)).withColumn("hit", F.lit(True))
    return candidates(spark, d).join(seen, "element", "left").select("element", F.coalesce("hit", F.lit(False)).alias("found"))


@query("known_probe", f"WITH {EV}, {CANDIDATES} SELECT element FROM cand WHERE element IN (SELECT element FROM ev)")
def known_probe(spark, d):
    return sets.known(candidates(spark, d), events(spark, d))


@query("absent_probe", f"WITH {EV}, {CANDIDATES} SELECT element FROM cand WHERE element NOT IN (SELECT element FROM ev)")
def absent_probe(spark, d):
    return sets.absent(candidates(spark, d), events(spark, d))


@query("cross_shard_union", "SELECT 'c/' || o_custkey AS element FROM orders UNION SELECT 'c/' || c_custkey FROM customer")
def cross_shard_union(spark, d):
    shard = lambda t, c: table(spark, d, t).select(F.concat(F.lit("c/"), F.col(c).cast("string")).alias("element"))
    return sets.distinct_union(shard("orders", "o_custkey"), shard("customer", "c_custkey"))


@query(
    "producer_union_oracle",
    f"""WITH {EV}, got AS (SELECT DISTINCT element FROM ev), want AS (SELECT DISTINCT concat_ws('/', user_id, event_type) AS element FROM events)
    SELECT (SELECT CAST(count(*) AS BIGINT) FROM want) AS expected, (SELECT CAST(count(*) AS BIGINT) FROM got) AS got,
    (SELECT CAST(count(*) AS BIGINT) FROM (SELECT * FROM want EXCEPT SELECT * FROM got)) AS loss,
    (SELECT CAST(count(*) AS BIGINT) FROM (SELECT * FROM got EXCEPT SELECT * FROM want)) AS phantom""",
)
def producer_union_oracle(spark, d):
    ev = events(spark, d)
    return verify.union_oracle(ev, sets.distinct_union(ev))


@query(
    "claimed_slots",
    f"""WITH {EV} SELECT (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT date_trunc('week', ts), element FROM ev)) AS claimed,
    (SELECT CAST(count(DISTINCT element) AS BIGINT) FROM ev) AS distinct_elements""",
)
def claimed_slots(spark, d):
    return metrics.claimed_slots(events(spark, d).withColumn("gen", F.date_trunc("week", "ts")))


@query("dedup_ratio", f"WITH {EV} SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT element) AS BIGINT) AS distinct_elements, CAST(count(*) AS DOUBLE) / CAST(count(DISTINCT element) AS DOUBLE) AS ratio FROM ev")
def dedup_ratio(spark, d):
    return metrics.dedup_ratio(events(spark, d))


def layout_sql(cap: int, arena: int) -> str:
    """The generations, one CTE each; generations that do not start have no row."""
    ctes = [EV, "seqd AS (SELECT element, row_number() OVER (ORDER BY ts, event_id) AS seq, (16 + octet_length(encode(element)) + 7) // 8 * 8 AS rec FROM ev)", "s0 AS (SELECT CAST(1 AS BIGINT) AS st)"]
    for g in range(LEVELS):
        c, a = cap * 4**g, arena * 4**g
        ctes += [
            f"f{g} AS (SELECT element, min(seq) AS seq, any_value(rec) AS rec FROM seqd, s{g} WHERE seq >= st GROUP BY element)",
            f"r{g} AS (SELECT seq, row_number() OVER (ORDER BY seq) AS claimed, sum(rec) OVER (ORDER BY seq) + 8 AS used FROM f{g})",
            f"x{g} AS (SELECT min(CASE WHEN claimed = {(c + 1) // 2} THEN seq END) AS slot_at, min(CASE WHEN used > {a} THEN seq END) AS arena_at FROM r{g})",
            f"e{g} AS (SELECT CASE WHEN arena_at IS NOT NULL AND (slot_at IS NULL OR arena_at <= slot_at) THEN arena_at ELSE slot_at + 1 END AS nx FROM x{g})",
            f"s{g + 1} AS (SELECT min(seq) AS st FROM seqd, e{g} WHERE seq >= nx)",
            f"o{g} AS (SELECT CAST({g} AS INTEGER) AS gen, CAST({c} AS BIGINT) AS cap, CAST({a} AS BIGINT) AS arena, st AS start_seq, CAST((SELECT count(*) FROM f{g}, e{g} WHERE nx IS NULL OR seq < nx) AS BIGINT) AS claimed FROM s{g} WHERE st IS NOT NULL)",
        ]
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT * FROM o{g}" for g in range(LEVELS))


def sequenced(spark, d):
    """Dense seq over (ts, event_id) without a single-task sort: rank in range + rows in ranges before."""
    ranged = dealt_in_ranges(events(spark, d).select("element", *ORDER), *ORDER)
    before = totals_before(ranged, before=F.count("*"))
    within = Window.partitionBy("part").orderBy(*ORDER)
    return ranged.join(F.broadcast(before), "part").select("element", (F.col("before") + F.row_number().over(within)).alias("seq"))


def _layout(cap, arena):
    return lambda spark, d: layout.generation_layout(sequenced(spark, d), cap, arena)


for _name, _geometry in GEOMETRIES.items():
    query(_name, layout_sql(*_geometry))(_layout(*_geometry))

FP = """list_reduce(list_transform(range(1, length(element) + 1), lambda i: CAST(ascii(substr(element, CAST(i AS INTEGER), 1)) AS HUGEINT)),
    lambda acc, x: (CAST(xor(CAST(acc AS UBIGINT), CAST(x AS UBIGINT)) AS HUGEINT) * 1099511628211) % 18446744073709551616, 1469598103934665603::HUGEINT)"""
PRINTS = f"{EV}, fp AS (SELECT element, CAST({FP} AS UBIGINT) AS h FROM (SELECT DISTINCT element FROM ev))"


@query("fingerprint", f"WITH {PRINTS} SELECT element, CAST(h AS VARCHAR) AS fingerprint FROM fp")
def fingerprint(spark, d):
    distinct = sets.distinct_union(events(spark, d))
    return distinct.select("element", E.unsigned(E.fingerprint(F.encode("element", "UTF-8"))).alias("fingerprint"))


@query("home_slots", f"WITH {PRINTS} SELECT CAST((h | 1) & 1023 AS BIGINT) AS slot, CAST(count(*) AS BIGINT) AS n FROM fp GROUP BY 1")
def home_slots(spark, d):
    distinct = sets.distinct_union(events(spark, d))
    return distinct.groupBy(E.home_slot(E.used_fingerprint(F.encode("element", "UTF-8")), 1024).alias("slot")).agg(F.count("*").alias("n"))


@query(
    "colliding_elements",
    f"WITH {PRINTS} SELECT CAST((h | 1) & 1023 AS BIGINT) AS slot, CAST(count(*) AS BIGINT) AS elements, min(element) AS first, max(element) AS last FROM fp GROUP BY 1 HAVING count(*) > 1",
)
def colliding_elements(spark, d):
    binary = sets.distinct_union(events(spark, d)).select(F.encode("element", "UTF-8").alias("element"))
    out = workload.colliding(binary, 1024)
    return out.select("slot", "elements", F.decode("first", "UTF-8").alias("first"), F.decode("last", "UTF-8").alias("last"))


@query("record_bytes", "SELECT doc_id, CAST((16 + octet_length(encode(text)) + 7) // 8 * 8 AS BIGINT) AS bytes FROM documents")
def record_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", E.record_bytes(F.encode("text", "UTF-8")).alias("bytes"))


@query(
    "shard_geometry",
    """SELECT CAST(g AS BIGINT) AS gen, CAST(c AS BIGINT) AS cap, CAST(a AS BIGINT) AS arena,
    CAST(((128 + c * 8 + 63) // 64 * 64 + a + 4095) // 4096 * 4096 AS BIGINT) AS file_bytes
    FROM (SELECT range AS g, CAST(1024 * power(4, range) AS BIGINT) AS c, CAST(262144 * power(4, range) AS BIGINT) AS a FROM range(0, 6))""",
)
def shard_geometry(spark, d):
    g = F.col("id")
    scale = F.pow(F.lit(E.GROWTH), g).cast("bigint")
    cap, arena = F.lit(1024) * scale, F.lit(262144) * scale
    return spark.range(6).select(g.alias("gen"), cap.alias("cap"), arena.alias("arena"), E.segment_file_bytes(cap, arena).alias("file_bytes"))


@query("exact_document_dedup", "SELECT md5(text) AS digest, CAST(count(*) AS BIGINT) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def exact_document_dedup(spark, d):
    # Folded by digest and length, so whole texts never cross an exchange.
    digests = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("key"), F.md5(F.encode("text", "UTF-8")).alias("digest"))
    return digests.groupBy("key", "digest").agg(F.count("*").alias("copies")).select("digest", "copies")


@query("pair_universe", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def pair_universe(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


STORM_ROUNDS = 8


@query("probe_storm", f"WITH {EV} SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT element) AS BIGINT) AS distinct_elements, CAST(count(*) AS DOUBLE) / CAST(count(DISTINCT element) AS DOUBLE) AS ratio FROM ev, range(0, {STORM_ROUNDS})")
def probe_storm(spark, d):
    rounds = events(spark, d).select("element", F.explode(F.sequence(F.lit(1), F.lit(STORM_ROUNDS))).alias("round"))
    return metrics.dedup_ratio(rounds)


@query(
    "growth_curve",
    f"""WITH {EV}, firsts AS (SELECT element, CAST(date_trunc('day', min(ts)) AS DATE) AS day FROM ev GROUP BY element),
    per AS (SELECT day, count(*) AS n FROM firsts GROUP BY day)
    SELECT CAST(day AS VARCHAR) AS day, CAST(n AS BIGINT) AS new_elements, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM per""",
)
def growth_curve(spark, d):
    firsts = events(spark, d).groupBy("element").agg(F.to_date(F.min("ts")).alias("day"))
    per = firsts.groupBy("day").agg(F.count("*").alias("new_elements"))
    # One row a day: the running total is over a small aggregate.
    return per.select(F.col("day").cast("string").alias("day"), "new_elements", F.sum("new_elements").over(Window.orderBy("day")).alias("total"))


A, B_, C_ = ("SELECT element FROM ev WHERE element LIKE '%{}%'".format(x) for x in ("1", "2", "3"))


@query(
    "semilattice_laws",
    f"""WITH {EV}, a AS ({A}), b AS ({B_}), c AS ({C_}),
    ab AS (SELECT * FROM a UNION SELECT * FROM b), ba AS (SELECT * FROM b UNION SELECT * FROM a), aa AS (SELECT * FROM a UNION SELECT * FROM a), da AS (SELECT DISTINCT * FROM a),
    l AS (SELECT * FROM ab UNION SELECT * FROM c), bc AS (SELECT * FROM b UNION SELECT * FROM c), r AS (SELECT * FROM a UNION SELECT * FROM bc)
    SELECT 'commutative' AS law, CAST((SELECT count(*) FROM (SELECT * FROM ab EXCEPT SELECT * FROM ba)) + (SELECT count(*) FROM (SELECT * FROM ba EXCEPT SELECT * FROM ab)) AS BIGINT) AS differences
    UNION ALL SELECT 'idempotent', CAST((SELECT count(*) FROM (SELECT * FROM aa EXCEPT SELECT * FROM da)) + (SELECT count(*) FROM (SELECT * FROM da EXCEPT SELECT * FROM aa)) AS BIGINT)
    UNION ALL SELECT 'associative', CAST((SELECT count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM r)) + (SELECT count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM l)) AS BIGINT)""",
)
def semilattice_laws(spark, d):
    ev = events(spark, d)
    a, b, c = (ev.where(F.contains("element", F.lit(x))).select("element") for x in ("1", "2", "3"))
    u = sets.distinct_union
    laws = {"commutative": (u(a, b), u(b, a)), "idempotent": (u(a, a), u(a)), "associative": (u(u(a, b), c), u(a, u(b, c)))}
    counts = [verify.union_oracle(x, y).select(F.lit(law).alias("law"), (F.col("loss") + F.col("phantom")).alias("differences")) for law, (x, y) in laws.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "monotone_snapshots",
    f"WITH {EV} SELECT CAST(count(*) AS BIGINT) AS lost FROM (SELECT element FROM ev WHERE ts < TIMESTAMP '{SPLIT}' EXCEPT SELECT element FROM ev WHERE ts < TIMESTAMP '{SPLIT}' + INTERVAL 1 DAY)",
)
def monotone_snapshots(spark, d):
    ev, at = events(spark, d), F.lit(SPLIT).cast("timestamp_ntz")
    return verify.monotone_losses(ev.where(F.col("ts") < at), ev.where(F.col("ts") < at + F.expr("interval 1 day"))).agg(F.count("*").alias("lost"))


CHAINS = [("whole", 0), ("whole", 1), ("whole", 2), ("gap", 0), ("gap", 2), ("headless", 1), ("single", 0)]


@query(
    "chain_contiguity",
    f"SELECT run, CAST(count(DISTINCT gen) AS BIGINT) AS found, CAST(max(gen) + 1 AS BIGINT) AS span, count(DISTINCT gen) = max(gen) + 1 AS contiguous FROM (VALUES {', '.join(map(str, CHAINS))}) v(run, gen) GROUP BY run",
)
def chain_contiguity(spark, d):
    return verify.chain_gaps(spark.createDataFrame(CHAINS, "run string, gen int"))


@query(
    "shard_count",
    f"SELECT CAST(max(gen) + 1 AS BIGINT) AS shards FROM (VALUES {', '.join(map(str, CHAINS))}) v(run, gen)",
)
def shard_count(spark, d):
    return metrics.shard_count(spark.createDataFrame(CHAINS, "run string, gen int"))


ANCHORS = [
    "my.app~v1.2~x.77.123.shard0",
    "my.app~r.77.10.shard0",
    "my.app~r.76.10.shard0",
    "other~r.76.1.shard0",
    "untagged.77.1.shard0",
    "my.app~r.77.1.shard1",
    "my.app~77.1.shard0",
    "my.app~r.x.1.shard0",
]
_P = N.ANCHOR.replace("'", "''")


@query(
    "reap_candidates",
    f"""WITH n AS (SELECT name FROM (VALUES {', '.join(f"('{a}')" for a in ANCHORS)}) v(name)),
    p AS (SELECT name, CASE WHEN regexp_matches(name, '{_P}') THEN regexp_extract(name, '{_P}', 1) END AS app_id, CASE WHEN regexp_matches(name, '{_P}') THEN regexp_extract(name, '{_P}', 2) END AS run_id,
    CASE WHEN regexp_matches(name, '{_P}') THEN regexp_extract(name, '{_P}', 3) END AS boot, CASE WHEN regexp_matches(name, '{_P}') THEN CAST(regexp_extract(name, '{_P}', 4) AS BIGINT) END AS pid FROM n)
    SELECT name, app_id, run_id, boot, pid, coalesce(app_id = 'my.app' AND (boot <> '77' OR pid <> 10), false) AS reap FROM p""",
)
def reap_candidates(spark, d):
    from unionlog.sources.reaper import plan_reap

    names = spark.createDataFrame([(a,) for a in ANCHORS], "name string")
    plan = plan_reap(names, "my.app", "77", spark.createDataFrame([(10,)], "pid bigint"))
    return plan.withColumn("boot", F.col("boot").cast("string"))


SHARD_FILES = ["a~r.1.2.shard0", "a~r.1.2.shard1", "a~r.1.2.shard12", "a~r.1.2.shardtmp.5.1", "a~r.1.2.shard0.tmp.9"]


@query(
    "shard_discovery",
    f"SELECT CAST(max(TRY_CAST(nullif(regexp_extract(name, '\\.shard([0-9]+)$', 1), '') AS BIGINT)) AS BIGINT) AS max_shard FROM (VALUES {', '.join(f"('{a}')" for a in SHARD_FILES)}) v(name)",
)
def shard_discovery(spark, d):
    return spark.createDataFrame([(a,) for a in SHARD_FILES], "name string").agg(F.max(N.shard_suffix(F.col("name"))).alias("max_shard"))


APP_IDS = ["my-app", "my.app", "", "a~b", "a/b"]


@query(
    "valid_app_id",
    f"SELECT app_id, length(app_id) > 0 AND NOT contains(app_id, '~') AND NOT contains(app_id, '/') AS valid FROM (VALUES {', '.join(f"('{a}')" for a in APP_IDS)}) v(app_id)",
)
def valid_app_id(spark, d):
    return spark.createDataFrame([(a,) for a in APP_IDS], "app_id string").select("app_id", N.valid_app_id(F.col("app_id")).alias("valid"))


@query("segment_names", "SELECT 'app-' || n_regionkey || '~' || n_name || '.' || 77 || '.' || n_nationkey AS name FROM nation")
def segment_names(spark, d):
    n = table(spark, d, "nation")
    return n.select(N.segment_base(F.concat(F.lit("app-"), F.col("n_regionkey").cast("string")), F.col("n_name"), F.lit(77), F.col("n_nationkey")).alias("name"))


@query(
    "p99_nearest",
    "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT coalesce(max(value), 0.0) AS p FROM r WHERE rn = least(n, n * 99 // 100 + 1)",
)
def p99_nearest(spark, d):
    return metrics.nearest_rank(table(spark, d, "events"), "value")


def _stream(spark, d, build, schema: str) -> DataFrame:
    from unionlog.streaming.ingest import drain

    raw = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    out = fresh_folder(spark)
    drain(build(raw.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("element"))), f"{out}/rows", f"{out}/state")
    return spark.read.schema(schema).parquet(f"{out}/rows")


@query("streaming_dedup", ORACLES["snapshot_distinct"])
def streaming_dedup(spark, d):
    from unionlog.streaming.ingest import distinct_stream

    return _stream(spark, d, distinct_stream, "element string")


@query(
    "streaming_status",
    f"WITH {EV} SELECT 'inserted' AS status, CAST(count(DISTINCT element) AS BIGINT) AS n FROM ev UNION ALL SELECT 'exists', CAST(count(*) - count(DISTINCT element) AS BIGINT) FROM ev",
)
def streaming_status(spark, d):
    from unionlog.streaming.ingest import status_stream

    return _stream(spark, d, status_stream, "element string, status string").groupBy("status").agg(F.count("*").alias("n"))


@query(
    "bench_storm",
    "WITH s AS (SELECT p.range AS producer, 'dep-' || i.range || '.h' AS element FROM range(0, 6) p, range(0, 40) r, range(0, 5000) i) SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT element) AS BIGINT) AS distinct_elements, CAST(count(*) AS DOUBLE) / CAST(count(DISTINCT element) AS DOUBLE) AS ratio FROM s",
)
def bench_storm(spark, d):
    return metrics.dedup_ratio(workload.probe_storm(spark))
