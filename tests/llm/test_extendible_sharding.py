import hashlib

import duckdb

from unionlog.llm import extendible_sharding as X


def brute(rows, limit):
    """Split recursively; rows are (id, bytes)."""
    bits = lambda i: format(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), "060b")
    out = []

    def split(prefix, members):
        total = sum(n for _, n in members)
        if total <= limit or len(members) == 1 or len(prefix) == 60:
            out.extend((i, n, prefix, len(prefix), total, len(members), total > limit) for i, n in members)
            return
        for b in "01":
            if inside := [m for m in members if bits(m[0]).startswith(prefix + b)]:
                split(prefix + b, inside)

    if rows:
        split("", rows)
    return sorted(out, key=str)


def run(spark, rows, limit):
    df = spark.createDataFrame([(i, None if n is None else "x" * n, "s") for i, n in rows], "doc_id long, text string, shard string")
    return sorted((tuple(r) for r in X.sharded(df, limit).collect()), key=str)


def test_against_recursive_splitting(spark, monkeypatch):
    rows = [(i, i * 37 % 101) for i in range(200)]
    for levels in (20, 2):
        monkeypatch.setattr(X, "LEVELS", levels)
        for limit in (150, 100_000):
            assert run(spark, rows, limit) == brute(rows, limit)


def test_oversized_equal_ids_and_nulls(spark):
    rows = [(1, 500), (2, 10), (None, 0), (None, 90), (None, 90), (7, 60), (7, 60)]
    assert run(spark, rows, 100) == brute(rows, 100)
    assert run(spark, [(3, None)], 100) == [(3, 0, "", 0, 0, 1, False)]
    assert run(spark, [], 100) == []


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = X.op6_extendible_sharding(spark, sf)
    want = con.sql(X.ORACLES["op6_extendible_sharding"])
    cols = df.columns
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=str)


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    shards = X.write_shards(docs, str(tmp_path / "out"), 64 << 10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == shards.count()
