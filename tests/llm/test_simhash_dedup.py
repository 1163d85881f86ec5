import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from unionlog.llm import simhash_dedup as S
from unionlog.llm.components import components


def brute_components(fps, radius=2):
    fps = list(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return {frozenset(g) for g in groups.values()}


def test_fingerprint_by_definition():
    from xxhash import xxh64_intdigest

    for text in ("", " \n", "one", "One TWO", "a b c d e f g a b c", "é É x y"):
        words = text.encode().lower().split()
        s = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
        hs = [xxh64_intdigest(x, 42) for x in s]
        want = sum(1 << b for b in range(64) if words and 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert S.fingerprint(text.encode()) == want
    assert S.fingerprint(("w1 w2 w3 w4 " * 20000).encode()) == S.fingerprint(("w1 w2 w3 w4 " * 20000).encode())


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("hot", [False, True])
def test_links_against_brute_force(spark, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(S, "BUCKET", 1)
    rng = random.Random(3)
    fps = set()
    for _ in range(120):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.randrange(4)):
            f ^= 1 << rng.randrange(64)
            if rng.random() < 0.7:
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = S.links(df)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    roots = {r.node: r.root for r in components(edges).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
    assert {frozenset(g) for g in groups.values()} == brute_components(fps)


def test_allocation_covers_radius():
    cost, thresholds = S.allocate([[0, 5, 9, 20], [0, 1, 2, 50], [0, 7, 8, 9]], 3)
    assert sum(t + 1 for t in thresholds) == 3 and cost == 2 + 5
    groups = S.grouped_bits(np.ones((64, 64)), 3)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_components_of_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame([*path, *star, (5, 5), (1000, 1001)], "a long, b long")
    roots = {r.node: r.root for r in components(df).collect()}
    assert all(roots[i] == 0 for i in range(61)) and all(roots[1000 + i] == 1000 for i in range(200)) and 5 in roots
    assert components(df.limit(0)).count() == 0


def test_nulls_copies_and_empty_tables(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(7, text, 1), (3, text, 1), (3, text, 1), (None, text, 1), (9, None, 1), (8, " ", 1), (2, "entirely other words stand here in a row", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (2, 2)], key=str)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = S.op8_simhash_dedup(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == {k: S.fingerprint(t.encode()) for k, t in text.items()}
    groups = {g: min(r.doc_id for r in got if int(r.fingerprint, 16) in g) for g in brute_components({int(r.fingerprint, 16) for r in got})}
    assert {r.doc_id: r.component_id for r in got} == {r.doc_id: next(m for g, m in groups.items() if int(r.fingerprint, 16) in g) for r in got}
