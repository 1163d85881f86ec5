import hashlib
import random
import tempfile

import numpy as np
import pytest

from unionlog.llm import suffix_dedup as D
from unionlog.llm.suffix_sort import permuted_lcp, suffix_array


@pytest.mark.parametrize("alphabet", [b"ab", b"abc\xff\x00", bytes(range(256))])
def test_suffix_array_and_prefixes(alphabet):
    rng = random.Random(1)
    for _ in range(400):
        t = bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 70)))
        a = np.frombuffer(t, np.uint8)
        sa = suffix_array(a)
        assert list(sa) == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = permuted_lcp(a, sa, 10**6, np.zeros(len(t), bool))
        for x, y in zip(sa[:-1], sa[1:]):
            n = next((k for k, (p, q) in enumerate(zip(t[x:], t[y:])) if p != q), min(len(t) - x, len(t) - y))
            assert lcp[y] == n


def brute(docs):
    """docs: (doc_id, bytes) in order of doc_id; a set of 100-byte strings seen so far."""
    seen, out = set(), {}
    for doc_id, t in docs:
        lost = bytearray(len(t))
        for i in range(len(t) - 99):
            w = t[i : i + 100]
            if w in seen:
                lost[i : i + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i in range(len(t)) if lost[i] and (i == 0 or not lost[i - 1]))
        kept = bytes(c for c, x in zip(t, lost) if not x)
        out[doc_id] = (len(t), sum(lost), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(spark, df):
    with tempfile.TemporaryDirectory() as folder:
        df.select("doc_id", "text").write.parquet(f"{folder}/documents.parquet")
        got = D.op10_suffix_dedup(spark, folder).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}, len(got)


@pytest.mark.parametrize("hot", [256, 2, 1])
def test_random_corpora(spark, monkeypatch, hot):
    monkeypatch.setattr(D, "HOT", hot)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [rng.choice([" ".join(word() for _ in range(rng.randrange(30))), rng.choice(passages), rng.choice(passages)[7:150], "ab" * rng.randrange(120), "z" * rng.randrange(260)]) for _ in range(rng.randrange(5))]
        docs.append((i, "".join(parts)))
    docs += [(100 + i, docs[7][1]) for i in range(9)] + [(200, passages[0] * 3), (201, None), (202, "")]
    got, n = result(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert n == len(docs) and got == brute([(i, (t or "").encode()) for i, t in docs])


def test_long_texts_cross_stretches(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    docs = [(1, base), (2, "x" + base[400_000:900_000] + "y")]
    got, _ = result(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == brute([(i, t.encode()) for i, t in docs])


def test_nulls_ties_and_empty_tables(spark):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdefghij") for _ in range(300))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (4, "k")], "doc_id long, text string")
    got, n = result(spark, df)
    assert n == 4 and got[None][1] == 0 and got[5][1] == 300 and got[4][1] == 0
    assert result(spark, df.limit(0)) == ({}, 0)


def test_stage_keeps_columns_and_characters(spark):
    p = "é".join("abcdefgh"[i % 8] + str(i) for i in range(80))
    rows = [(1, "first " + p, "en", "s", 1), (2, "second " + p + " end", "en", "s", 1), (3, p, "en", None, 1), (4, None, None, None, None), (5, "other", "de", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = D.shortened(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 2, 4, 5} and got[1].text == rows[0][1] and got[5].text == "other"
    assert got[2].text.startswith("second") and got[2].text.endswith(" end") and "�" not in got[2].text and got[2].n_chars == len(got[2].text)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = D.op10_suffix_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(docs)


def test_thousands_of_repeated_rows_and_copies(spark):
    """5,000 rows of one document, 2,000 copies of its text under other ids: work and rows stay linear."""
    rng = random.Random(9)
    t = "".join(rng.choice("abcdefghij ") for _ in range(2000))
    rows = [(7, t)] * 5000 + [(100 + i, t) for i in range(2000)] + [(None, t[:700])] * 3
    got, n = result(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert n == len(rows) and got[None][1] == 0
    assert got[7][1:3] == (700, 1) and {got[100 + i][1:3] for i in range(2000)} == {(2000, 1)}
