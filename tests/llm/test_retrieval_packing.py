import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from unionlog.llm import retrieval_packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    return P.WordTokenizer(PATH), Tokenizer.from_file(PATH)


def test_ids_fuzz(pair):
    rng = random.Random(7)
    alphabet = "abcDEéßñÀ İſςΣ'’s re ve \u0085 　\x1c\x0b\t\n129²٣½ªµ!?.,<|>#中字🙂👍🏽éfiÅ"
    for _ in range(2500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 50)))
        assert list(pair[0].ids(text) if text else []) == pair[1].encode(text, add_special_tokens=False).ids, repr(text)
    for text in ("a<|endoftext|>b", "<|startoftext|>", "DON'T we'll", "'s's'S"):
        assert list(pair[0].ids(text)) == pair[1].encode(text, add_special_tokens=False).ids


def sound(pieces, ids_of):
    """Every id of every document in exactly one piece; sequences gapless; returns padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p[0]].append(p)
        sequences[p[5]].append(p)
    assert set(docs) == set(ids_of)
    for doc, own in docs.items():
        at, ids = 0, np.array(ids_of[doc], "<u4")
        for p in sorted(own, key=lambda p: p[1]):
            assert p[1] == at and p[2] > 0 and p[4] == len(ids) and p[3] == zlib.crc32(ids[at : at + p[2]].tobytes())
            at += p[2]
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at <= P.WINDOW
        padding += 0 if at & (at - 1) == 0 else P.WINDOW - at
    return padding


def test_whole_table(spark, pair):
    sf = "/root/testdata/sf0.001"
    ids = {r.doc_id: [*pair[1].encode(r.text, add_special_tokens=False).ids, 2] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = [tuple(r) for r in P.op3_retrieval_packing(spark, sf).collect()]
    assert sound(pieces, ids) == 0


@pytest.mark.parametrize("shard", [1 << 12, 1 << 14, 1 << 21])
def test_packer(monkeypatch, shard):
    monkeypatch.setattr(P, "SHARD_TOKENS", shard)
    rng = np.random.default_rng(1)
    packer = P.Packer(0)
    ids = {i: rng.integers(0, 500, int(n)).astype(np.uint32) for i, n in enumerate(rng.choice([1, 2, 50, 900, 4095, 4096, 4097, 9000], 150))}
    for i, x in ids.items():
        packer.add(i, x)
    packer.close()
    assert sound(packer.pieces, ids) == 0


def test_neighbours_by_hand():
    docs = [np.array(d, np.uint32) for d in ([1, 2, 3], [4, 5, 6], [1, 2, 9], [7, 7, 7], [1, 8, 8])]
    index = P.InvertedIndex(docs)
    free = np.array([False, True, True, True, True])
    assert list(index.neighbours(0, free)) == [2, 4, 1, 3]
    n, avg = 5, 3
    idf = lambda df: np.log1p((n - df + 0.5) / (df + 0.5))
    assert np.isclose(index.scores(0)[2], (idf(3) + idf(2)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / avg)))


def test_scores_against_brute_force():
    """BM25 of each document for all the distinct terms of another, by the formula; a document has up to 300 terms."""
    rng = np.random.default_rng(3)
    docs = [(rng.zipf(1.3, int(n)) % 2000).astype(np.uint32) for n in rng.integers(1, 900, 60)]
    index = P.InvertedIndex(docs)
    avg = np.mean([len(d) for d in docs])
    df = {t: sum(t in set(d.tolist()) for d in docs) for t in set(np.concatenate(docs).tolist())}
    assert max(len(set(d.tolist())) for d in docs) > 100
    for seed in range(0, 60, 7):
        want = []
        for d in docs:
            tf = dict(zip(*(x.tolist() for x in np.unique(d, return_counts=True)), strict=True))
            norm = P.K1 * (1 - P.B + P.B * len(d) / avg)
            want.append(sum(np.log1p((60 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (P.K1 + 1) / (tf[t] + norm) for t in set(docs[seed].tolist()) if t in tf))
        assert np.allclose(index.scores(seed), want, rtol=1e-4)
        free = np.ones(60, bool)
        free[seed] = False
        scores = index.scores(seed)
        assert list(index.neighbours(seed, free)) == sorted((i for i in range(60) if i != seed), key=lambda i: (-scores[i], i))


def test_related_documents_meet():
    packer = P.Packer(0)
    rng = np.random.default_rng(2)
    for i in range(80):
        packer.add(i, rng.integers(1000 * (i % 4), 1000 * (i % 4) + 300, 1024).astype(np.uint32))
    packer.close()
    groups = defaultdict(list)
    for p in packer.pieces:
        groups[p[5]].append(p[0] % 4)
    assert sum(len(set(g)) == 1 for g in groups.values()) >= 15


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "word", 5), (2, "", 5)], "doc_id long, text string, start int")
    got = sorted((tuple(r) for r in P.pack(df, PATH).collect()), key=str)
    assert sorted((p[0], p[4]) for p in got if p[0]) == [(1, 1), (2, 1)] and sum(p[2] for p in got) == sum({p[0]: p[4] for p in got}.values())
    assert P.pack(df.limit(0), PATH).count() == 0
