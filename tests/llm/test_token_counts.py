import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from unionlog.llm.token_counts import Merger, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    return Merger(PATH), Tokenizer.from_file(PATH)


def same(pair, text):
    assert pair[0].count(text) == len(pair[1].encode(text, add_special_tokens=False).ids), repr(text)


def test_fuzz(pair):
    rng = random.Random(7)
    alphabet = "abcdeéßñ İſς'’s re ve \u0085 　\x1c\x1d\x1f\x0b\x0c\t\n\r0129²٣!?.,<|>#中文字🙂👍🏽é"
    for _ in range(3000):
        same(pair, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))))


@pytest.mark.parametrize("text", ["", " ", "\n\n  ", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "don't WE'LL", "x" * 3000, "ab" * 2000, " " * 1000 + "x"])
def test_cases(pair, text):
    same(pair, text)


def test_long_piece_is_fast(pair):
    assert pair[0].count("ab" * 200_000) > 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tok = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    got = {r.doc_id: r for r in token_counts(docs, PATH).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got.values())


def test_nulls_ties_and_empty_tables(spark):
    schema = "doc_id long, text string, n_tokens string, n_bytes string"
    df = spark.createDataFrame([(1, None, "x", "y"), (1, None, "x", "y"), (None, "é", None, None)], schema)
    rows = sorted(token_counts(df, PATH).collect(), key=str)
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows] == [(1, 0, 0, False), (1, 0, 0, False), (None, 2, 1, False)]
    assert token_counts(df.limit(0), PATH).count() == 0
