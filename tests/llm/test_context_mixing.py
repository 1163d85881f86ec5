import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from unionlog.llm import context_mixing as M


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def check(rows, got):
    train = Counter(w for i, t in rows if not is_held(i) for w in words(t))
    n, v = sum(train.values()), len(train)
    want = {}
    for i, t in rows:
        ws = words(t)
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want[i] = (is_held(i), len(ws), sum(train[w] > 0 for w in ws), n, base)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert math.isclose(r.base_score, w[4], rel_tol=1e-9, abs_tol=1e-9) and r.score < 0 and math.isfinite(r.score)


@pytest.mark.parametrize("common", [1 << 16, 20])
def test_whole_table(spark, monkeypatch, common):
    monkeypatch.setattr(M, "COMMON", common)
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = M.op5_context_mixing(spark, sf).collect()
    check(rows, got)
    out = [r for r in got if r.held_out]
    # Bits per token on texts not trained on: far under the 8 bits a byte of no model.
    assert -sum(r.score for r in out) / math.log10(2) < 3.5 * sum(len((t or "").encode()) for i, t in rows if is_held(i))


CODE = M.Code(np.bincount(np.frombuffer(b"the quick brown fox jumps over the lazy dog. " * 9, np.uint8), minlength=256))


def test_probabilities_add_up():
    """The chances of all 256 first bytes add up to one."""
    rng = np.random.default_rng(1)
    model = M.Model(rng.integers(0, 3, (M.ENTRIES, 2)).astype(np.uint32), frozenset(), CODE)
    shard = M.Shard([M.PLACES[0] + bytes([b]) for b in range(256)], rng.integers(0, 3, 256), model)
    shard.learn()
    x = np.stack([M._logit(a, b) for a, b in zip(shard.zeros, shard.ones)])
    gate = M._gate(shard.zeros[M.LASTS + 1] + shard.ones[M.LASTS + 1], shard.zeros[M.LASTS - 1] + shard.ones[M.LASTS - 1])
    z = shard._mixed(x, gate)
    p = np.clip(1 / (1 + np.exp(-z.astype(float))) + 0.5 * shard.correction[gate * M.BINS + M._bin(z)], 1e-6, 1 - 1e-6)
    chance = np.where(shard.bits.outcome, p, 1 - p)
    assert math.isclose(sum(float(np.prod(chance[shard.bits.row == b][: CODE.decisions[b]])) for b in range(256)), 1, abs_tol=1e-6)


def test_code_is_a_prefix_code():
    assert math.isclose(sum(2.0**-d for d in CODE.decisions), 1) and CODE.decisions[ord("e")] < CODE.decisions[0]
    paths = {tuple(zip(CODE.nodes[b, :d], CODE.outcomes[b, :d])) for b, d in enumerate(CODE.decisions)}
    assert len(paths) == 256 and CODE.nodes.max() < 256
    assert M.Code(np.zeros(256)).decisions.tolist() == [8] * 256


def test_contexts_do_not_depend_on_the_batch():
    keys = [M.PLACES[p] + w for p, w in [(0, b"alpha"), (1, b""), (17, b"beta"), (M.CONTINUED, b"x" * M.PIECE), (M.CONTINUED, b""), (3, "é".encode())]]
    together = M.Bits(keys, frozenset(), CODE)
    for i, key in enumerate(keys):
        alone = M.Bits([key], frozenset(), CODE)
        mine = together.row == i
        assert all((a[mine] == b).all() for a, b in zip(together.hashes, alone.hashes)) and (together.outcome[mine] == alone.outcome).all()


def plain_keys(markers, text):
    """Keys word by word, for texts without long words."""
    keys, kind, last, place = [], 0, 0, 0
    for w in text.lower().split():
        keys.append(M.PLACES[place] + w)
        if w in markers:
            group, number = markers[w]
            kind = group if group == last else kind
            last, place = group, 2 * kind * M.NAMED + number
        else:
            place = (2 * kind + (w[-1] in M.SIGNS)) * M.NAMED
    return [*keys, M.PLACES[place]]


def test_places_of_whole_texts_at_once():
    rng = random.Random(3)
    markers = {b"the": (1, 1), b"of": (1, 2), b"der": (2, 3), b"|": (2, 0), b"la": (3, 0)}
    word = lambda: rng.choice([*markers, b"The", b"x#", b"a%", b"stone", "über".encode(), b"end.", b"q" * 47])
    texts = [b""] + [rng.choice([b" ", b"\n", b"\x0b "]).join(word() for _ in range(rng.randrange(40))) + rng.choice([b"", b" "]) for _ in range(200)]
    tokens = M.Tokens(markers)
    words, places, extra = tokens.split(texts)
    got = M.bytes_of(words.t, places, words.begin, words.length).to_pylist()
    assert not extra and [[k for k, d in zip(got, words.doc) if d == i] for i in range(len(texts))] == [plain_keys(markers, t) for t in texts]
    assert [tokens.keys(t) for t in texts] == [plain_keys(markers, t) for t in texts]
    one, number = M._group(M.key_hashes(words.hash, places))
    assert [got[one[i]] for i in number] == got and len(one) == len(set(got))


def test_long_words_go_in_pieces():
    tokens = M.Tokens({b"the": (1, 1)})
    long = bytes(range(97, 123)) * 5
    keys = tokens.keys(b"the " + long + b" end")
    assert b"".join(k[2:] for k in keys[1:-3]) == long and all(len(k) == 2 + M.PIECE for k in keys[1:-4])
    assert [M.is_token(k) for k in keys] == [True, False, False, False, True, True, True] and len(tokens.keys(b"x" * (M.PIECE - 1))) == 2
    # A word of whole pieces ends with an empty one, which is not the end token.
    assert tokens.keys(b"y" * M.PIECE)[1] == M.PLACES[M.CONTINUED] and tokens.keys(b"y" * M.PIECE)[-1] == M.PLACES[0]


def test_same_scores_however_rows_are_dealt(spark, monkeypatch):
    """Other partitions, other numbers of shuffle partitions, split groups: scores follow from the rows alone."""
    monkeypatch.setattr(M, "SHARD", 1 << 10)
    monkeypatch.setattr(M, "GROUP", 50)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for pieces, shuffled in ((1, "3"), (5, "8")):
            spark.conf.set("spark.sql.shuffle.partitions", shuffled)
            got.append({r.doc_id: r for r in M.scored(docs.repartition(pieces)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    a, b = got
    assert a.keys() == b.keys() and len(M.split_groups(M.counted(docs.withColumn("out", M.F.lit(False)), M.Tokens({})))) > 0
    assert all(math.isclose(a[d].score, b[d].score, rel_tol=1e-9) and math.isclose(a[d].base_score, b[d].base_score, rel_tol=1e-9) for d in a)
    assert all(math.isclose(r.bits_per_byte * r.n_bytes, -r.score / math.log10(2), rel_tol=1e-9) for r in a.values() if r.n_bytes)


def test_better_than_the_base_on_held_out_texts(spark):
    out = [r for r in M.op5_context_mixing(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_split_groups_change_only_the_bounded_tables():
    """Counts of a context are the same above and below a split."""
    keys = [M.PLACES[0] + b"http" + bytes([97 + i % 26, 97 + i // 26]) for i in range(300)]
    times, size = np.arange(300) % 4, (M.ENTRIES, 2)
    seen = []
    for splits in (frozenset(), frozenset([b"htt"])):
        total = np.zeros(2 * M.ENTRIES)
        M.add_bounded(total, keys, times, splits, CODE)
        shard = M.Shard(keys, times, M.Model(total.reshape(size), splits, CODE))
        seen.append((shard.zeros, shard.ones))
    # Tables are hashed, so that a few entries may collide in one of the two.
    assert all((a == b).mean() > 0.97 for a, b in zip(*seen))


def test_nulls_and_empty_tables(spark):
    rows = [(i, f"the quick {i % 7} fox. THE end") for i in range(40)] + [(None, None), (100, ""), (101, "ünseen wörd " * 3), (102, "q" * 100_000), (103, "word " * 50_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    check(rows, M.scored(df).collect())
    assert M.scored(df.limit(0)).count() == 0
    twice = df.unionByName(df)
    got = M.scored(twice).collect()
    assert len(got) == 2 * len(rows)


def test_memory_of_a_shard(monkeypatch):
    """A decision takes what was counted for it (48 bytes) and about as much again, not all contexts' hashes and logits side by side."""
    rng = random.Random(5)
    keys = list(dict.fromkeys(M.PLACES[rng.randrange(4)] + bytes(rng.choices(b"etaoinshr", k=rng.randrange(3, 14))) for _ in range(12_000)))
    times = np.arange(len(keys)) % 3
    model = M.Model(np.zeros((M.ENTRIES, 2), np.uint32), frozenset(), CODE)
    decisions = len(M.Bits(keys, frozenset(), CODE).outcome)
    tracemalloc.start()
    got = M.scored_rows(keys, times, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130 * decisions
    for steps in (1, 7, 1000):
        monkeypatch.setattr(M, "STEPS", steps)
        assert all((a == b).all() for a, b in zip(got, M.scored_rows(keys, times, model)))


def test_counts_are_sent_in_parts(spark, monkeypatch):
    """A task's counts leave in batches of bounded rows, and add up to the same."""
    monkeypatch.setattr(M, "SENT", 64)
    sizes, tokens = [], M.Tokens({b"the": (1, 1)})
    texts = [f"the w{i % 300} x{i}" for i in range(500)]

    class Docs:
        def mapInArrow(self, run, kind):
            batch = M.pa.RecordBatch.from_pydict({"text": texts, "out": [i % 5 == 1 for i in range(500)]})
            out = list(run(iter([batch])))
            sizes.extend(b.num_rows for b in out)
            return spark.createDataFrame(M.pa.Table.from_batches(out))

    got = {bytes(r.key): (r.n, r.m) for r in M.counted(Docs(), tokens).collect()}
    want = Counter(k for t in texts for k in tokens.keys(t.encode()))
    learnt = Counter(k for i, t in enumerate(texts) if i % 5 != 1 for k in tokens.keys(t.encode()))
    assert got == {k: (learnt[k], m) for k, m in want.items()} and max(sizes) <= 64


def test_texts_go_to_python_by_bytes(spark, monkeypatch):
    """No batch of texts has much over BATCH_BYTES, and the setting is as it was afterwards."""
    sizes, before, whole = [], spark.conf.get(M.BATCHES), M.marked

    def nbytes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    def measured(docs):
        sizes.extend(r.n for r in docs.mapInArrow(nbytes, "n long").collect())
        return whole(docs)

    monkeypatch.setattr(M, "marked", measured)
    docs = spark.createDataFrame([(i, "word " * 20_000) for i in range(100)], "doc_id long, text string").coalesce(1)
    assert M.scored(docs).count() == 100 and spark.conf.get(M.BATCHES) == before
    assert sum(sizes) > 7_000_000 and max(sizes) < (2 << 20) + 200_000
