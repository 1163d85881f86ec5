import itertools
import random

import pytest

from unionlog.llm import shingle_join as J
from unionlog.llm import simhash_dedup


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)])


def brute_kept(texts):
    """doc_ids that stay of {doc_id: text}: the least of each component."""
    sets = {d: brute_shingles(t) for d, t in texts.items()}
    group = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {k: new if g == old else g for k, g in group.items()}
    return set(group.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 200]))] + (passage if rng.random() < 0.5 else [])
        texts.append(words)
        for _ in range(rng.randrange(5)):  # about 0.7 to 1, chains included
            words = list(words)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(words)
    rng.shuffle(texts)
    docs = dict(enumerate([*map(" ".join, texts), None, " \n", "A b", "a  B"]))
    out = simhash_dedup.stage(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), "")
    got = [r.doc_id for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_kept(docs)


def test_similarity_of_nine_tenths_and_of_less_than_four_fifths(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    changed = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    docs = {1: changed(), 2: changed(50), 3: changed(20, 50), 4: changed(0, 20, 50, 80, 103)}
    for pair in ((1, 2), (1, 3), (1, 4), (3, 4)):
        two = {d: docs[d] for d in pair}
        out = simhash_dedup.stage(spark, spark.createDataFrame(list(two.items()), "doc_id long, text string"), "")
        assert {r.doc_id for r in out.collect()} == brute_kept(two)


def test_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """400 copies of a text with up to four words changed: some 30,000 pairs when each outside the group met all of it."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(104)]
    docs = {0: " ".join(words)}
    for d in range(1, 401):
        changed = {rng.randrange(104) for _ in range(rng.randrange(1, 5))}
        docs[d] = " ".join(rng.choice("abcdefgh") if i in changed else w for i, w in enumerate(words))
    monkeypatch.setattr(J, "ROUND_PAIRS", 1, raising=False)
    seen = []
    verified = J._verified
    monkeypatch.setattr(J, "_verified", lambda pairs, texts: seen.append(pairs.count()) or verified(pairs, texts))
    out = simhash_dedup.stage(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "")
    assert {r.doc_id for r in out.collect()} == brute_kept(docs)
    assert sum(seen) < 12_000, seen


def test_repeated_rows_and_empty_tables(spark):
    t = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(3, t, "a"), (3, t, "b"), (None, t, "c"), (2, "else " + t[::-1], "d"), (4, None, "e")], "doc_id long, text string, fp string")
    out = J.one_of_each(df, simhash_dedup.candidates)
    assert out.columns == df.columns and sorted((r.doc_id, r.text is None) for r in out.collect()) == [(2, False), (3, False), (4, True)]
    assert J.one_of_each(df.limit(0), simhash_dedup.candidates).count() == 0


def test_asked(spark, monkeypatch):
    """Exactly the wanted texts, also where the map has few bits and lets others through."""
    ids = [0, 1, -1, 2**63 - 1, -(2**63), *range(100, 3000)]
    texts = spark.createDataFrame([(i, f"text {i}") for i in ids for _ in range(2)], "id long, text string")
    wanted = {i for i in ids if i % 7 == 0 or abs(i) < 2}
    for bits in (1 << 26, 1 << 16, 64):
        monkeypatch.setattr(J, "MAP_BITS", bits)
        got = J._asked(texts, spark.createDataFrame([(i,) for i in wanted], "id long")).collect()
        assert sorted((r.id, r.text) for r in got) == sorted((i, f"text {i}") for i in wanted for _ in range(2))
    assert J._asked(texts, spark.createDataFrame([], "id long")).count() == 0
    assert J._asked(texts.limit(0), spark.createDataFrame([(1,)], "id long")).count() == 0
