import random

import pytest

from unionlog.llm import decontamination as C


def edit_in(item, text):
    """Fewest edits of item against any passage of text."""
    row = [0] * (len(text) + 1)
    for c in item:
        nxt = [row[0] + 1]
        for j, d in enumerate(text):
            nxt.append(min(row[j] + (c != d), row[j + 1] + 1, nxt[j] + 1))
        row = nxt
    return min(row)


def test_against_full_alignment():
    rng = random.Random(9)
    letters = "abcdefghij  "
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    hits = 0
    for _ in range(60):
        item = C.normalised(make(rng.randrange(16, 90)))
        passage = list(item.decode())
        for _ in range(rng.randrange(0, 12)):
            at = rng.randrange(len(passage))
            passage[at : at + rng.randrange(2)] = rng.choice(["", "x", "yy"])
        text = make(rng.randrange(120)) + "".join(passage) + make(rng.randrange(120))
        k = C.budget(len(item))[0]
        want = edit_in(item, C.normalised(text))
        got = C.Searcher([(1, item)]).find(text)
        assert [g["edits"] for g in got] == ([want] if want <= k else []), (item, text)
        if got:
            hits += 1
            assert edit_in(item, C.normalised(text)[got[0]["begin"] : got[0]["end"]]) <= got[0]["edits"]
    assert hits > 10


def test_lemma():
    for m in range(C.Q, 500):
        k, need = C.budget(m)
        assert need >= 1 and need == m - C.Q + 1 - k * C.Q


ITEM = "What, then, is the capital of the old kingdom: north or south of the river?"


@pytest.mark.parametrize(
    ("text", "edits"),
    [(ITEM, 0), (f"intro {ITEM.upper()} outro", 0), (ITEM.replace(",", " -- "), 0), (ITEM.replace("capital", "capitol"), 1), (ITEM[:30], None), ("", None), (None, None), ("x" * 200_000 + ITEM, 0)],
)
def test_cases(text, edits):
    got = C.Searcher([(5, C.normalised(ITEM))]).find(text) if text else []
    assert [g["edits"] for g in got] == ([] if edits is None else [edits])


def test_short_items():
    """Items without a q-gram match as whole words, all of them, repeated ones too."""
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("aab \u00e9,") for _ in range(n))
    for _ in range(300):
        items = [(i, C.normalised(make(rng.randrange(6)))) for i in range(6)]
        text = make(rng.randrange(40))
        data = b" " + C.normalised(text) + b" "
        want = [(i, data.find(b" " + t + b" "), len(t)) for i, t in items if 0 < len(t) < C.Q and b" " + t + b" " in data]
        got = C.Searcher(items).find(text)
        assert sorted((g["item_id"], g["begin"], g["end"] - g["begin"]) for g in got if len(items[g["item_id"]][1]) < C.Q) == want
        assert all(data[1 + g["begin"] : 1 + g["end"]] == items[g["item_id"]][1] for g in got if g["edits"] == 0)


def test_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"a {ITEM} b", "x", "r"), (1, f"a {ITEM} b", "x", "r"), (None, ITEM, None, None), (2, None, "x", "r"), (3, "clean words of no benchmark at all", "x", "r")], "doc_id long, text string, found string, item_id string")
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "short"), (11, "--"), (None, ITEM), (10, "Entirely different question, never asked anywhere else")], "item_id long, text string")
    for size in (2 << 20, 10):
        monkeypatch.setattr(C, "BLOCK_BYTES", size)
        got = sorted(((r.doc_id, r.item_id) for r in C.matches(docs, bench).collect()), key=str)
        assert got == sorted([(1, 7), (1, 7), (None, 7), (1, None), (1, None), (None, None)], key=str)
        left = C.clean(docs, bench)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
    assert C.matches(docs.limit(0), bench).count() == 0 and C.matches(docs, bench.limit(0)).count() == 0
    assert C.clean(docs, bench.limit(0)).count() == 5


def test_planted_passages(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in C.op9_decontamination(spark, sf).collect()}
    items = [(r.item_id, C.normalised(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, C.normalised(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    exact = {(d, i) for d, t in docs for i, x in items if x in t}
    assert exact and exact <= got and len(got) <= len(exact) + 5
