import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from unionlog.llm import quality_rules as Q

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    w = re.findall(WORD, text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def counts(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words string")
    rows = Q.counted(df).select("row.doc_id", "q.*").orderBy("doc_id").collect()
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]


TEXTS = [None, "", " ", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\n\nx\n \nx y\nx", "é ü #*$%&|<> 🙂 x", "a b c d a b c e a b c", "\x0b\x0c\r\n\t", "a\u0085b c"]


def test_counts(spark):
    assert counts(spark, TEXTS) == [brute(t) for t in TEXTS]


def test_counts_with_few_hash_bits(spark, monkeypatch):
    """With 61 of 64 bits for places, hashes mislead all the time and the exact way decides."""
    monkeypatch.setattr(Q, "PLACE_BITS", 61)
    texts = [*TEXTS, " ".join(f"w{i % 17}" for i in range(60)), " ".join(f"w{i * i % 23}" for i in range(80))]
    assert counts(spark, texts) == [brute(t) for t in texts]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = Q.op7_quality_rules(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {k: brute(t) for k, t in text.items()}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 1000), (0, 461), (20, 3000), (50, 1000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", Q.binomial_tail(F.col("k"), F.col("n"), 0.0125).alias("p"))
    for k, n, p in df.collect():
        exact = sum(math.comb(n, j) * 0.0125**j * 0.9875 ** (n - j) for j in range(k + 1))
        assert p == 1.0 if k > n * 0.0125 else math.isclose(p, exact, rel_tol=1e-9)


def labelled(spark, good, bad):
    rows = [("en", True, x, 0.0, 0.0, 0.0) for x in good] + [("en", False, x, 0.0, 0.0, 0.0) for x in bad]
    return spark.createDataFrame(rows, "stratum string, good boolean, symbols double, shouting double, dup_lines double, repeats double")


def test_cutoffs(spark):
    found = Q.certified_cutoffs(labelled(spark, [0.001] * 800, [0.2] * 50)).collect()
    assert len(found) == 1 and 0.1 < found[0].symbols < 0.2 and found[0].repeats is None
    # Too few good documents to certify anything.
    assert Q.certified_cutoffs(labelled(spark, [0.001] * 100, [0.2] * 50)).collect() == []
    # Good ones among the bad: the cutoff stays above them.
    assert all(r.symbols is None or r.symbols >= 0.19 for r in Q.certified_cutoffs(labelled(spark, [0.2] * 800, [0.2] * 50)).collect())


def plain_kept(docs, labels, limit=0.05, error=0.05):
    """Verdicts by the definition, in plain Python: docs (doc_id, text, lang), labels {doc_id: quality}."""
    rows = []
    for i, text, lang in docs:
        w, chars, symbols, dups, repeats = brute(text)
        lines = len([x for x in (text or "").split("\n") if re.search(WORD, x)])
        upper = len(re.findall("[A-Z]", text or ""))
        rows.append((i, lang, w < 50 or 100 * repeats > 50 * w, [symbols / max(chars, 1), upper / max(chars, 1), dups / max(lines, 1), repeats / max(w, 1)]))
    trials = {}
    for i, lang, failed, x in rows:
        if not failed and i in labels:
            old = trials.get((i, lang), x)
            trials[i, lang] = [max(a, b) for a, b in zip(old, x)]
    strata = {lang for _, lang in trials}
    a, level = limit / 4, error / max(1, 4 * len(strata))
    cut = {}
    for lang in strata:
        for rule in range(4):
            good = [x[rule] for (i, g), x in trials.items() if g == lang and labels[i] == 1]
            bad = [x[rule] for (i, g), x in trials.items() if g == lang and labels[i] != 1]
            for at in Q.GRID:
                k, hit, n = sum(x > at for x in good), sum(x > at for x in bad), len(good)
                p = sum(math.comb(n, j) * a**j * (1 - a) ** (n - j) for j in range(k + 1))
                gain = hit - Q.GOOD_COST * k
                if n and k <= n * a and p <= level and gain > 0 and gain >= cut.get((lang, rule), (0, 0))[0]:
                    cut[lang, rule] = (gain, at)
    return {(i, lang): not failed and not any(x[r] > cut[lang, r][1] for r in range(4) if (lang, r) in cut) for i, lang, failed, x in rows}


def test_verdicts_by_the_definition(spark):
    """Two languages and none, rows that repeat, labels for most: some rules certified, some not."""
    rng = random.Random(4)
    docs, labels = [], {}
    for i in range(2600):
        lang, good = rng.choice(["en", "en", "de", None, ""]), rng.random() < 0.8
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(45, 90))]
        if not good and rng.random() < 0.8:
            words = [w + rng.choice(["###", "$", ""]) for w in words]
        docs.append((i, " ".join(words) + ("\nsame line" * rng.randrange(3)), lang))
        if rng.random() < 0.9:
            labels[i] = int(good)
    docs += rng.sample(docs, 500) * 2
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    got = Q.judge(df, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).select("row.doc_id", "row.lang", "kept").collect()
    want = plain_kept(docs, labels)
    assert len(got) == len(docs) and {(r.doc_id, r.lang): r.kept for r in got} == want
    assert any(not k for (i, lang), k in want.items() if lang == "en") and not all(want.values())


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "w " * 60, None, "k"), (1, "w " * 60, None, "k"), (None, None, "en", None)], "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([(1, 1), (None, None)], "doc_id long, quality int")
    rows = Q.judge(docs, labels).select("row.*").where("kept is not null").collect()
    assert len(rows) == 2
    assert Q.judge(docs.limit(0), labels.limit(0)).count() == 0
