"""Quality rules whose cutoffs are certified on labelled documents.

Every document gets counts from native expressions. Each rule compares a ratio of these with a
cutoff chosen per stratum (the language):

* the labelled good documents of a stratum are its holdout; for a cutoff, k of n of them exceed it;
* a cutoff is valid if P[Bin(n, a) <= k] <= d, the exact binomial test of "its false rejection rate
  is a or more". a is the stratum's limit divided by the number of rules, so that all rules together
  reject at most the limit; d is the error level divided by strata x rules (Bonferroni). Along the
  grid from lenient to strict k never falls, hence p-values never fall, and testing in that fixed
  order costs no further correction;
* among valid cutoffs, the one that rejects most labelled bad documents less `GOOD_COST` times the
  good ones, the most lenient of equals. A stratum too small to certify anything rejects nothing.

Only DataFrame functions are used.

Nulls: a null text has no words, so it fails the base rule; a null language is a stratum of its
own; a null doc_id has no label. Rows that repeat are judged alike, and are one trial of the tests. With no labels no
rule is certified, and only the base rule rejects; a table without rows gives none. Very long texts are counted whole.
Columns of the input that have names like ours are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unionlog.llm.common import cut, table, text_or_empty, words_of

#: Symbols that count as noise.
SYMBOLS = "#*$%&|<>"
PLACE_BITS = 20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Share of good documents that may be rejected in a stratum, and the chance that this fails anywhere.
LIMIT, ERROR = 0.05, 0.05
GOOD_COST = 5.0
GRID = [round(0.002 * 1.17**i, 6) for i in range(40)]
RULES = ("symbols", "shouting", "dup_lines", "repeats")


def _count(text: Column, chars: str) -> Column:
    """Characters of the text that are in the class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("bigint")


def _covered(starts: Column) -> Column:
    """Words in the union of the 3-word windows that begin at these sorted places."""
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(x.alias("last"), (a.n + F.least(F.lit(3), x - a["last"])).alias("n"))
    return F.aggregate(starts, zero, step, lambda a: a.n)


def _sorted_windows(w: str, n: str) -> Column:
    """The windows as (first, second, third, place), sorted: equal ones are neighbours."""
    part = lambda i: F.slice(w, i, F.greatest(F.col(n) - 2, F.lit(0)))
    return F.sort_array(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), F.sequence(F.lit(0), F.greatest(F.col(n) - 3, F.lit(0))).alias("i")))


def counted(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each row as `row` (a struct of all its columns, or of those to keep) with its counts in `q` (a struct).

    Repeated windows are found on longs, 44 bits of hash over 20 bits of place, which sort without boxing;
    windows of equal hash are then compared word by word, and a text in which a hash misleads, or with over
    2**20 words, is done over by sorting the words themselves.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), text_or_empty().alias("t"))
    split = rows.withColumn("w", words_of(F.col("t"))).withColumn("n", F.size("w"))
    low = (1 << PLACE_BITS) - 1
    places = F.sequence(F.lit(0), F.greatest(F.col("n") - 3, F.lit(0)))
    word = lambda i: F.get("w", i)
    key = lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint"))
    keyed = split.withColumn("s", F.sort_array(F.transform(places, key)))
    bucket = lambda x: F.shiftright(x, PLACE_BITS)
    near = F.filter("s", lambda x, p: (bucket(x) == bucket(F.get("s", p - 1))) | (bucket(x) == bucket(F.get("s", p + 1))))
    found = keyed.withColumn("near", near).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    differ = lambda a, b: (word(a) != word(b)) | (word(a + 1) != word(b + 1)) | (word(a + 2) != word(b + 2))
    misled = F.filter("near", lambda x, p: (bucket(x) == bucket(F.get("near", p - 1))) & differ(place(x), place(F.get("near", p - 1))))
    exact = (F.col("n") > low) | (F.size(misled) > 0)
    nothing = F.array().cast("array<struct<a:string,b:string,c:string,i:int>>")
    found = found.withColumn("x", F.when(exact, _sorted_windows("w", "n")).otherwise(nothing))
    same = lambda x, y: (x.a == y.a) & (x.b == y.b) & (x.c == y.c)
    twice = F.filter("x", lambda x, p: same(x, F.get("x", p - 1)) | same(x, F.get("x", p + 1)))
    starts = F.sort_array(F.when(F.size("x") > 0, F.transform(twice, lambda x: x.i)).otherwise(F.transform("near", place)))
    t = F.col("t")
    counts = F.struct(
        F.col("n").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        _count(t, SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _covered(starts).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        _count(t, "A-Z").alias("n_upper"),
    )
    return found.select("row", counts.alias("q"))


def stratum(lang: str) -> Column:
    """The language; null is one of its own, which no language is named like."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(""))


def base_failed(q: str = "q") -> Column:
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{q}.n_words"))


def ratios(q: str = "q") -> dict[str, Column]:
    """What each rule looks at; higher is worse."""
    share = lambda a, b: F.col(f"{q}.{a}") / F.greatest(F.col(f"{q}.{b}"), F.lit(1))
    return {"symbols": share("n_symbols", "word_chars"), "shouting": share("n_upper", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")}


def binomial_tail(k: Column, n: Column, a: float) -> Column:
    """P[Bin(n, a) <= k], exactly; 1 where k is over the mean, where no test could succeed."""
    first = n * F.log1p(F.lit(-a))
    odds = F.log(F.lit(a)) - F.log1p(F.lit(-a))
    start = F.struct(first.alias("term"), F.exp(first).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        term = acc.term + F.log((n - j + 1) / j) + odds
        return F.struct(term.alias("term"), (acc.total + F.exp(term)).alias("total"))

    js = F.when((k >= 1) & (k <= n * a), F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * a, F.lit(1.0)).otherwise(F.aggregate(js, start, step, lambda s: s.total))


def certified_cutoffs(labelled: DataFrame, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """(stratum, one nullable cutoff a rule) from rows (stratum, good, one ratio a rule)."""
    a = limit / len(RULES)
    grid = F.array(*(F.lit(g) for g in GRID))
    bin_of = lambda r: F.size(F.filter(grid, lambda g: F.col(r) > g))
    binned = labelled.select("stratum", "good", *(bin_of(r).alias(r) for r in RULES))
    # One row a rule: a fixed fan-out of four, folded to at most strata x rules x 41 rows.
    long = binned.select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("bin")) for r in RULES))).alias("x")).select("stratum", "good", "x.rule", "x.bin")
    counts = long.groupBy("stratum", "rule", "bin").agg(F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("bad"))
    frame = counts.select("stratum", "rule").distinct().select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.lit(len(GRID)))).alias("bin"))
    full = frame.join(counts, ["stratum", "rule", "bin"], "left").fillna(0, ["good", "bad"])
    each = Window.partitionBy("stratum", "rule")
    above = each.orderBy(F.desc("bin"))
    tests = full.select(
        "stratum", "rule", "bin", F.sum("good").over(above).alias("k"), F.sum("bad").over(above).alias("hit"), F.sum("good").over(each).alias("n")
    ).where(F.col("bin") > 0)
    # Rejecting bin and above is the cutoff GRID[bin - 1].
    level = labelled.select("stratum").distinct().agg((F.lit(error) / F.greatest(F.count("*") * len(RULES), F.lit(1))).alias("level"))
    valid = tests.join(F.broadcast(level)).where((F.col("n") > 0) & (binomial_tail(F.col("k"), F.col("n"), a) <= F.col("level")))
    gain = F.col("hit") - GOOD_COST * F.col("k")
    cutoff = F.get(grid, F.col("bin") - 1)
    best = valid.where(gain > 0).groupBy("stratum", "rule").agg(F.max_by(cutoff, F.struct(gain.alias("gain"), F.col("bin").alias("lenient"))).alias("cutoff"))
    return best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR, keep: list[str] | None = None) -> DataFrame:
    """(row, q, base_failed, kept) for each row of docs (doc_id, text, lang, ...).

    The counts are written once to the shared folder: calibration and verdicts both read them there.
    """
    spark = docs.sparkSession
    rows = cut(counted(docs, keep))
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    slim = rows.where(~base_failed()).select(F.col("row.doc_id").alias("doc_id"), stratum("row.lang").alias("stratum"), *(c.alias(r) for r, c in ratios().items()))
    # A document is one trial however often it is there, and fails a rule if any of its rows does.
    once = slim.join(marks, "doc_id").groupBy("doc_id", "stratum", "quality").agg(*(F.max(r).alias(r) for r in RULES))
    labelled = once.withColumn("good", F.col("quality") == 1)
    found = certified_cutoffs(labelled.select("stratum", "good", *RULES), limit, error)
    cutoffs = cut(found.select("stratum", *(F.col(r).alias(f"c_{r}") for r in RULES)))
    judged = rows.withColumn("stratum", stratum("row.lang")).join(cutoffs, "stratum", "left")
    rejected = F.lit(False)
    for rule, ratio in ratios().items():
        rejected = rejected | F.coalesce(ratio > F.col(f"c_{rule}"), F.lit(False))
    return judged.select("row", "q", base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    # The text is only read for its counts; what is written and joined is a few numbers a row.
    judged = judge(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), keep=["doc_id", "lang"])
    return judged.select("row.doc_id", *(f"q.{c}" for c in counts), "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return judge(docs, table(spark, sf_dir, "labels", "doc_id", "quality")).where("kept").select("row.*")


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES: dict[str, str] = {}
