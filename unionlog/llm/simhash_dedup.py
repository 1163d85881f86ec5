"""SimHash near-duplicates, linked by the general pigeonhole principle.

Fingerprints: each 3-word shingle (n words is a parameter) is hashed to 64 bits; a bit of the fingerprint is
set if more than half of the hashes have it.

Links: with the 64 bits in m partitions and thresholds t_1..t_m (-1: skipped) whose (t_i + 1) add up to
radius + 1, two fingerprints within the radius agree to within t_i bits in some partition i. Bits that
go together are put in one partition (greedily by measured correlation), and the thresholds come from dynamic
programming on estimated numbers of candidates: for t=0 the measured pairs in equal buckets, for more the
chance that so few of the partition's bits differ. A fingerprint probes every value within t_i of its own in
partition i; candidates are verified on all 64 bits.

Distinct fingerprints only are linked, copies are joined back at the end. A bucket of over `BUCKET` fingerprints (its probes and its own)
makes no pairs: its fingerprints go another exact way, in which each is listed under itself and its 64 one-bit
variants (radius 2: two fingerprints are within two bits if and only if they share a listing). A listing
holds 65 fingerprints at most, so that way is linear however large a group of near copies is. It covers a radius
of up to 2, as do links().

Nulls: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a
shingle are hashed as one sequence. A null doc_id takes part; a component of nothing but null ids has a
null component_id. Repeated rows get equal results.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlog.llm import shingle_join
from unionlog.llm.common import byte_texts, cut, spread, table, text_or_empty, trimmed
from unionlog.llm.components import components

BITS = 64
SEED = 42
RADIUS = 2
SHINGLE, STAGE_SHINGLE = 3, 5
#: Fingerprints of a bucket up to which its pairs are made one by one: at most four rows for each entry.
BUCKET = 8
#: Hashes turned into bit counts at a time.
BLOCK = 1 << 14
PARTITION_COUNTS = (2, 3)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 bits, lowest first, how many hashes have it."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += block.sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 text. bytes.split() and .lower() act on ASCII only, as wanted.

    A shingle of 0 words stands for the set of the text's words, whatever their order and number.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if not shingle:
        pieces = set(words)
    else:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else (b" ".join(words),)
    hashes = np.fromiter((xxh64_intdigest(p, SEED) for p in pieces), np.uint64)
    set_bits = 2 * bit_counts(hashes) > len(hashes)
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingles: tuple[int, ...] = (SHINGLE,), key: str = "doc_id") -> DataFrame:
    """(key, fp, fp1, ...) of docs (key, text): the bits of a fingerprint for each size of shingle, as longs."""
    names = ["fp", *(f"fp{i}" for i in range(1, len(shingles)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch)
            values = [pa.array(np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64)) for n in shingles]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), *values], [key, *names])

    return docs.select(key, "text").mapInArrow(trimmed(run), f"{key} {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def correlations(fps: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Share of fingerprints with each bit, |correlation| of each two bits, and their number; over all rows.

    Each task adds up one 64 x 64 matrix; what reaches the driver is one matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = np.unpackbits(np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        i = np.arange(BITS * BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(both.ravel()), pa.array(np.full(BITS * BITS, n))], ["i", "together", "n"])

    sums = fps.select("fp").mapInArrow(trimmed(run), "i long, together long, n long").groupBy("i").agg(F.sum("together").alias("together"), F.sum("n").alias("n"))
    rows = sums.collect()  # 4096 rows whatever the input
    both, n = np.zeros(BITS * BITS), 1
    for r in rows:
        both[r.i], n = r.together, max(1, r.n)
    both = both.reshape(BITS, BITS) / n
    p = both.diagonal()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both - np.outer(p, p)) / np.outer(spread, spread)
    return p, corr, n if rows else 0


def grouped_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each grows by the bit that goes best with those it has."""
    left, out = set(range(BITS)), []
    for i in range(m):
        width = (BITS - sum(map(len, out))) // (m - i)
        group = [max(left, key=lambda b: (sum(corr[b, c] for c in left if c != b), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def chance_within(p: np.ndarray, bits: list[int], most: int) -> list[float]:
    """P(two fingerprints differ in at most t of these bits), t = 0..most, for independent bits."""
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for b in bits:
        q = 2 * p[b] * (1 - p[b])
        dist = dist * (1 - q) + np.concatenate([[0], dist[:-1]]) * q
    return list(np.cumsum(dist))


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost; costs[i][u] is partition i's for threshold u - 1; units are shared out whole."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for u, c in enumerate(row[: units - used + 1]):
                if used + u not in nxt or cost + c < nxt[used + u][0]:
                    nxt[used + u] = (cost + c, [*chosen, u - 1])
        best = nxt
    return best[units]


def variants(width: int, t: int) -> list[int]:
    """Masks of at most t of `width` bits."""
    return [sum(1 << i for i in c) for k in range(t + 1) for c in itertools.combinations(range(width), k)]


def value_of(bits: list[int], column: str = "fp"):
    """The partition's bits, packed."""
    parts = [F.shiftleft(F.shiftrightunsigned(F.col(column), b).bitwiseAND(F.lit(1).cast("bigint")), i) for i, b in enumerate(bits)]
    out = parts[0]
    for x in parts[1:]:
        out = out.bitwiseOR(x)
    return out


def plan(fps: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """The partitions to probe, each with its threshold, at the least estimated cost."""
    p, corr, n = correlations(fps)
    options = []
    for m in PARTITION_COUNTS:
        groups = grouped_bits(corr, m)
        equal = fps.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), value_of(g).alias("v")) for i, g in enumerate(groups)))).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("c"))
        pairs = {r.i: float(r.pairs) for r in equal.groupBy("i").agg((F.sum(F.col("c").cast("double") * (F.col("c") - 1)) / 2).alias("pairs")).collect()}  # m rows
        costs = []
        for i, g in enumerate(groups):
            chance = chance_within(p, g, radius)
            measured = pairs.get(i, 0.0)
            row = [0.0]
            for t in range(radius + 1):
                probes = sum(math.comb(len(g), k) for k in range(t + 1)) * n
                row.append(probes + n + (measured if t == 0 else max(measured, n * n / 2 * chance[t])))
            costs.append(row)
        cost, thresholds = allocate(costs, radius + 1)
        options.append((cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with a > b: links that connect all distinct fingerprints within the radius of each other.

    Every pair from an ordinary bucket is there; from a hot bucket there is a star for each listing, which
    connects the same fingerprints.
    """
    if radius > 2:
        raise ValueError("the way for hot buckets covers a radius of 2")
    rows = []
    for i, (bits, t) in enumerate(plan(fps, radius)):
        own = value_of(bits)
        rows.append(fps.select("fp", F.lit(i).alias("i"), own.alias("v"), F.lit(False).alias("probe")))
        masks = F.array(*(F.lit(x).cast("bigint") for x in variants(len(bits), t)))
        rows.append(fps.select("fp", F.lit(i).alias("i"), own.alias("v0"), F.explode(masks).alias("mask")).select("fp", "i", F.col("v0").bitwiseXOR(F.col("mask")).alias("v"), F.lit(True).alias("probe")))
    entries = rows[0]
    for r in rows[1:]:
        entries = entries.unionByName(r)
    # A bucket matters if two different fingerprints meet in it.
    size = entries.groupBy("i", "v").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("i", "v", "n")
    met = cut(entries.join(cut(size), ["i", "v"]))
    small = met.where(F.col("n") <= 2 * BUCKET)
    a, b = small.where("probe").select("i", "v", F.col("fp").alias("a")), small.where("not probe").select("i", "v", F.col("fp").alias("b"))
    near = a.join(b, ["i", "v"]).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    pairs = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    hot = met.where(F.col("n") > 2 * BUCKET).select("fp").distinct()
    # 65 listings each; for a radius of 1 a verification keeps only those at one bit.
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(x - 2**64 if x >= 2**63 else x).cast("bigint") for x in (1 << i for i in range(BITS))))
    listed = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    least = listed.groupBy("at").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    stars = least.select(F.explode(F.slice("fps", 2, BITS + 1)).alias("a"), F.col("fps")[0].alias("b"))
    if radius < 2:
        each = least.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b"))
        stars = each.where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text)."""
    marked = cut(fingerprints(docs, (shingle,)))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps.select("fp"), radius))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.select("fp", "root").join(cut(ids), "root").select("fp", "component_id"))
    return marked.join(named, "fp")


def candidates(texts: DataFrame) -> DataFrame:
    """(a, b), a > b, of texts (id, text) with equal or linked fingerprints of STAGE_SHINGLE words, by one text of each fingerprint."""
    marked = cut(fingerprints(texts, (STAGE_SHINGLE,), "id").distinct())
    one = cut(marked.groupBy("fp").agg(F.min("id").alias("one")))
    found = links(one.select("fp"))
    end = lambda c: one.select(F.col("fp").alias(c), F.col("one").alias(f"one_{c}"))
    across = found.join(end("a"), "a").join(end("b"), "b").select(F.greatest("one_a", "one_b").alias("a"), F.least("one_a", "one_b").alias("b"))
    within = marked.join(one, "fp").where("id <> one").select(F.col("id").alias("a"), F.col("one").alias("b"))
    return across.unionByName(within)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles at a similarity of 0.8 or more.

    Fingerprints find the nearest copies; that similarity is some ten bits of 64 away, which no fingerprint tells from
    other texts, so each link is verified on the shingles, and links that are missing are added by a prefix filter.
    """
    return shingle_join.one_of_each(docs, candidates)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spread(table(spark, sf_dir, "documents", "doc_id", "text")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_dedup": op8_simhash_dedup}
ORACLES: dict[str, str] = {}
