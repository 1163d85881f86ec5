"""All texts of five-word shingle sets at Jaccard similarity 0.8 or more, exactly.

Prefix filter: a set of n shingles that is similar to another has at least `need` = ceil(0.8 n) in common with it, so
if all shingles stand in one order, the first n - need + 1 of both have one in common. The order is by the number of
texts that have the shingle, rarest first: shingles of one text only join nothing, and a passage that many texts have
is looked up only for texts that are made of little else. Numbers of texts are counted over the whole table.

Tokens (32 bits of a shingle's hash) and text numbers travel packed, dealt by ranges of tokens whose number grows with the
input. Two shingles of one token add a candidate at most: `need` counts shingles, and those that a text loses to
another of its own are taken off it. Candidates are verified on 64-bit hashes of all shingles.

Links: candidates of another search (SimHash) are verified first. Then texts at a token are compared with its first and
last text in the order of components, if these are of other components; then each two that are not yet
in one component and whose places in the order leave enough shingles to share (similar texts do at the first shingle they
share). That goes in rounds: texts have a place by hash, and a round compares those of the next places with all that are
not before them, so each two meet once. A round takes as many places as give a pair for each text at a token, or four times those of the
round before: most texts of a large group are in one component after the first rounds, whose pairs need not be made,
and nothing that is similar stays unlinked.

A text of fewer than five words is one shingle of all of them; null and wordless texts are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unionlog.llm.common import byte_texts, cut, drop_cut, partitions, text_or_empty, trimmed
from unionlog.llm.components import components

WORDS = 5
SEED = 42
#: Tokens that a task packs at a time; ranges of tokens for each partition of a shuffle; bytes of input for each of these.
PACKED, RANGES, PIECE = 1 << 18, 2, 1 << 22
#: Places that texts have in the order in which they are compared with all others; pairs that a round may always make.
PLACES, ROUND_PAIRS = 1 << 20, 1 << 14
#: Bits of the map that tells most texts which nobody asked for: 8 MB, however many texts there are.
MAP_BITS = 1 << 26
#: Rows of packed numbers: (text, token, number of texts with it), or if `whole` (text, its shingles, its tokens).
_PACK = "at int, whole boolean, ids binary, x binary, y binary"
_KINDS = (np.int64, np.uint32, np.uint32)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    pieces = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else (b" ".join(words),)
    return np.unique(np.fromiter((xxh64_intdigest(p, SEED) for p in pieces), np.uint64))


def need(n: np.ndarray) -> np.ndarray:
    """Shingles in common with any similar set, at least: 0.8 n, rounded up."""
    return (4 * n + 4) // 5


def _packed(at: np.ndarray, whole: bool, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each value of `at`."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = [*starts[1:], len(at)]
    packs = [[c[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] for c in (c[order].astype(k) if len(c) else c for c, k in zip(columns, _KINDS, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(at[starts], pa.int32()), pa.array([whole] * len(starts)), *(pa.array(p, pa.binary()) for p in packs)], ["at", "whole", "ids", "x", "y"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> dict[bool, list[np.ndarray]]:
    parts: dict[bool, list[list[np.ndarray]]] = {w: [[], [], []] for w in (False, True)}
    for batch in batches:
        for whole, mask in ((True, batch.column(1)), (False, pc.invert(batch.column(1)))):
            rows = batch.filter(mask)
            if rows.num_rows:
                for part, column, kind in zip(parts[whole], rows.columns[2:], _KINDS, strict=True):
                    # Values of a column lie one after the other.
                    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
                    data = column.buffers()[2]
                    part.append(np.frombuffer(bytes(memoryview(data)[ends[0] : ends[-1]]) if data else b"", kind))
    return {w: [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(part, _KINDS, strict=True)] for w, part in parts.items()}


def prefixes(texts: DataFrame) -> DataFrame:
    """(token, id, n, pos) of texts (id, text): the tokens at which a text meets all that are similar; n counts its shingles, pos those before."""
    plan = texts._jdf.queryExecution()
    leaves = plan.optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    # Tables that are not files have no size, or a made-up one.
    pieces = max(partitions(texts), size // PIECE if size < 1 << 50 else 4 * plan.toRdd().getNumPartitions())
    ranges = RANGES * pieces

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            ids = np.array(list(found), np.int64)
            n = np.array([x for x, _ in found.values()])
            own = np.array([len(t) for _, t in found.values()])
            tokens = np.concatenate([t for _, t in found.values()])
            yield _packed(tokens % ranges, False, np.repeat(ids, own), tokens, np.zeros(0))
            yield _packed(ids % ranges, True, ids, n, own)
            found.clear()

        size = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), byte_texts(batch), strict=True):
                if i in found:
                    continue
                hashes = shingles(text)
                tokens = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
                found[i] = (len(hashes), tokens)
                size += len(tokens)
                if size >= PACKED:
                    yield from out()
                    size = 0
        if found:
            yield from out()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of several texts, with the number of these; dealt by text."""
        every = _unpacked(batches)
        ids, tokens, _ = every.pop(False)
        order = np.lexsort((ids, tokens))
        ids, tokens = ids[order], tokens[order]
        once = np.ones(len(ids), bool)
        once[1:] = (ids[1:] != ids[:-1]) | (tokens[1:] != tokens[:-1])
        ids, tokens = ids[once], tokens[once]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        times = np.diff(np.append(starts, len(tokens)))
        times = np.repeat(times, times)
        several = times > 1
        if several.any():
            yield _packed(ids[several] % ranges, False, ids[several], tokens[several], times[several])
        if len(every[True][0]):
            yield _packed(every[True][0] % ranges, True, *every[True])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens of each text's prefix that other texts have."""
        every = _unpacked(batches)
        texts_of, at = np.unique(every[True][0], return_index=True)
        n, own = (c[at].astype(np.int64) for c in every[True][1:])
        ids, tokens, times = every[False]
        order = np.lexsort((tokens, times, ids))
        ids, tokens = ids[order], tokens[order]
        who = np.searchsorted(texts_of, ids)
        met = np.bincount(who, minlength=len(texts_of))
        # Tokens of no other text come first and fill the prefix up.
        most = n - need(n) + 1 - (own - met)
        place = np.arange(len(ids)) - (np.cumsum(met) - met)[who]
        kept = place < most[who]
        if kept.any():
            pos = (place + (own - met)[who])[kept]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[kept].astype(np.int64)), pa.array(ids[kept]), pa.array(n[who][kept]), pa.array(pos)], ["token", "id", "n", "pos"])

    dealt = texts.select("id", "text").mapInArrow(trimmed(deal), _PACK).repartition(pieces, "at")
    return dealt.mapInArrow(trimmed(shared), _PACK).repartition(pieces, "at").mapInArrow(trimmed(first), "token long, id long, n long, pos long")


def _asked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """texts whose id is in wanted (id).

    The ids' hashes are marked in a map of bits, of which each bucket of 32,768 bits is a row, and the map is broadcast. What
    it lets through is joined exactly, so that only texts that are likely wanted are exchanged, not the whole corpus.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    bit = F.bitmap_bit_position(place)
    # Dealt by bucket first: numbers are exchanged, not partly filled buckets.
    marks = wanted.select(F.bitmap_bucket_number(place).alias("bucket"), bit.alias("bit")).repartition("bucket")
    bits = marks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    placed = texts.withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("bit", bit)
    marked = F.expr("shiftright(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1")
    likely = placed.join(F.broadcast(bits.withColumnRenamed("bucket", "of")), (F.col("bucket") == F.col("of")) & marked, "left_semi")
    return likely.select(*texts.columns).join(wanted, "id", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of (a, b) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t).view(np.int64) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"])

    wanted = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    once = _asked(texts.select("id", "text"), wanted).groupBy("id").agg(F.first("text").alias("text"))
    sets = cut(once.mapInArrow(trimmed(run), "id long, hashes array<long>"))
    drop_cut(wanted)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("h")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("g")), "b")
    # i / (h + g - i) >= 0.8 in whole numbers.
    out = cut(both.where(9 * F.size(F.array_intersect("h", "g")) >= 4 * (F.size("h") + F.size("g"))).select("a", "b"))
    drop_cut(sets)
    return out


def similar(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node, root) for each id of texts (id, text) that is similar to another; root is the same for connected ones.

    Rows of one id have one text. candidates (a, b), a > b, from another search are verified first; what they connect is
    not looked at again here.
    """
    roots = cut(components(_verified(cut(candidates.distinct()), texts)))
    met = cut(prefixes(texts).withColumn("place", F.pmod(F.xxhash64("id"), F.lit(PLACES))))

    def rooted() -> DataFrame:
        return cut(met.join(roots, met.id == roots.node, "left").select(*met.columns, F.coalesce("root", "id").alias("root")))

    def linked(pairs: DataFrame) -> DataFrame:
        """The components with those of pairs that are similar; earlier ones are a link a text."""
        pairs = cut(pairs.distinct())
        more = _verified(pairs, texts)
        out = cut(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
        for df in (pairs, more, roots):
            drop_cut(df)
        return out

    now, whole = rooted(), F.struct("root", "id")
    ends = cut(now.groupBy("token").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi")).where("lo.root <> hi.root"))
    stars = now.join(ends, "token").select("root", "id", F.explode(F.array("lo", "hi")).alias("o")).where("root <> o.root")
    # One text of another component is enough for now, however many tokens they meet at.
    one = stars.groupBy("id", F.col("o.root").alias("to")).agg(F.min("o.id").alias("other"))
    roots = linked(one.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")))
    drop_cut(ends)
    low = width = 0
    while low < PLACES:
        drop_cut(now)
        now = rooted()
        later = now.where(F.col("place") >= low)
        # Tokens at which components meet, with their texts and with the pairs that are not in one component.
        met_by = later.groupBy("token", "root").agg(F.count("*").cast("double").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count("*").alias("roots"))
        mixed = cut(met_by.where("roots > 1").select("token", "n", ((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs")))
        texts_met, pairs_met = mixed.agg(F.sum("n"), F.sum("pairs")).first()
        if not pairs_met:
            break
        # As many pairs as there are texts at tokens, or four times the places of the round before.
        width = max(4 * width, int((PLACES - low) * min(1.0, max(ROUND_PAIRS, texts_met) / pairs_met)), 1)
        high = PLACES if 2 * width >= PLACES - low else low + width
        side = lambda df, s: df.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "pos", "root", "place")))
        a = side(later.where(F.col("place") < high).join(mixed.select("token"), "token", "left_semi"), "a")
        b = side(later, "b")
        # At the first shingle that two texts share, what follows in both must suffice for what similar texts have in common.
        close = 9 * F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= 4 * (F.col("n_a") + F.col("n_b"))
        once = (F.col("place_b") >= high) | (F.col("id_a") > F.col("id_b"))
        pairs = a.join(b, (a.token == b.token) & once & (F.col("root_a") != F.col("root_b")) & close)
        roots = linked(pairs.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")))
        drop_cut(mixed)
        low = high
    return roots


def one_of_each(docs: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs with one row of each group of similar texts: the one of least doc_id (nulls last, then by text hash). All columns are kept.

    search gives candidates (a, b) of texts (id, text); what it does not find is found here.
    """
    key = F.xxhash64(text_or_empty())
    texts = docs.select(key.alias("id"), "text")
    roots = similar(texts, search(texts))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("th").alias("th"))
    each = docs.select("doc_id", key.alias("th")).groupBy("th").agg(F.min(order).alias("first"))
    least = each.join(roots, each.th == roots.node, "left").groupBy(F.coalesce("root", "th").alias("root")).agg(F.min("first").alias("first"))
    kept = cut(least.select(F.col("first.doc_id").alias("k_doc_id"), F.col("first.th").alias("k_th")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("th"))
    out = rows.join(kept, rows.doc_id.eqNullSafe(kept.k_doc_id) & (rows.th == kept.k_th))
    # Rows that repeat as a whole: settled on the keys alone, as they are rare.
    if rows.count() > rows.select("doc_id", "th").distinct().count():
        out = out.dropDuplicates(["doc_id", "th"])
    return out.select("row.*")
