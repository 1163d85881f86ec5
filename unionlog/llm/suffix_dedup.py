"""Removes bytes that are covered by a 100-byte string which also starts earlier in the corpus.

"Earlier" is a smaller doc_id, or the same document and a smaller place. Strings are judged on the input.

1. Every 100-byte window chooses, of its 32-byte strings, the one of least hash (the leftmost of equals): its
   anchor. Equal windows choose equal anchors, so windows of different anchors need no comparison.
   Neighbouring windows mostly share their anchor: there is one run, with the segment of text it covers, for some 35 windows.
2. Anchors that occur once in the corpus are dropped (a combined count, written, then a join).
3. Runs of equal anchor and equal segment (64 bits of hash each, of different families) are settled by a combined
   minimum: all but the earliest lose all their windows. That covers the inner part of every copy, however often
   it occurs, and no text travels for it.
4. An anchor that is left with several segments has their bytes taken from the texts. They are dealt by anchor, so equal
   windows meet, and strung together into blocks of bounded size that hold whole anchors. A suffix array of the block by
   induced sorting and its permuted common prefixes show which windows are equal: the earliest of each keeps its
   bytes, the others lose theirs.
5. An anchor of over `HOT` segments does not go into a block, which would have no bound: its windows are dealt one by one by
   128 bits of hash, the earliest of equals from each task only, and the earliest of all stays.
6. The runs lost come back to their documents.

Each step ends in the shared folder; what it shuffled and what it has read for the last time are deleted then.

Nulls: a null text is empty; a null doc_id is earlier than any other. Rows of equal doc_id and equal text are the
same document: they are looked at once and get the same result; of equal doc_id and other text, that with the smaller text
hash is earlier. Texts under 100 bytes and empty tables lose nothing. Very long texts are hashed in stretches; any
bytes are allowed. Columns besides doc_id and text are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlog.llm.common import byte_texts, cut, drop_cut, partitions, spread, table, text_or_empty, trimmed
from unionlog.llm.suffix_sort import permuted_lcp, suffix_array

WINDOW = 100
ANCHOR = 32
#: Anchors are found in stretches of at most so many bytes (a place must fit the low bits of a hash).
PLACE_BITS = 20
STRETCH = (1 << PLACE_BITS) - 4 * WINDOW
#: Segments of an anchor up to which they are sorted together.
HOT = 256
#: Set in `runs` for an anchor with more.
HOT_BIT = 128
#: Bytes of a block that is suffix-sorted at once; a single anchor's segments can add up to HOT of them.
BLOCK = 1 << 20
#: Windows of hot anchors that a task compares before they are dealt.
REMEMBERED = 200_000
ROWS = 20_000
#: Stands between segments; never in UTF-8. Even where a text has it, windows are compared on their own bytes.
SEPARATOR = 0xFF

_RNG = np.random.default_rng(20240229)
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: A value for each byte and a base, for anchors and for segments.
FAMILIES = ((_RNG.integers(0, 2**64, 256, np.uint64), BASE), (_RNG.integers(0, 2**64, 256, np.uint64), np.uint64(0xC2B2AE3D27D4EB4F)))


@lru_cache(maxsize=2)
def _powers(base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for every place of a stretch."""
    out = []
    for b in (base, np.uint64(pow(int(base), -1, 2**64))):
        p = np.full(1 << PLACE_BITS, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _sums(t: np.ndarray, family: int) -> np.ndarray:
    values, base = FAMILIES[family]
    return np.concatenate([[np.uint64(0)], np.cumsum(values[t] * _powers(base)[0][: len(t)])])


def _hashed(sums: np.ndarray, begins, ends, family: int) -> np.ndarray:
    """Hashes of the strings between places, from sums over their stretch."""
    h = (sums[ends] - sums[begins]) * _powers(FAMILIES[family][1])[1][begins]
    h ^= h >> np.uint64(29)
    h *= MIX
    return h ^ (h >> np.uint64(32))


def anchor_hashes(t: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place."""
    n = len(t) - ANCHOR + 1
    return _hashed(_sums(t, 0), slice(0, n), slice(ANCHOR, None), 0)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, covers = values, 1
    while covers * 2 <= width:
        out = np.minimum(out[:-covers], out[covers:])
        covers *= 2
    rest = width - covers
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def window_anchors(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the stretch the place of its anchor; the anchors' hashes by place."""
    h = anchor_hashes(t)
    low = np.uint64((1 << PLACE_BITS) - 1)
    keyed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    return (sliding_least(keyed, WINDOW - ANCHOR + 1) & low).astype(np.int64), h


def anchored_runs(texts: list[bytes], segments: bool = True) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: index of the text, anchor's hash, first window, windows, and the segment's hash if wanted."""
    out: list[tuple[np.ndarray, ...]] = []
    pieces: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal pieces, size
        if not pieces:
            return
        t = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        lengths = np.array([len(p[2]) for p in pieces])
        begins = np.cumsum(lengths) - lengths
        anchors, h = window_anchors(t)
        piece = np.repeat(np.arange(len(pieces)), lengths)[: len(anchors)]
        at = np.arange(len(anchors))
        valid = at + WINDOW <= (begins + lengths)[piece]
        new = np.ones(len(anchors), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (piece[1:] != piece[:-1]) | ~valid[:-1]
        starts = np.flatnonzero(new & valid)
        run = np.cumsum(new & valid) - 1
        count = np.bincount(run[valid], minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
        of = piece[starts]
        found = (np.array([p[0] for p in pieces])[of], h[anchors[starts]], starts - begins[of] + np.array([p[1] for p in pieces])[of], count)
        out.append((*found, _hashed(_sums(t, 1), starts, starts + count + WINDOW - 1, 1)) if segments else found)
        pieces, size = [], 0

    for i, text in enumerate(texts):
        for at in range(0, len(text) - WINDOW + 1, STRETCH // 2):
            part = text[at : at + STRETCH // 2 + WINDOW - 1]
            if size + len(part) > STRETCH:
                flush()
            pieces.append((i, at, part))
            size += len(part)
    flush()
    if not out:
        return tuple(np.zeros(0, d) for d in (np.int64, np.uint64, np.int64, np.int64, np.uint64)[: 4 + segments])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(anchored_runs(byte_texts(batch), segments=False)[1].view(np.int64))], ["key"])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of, h, first, count, segment = anchored_runs(byte_texts(batch))
        take = pa.array(of)
        ids, hashes = (batch.column(batch.schema.get_field_index(c)).take(take) for c in ("doc_id", "th"))
        # Windows of one anchor are at most WINDOW - ANCHOR + 1, which fits seven bits.
        yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(h.view(np.int64)), pa.array(segment.view(np.int64)), pa.array(first << 8 | count)], ["doc_id", "th", "key", "seg", "runs"])


def runs_of(texts: DataFrame) -> DataFrame:
    """(doc_id, th, key, seg, runs) of all texts; runs is the first window above a free bit and seven bits of their number."""
    return texts.mapInArrow(trimmed(_run_rows), "doc_id long, th long, key long, seg long, runs long")


def _joined(rows: list[tuple]) -> list[tuple]:
    """Rows (doc_id, th, runs) in order, with runs that follow each other in one document made one."""
    out: list[tuple] = []
    for doc_id, th, runs in rows:
        if out and out[-1][:2] == (doc_id, th) and (out[-1][2] >> 8) + (out[-1][2] & 127) == runs >> 8 and (out[-1][2] & 127) + (runs & 127) < HOT_BIT:
            out[-1] = (doc_id, th, out[-1][2] + (runs & 127))
        else:
            out.append((doc_id, th, runs))
    return out


def _in_order(row: tuple) -> tuple:
    return (row[0] is not None, row[0] or 0, row[1], row[2])


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, runs, key, w2, segment) for each run of `hits`.

    Of anchors marked hot there is a row for each window, with its hash as (key, w2) and no segment; of equal windows that
    meet in the task only the earliest goes on, the others are rows without key or segment: lost.
    """
    from xxhash import xxh3_128_digest

    names = ("doc_id", "th", "runs", "key", "w2", "segment")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    out: list[tuple] = []
    hot: dict[bytes, tuple] = {}
    lost: list[tuple] = []

    def emit() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out.clear()
        return made

    def deal() -> None:
        out.extend((*row, int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True), None) for w, row in hot.items())
        out.extend((*row, None, None, None) for row in _joined(sorted(lost, key=_in_order)))
        hot.clear()
        lost.clear()

    for batch in batches:
        texts = byte_texts(batch)
        ids, hashes, hits = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "th", "hits"))
        for text, doc_id, th, own in zip(texts, ids, hashes, hits, strict=True):
            for hit in own:
                key, runs = hit["key"], hit["runs"]
                first, windows = runs >> 8, runs & 127
                segment = text[first : first + windows + WINDOW - 1]
                if not runs & HOT_BIT:
                    out.append((doc_id, th, runs, key, None, segment))
                    continue
                for i in range(windows):
                    row, at = (doc_id, th, (first + i) << 8 | 1), xxh3_128_digest(segment[i : i + WINDOW])
                    known = hot.setdefault(at, row)
                    if known is not row:
                        hot[at], late = (row, known) if _in_order(row) < _in_order(known) else (known, row)
                        lost.append(late)
            if len(hot) + len(lost) >= REMEMBERED:
                deal()
            while len(out) >= ROWS:
                yield emit()
    deal()
    if out:
        yield emit()


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs lost, from windows (doc_id, th, runs, key, w2) sorted by hash and then by place."""
    last = None
    for batch in batches:
        lost = []
        for *row, key, w2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, w2) == last:
                lost.append(tuple(row))
            last = (key, w2)
        lost = _joined(sorted(lost, key=_in_order))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*lost, strict=True) if lost else ([], [], []))], ["doc_id", "th", "runs"])


def lost_windows(segments: list[bytes], windows: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (segment, first, windows) of windows equal to an earlier one; rank orders the segments by place."""
    lengths = np.array([len(s) for s in segments]) + 1
    begins = np.cumsum(lengths) - lengths
    t = np.frombuffer(bytes([SEPARATOR]).join(segments) + bytes([SEPARATOR]), np.uint8)
    n = len(t)
    of = np.repeat(np.arange(len(segments)), lengths)
    offset = np.arange(n) - begins[of]
    valid = offset < windows[of]
    sa = suffix_array(t)
    fresh = np.zeros(n, bool)
    fresh[begins] = True
    lcp = permuted_lcp(t, sa, WINDOW + int(lengths.max()), fresh)
    group = np.cumsum(lcp[sa] < WINDOW)
    real = valid[sa]
    places, group = sa[real], group[real]
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = rank[of[places]] * (int(windows.max()) + 1) + offset[places]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    earliest = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.append(starts, len(order))))
    lost = np.zeros(n + 1, bool)
    lost[places[order != earliest]] = True
    edges = np.flatnonzero(lost[1:] != lost[:-1]) + 1
    edges = np.concatenate([[0], edges]) if lost[0] else edges
    firsts, ends = edges[::2], edges[1::2]
    return of[firsts], offset[firsts], ends - firsts


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs lost, from distinct segments (doc_id, th, runs, key, segment) sorted by key; a block holds whole keys."""
    block: list[tuple] = []
    size, last = 0, None

    def solve() -> pa.RecordBatch:
        rank = np.empty(len(block), np.int64)
        rank[sorted(range(len(block)), key=lambda i: _in_order(block[i]))] = np.arange(len(block))
        which, first, count = lost_windows([r[4] for r in block], np.array([r[2] & 127 for r in block], np.int64), rank)
        rows = [(block[i][0], block[i][1], (block[i][2] >> 8) + f << 8 | n) for i, f, n in zip(which.tolist(), first.tolist(), count.tolist(), strict=True)]
        block.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], ["doc_id", "th", "runs"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if row[3] != last:
                last = row[3]
                if size >= BLOCK:
                    yield solve()
                    size = 0
            block.append(row)
            size += len(row[4])
    if block:
        yield solve()


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as `row`, with the key (doc_id, th) of its document."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"))


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["d_doc_id"]) & (a["th"] == b["d_th"])


def _not_first(rows: DataFrame, firsts: DataFrame, *key: str) -> DataFrame:
    """(doc_id, th, runs) of the rows that share a key with an earlier one; firsts has been written, so hot keys are split."""
    mine = F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("th") == F.col("f_th")) & (F.col("runs") == F.col("f_runs"))
    return rows.join(firsts, list(key)).where(~mine).select("doc_id", "th", "runs")


def _firsts(rows: DataFrame, *key: str) -> DataFrame:
    """The earliest row of each key as (key, f_doc_id, f_th, f_runs)."""
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"), F.col("runs").alias("runs"))
    least = rows.groupBy(*key).agg(F.min(place).alias("f"))
    return least.select(*key, F.col("f.doc_id").alias("f_doc_id"), F.col("f.th").alias("f_th"), F.col("f.runs").alias("f_runs"))


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text) of the documents that are long enough, once each."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))
    texts = texts.where(F.octet_length("text") >= WINDOW)
    repeated = texts.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1")
    return texts if repeated.isEmpty() else cut(texts.groupBy("doc_id", "th").agg(F.first("text").alias("text")))


def lost_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, runs) of the windows whose bytes go, from docs (doc_id, text); written to the shared folder."""
    texts = _documents(docs)
    shared = cut(texts.mapInArrow(trimmed(_key_rows), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    repeated = cut(runs_of(texts).join(shared, "key"))
    drop_cut(shared)
    segments = cut(_firsts(repeated, "key", "seg"))
    several = cut(segments.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    run = F.when(F.col("n") > HOT, F.col("f_runs").bitwiseOR(F.lit(HOT_BIT))).otherwise(F.col("f_runs"))
    hits = segments.join(several, "key").groupBy(F.col("f_doc_id").alias("d_doc_id"), F.col("f_th").alias("d_th")).agg(F.collect_list(F.struct("key", run.alias("runs"))).alias("hits"))
    with_text = texts.join(hits, _same_document(texts, hits)).select("doc_id", "th", "text", "hits")
    rows = cut(with_text.mapInArrow(trimmed(_segment_rows), "doc_id long, th long, runs long, key long, w2 long, segment binary"))
    drop_cut(several)
    dealt = rows.where("segment is not null").select("doc_id", "th", "runs", "key", "segment").repartition(partitions(docs), "key").sortWithinPartitions("key")
    lost = dealt.mapInArrow(trimmed(_block_rows), "doc_id long, th long, runs long")
    windows = rows.where("segment is null and key is not null").select("doc_id", "th", "runs", "key", "w2")
    windows = windows.repartition(partitions(docs), "key").sortWithinPartitions("key", "w2", "doc_id", "th", "runs")
    hot = windows.mapInArrow(trimmed(_window_rows), "doc_id long, th long, runs long").unionByName(rows.where("key is null").select("doc_id", "th", "runs"))
    copies = _not_first(repeated, segments, "key", "seg")
    out = cut(copies.unionByName(lost).unionByName(hot))
    for done in (repeated, segments, rows):
        drop_cut(done)
    return out


def merged_spans(runs: list[int]) -> list[tuple[int, int]]:
    """The bytes that runs of windows cover: disjoint, not touching, in order."""
    out: list[tuple[int, int]] = []
    for run in sorted(runs):
        begin, end = run >> 8, (run >> 8) + (run & 127) + WINDOW - 1
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for begin, end in spans:
        parts.append(text[at:begin])
        at = end
    return b"".join([*parts, text[at:]])


def with_lost(docs: DataFrame) -> DataFrame:
    """(row, spans): each row of docs with its lost runs of windows as an array, null if none."""
    lost = lost_runs(docs)
    per = lost.groupBy(F.col("doc_id").alias("d_doc_id"), F.col("th").alias("d_th")).agg(F.collect_list("runs").alias("spans"))
    keyed = _keyed(docs)
    return keyed.join(per, _same_document(keyed, per), "left").select("row", "spans")


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, doc_id, found in zip(byte_texts(batch), batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            spans = merged_spans(found or [])
            rows.append((doc_id, len(text), sum(e - b for b, e in spans), len(spans), hashlib.sha256(without(text, spans)).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_lost(spread(table(spark, sf_dir, "documents", "doc_id", "text")))
    return found.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "row.text", "spans").mapInArrow(trimmed(_digest_rows), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans less the bytes of characters that lie in them in part only."""
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    out = []
    for begin, end in spans:
        while begin < end and inside(begin):
            begin += 1
        while end > begin and inside(end):
            end -= 1
        if end > begin:
            out.append((begin, end))
    return out


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose `spans` is set, with `text` shortened; other columns pass through."""
    for batch in batches:
        texts = []
        for text, found in zip(byte_texts(batch), batch.column(batch.schema.get_field_index("spans")).to_pylist(), strict=True):
            texts.append(without(text, whole_characters(text, merged_spans(found or []))).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(batch.schema.get_field_index("row"))], ["new_text", "row"])


def shortened(docs: DataFrame) -> DataFrame:
    """docs without their repeated bytes, in whole characters; a document of which no word is left goes.

    n_chars, if there is one, follows the text. Documents that lose nothing are passed on as they are.
    """
    found = with_lost(docs)
    kind = found.schema["row"].dataType.simpleString()
    changed = found.where("spans is not null").select("row.text", "row", "spans").mapInArrow(trimmed(_shortened), f"new_text string, row {kind}")
    changed = changed.where(F.col("new_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    columns = [(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return found.where("spans is null").select("row.*").unionByName(changed.select(*columns))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shortened(docs)


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES: dict[str, str] = {}
