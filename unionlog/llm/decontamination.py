"""Finds benchmark items in documents by q-gram lemma filtering and banded alignment.

Texts are compared in lower case, with everything but letters and digits as single spaces, as bytes. An item of m
bytes matches a passage within k edits: 10 % of m, or the most that the lemma can filter if that is less ((m - q) / q; it
is one edit less at 10 to 15, 20 to 23, 30 and 31 bytes). By the q-gram lemma such a passage shares at least
m - q + 1 - k q of the item's q-grams, on diagonals (place in text less place in item) that lie within 2k + 1 of
each other. So shared q-grams are counted in strips of 2k + 1 diagonals; each two neighbouring strips are a
band, bands overlap, and any such passage lies in one whole. Bands that reach the bound are verified by an
alignment of the item with the band's stretch of text that stays within the band's diagonals. Items of fewer than q bytes have
no q-gram: they match where they stand exactly and as whole words, found for all such items in one pass by an automaton.

The text's q-grams are looked up in a bit table first, as most are in no item. Items are broadcast in blocks of at
most `BLOCK_BYTES`; a larger benchmark takes more passes over the documents, not more memory. There is no
exchange, and every document is searched whole.

Nulls: a null text has no match, a null item or one without a letter or digit matches nothing, a null
doc_id or item_id is carried along. Repeated items match each; repeated rows are reported each. Of an item's
matches in a document the one of fewest edits, then the first, is reported. Very long texts are looked up a stretch at a
time, whole. Empty tables give no rows. Further columns are kept by `clean`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlog.llm.common import spread, table, trimmed

Q = 8
EDIT_SHARE = 0.1
BLOCK_BYTES = 2 << 20
TABLE_BITS = 22
#: Bytes of text whose q-grams are looked up at a time.
STRETCH = 1 << 20

_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split())


def grams(data: bytes) -> np.ndarray:
    """The Q bytes from each place as a number."""
    t = np.frombuffer(data, np.uint8)
    n = len(t) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.as_strided(t, (n, Q), (1, 1)).copy().view("<u8").ravel()


def budget(m: int) -> tuple[int, int]:
    """Edits allowed for an item of m bytes, and q-grams that a match must share (1 at least)."""
    k = min(int(EDIT_SHARE * m), (m - Q) // Q)
    return k, m - Q + 1 - k * Q


def aligned(item: bytes, text: bytes, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the best passage on the diagonals low..high, widened by k; None if over k edits.

    Row i holds, for each diagonal, the fewest edits of the item's first i bytes against a passage that ends there,
    and where that passage begins.
    """
    at = text.find(item, max(0, low), max(0, high + len(item)))
    if at >= 0:
        return 0, at, at + len(item)
    low, high = low - k, high + k
    width = high - low + 1
    # text place of column d in row i is i + low + d
    padded = np.full(width + len(item) + 1, 256, np.int16)
    begin, end = max(0, low), min(len(text), low + width + len(item))
    padded[begin - low : end - low] = np.frombuffer(text[begin:end], np.uint8)
    ahead = np.arange(width)
    far = 1 << 20
    # cost and start in one number, so that a minimum carries the start along (the smallest of equals)
    scale = 1 << 32
    place = low + ahead
    inside = (place >= 0) & (place <= len(text))
    row = np.where(inside, np.maximum(place, 0), far * scale)
    slope = ahead * scale
    up = np.full(width, far * scale)
    for i, c in enumerate(item):
        up[:-1] = row[1:]
        row = np.minimum(row + (padded[i : i + width] != c) * scale, up + scale)
        row = np.minimum.accumulate(row - slope) + slope
        ends = place + (i + 1)
        if ends[0] < 0 or ends[-1] > len(text):
            row[(ends < 0) | (ends > len(text))] = far * scale
    best = int(row.min())
    edits, start = best // scale, best % scale
    if edits > k:
        return None
    return edits, start, int(place[int(np.argmin(row))] + len(item))


def _automaton(items: list[tuple[int | None, bytes]]):
    """Finds items as whole words; None without items. A value is (text between spaces, ids of the items that read so)."""
    if not items:
        return None
    import ahocorasick

    ids: dict[bytes, list[int | None]] = {}
    for i, t in items:
        ids.setdefault(t, []).append(i)
    out = ahocorasick.Automaton()
    for t, own in ids.items():
        out.add_word(f" {t.decode('latin-1')} ", (len(t), own))
    out.make_automaton()
    return out


class Searcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.items = [(i, t) for i, t in items if len(t) >= Q]
        self.short = _automaton([(i, t) for i, t in items if 0 < len(t) < Q])
        self.budgets = [budget(len(t)) for _, t in self.items]
        parts = [grams(t) for _, t in self.items]
        keys = np.concatenate([*parts, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts]).astype(np.int64)
        place = np.concatenate([*(np.arange(len(p)) for p in parts), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        self.item, self.place, keys = item[order], place[order], keys[order]
        self.keys, first = np.unique(keys, return_index=True)
        self.ends = np.append(first, len(keys))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self._slot(self.keys)] = True
        self.strip = np.array([2 * k + 1 for k, _ in self.budgets], np.int64)
        self.need = np.array([t for _, t in self.budgets], np.int64)

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return (g * _MULTIPLIER) >> np.uint64(64 - TABLE_BITS)

    def _hits(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, diagonal, place in the item) of each shared q-gram."""
        items, diagonals, places = [], [], []
        for at in range(0, max(1, len(data) - Q + 1), STRETCH):
            g = grams(data[at : at + STRETCH + Q - 1])
            maybe = np.flatnonzero(self.table[self._slot(g)])
            i = np.searchsorted(self.keys, g[maybe])
            i = np.minimum(i, len(self.keys) - 1)
            real = self.keys[i] == g[maybe]
            i, p = i[real], maybe[real] + at
            times = self.ends[i + 1] - self.ends[i]
            posting = np.repeat(self.ends[i] - np.cumsum(times) + times, times) + np.arange(times.sum())
            items.append(self.item[posting])
            places.append(self.place[posting])
            diagonals.append(np.repeat(p, times) - places[-1])
        return np.concatenate(items), np.concatenate(diagonals), np.concatenate(places)

    def find(self, text: str) -> list[dict]:
        """Matches (item_id, begin, end, edits); places are in the normalised text."""
        data = normalised(text)
        return self._short(data) + self._long(data)

    def _short(self, data: bytes) -> list[dict]:
        if self.short is None:
            return []
        first: dict[int, tuple[int, int, list[int | None]]] = {}
        # A character a byte; places are one on by the space in front, and `end` is that of the space behind.
        for end, (size, own) in self.short.iter(f" {data.decode('latin-1')} "):
            first.setdefault(id(own), (end - 1 - size, size, own))
        return [{"item_id": i, "begin": at, "end": at + size, "edits": 0} for at, size, own in first.values() for i in own]

    def _long(self, data: bytes) -> list[dict]:
        if not len(self.keys) or len(data) < Q:
            return []
        item, diagonal, place = self._hits(data)
        if not len(item):
            return []
        key = (item << 40) + (diagonal // self.strip[item]) + (1 << 38)
        strips, counts = np.unique(key, return_counts=True)
        joined = counts.copy()
        neighbours = np.flatnonzero(strips[1:] == strips[:-1] + 1)
        joined[neighbours] += counts[neighbours + 1]
        of = strips >> 40
        bands = np.flatnonzero(joined >= self.need[of])
        if not len(bands):
            return []
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        best: dict[int, tuple[int, int, int]] = {}
        for c in bands:
            i = int(of[c])
            # A q-gram of the item counts once, however often the band's stretch of text has it.
            own = place[np.searchsorted(key, strips[c]) : np.searchsorted(key, strips[c] + 1, side="right")]
            if len(np.unique(own)) < self.need[i]:
                continue
            k, size = self.budgets[i][0], int(self.strip[i])
            low = (int(strips[c] & ((1 << 40) - 1)) - (1 << 38)) * size
            got = aligned(self.items[i][1], data, low, low + 2 * size - 1, k)
            if got is not None and (i not in best or got < best[i]):
                best[i] = got
        return [{"item_id": self.items[i][0], "begin": b, "end": e, "edits": d} for i, (d, b, e) in sorted(best.items())]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """Normalised items, at most BLOCK_BYTES together (a longer item is a block of its own), read as a stream."""
    block: list[tuple[int | None, bytes]] = []
    size = 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        item = (r.item_id, normalised(r.text))
        if block and size + len(item[1]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item[1])
    if block:
        yield block


FOUND = "array<struct<item_id:bigint,begin:bigint,end:bigint,edits:bigint>>"


def searched(rows: DataFrame, items: list[tuple[int | None, bytes]]) -> DataFrame:
    """(row, text) with the matches of a block of items as `found`."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("item_id", "begin", "end", "edits")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value)
        for batch in batches:
            row, text = (batch.column(batch.schema.get_field_index(c)) for c in ("row", "text"))
            found = [searcher.find(t) if t else [] for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([row, text, pa.array(found, kind)], ["row", "text", "found"])

    row_kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "text").mapInArrow(trimmed(run), f"row {row_kind}, text string, found {FOUND}")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, begin, end, edits) of every item found in every row of docs (doc_id, text)."""
    rows = docs.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id")).alias("row"), "text")
    parts = [searched(rows, b).select("row.doc_id", F.explode("found").alias("f")).select("doc_id", "f.*") for b in blocks(benchmark)]
    if not parts:
        return rows.where(F.lit(False)).select("row.doc_id", *(F.lit(0).cast("bigint").alias(c) for c in ("item_id", "begin", "end", "edits")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    for b in blocks(benchmark):
        rows = searched(rows, b).where(F.size("found") == 0).select("row", "text")
    return rows.select("row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spread(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "benchmark", "item_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLES: dict[str, str] = {}
