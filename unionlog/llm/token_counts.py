"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token's bytes are a linked list of symbols; a heap holds the adjacent pairs that have a rank,
lowest rank first and leftmost of equals. Popping a pair merges it, which can make two new
pairs; entries whose symbols have changed meanwhile are skipped. The count is the number of initial
symbols less the merges; no identifiers are made. A pre-token of n bytes takes O(n log n), so one of a
whole very long text is no trouble.

Counts of pre-tokens met before are kept in a dictionary of bounded size, which is emptied when full.

A null text counts as empty (0 tokens). Repeated rows are counted each; a null doc_id stays null; an
empty table gives no rows. The vocabulary's special strings in a text are one token each.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from unionlog.llm.common import Remembered, spread, table, trimmed

LIMIT = 512
#: Pre-tokens whose count is remembered in a Python worker.
#: Longer texts are split by an iterator instead of into one list.
LIST_CHARS = 1 << 20

# Fixed pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others moved up from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(moved)}


class Merger:
    """Counts the tokens of a vocabulary in the JSON format of byte-level BPE."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        symbols = dict(byte_alphabet())
        # By pair of symbols its rank; by rank the pair and what it merges into.
        self.ranks: dict[tuple[int, int], int] = {}
        self.rules: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merged = symbols.setdefault(left + right, 256 + rank)
            self.ranks[symbols[left], symbols[right]] = rank
            self.rules.append((symbols[left], symbols[right], merged))
        self.split = regex.compile(PATTERN)
        special = [t["content"] for t in model.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.seen = _Remembered(self.merge)

    def merge(self, piece: str) -> int:
        """Tokens of one pre-token."""
        symbols: list[int] = list(piece.encode("utf-8", "surrogatepass"))
        n = count = len(symbols)
        if n == 1:
            return 1
        rank_of, rules = self.ranks.get, self.rules
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is one integer: the rank above the place, so that order is by rank, then from the left.
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = [(r << bits) | i for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & low
            left, right, merged = rules[entry >> bits]
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = merged, -1
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of((merged, symbols[k]))) is not None:
                    heapq.heappush(heap, (r << bits) | i)
            if (h := before[i]) >= 0 and (r := rank_of((symbols[h], merged))) is not None:
                heapq.heappush(heap, (r << bits) | h)
        return count

    def _plain(self, text: str) -> int:
        if len(text) > LIST_CHARS:
            return sum(self.seen[m[0]] for m in self.split.finditer(text))
        return sum(map(self.seen.__getitem__, self.split.findall(text)))

    def count(self, text: str) -> int:
        if self.special is None or not (found := self.special.findall(text)):
            return self._plain(text)
        return len(found) + sum(self._plain(part) for part in self.special.split(text))


class _Remembered(Remembered):
    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key: str) -> int:
        return self.keep(key, self.f(key), 4 * len(key))


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """One for each vocabulary in a Python worker, which runs many tasks."""
    return Merger(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs (doc_id, text). No exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(vocabulary)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            counts = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spread(table(spark, sf_dir, "documents", "doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
