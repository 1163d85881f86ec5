"""Packs documents into training sequences, each filled with lexical neighbours of its first document.

A task works through its documents in shards of bounded size. A shard has a BM25 inverted index over its
documents' tokens. A sequence starts with a seed document; the documents not yet used that BM25 ranks highest for
the seed's terms, each once, fill its window in that order (those that match nothing come last), and the one
that does not fit is cut: what is left of it seeds the next sequence. Documents of a window or more give
whole windows first. What is left when a shard's tokens do not fill a window goes on to the task's next
shard; at the task's end it is dealt to sequences of descending powers of two, which need no padding.

No exchange: shards are made where the documents are read, so that the work and its memory are the same
however large the corpus is and wherever its rows came from. Sequence ids hold the number of the task's partition;
a task that runs again gives the same sequences.

Nulls: a null text is empty (a document of just the end id); a null doc_id stays null; repeated rows are
packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from unionlog.llm.common import Remembered, spread, table, trimmed
from unionlog.llm.token_counts import byte_alphabet

WINDOW = 4096
END_ID = 2
K1, B = 1.2, 0.75
#: A shard is closed at so many tokens or documents.
SHARD_TOKENS, SHARD_DOCS = 1 << 21, 1 << 15
#: Terms of more than one in so many documents of a shard are held as rows rather than postings.
DENSE = 8
#: Ranked neighbours at first; all are ranked where these do not fill the window.
FIRST_RANKED = 64

# Fixed pattern of the vocabulary's pre-tokenizer; white space is dropped.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


class WordTokenizer:
    """Ids of texts as the tokenizers library gives them for a vocabulary that merges within words only.

    The library's model encodes each distinct word once; the texts are put together from these.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words = regex.compile(PATTERN)
        self.known: dict[str, bytes] = _Words(self.library)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        # In Latin-1 composition changes nothing and lower case is the same everywhere.
        plain = text.isascii() or max(text) <= "\xff"
        text = text.lower() if plain else self.library.normalizer.normalize_str(text)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.words.findall(text))), np.uint32)


class _Words(Remembered):
    """Ids of words that are normalised already: the vocabulary's model sees them as byte characters."""

    def __init__(self, library):
        super().__init__()
        self.model = library.model
        self.characters = {b: c for c, b in byte_alphabet().items()}

    def __missing__(self, word: str) -> bytes:
        pieces = self.model.tokenize("".join(map(self.characters.__getitem__, word.encode())))
        ids = np.array([p.id for p in pieces], np.uint32).tobytes()
        return self.keep(word, ids, 4 * len(word) + len(ids))


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class InvertedIndex:
    """BM25 weights by term, for a shard's documents."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        keys = np.repeat(np.arange(n, dtype=np.int64), lengths) << 32 | np.concatenate(docs).astype(np.int64)
        keys.sort()
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        tf = np.diff(np.append(new, len(keys)))
        doc, term = keys[new] >> 32, keys[new] & 0xFFFFFFFF
        self.by_doc = np.searchsorted(doc, np.arange(n + 1))
        df = np.bincount(term)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        self.term, self.weight = term, (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        # Ids of 16 bits are sorted by radix.
        order = np.argsort(term.astype(np.uint16) if len(df) <= 1 << 16 else term, kind="stable")
        self.posted_doc, self.posted_weight = doc[order], self.weight[order]
        self.posted_at = np.concatenate([[0], np.cumsum(df)])
        self.size = n
        # Terms of many documents have a whole row of weights, no longer than DENSE times their postings.
        often = np.flatnonzero(df * DENSE > n)
        self.row = np.full(len(df), -1)
        self.row[often] = np.arange(len(often))
        at = np.flatnonzero(self.row[term] >= 0)
        self.rows = np.zeros((len(often), n), np.float32)
        self.rows[self.row[term[at]], doc[at]] = self.weight[at]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for all the distinct terms of one."""
        terms = self.term[self.by_doc[doc] : self.by_doc[doc + 1]]
        row = self.row[terms]
        terms = terms[row < 0]
        first = self.posted_at[terms]
        times = self.posted_at[terms + 1] - first
        at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        out = np.bincount(self.posted_doc[at], self.posted_weight[at], self.size).astype(np.float32)
        return out + self.rows[row[row >= 0]].sum(axis=0)

    def neighbours(self, doc: int, free: np.ndarray) -> Iterator[int]:
        """Free documents, best first, ties in order of place."""
        scores = np.where(free, self.scores(doc), -1)
        if FIRST_RANKED < self.size:
            top = np.argpartition(-scores, FIRST_RANKED)[:FIRST_RANKED]
            top = top[np.lexsort((top, -scores[top]))]
            yield from (int(i) for i in top if scores[i] >= 0)
            scores[top] = -1
        order = np.argsort(-scores, kind="stable")
        yield from (int(i) for i in order if scores[i] >= 0)


class Packer:
    """Sequences of one task. A piece is (doc_id, start, length, crc, doc_tokens, sequence_id, offset)."""

    def __init__(self, first_sequence: int):
        self.sequence = first_sequence
        self.open: list[list] = []  # [doc_id, ids, next place]
        self.tokens = 0
        self.pieces: list[tuple] = []

    def _piece(self, doc: list, length: int, offset: int) -> None:
        doc_id, ids, at = doc
        self.pieces.append((doc_id, at, length, zlib.crc32(ids[at : at + length].astype("<u4").tobytes()), len(ids), self.sequence, offset))
        doc[2] += length

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        doc = [doc_id, ids, 0]
        while len(ids) - doc[2] >= WINDOW:
            self._piece(doc, WINDOW, 0)
            self.sequence += 1
        if doc[2] < len(ids):
            self.open.append(doc)
            self.tokens += len(ids) - doc[2]
        if self.tokens >= SHARD_TOKENS or len(self.open) >= SHARD_DOCS:
            self.pack()

    def pack(self) -> None:
        """Fills windows while the shard's tokens last; the rest stays open."""
        docs, self.open = self.open, []
        index = InvertedIndex([ids[at:] for _, ids, at in docs]) if docs else None
        free = np.ones(len(docs), bool)
        seed = 0
        while self.tokens >= WINDOW:
            while not free[seed]:
                seed += 1
            self.tokens -= WINDOW
            free[seed] = False
            offset = self._take(docs[seed], 0)
            left = -1 if docs[seed][2] == len(docs[seed][1]) else seed
            if offset < WINDOW:
                for i in index.neighbours(seed, free):
                    free[i] = False
                    offset = self._take(docs[i], offset)
                    if offset == WINDOW:
                        left = -1 if docs[i][2] == len(docs[i][1]) else i
                        break
            self.sequence += 1
            if left >= 0:
                free[left] = True
                seed = left
            else:
                seed = 0 if not len(docs) else int(np.argmax(free))
        self.open = [d for d, f in zip(docs, free, strict=True) if f]

    def _take(self, doc: list, offset: int) -> int:
        length = min(WINDOW - offset, len(doc[1]) - doc[2])
        self._piece(doc, length, offset)
        return offset + length

    def close(self) -> None:
        """The last tokens, in sequences of powers of two."""
        self.pack()
        rest = iter(self.open)
        doc = next(rest, None)
        for size in (1 << i for i in reversed(range(WINDOW.bit_length())) if self.tokens >> i & 1):
            offset = 0
            while offset < size:
                while doc[2] == len(doc[1]):
                    doc = next(rest)
                length = min(size - offset, len(doc[1]) - doc[2])
                self._piece(doc, length, offset)
                offset += length
            self.sequence += 1
        self.open, self.tokens = [], 0


def pack(docs: DataFrame, vocabulary: str) -> DataFrame:
    """A row for each piece of docs (doc_id, text)."""
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 40)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).to_pylist()
            for doc_id, text in zip(ids, batch.column(batch.schema.get_field_index("text")).to_pylist(), strict=True):
                packer.add(doc_id, np.append(tokenizer.ids(text) if text else np.zeros(0, np.uint32), np.uint32(END_ID)))
            if packer.pieces:
                yield rows(packer.pieces)
                packer.pieces = []
        packer.close()
        if packer.pieces:
            yield rows(packer.pieces)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), ", ".join(f"{n} long" for n in names))


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents", "doc_id", "text")), _vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces; the pipeline's last stage."""
    return pack(docs, _vocabulary())


QUERIES = {"op3_retrieval_packing": op3_retrieval_packing}
ORACLES: dict[str, str] = {}
