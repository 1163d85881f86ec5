"""Language-model scores by logistic context mixing, trained on the corpus itself.

A text is lower-cased (A-Z), split into words, and ends with one end token. A word is coded byte by byte and a space
after it, the end token as one newline; a word of `PIECE` bytes or more goes in pieces of that many and a last one. So all
texts' probabilities together do not exceed 1. A byte is a path of binary decisions in a tree that is drawn up from
how often bytes occur (frequent ones have short paths; any byte has one).

For each decision six hashed contexts are looked up in tables of zeros and ones counted over the training texts: the
last two, three and four bytes of the word with the language; all the word so far; that with the language; that with the
whole place. A place is the language, a sign at the end of the word before, and that word itself if it is one of the
most frequent: what stands before a word counts, not its spelling alone. Languages are groups of the most frequent
words that occur in the same texts, and a place is of the group that the last two such words agreed on.

The six logits, weighed by how much was counted, are added up with weights from the set that a gate selects (how often
the word so far, and its last four bytes, were seen). The weights are learnt online: a batch of words is predicted, each with
one occurrence of its own taken out, then moves the weights. A last table corrects predictions by gate and logit. The
result is refined on each text by a few experts: the mixer with flatter, equal or sharper logits, and a share for the rows
that the text has had before (a word comes again by how often it came, over the text's length; at a row's repeats the
better of both ways counts, which is a lower bound of their sum). The experts' average, each weighed by what it made of the text
itself (a Bayes mixture), is the text's probability. Minus its logarithm is the total bits.

How it grows. Training and scoring go by distinct (place, word) with counts, not by position. Contexts of a word so far
number as many as there are words, so these tables are sharded: words are dealt by their first bytes, and the shard
that has a group of words makes the tables of their contexts, of a size that follows the words it has. A group with over
`GROUP` rows is split by twice as many first bytes, and so on; the few contexts above a split are counted with the others of
bounded number (last bytes, first bytes) in tables of fixed size, which are broadcast. Every shard learns its own weights.
Shards are drawn up from the counts alone, so scores do not depend on how rows are partitioned or on the cluster.

The most frequent (place, word) rows, `COMMON` of them, are broadcast with their scores; the other words of the texts are
joined with theirs.

Nulls: a null text is empty (just its end token); a null doc_id is never held out; repeated rows are scored each. Very
long texts are read whole, and very long words go in pieces. With no training rows every table is empty and each decision
starts at one half. An empty table gives no rows. Columns besides doc_id and text are not looked at, so
their names cannot clash.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlog.llm.common import byte_texts, cut, drop_cut, held, is_held, partitions, spread, table, trimmed

MODULUS = 5
#: Rows broadcast with their scores.
COMMON = 1 << 18
#: The most frequent words (of at most so many bytes), from which groups of texts are made; groups; words that a place names.
MARKERS, MARKER_BYTES, GROUPS, NAMED = 256, 4, 8, 8
#: Bytes of a piece of a long word.
PIECE = 48
#: Rows of a shard on average, and of a group of words that is not split at most; first bytes that make a group.
SHARD, GROUP, FIRST = 1 << 11, 1 << 14, 3
#: log2 of the sizes of the tables of bounded contexts: last bytes, then first bytes.
TABLE_BITS = (19, 21, 21, 17, 19, 21)
CONTEXTS, LASTS = len(TABLE_BITS), 3
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])]).astype(np.int64)
ENTRIES = int(OFFSETS[-1])
CHUNK, BLOCK = 1 << 14, 1 << 14
GATES = 6 * 4
#: Where every shard's weights start: a tuned value for each context.
START = (0.15, 0.25, 0.25, 0.2, 0.3, 0.2)
RATE, BATCH_WORDS = 1.0, 100
#: Batches of a shard whose decisions are worked out at a time; and rows of counts that are sent at a time.
STEPS, SENT = 20, 1 << 15
BINS, BIN_WIDTH = 33, 0.5
#: Factors of the logits; and a text's experts: a factor's number, and the share of what comes again.
SHARPNESS = (0.8, 1.0, 1.2)
EXPERTS = ((1, 0.0), (1, 0.02), (1, 0.1), (0, 0.1), (2, 0.02), (0, 0.4))
#: Tokens that a task holds before it emits their counts, and bytes of text that are split at a time.
HELD, CHARS = 2_000_000, 1 << 19
#: Bytes of rows that go to Python at a time (Spark's own default is 64 MB): JVM and worker each hold them more than once.
BATCH_BYTES, BATCHES = "2m", "spark.sql.execution.arrow.maxBytesPerBatch"
LN10 = math.log(10)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C, 0xC0AC29B7C97C50DD], np.uint64)

#: Words that end in one of these mark the place after them.
SIGNS = frozenset(b"#*$%&|<>!")

#: Keys of rows: two bytes of place, then the piece. A place is (2 * language + sign) * NAMED + word before.
CONTINUED = 2 * (GROUPS + 1) * NAMED
WHOLE = CONTINUED + 1
PLACES = [i.to_bytes(2, "big") for i in range(WHOLE + 1)]


IS_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
IS_SIGN = np.isin(np.arange(256), list(SIGNS))


def pieces_of(place: int, word: bytes) -> list[bytes]:
    """Keys of a long word: its pieces, and the whole of it."""
    from xxhash import xxh3_128_digest

    rest = [PLACES[CONTINUED] + word[k : k + PIECE] for k in range(PIECE, len(word) + 1, PIECE)]
    return [PLACES[place] + word[:PIECE], *rest, PLACES[WHOLE] + xxh3_128_digest(word)]


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MIX, np.uint64(pow(int(_MIX), -1, 2**64))):
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def string_hashes(t: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each t[begin:end]; that of no bytes is zero."""
    # A run of texts ends with a space, so that it has up to a byte more.
    powers, inverse = _powers(CHARS + 1 if len(t) <= CHARS + 1 else 1 << len(t).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum((t + np.uint64(1)) * _MIX2 * powers[: len(t)])])
    h = (sums[ends] - sums[begins]) * inverse[begins]
    h ^= h >> np.uint64(29)
    return h * _MIX


def key_hashes(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    h = words + (places.astype(np.uint64) + np.uint64(1)) * _SALTS[2]
    h ^= h >> np.uint64(32)
    return h * _MIX2


@dataclass
class Words:
    """The words of some texts in order, each text's followed by an end token (no bytes)."""

    t: np.ndarray  # all bytes, in lower case
    doc: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    hash: np.ndarray


def words_of(texts: list[bytes], hashed: bool = True) -> Words:
    """Words of texts; markers are found without hashes."""
    joined = b" ".join([*texts, b""]).lower()
    t = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    stops = np.cumsum(sizes)
    space = np.concatenate([[True], IS_SPACE[t]])
    begins, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(space[1:] & ~space[:-1])
    doc = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], np.searchsorted(begins, stops)])))
    at = np.arange(len(begins)) + doc  # an end token before each later text
    last = np.searchsorted(begins, stops) + np.arange(len(texts))
    n = len(begins) + len(texts)
    out = Words(t, np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64))
    out.doc[at], out.doc[last] = doc, np.arange(len(texts))
    out.begin[at], out.begin[last] = begins, stops - 1
    out.length[at] = ends - begins
    if hashed:
        out.hash[at] = string_hashes(t, begins, ends)
    return out


def short_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Which words have one to MARKER_BYTES bytes, and these bytes with their number as one number."""
    at = np.flatnonzero((words.length > 0) & (words.length <= MARKER_BYTES))
    begin, length = words.begin[at], words.length[at]
    out = length << 8 * MARKER_BYTES
    for i in range(MARKER_BYTES):
        out |= np.where(length > i, words.t[np.minimum(begin + i, len(words.t) - 1)].astype(np.int64) << 8 * i, 0)
    return at, out


def chunks_of(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about CHARS bytes (a longer text is one of its own), with their place."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHARS:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, texts[first:]


def bytes_of(t: np.ndarray, places: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Keys as a column: two bytes of place, then t[begin:begin + length]."""
    offsets = np.concatenate([[0], np.cumsum(lengths + 2)])
    out = np.empty(offsets[-1], np.uint8)
    out[offsets[:-1]], out[offsets[:-1] + 1] = places >> 8, places & 255
    within = np.ones(offsets[-1], bool)
    within[offsets[:-1]] = within[offsets[:-1] + 1] = False
    out[within] = t[np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _group(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each of the different hashes, and each hash's number among these."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(hashes), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    del ordered
    number = np.empty(len(hashes), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[new], number


class Tokens:
    """Places of texts' words, given markers: word -> (group from 1, its number if a place names it, else 0)."""

    def __init__(self, markers: dict[bytes, tuple[int, int]]):
        words = list(markers)
        numbers = np.array([len(w) << 8 * MARKER_BYTES | int.from_bytes(w, "little") for w in words], np.int64)
        order = np.argsort(numbers)
        self.sorted = numbers[order]
        self.codes = np.array([markers[words[i]][0] * NAMED + markers[words[i]][1] for i in order], np.int64)
        self.numbers = order

    def marks(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are markers, and which they are in the order of `codes`."""
        at, number = short_words(words)
        if not len(self.sorted):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.sorted, number), len(self.sorted) - 1)
        real = self.sorted[i] == number
        return at[real], i[real]

    def places(self, words: Words) -> np.ndarray:
        n = len(words.doc)
        at, which = self.marks(words)
        after, doc = at + 1, words.doc
        code = np.zeros(n + 1, np.int64)  # of the marker before each place
        code[after] = self.codes[which]
        agree = np.zeros(n + 1, np.int64)
        both = (doc[at[1:]] == doc[at[:-1]]) & (code[after[1:]] // NAMED == code[after[:-1]] // NAMED)
        agree[after[1:][both]] = after[1:][both]
        last = np.maximum.accumulate(agree)[:n]
        first = np.searchsorted(doc, doc)
        kind = np.where(last > first, code[last] // NAMED, 0)
        signed = np.zeros(n, np.int64)
        real = np.flatnonzero(words.length[:-1] > 0)
        signed[real + 1] = IS_SIGN[words.t[words.begin[real] + words.length[real] - 1]]
        code = code[:n]
        return 2 * NAMED * kind + np.where(code > 0, code % NAMED, NAMED * signed)

    def keys(self, text: bytes) -> list[bytes]:
        """A text's keys one by one."""
        words = words_of([text])
        out: list[bytes] = []
        for place, begin, length in zip(self.places(words).tolist(), words.begin.tolist(), words.length.tolist(), strict=True):
            word = words.t[begin : begin + length].tobytes()
            out += [PLACES[place] + word] if length < PIECE else pieces_of(place, word)
        return out

    def split(self, texts: list[bytes]) -> tuple[Words, np.ndarray, list[tuple[int, bytes]]]:
        """Words under PIECE bytes with their places, and (text, key) of the pieces of the longer ones."""
        words = words_of(texts)
        places = self.places(words)
        longs = np.flatnonzero(words.length >= PIECE)
        if not len(longs):
            return words, places, []
        extra = [(int(words.doc[i]), k) for i in longs for k in pieces_of(int(places[i]), words.t[words.begin[i] : words.begin[i] + words.length[i]].tobytes())]
        short = words.length < PIECE
        return Words(words.t, words.doc[short], words.begin[short], words.length[short], words.hash[short]), places[short], extra


def is_token(key: bytes) -> bool:
    """Whether the row stands for a token, once: a word that is not in pieces, or a whole long one."""
    return key[:2] == PLACES[WHOLE] or (len(key) < 2 + PIECE and key[:2] != PLACES[CONTINUED])


def grouped(together: np.ndarray) -> np.ndarray:
    """Group of each marker, from their counts of common texts: the nearest of GROUPS centres by direction."""
    n = len(together)
    if n == 0:
        return np.zeros(0, np.int64)
    own = np.maximum(together.diagonal(), 1)
    rows = together / np.sqrt(np.outer(own, own))
    rows = rows - rows.mean(0)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    centres = [rows[0]]
    while len(centres) < min(GROUPS, n):  # the row that is farthest from all centres so far
        centres.append(rows[int(np.argmin(np.max(rows @ np.array(centres).T, axis=1)))])
    centre = np.array(centres)
    for _ in range(20):
        of = np.argmax(rows @ centre.T, axis=1)
        for g in range(len(centre)):
            if (of == g).any():
                mean = rows[of == g].mean(0)
                centre[g] = mean / max(np.linalg.norm(mean), 1e-9)
    return np.argmax(rows @ centre.T, axis=1)


class Code:
    """A prefix code for bytes, by how often each occurs: the decisions of each byte, their nodes and outcomes."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []  # inner nodes are numbered from 256
        while len(heap) > 1:
            (n, _, zero), (m, _, one) = heapq.heappop(heap), heapq.heappop(heap)
            children.append((zero, one))
            heapq.heappush(heap, (n + m, 255 + len(children), 255 + len(children)))
        paths: dict[int, list[tuple[int, bool]]] = {255 + len(children): []}
        for node in range(254 + len(children) + 1, 255, -1):
            for child, bit in zip(children[node - 256], (False, True), strict=True):
                paths[child] = [*paths[node], (node, bit)]
        self.decisions = np.array([len(paths[b]) for b in range(256)], np.int64)
        self.nodes, self.outcomes = np.zeros((256, self.decisions.max()), np.int64), np.zeros((256, self.decisions.max()), bool)
        for b in range(256):
            for j, (node, bit) in enumerate(paths[b]):
                self.nodes[b, j], self.outcomes[b, j] = node - 256, bit


#: A random number for each node, which is mixed into the hash of a context.
NODE_BITS = np.random.default_rng(3).integers(0, 2**63, 256, np.uint64)


def depth_of(word: bytes, splits: frozenset[bytes]) -> int:
    """How many first bytes deal the word to its group: doubled while these are a group that was split."""
    depth = FIRST
    while word[:depth] in splits and depth < PIECE:
        depth *= 2
    return depth


def coded_bytes(keys: list[bytes]) -> list[bytes]:
    """What is coded of each row: the word and a space, a newline for the end token, a piece that is not the last as it is."""
    end, last = PLACES[CONTINUED], PIECE + 2
    return [k[2:] if len(k) >= last else k[2:] + (b"\n" if len(k) == 2 and k != end else b" ") for k in keys]


class Bits:
    """The binary decisions of many rows: hashes of each context, outcome, row, and whether the context is above the row's group.

    There are some five decisions to a byte, so contexts are kept by byte, and hashes are made for one context at a time.
    """

    def __init__(self, keys: list[bytes], splits: frozenset[bytes], code: Code, wanted: range | None = None):
        coded = coded_bytes(keys)
        places = np.frombuffer(b"".join(k[:2] for k in keys), ">u2").astype(np.uint64)
        lengths = np.array([len(w) for w in coded], np.int64)
        raw = np.frombuffer(b"".join(coded), np.uint8)
        t = raw.astype(np.uint64)
        n = len(t)
        starts = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(keys)), lengths)
        within = np.arange(n) - starts[row]
        # Hash of the whole prefix: differences of sums, scaled back to the word's start.
        powers = np.full(n + 1, _MIX, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        inverse = np.full(n + 1, np.uint64(pow(int(_MIX), -1, 2**64)), np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((t + np.uint64(1)) * _MIX2 * powers[:n])])
        first = starts[row]
        prefix = (sums[:n] - sums[first]) * inverse[first] + within.astype(np.uint64) * _MIX2
        language = ((places // np.uint64(2 * NAMED))[row] + np.uint64(1)) * _SALTS[0]
        recent, contexts = np.zeros(n, np.uint64), []
        for k in range(1, LASTS + 2):
            recent = recent << np.uint64(8)
            recent[k:] += np.where(within[k:] >= k, t[: n - k], 0) if n > k else 0
            if k > 1:
                contexts.append(recent + language + np.uint64(k << 40))
        contexts += [prefix, prefix + language, prefix + (places[row] + np.uint64(1)) * _SALTS[1]]
        del powers, inverse, sums, first, prefix, language, recent
        self.contexts: list[np.ndarray | None] = []
        for k, c in enumerate(contexts):
            if wanted is not None and k not in wanted:
                self.contexts.append(None)
                continue
            base = (c + _SALTS[k]) * _MIX
            base ^= base >> np.uint64(31)
            self.contexts.append(base)
        contexts.clear()
        depth = np.array([depth_of(w, splits) for w in coded], np.int64)
        self.times = times = code.decisions[raw]
        self.above = np.repeat(within < depth[row], times)
        self.row = np.repeat(row.astype(np.int32), times)
        # A byte's decisions lie side by side in the code.
        step = np.repeat(raw * np.int64(code.nodes.shape[1]) - np.cumsum(times) + times, times)
        step += np.arange(len(step))
        self.outcome = code.outcomes.ravel()[step]
        self.node = code.nodes.ravel()[step].astype(np.uint8)

    def hash(self, k: int) -> np.ndarray:
        h = np.repeat(self.contexts[k], self.times)
        h ^= NODE_BITS[self.node]
        h *= _MIX2
        return h

    @property
    def hashes(self) -> list[np.ndarray | None]:
        return [None if c is None else self.hash(k) for k, c in enumerate(self.contexts)]

    def slot(self, k: int, bits: int) -> np.ndarray:
        return slots(self.hash(k), bits)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Entries of a table, in the place of the hashes."""
    hashes >>= np.uint64(64 - bits)
    return hashes.view(np.int64)


def add_bounded(total: np.ndarray, keys: list[bytes], times: np.ndarray, splits: frozenset[bytes], code: Code) -> None:
    """Counts rows into the tables of bounded contexts: zeros and ones of an entry side by side."""
    parts: list[Counter] = [Counter(), Counter()]
    for key, n in zip(keys, times.tolist(), strict=True):
        place = int.from_bytes(key[:2], "big")
        parts[0][PLACES[place // (2 * NAMED) * 2 * NAMED if place != CONTINUED else place] + key[2:]] += n
        word = key[2:]
        depth = depth_of(word, splits)
        # What of the word lies above its group, and whether that is all of it.
        parts[1][key[: 2 + depth]] += n
    for part, contexts in ((parts[0], range(LASTS)), (parts[1], range(LASTS, CONTEXTS))):
        if not part:
            continue
        bits, weight = Bits(list(part), splits, code, contexts), np.array(list(part.values()), np.float64)
        weight = weight[bits.row]
        for k in contexts:
            # A word cut at its group's depth would end there with a space; that decision is not above the group.
            used = slice(None) if k < LASTS else bits.above
            np.add.at(total, 2 * (bits.slot(k, TABLE_BITS[k])[used] + OFFSETS[k]) + bits.outcome[used], weight[used])


def _logit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a + b
    return np.log((b + np.float32(0.05)) / (a + np.float32(0.05))) * (total / (total + np.float32(0.4)))


def _gate(whole: np.ndarray, short: np.ndarray) -> np.ndarray:
    """By what the tables of the word so far and of the last four bytes have counted."""
    steps = lambda total, at: sum((total > x).astype(np.int8) for x in at)
    return (steps(whole, (0.5, 1.5, 3.5, 15.5, 127.5)) * np.int8(4) + steps(short, (0.5, 3, 20))).astype(np.int64)


def _bin(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z / BIN_WIDTH).astype(np.int64) + BINS // 2, 0, BINS - 1)


@dataclass
class Model:
    """What is broadcast: of bounded size, but for the first bytes of split groups (one for each GROUP rows at most)."""

    bounded: np.ndarray
    splits: frozenset[bytes]
    code: Code


class Shard:
    """Tables, weights and corrections of a shard's rows (keys and how often each is in the training texts).

    Of a decision only what was counted, its outcome and its row are kept; all else is made for `STEPS` batches at a time.
    """

    def __init__(self, keys: list[bytes], times: np.ndarray, model: Model):
        self.bits = bits = Bits(keys, model.splits, model.code)
        self.times, self.rows = times, len(keys)
        n = len(bits.outcome)
        above = bits.above
        below = ~above
        out = bits.outcome[below]
        self.zeros, self.ones = np.empty((CONTEXTS, n), np.float32), np.empty((CONTEXTS, n), np.float32)
        for k in reversed(range(CONTEXTS)):
            hashes = bits.hash(k)
            bits.contexts[k] = None
            if k >= LASTS:
                at = _group(hashes[below])[1]
                hashes = hashes[above]
                entry = 2 * at
                entry += out
                pair = np.bincount(entry, times[bits.row[below]], 2 * (int(at.max(initial=-1)) + 1)).astype(np.float32).reshape(-1, 2)
                del entry
                self.zeros[k, below], self.ones[k, below] = pair[at, 0], pair[at, 1]
                del at
            common = slice(None) if k < LASTS else above
            at = slots(hashes, TABLE_BITS[k])
            at += OFFSETS[k]
            pair = model.bounded[at]
            self.zeros[k, common], self.ones[k, common] = pair[:, 0], pair[:, 1]
            del hashes, at, pair
        bits.node = bits.above = None
        self.weights = np.tile(np.array(START, np.float32), (GATES, 1))
        self.correction = np.zeros(GATES * BINS)

    def _mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(len(gate), np.float32)
        for k in range(CONTEXTS):
            z += self.weights[:, k][gate] * x[k]
        return np.clip(z, -11, 11)

    def _blocks(self) -> Iterator[tuple[int, int, slice]]:
        """STEPS batches of rows at a time: first row, the one after the last, and their decisions."""
        for first in range(0, self.rows, STEPS * BATCH_WORDS):
            to = min(first + STEPS * BATCH_WORDS, self.rows)
            yield first, to, slice(*np.searchsorted(self.bits.row, np.array([first, to], np.int32)).tolist())

    def learn(self) -> None:
        """Online over the training rows, each predicted with one occurrence of its own taken out."""
        if not (self.times > 0).any():
            return
        weights = np.sqrt(self.times.astype(np.float64))
        seen = np.zeros((2, GATES * BINS))
        for first_row, to_row, part in self._blocks():
            row = self.bits.row[part]
            used = (self.times > 0)[row]
            outcome, row = self.bits.outcome[part][used], row[used]
            one = outcome.astype(np.float32)
            x = np.empty((CONTEXTS, len(row)), np.float32)
            for k in range(CONTEXTS):
                a, b = np.maximum(self.zeros[k, part][used] - (1 - one), 0), np.maximum(self.ones[k, part][used] - one, 0)
                x[k] = _logit(a, b)
                if k == LASTS - 1:
                    short = a + b
                elif k == LASTS + 1:
                    whole = a + b
            gate = _gate(whole, short)
            weight = weights[row]
            edges = np.searchsorted(row, np.arange(first_row, to_row + BATCH_WORDS, BATCH_WORDS, np.int32))
            for step, (at, to) in enumerate(zip(edges[:-1], edges[1:], strict=True), first_row // BATCH_WORDS):
                if at == to:
                    continue
                g, own = gate[at:to], x[:, at:to]
                z = self._mixed(own, g)
                error = one[at:to] - 1 / (1 + np.exp(-z))
                w = weight[at:to]
                moved, total = w * error, np.bincount(g, w, GATES) + 50
                for k in range(CONTEXTS):
                    self.weights[:, k] += (RATE / (1 + step / 50) * np.bincount(g, moved * own[k], GATES) / total).astype(np.float32)
                place = g * BINS + _bin(z)
                seen += np.stack([np.bincount(place, w * one[at:to], GATES * BINS), np.bincount(place, w, GATES * BINS)])
        centre = 1 / (1 + np.exp(-(np.arange(BINS) - BINS // 2) * BIN_WIDTH))
        prior = np.tile(centre, GATES)
        self.correction = (seen[0] + 50 * prior) / (seen[1] + 50) - prior

    def log10(self) -> np.ndarray:
        """log10 probability of each row by each factor."""
        out = np.zeros((len(SHARPNESS), self.rows))
        correction = (0.5 * self.correction).astype(np.float32)
        for first, to, part in self._blocks():
            zeros, ones = self.zeros[:, part], self.ones[:, part]
            x = np.empty_like(zeros)
            for k in range(CONTEXTS):
                x[k] = _logit(zeros[k], ones[k])
            gate = _gate(zeros[LASTS + 1] + ones[LASTS + 1], zeros[LASTS - 1] + ones[LASTS - 1])
            z = self._mixed(x, gate)
            moved = correction[gate * BINS + _bin(z)]
            outcome, row = self.bits.outcome[part], self.bits.row[part] - first
            for i, sharp in enumerate(SHARPNESS):
                p = np.clip(1 / (1 + np.exp(np.float32(-sharp) * z)) + moved, np.float32(1e-6), np.float32(1 - 1e-6))
                out[i, first:to] = np.bincount(row, np.log(np.where(outcome, p, 1 - p)), to - first) / LN10
        return out


def scored_rows(keys: list[bytes], times: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token count, 1 at a known token's first row, log10 by factor) of a shard's rows; all rows of a word are in one shard."""
    places = np.frombuffer(b"".join([k[:2] for k in keys]), ">u2")
    whole = places == WHOLE
    token = whole | ((np.fromiter(map(len, keys), np.int64, len(keys)) < 2 + PIECE) & (places != CONTINUED))
    logs = np.zeros((len(SHARPNESS), len(keys)))
    spelled = np.flatnonzero(~whole)
    if len(spelled):
        shard = Shard([keys[i] for i in spelled], times[spelled], model)
        shard.learn()
        logs[:, spelled] = shard.log10()
    numbers: dict[bytes, int] = {}
    # Digests of whole words keep their place, so that no word is taken for one.
    word = np.array([numbers.setdefault(k if w else k[2:], len(numbers)) for k, w in zip(keys, whole.tolist(), strict=True)], np.int64)
    count = np.where(token, np.bincount(word, times * token, len(numbers))[word], 0).astype(np.int64)
    first = np.zeros(len(keys), np.int64)
    known = np.flatnonzero(count)
    first[known[np.unique(word[known], return_index=True)[1]]] = 1
    return count, first, logs


def marker_words(docs: DataFrame) -> list[bytes]:
    """The most frequent short words of the training texts, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for _, texts in chunks_of(byte_texts(batch)):
                found, counts = np.unique(short_words(words_of(texts, hashed=False))[1], return_counts=True)
                for word, n in zip(found.tolist(), counts.tolist(), strict=True):
                    total[word.to_bytes(MARKER_BYTES + 1, "little")[: word >> 8 * MARKER_BYTES]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counts = docs.mapInArrow(trimmed(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(MARKERS).collect()]


def marked(docs: DataFrame) -> dict[bytes, tuple[int, int]]:
    """The markers of docs (text), for Tokens."""
    markers = marker_words(docs)
    find, n = Tokens({w: (0, 0) for w in markers}), len(markers)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n), np.int64)
        for batch in batches:
            for _, texts in chunks_of(byte_texts(batch)):
                words = words_of(texts, hashed=False)
                seen = np.zeros((len(texts), n), np.float32)
                at, which = find.marks(words)
                seen[words.doc[at], find.numbers[which]] = 1
                total += (seen.T @ seen).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(n * n)), "x": pa.array(total.ravel())})

    rows = docs.mapInArrow(trimmed(together), "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).collect()  # MARKERS squared
    both = np.zeros(n * n)
    for r in rows:
        both[r.i] = r.x
    groups = grouped(both.reshape(n, n)).tolist()
    return {w: (g + 1, i + 1 if i + 1 < NAMED else 0) for i, (w, g) in enumerate(zip(markers, groups, strict=True))}


def counted(docs: DataFrame, tokens: Tokens) -> DataFrame:
    """(key, n, m): times of each row in the training texts, and in all texts of docs (text, out)."""
    names = ("key", "n", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        size, held_tokens = 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            def whole(i: int) -> np.ndarray:
                joined = np.concatenate(parts[i])
                parts[i].clear()
                return joined

            one, number = _group(whole(1))
            n, m = np.bincount(number[whole(5)], minlength=len(one)), np.bincount(number, minlength=len(one))
            del number
            t, places, begins, lengths = whole(0), whole(2)[one], whole(3)[one], whole(4)[one]
            for at in range(0, len(one), SENT):
                s = slice(at, at + SENT)
                yield pa.RecordBatch.from_arrays([bytes_of(t, places[s].astype(np.int64), begins[s], lengths[s].astype(np.int64)), pa.array(n[s]), pa.array(m[s])], names)

        for batch in batches:
            texts = byte_texts(batch)
            learnt = ~batch.column(batch.schema.get_field_index("out")).to_numpy(zero_copy_only=False)
            for first, chunk in chunks_of(texts):
                words, places, extra = tokens.split(chunk)
                for kept, new in zip(parts, (words.t, key_hashes(words.hash, places), places.astype(np.uint8), words.begin + size, words.length.astype(np.uint8), learnt[first + words.doc]), strict=True):
                    kept.append(new)
                size += len(words.t)
                held_tokens += len(places)
                if extra:
                    keys = [k for _, k in extra]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([int(learnt[first + d]) for d, _ in extra]), pa.array([1] * len(keys))], names)
                if held_tokens >= HELD:
                    yield from out()
                    size = held_tokens = 0
        if held_tokens:
            yield from out()

    return docs.mapInArrow(trimmed(run), "key binary, n long, m long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _word(first: int):
    return F.substring("key", 3, first)


def split_groups(rows: DataFrame) -> frozenset[bytes]:
    """First bytes of words whose groups have too many rows: at most one for each GROUP rows and doubling.

    A group that is too large is in a group that is: counts of a depth tell whether the next is needed.
    """
    spelled, splits, depth = rows.where(F.substring("key", 1, 2) != F.lit(PLACES[WHOLE])), frozenset(), FIRST
    while depth < PIECE:
        groups = spelled.where(F.octet_length("key") >= 2 + depth).groupBy(_word(depth).alias("g")).agg(F.count("*").alias("c"))
        large = frozenset(bytes(r.g) for r in groups.where(F.col("c") > GROUP).collect())
        if not large:
            break
        splits |= large
        depth *= 2
    return splits


def bounded_tables(rows: DataFrame, splits: frozenset[bytes], code: Code) -> np.ndarray:
    """Zeros and ones of the entries of all bounded contexts: a table of fixed size, as 32-bit counts."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * ENTRIES)
        for keys, times in _parts(batches):
            add_bounded(total, keys, times, splits, code)
        pack = zstandard.ZstdCompressor(level=1).compress
        for i in range(0, 2 * ENTRIES, CHUNK):
            part = total[i : i + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": [i // CHUNK], "data": pa.array([pack(part.astype("<i8").tobytes())], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(unpack(data), "<i8")
        for chunk, both in sums.items():
            both = both.reshape(-1, 2)
            # Halved together until both fit, so that their ratio stays.
            shift = np.maximum(0, np.ceil(np.log2(np.maximum(both.max(1), 1) / 4294967295.0))).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "data": pa.array([zstandard.ZstdCompressor(level=1).compress((both >> shift[:, None]).astype("<u4").tobytes())], pa.binary())})

    kind = "chunk long, data binary"
    learnt = rows.where("n > 0").where(F.substring("key", 1, 2) != F.lit(PLACES[WHOLE])).select("key", "n")
    out = np.zeros(2 * ENTRIES, np.uint32)
    for r in learnt.mapInArrow(trimmed(run), kind).repartition(partitions(rows), "chunk").mapInArrow(trimmed(added), kind).toLocalIterator():
        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.data)), "<u4")
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(part)] = part
    return out.reshape(-1, 2)


def byte_code(rows: DataFrame) -> Code:
    """The code for the bytes of the training rows, each row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for keys, _ in _parts(batches):
            total += np.bincount(np.frombuffer(b"".join(coded_bytes(keys)), np.uint8), minlength=256)
        yield pa.RecordBatch.from_pydict({"byte": pa.array(np.arange(256)), "n": pa.array(total)})

    learnt = rows.where("n > 0").where(F.substring("key", 1, 2) != F.lit(PLACES[WHOLE])).select("key", "n")
    counts = np.zeros(256, np.int64)
    for r in learnt.mapInArrow(trimmed(run), "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[r.byte] = r.n
    return Code(counts)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Keys and times, at most BLOCK at a time."""
    for batch in batches:
        keys, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        for at in range(0, len(keys), BLOCK):
            yield keys[at : at + BLOCK], times[at : at + BLOCK]


def score_rows(rows: DataFrame, shards: int, splits: frozenset[bytes], model) -> DataFrame:
    """(key, m, c, first, l0, l1, ...) of rows (key, n, m), each shard on its own; model is a broadcast Model, splits is its own.

    Rows are dealt by the splits alone, without the tables.
    """
    names = ("key", "m", "c", "first", *(f"l{i}" for i in range(len(SHARPNESS))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            keys = batch.column(0).to_pylist()
            words = [k[2:] for k in keys]
            shard = [xxh3_64_intdigest(w[: depth_of(w, splits)]) % shards for w in words]
            order = [xxh3_64_intdigest(k) >> 1 for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int64()), pa.array(order, pa.int64())], ["key", "n", "m", "shard", "turn"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        times: list[int] = []
        alls: list[int] = []
        now = None

        def out() -> pa.RecordBatch:
            count, first, logs = scored_rows(keys, np.array(times, np.int64), model.value)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(alls, pa.int64()), pa.array(count), pa.array(first), *map(pa.array, logs)], names)

        for batch in batches:
            for key, n, m, shard in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != now:
                    if keys:
                        yield out()
                    keys, times, alls, now = [], [], [], shard
                keys.append(key)
                times.append(n)
                alls.append(m)
        if keys:
            yield out()

    dealt = rows.select("key", "n", "m").mapInArrow(trimmed(place), "key binary, n long, m long, shard long, turn long")
    dealt = dealt.repartition(max(partitions(rows), shards // 64), "shard").sortWithinPartitions("shard", "turn", "key")
    kind = "key binary, m long, c long, first long, " + ", ".join(f"{n} double" for n in names[4:])
    return dealt.mapInArrow(trimmed(score), kind)


@dataclass
class Common:
    """Scores of the most frequent rows, in the order of their keys' hashes."""

    hashes: np.ndarray
    counts: np.ndarray
    logs: np.ndarray
    tokens: Tokens

    @classmethod
    def of(cls, keys: list[bytes], counts: np.ndarray, logs: np.ndarray, tokens: Tokens) -> Common:
        plain = np.array([is_token(k) and k[:2] != PLACES[WHOLE] for k in keys], bool)
        words = words_of([k[2:] for k, p in zip(keys, plain, strict=True) if p])
        # A text of one word, or of none: its first token is the word, or else the end.
        hashes = key_hashes(words.hash[np.searchsorted(words.doc, np.arange(plain.sum()))], np.array([int.from_bytes(k[:2], "big") for k, p in zip(keys, plain, strict=True) if p], np.int64))
        order = np.argsort(hashes)
        return cls(hashes[order], counts[plain][order], logs[plain][order], tokens)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[i] == hashes, i, -1)


def expert_sums(doc: np.ndarray, logs: np.ndarray, times: np.ndarray, again: np.ndarray, size: np.ndarray, docs: int) -> list[np.ndarray]:
    """What each expert adds for rows (text, log10 by factor, times, log10 of times' repeats, rows of the text), by text."""
    out = []
    for factor, share in EXPERTS:
        own = logs[:, factor] + math.log10(1 - share)
        repeats = (times - 1) * own
        if share:
            repeats = np.maximum(repeats, (times - 1) * (math.log10(share) - np.log10(size)) + again)
        out.append(np.bincount(doc, own + repeats, docs))
    return out


def most_frequent(words: DataFrame) -> DataFrame:
    """At most COMMON rows: all that occur more often than a step of a logarithmic scale."""
    step = F.floor(F.log2("m") * 16).cast("bigint").alias("step")
    held_by, cutoff = 0, None
    for r in words.groupBy(step).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # a thousand steps at most
        held_by += r.n
        if held_by > COMMON:
            break
        cutoff = r.step
    return words.where(step >= cutoff if cutoff is not None else F.lit(False))


def scored(docs: DataFrame) -> DataFrame:
    """The contract's columns with n_bytes, total_bits and bits_per_byte, for each row of docs (doc_id, text)."""
    # All that goes through Python is written in here.
    conf = docs.sparkSession.conf
    before = conf.get(BATCHES)
    conf.set(BATCHES, BATCH_BYTES)
    try:
        return _scored(docs)
    finally:
        conf.set(BATCHES, before)


def _scored(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held(F.col("doc_id"), MODULUS).alias("out"))
    tokens = Tokens(marked(texts.where("not out").select("text")))
    rows = cut(counted(texts.select("text", "out"), tokens))
    shards = max(1, rows.count() // SHARD)
    splits = split_groups(rows)
    code = byte_code(rows)
    model = spark.sparkContext.broadcast(Model(bounded_tables(rows, splits, code), splits, code))
    words = cut(score_rows(rows, shards, splits, model))
    drop_cut(rows)
    model.unpersist()
    totals = words.agg(F.coalesce(F.sum(F.when(F.col("first") > 0, F.col("c"))), F.lit(0)).alias("n"), F.coalesce(F.sum("first"), F.lit(0)).alias("v")).first()
    total, log_denominator = totals.n, math.log10(totals.n + 0.5 * (totals.v + 1))
    factors = [f"l{i}" for i in range(len(SHARPNESS))]
    top = most_frequent(words).select("key", "c", *factors).toArrow()
    logs = np.stack([top.column(f).to_numpy() for f in factors], axis=1)
    shared = spark.sparkContext.broadcast(Common.of(top.column("key").to_pylist(), top.column("c").to_numpy(), logs, tokens))

    sums = [f"s{i}" for i in range(len(EXPERTS))]
    names = ("row", "doc_id", "held_out", "n_bytes", "n_tokens", "known", "base", "size", *sums, "rest")
    kinds = (pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.int64(), *[pa.float64()] * len(sums), pa.list_(pa.struct([("key", pa.binary()), ("times", pa.int64()), ("again", pa.float64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, next_row = shared.value, TaskContext.get().partitionId() << 40
        log_count = np.log10(use.counts + 0.5)
        log_again = lambda times: np.array([math.lgamma(n) for n in times.tolist()]) / LN10

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, texts in chunks_of(byte_texts(batch)):
                n = len(texts)
                words, places, extra = use.tokens.split(texts)
                hashes = key_hashes(words.hash, places)
                one, number = _group(hashes + words.doc.astype(np.uint64) * _SALTS[3])
                one = one[order := np.argsort(words.doc[one], kind="stable")]
                times = np.bincount(number, minlength=len(one))[order]
                doc, where = words.doc[one], use.find(hashes[one])
                again = np.zeros(len(one))
                several = np.flatnonzero(times > 2)
                again[several] = log_again(times[several])
                size = np.bincount(words.doc, minlength=n)
                n_tokens = size + np.bincount([d for d, k in extra if is_token(k)], minlength=n)
                size = size + np.bincount([d for d, _ in extra], minlength=n)
                k = np.flatnonzero(where >= 0)
                at = where[k]
                added = expert_sums(doc[k], use.logs[at], times[k], again[k], size[doc[k]].astype(np.float64), n)
                known = np.bincount(doc[k], times[k] * (use.counts[at] > 0), n).astype(np.int64)
                base = np.bincount(doc[k], times[k] * log_count[at], n)
                r = np.flatnonzero(where < 0)
                rest = pa.StructArray.from_arrays([bytes_of(words.t, places[one[r]], words.begin[one[r]], words.length[one[r]]), pa.array(times[r]), pa.array(again[r])], ["key", "times", "again"])
                rests = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[r], np.arange(n + 1)), pa.int32()), rest)
                if extra:
                    lists = rests.to_pylist()
                    for (d, key), m in Counter(extra).items():
                        lists[d].append({"key": key, "times": m, "again": math.lgamma(m) / LN10})
                    rests = pa.array(lists, kinds[-1])
                mine = ids.slice(first, n)
                columns = [np.arange(next_row, next_row + n), mine, [is_held(d, MODULUS) for d in mine.to_pylist()], [len(x) for x in texts], n_tokens, known, base, size, *added, rests]
                next_row += n
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    kind = "row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, known long, base double, size long, " + ", ".join(f"{c} double" for c in sums) + ", rest array<struct<key:binary,times:bigint,again:double>>"
    found = cut(texts.select("doc_id", "text").mapInArrow(trimmed(run), kind))
    rare = found.select("row", "size", F.explode("rest").alias("r")).select("row", "size", "r.*", F.xxhash64("r.key").alias("h"))
    rare = rare.join(words.drop("m", "first").withColumn("h", F.xxhash64("key")), ["h", "key"])
    whole = F.substring("key", 1, 2) == F.lit(PLACES[WHOLE])
    token = whole | ((F.octet_length("key") < 2 + PIECE) & (F.substring("key", 1, 2) != F.lit(PLACES[CONTINUED])))

    def added(factor: int, share: float):
        own = F.col(factors[factor]) + math.log10(1 - share)
        repeats = (F.col("times") - 1) * own
        if share:
            repeats = F.greatest(repeats, (F.col("times") - 1) * (math.log10(share) - F.log10("size")) + F.col("again"))
        return F.sum(F.when(whole, 0.0).otherwise(own + repeats))

    per = rare.groupBy("row").agg(
        F.sum(F.when(token & (F.col("c") > 0), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.when(token, F.col("times") * F.log10(F.col("c") + 0.5)).otherwise(0.0)).alias("rare_base"),
        *(added(*e).alias(f"rare_{c}") for c, e in zip(sums, EXPERTS, strict=True)),
    )
    both = found.drop("rest").join(per, "row", "left").fillna(0, ["rare_known"]).fillna(0.0, ["rare_base", *(f"rare_{c}" for c in sums)])
    each = [F.col(c) + F.col(f"rare_{c}") for c in sums]
    best = F.greatest(*each)
    # The average of the experts' probabilities: each counts by what it made of the text.
    parts = [F.pow(F.lit(10.0), F.greatest(e - best, F.lit(-300.0))) for e in each]
    score = best + F.log10(sum(parts[1:], parts[0]) / len(parts))
    bits = -score / math.log10(2)
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("rare_known")).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("rare_base") - F.col("n_tokens") * F.lit(log_denominator)).alias("base_score"),
        score.alias("score"),
        "n_bytes",
        bits.alias("total_bits"),
        F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


QUERIES = {"op5_context_mixing": op5_context_mixing}
ORACLES: dict[str, str] = {}
