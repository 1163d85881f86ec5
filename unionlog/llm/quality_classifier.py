"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A word has two units, a lexical one (its letters, hashed) and one of shape (runs of upper case, lower case,
digits, and symbols as they are). Each unit has a fixed sparse random index vector; its context
vector is the sum of the index vectors of the words within `REACH` places in the training texts. A document's
input is the mean of its words' index and context vectors, and a few pooled shares (repeated words, repeated lines,
symbols, upper case, word length, length). A network with one hidden layer, in numpy, is trained on it;
a temperature fitted on a part of the training rows that the network has not seen calibrates its probabilities.

Labels of at most `TRAIN_ROWS` documents are used (those first by a hash of the id, none held out), and only
their texts make the context vectors; every document is scored on its whole text. The inputs are the
text's words alone: no label, language, source or id.

Nulls: a null text is an empty one, which gets a score like any other; rows that are repeated get equal scores; a
null doc_id is never held out and never trained on. Contradicting labels of a document count as the larger.
With no labels, or one kind only, all scores are that kind's share (0.5 with none).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlog.llm.common import Remembered, byte_texts, cut, held, is_held, spread, table, trimmed

MODULUS = 3
#: At most so many labelled documents are learnt from.
TRAIN_ROWS = 8000
DIM, NONZERO = 32, 4
LEXICAL, SHAPES = 1 << 14, 1 << 10
REACH = 2
HIDDEN = 32
EPOCHS, BATCH, RATE, DECAY = 60, 128, 3e-3, 1e-4
#: One in so many training rows is kept for the temperature.
CALIBRATE = 5
SHARES = 6
WIDTH = 4 * DIM + SHARES

_LETTERS = re.compile(rb"[^a-z0-9\x80-\xff]+")
_SHAPE = bytes(0x41 if 65 <= c <= 90 else 0x61 if 97 <= c <= 122 or c >= 128 else 0x30 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


def units(word: bytes) -> int:
    """The word's lexical unit above its unit of shape, as one number."""
    shape = _RUNS.sub(rb"\1", word.translate(_SHAPE))
    return (zlib.crc32(_LETTERS.sub(b"", word.lower())) % LEXICAL) * SHAPES + zlib.crc32(shape) % SHAPES


class _Units(Remembered):
    def __missing__(self, word: bytes) -> int:
        return self.keep(word, units(word), len(word))


@lru_cache(maxsize=1)
def _worker() -> tuple[_Units, np.ndarray, np.ndarray]:
    """Known words and the index vectors of both kinds of unit: the same in every process."""
    rng = np.random.default_rng(11)

    def sparse(rows: int) -> np.ndarray:
        out = np.zeros((rows, DIM), np.float32)
        at = np.argsort(rng.random((rows, DIM)), axis=1)[:, :NONZERO]
        np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (rows, NONZERO)), axis=1)
        return out

    return _Units(), sparse(LEXICAL), sparse(SHAPES)


def document_units(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    words = text.split()
    both = np.fromiter(map(_worker()[0].__getitem__, words), np.int64, len(words))
    return words, both // SHAPES, both % SHAPES


def context_sums(texts: Iterator[bytes]) -> np.ndarray:
    """Sums of neighbours' index vectors for each unit, lexical ones first."""
    _, lexical, shapes = _worker()
    sums = np.zeros((LEXICAL + SHAPES, DIM), np.float32)
    for text in texts:
        _, a, b = document_units(text)
        index = lexical[a] + shapes[b]
        around = np.zeros_like(index)
        for k in range(1, REACH + 1):
            around[k:] += index[:-k]
            around[:-k] += index[k:]
        np.add.at(sums, a, around)
        np.add.at(sums, LEXICAL + b, around)
    return sums


def pooled(text: bytes, context: np.ndarray) -> np.ndarray:
    """The document's input."""
    words, a, b = document_units(text)
    out = np.zeros(WIDTH, np.float32)
    n = len(words)
    if not n:
        return out
    _, lexical, shapes = _worker()
    # By distinct units with their counts: long texts repeat theirs.
    for k, (u, t, c) in enumerate(((a, lexical, context[:LEXICAL]), (b, shapes, context[LEXICAL:]))):
        seen, times = np.unique(u, return_counts=True)
        weight = (times / n).astype(np.float32)
        out[2 * k * DIM : (2 * k + 1) * DIM] = weight @ t[seen]
        out[(2 * k + 1) * DIM : (2 * k + 2) * DIM] = weight @ c[seen]
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)
    letters = len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(text.translate(None, b"#*$%&|<>!@^~_=+{}[]\\/"))
    out[-SHARES:] = (np.log1p(n) / 10, 1 - len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), 1 - symbols / size, 1 - letters / size, size / n / 20)
    return out


def unit_length(sums: np.ndarray) -> np.ndarray:
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)


class Network:
    """Inputs are standardised; one hidden layer of rectified units; logistic output over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        fit = ~calibrate
        self.prior = float(y.mean()) if len(y) else 0.5
        self.single = len(y) == 0 or len(set(y[fit])) < 2
        if self.single:
            return
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        rng = np.random.default_rng(5)
        width = x.shape[1]
        self.weights = [rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        self._train((x[fit] - self.mean) / self.scale, y[fit], rng)
        self.temperature = 1.0
        z, t = self.logits(x[calibrate]), y[calibrate]
        if len(set(t)) == 2:
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
            loss = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _train(self, x: np.ndarray, y: np.ndarray, rng) -> None:
        m = [np.zeros_like(w) for w in self.weights]
        v = [np.zeros_like(w) for w in self.weights]
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                w1, b1, w2, b2 = self.weights
                h = np.maximum(x[rows] @ w1 + b1, 0)
                g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y[rows]) / len(rows)
                gh = np.outer(g, w2) * (h > 0)
                grads = [x[rows].T @ gh + DECAY * w1, gh.sum(0), h.T @ g + DECAY * w2, np.array([g.sum()])]
                step += 1
                for i, d in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    self.weights[i] = self.weights[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.single:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, quality, text) of at most `rows` labelled documents that are not held out."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held(F.col("doc_id"), MODULUS))
    chosen = marks.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # `rows` ids and labels: a few hundred KB at most. Repeated documents count once.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return cut(sample)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """Context vectors and network."""
    spark = docs.sparkSession
    sample = training_sample(docs, labels, rows)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = context_sums(t for batch in batches for t in byte_texts(batch))
        seen = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_pydict({"unit": pa.array(seen), "vector": pa.array([total[i].tobytes() for i in seen], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for u, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[u] = total.get(u, 0) + np.frombuffer(vec, np.float32)
        yield pa.RecordBatch.from_pydict({"unit": pa.array(list(total), pa.int64()), "vector": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    kind = "unit long, vector binary"
    context = np.zeros((LEXICAL + SHAPES, DIM), np.float32)
    # One vector a unit: a bounded table, whatever the input.
    for r in sample.select("text").repartition(8).mapInArrow(trimmed(sums), kind).repartition(8, "unit").mapInArrow(trimmed(added), kind).collect():
        context[r.unit] = np.frombuffer(bytes(r.vector), np.float32)
    context = unit_length(context)
    shared = spark.sparkContext.broadcast(context)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [pooled(t, shared.value).tobytes() for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(vectors, pa.binary())], ["doc_id", "quality", "x"])

    got = sorted(sample.select("doc_id", "quality", "text").repartition(8).mapInArrow(trimmed(inputs), "doc_id long, quality int, x binary").collect(), key=lambda r: r.doc_id)
    x = np.array([np.frombuffer(bytes(r.x), np.float32) for r in got], np.float64).reshape(-1, WIDTH)
    y = np.array([r.quality for r in got], np.float64)
    # ids differ in this hash even where they agree in the one that holds rows out
    calibrate = np.array([zlib.adler32(str(r.doc_id).encode()) * 2654435761 % 2**32 % CALIBRATE == 0 for r in got], bool)
    return context, Network(x, y, calibrate)


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, network = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            x = np.array([pooled(t, context) for t in byte_texts(batch)], np.float64).reshape(-1, WIDTH)
            score = network.scores(x)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([is_held(i, MODULUS) for i in ids.to_pylist()], pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spread(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "labels", "doc_id", "quality"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLES: dict[str, str] = {}
