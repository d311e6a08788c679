"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Words and their shapes (runs of upper case, lower case, digits and each punctuation mark) fall into fixed buckets.
Every bucket has a sparse random index vector; its context vector is the sum of the index vectors of its neighbours
over the whole corpus, one summed table of fixed size. A document is pooled to the mean and spread of the context
vectors of its words and shapes and the likeness of the index vectors of words one to three places apart.

The network is fitted on the driver on the pooled vectors of at most ``max_fit_rows`` labelled rows (those of smallest
hash of the id; everything else covers all rows), and a temperature chosen on a fifth of them calibrates its output.

Defined cases: null and empty texts pool to zeros and get the score of that vector; of rows that share a labelled id
one is fitted, that of the smallest pooled vector; several labels of a document count as their mean, null labels are left out; without labels every score is 0.5, with labels of one kind the network still
answers, near that kind; repeated rows each get a row; whole texts are read; other columns pass through ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import sketch, textscan

WORD_BITS, SHAPE_BITS, DIM, NONZERO = 13, 10, 32, 2
ROWS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
BLOCK = 1 << 14
MAX_FIT_ROWS = 20_000
LAGS = (1, 2, 3)
STEPS, BATCH = 8000, 128  # of the fit, whatever the number of rows
FEATURES = 4 * DIM + len(LAGS)
_FLUSH = 1 << 18
_SLICE = 1 << 15

_rng = np.random.default_rng(11)
_PLACE = _rng.integers(0, DIM, (ROWS, NONZERO))
_SIGN = _rng.integers(0, 2, (ROWS, NONZERO)) * 2.0 - 1.0
INDEX = np.zeros((ROWS, DIM), np.float32)
for _k in range(NONZERO):
    np.add.at(INDEX, (np.arange(ROWS), _PLACE[:, _k]), _SIGN[:, _k].astype(np.float32))

_SPACES = bytes(0x20 if b in (0x20, *range(0x09, 0x0E)) else b for b in range(256))
_SHAPES = bytes(
    0x20 if b in (0x20, *range(0x09, 0x0E)) else 0x78 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x58 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b
    for b in range(256))


def buckets(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Word and shape bucket of every word."""
    text = text or b""
    h, _, _ = textscan.words(text.translate(_SPACES))
    b = np.frombuffer(text.translate(_SHAPES), np.uint8)
    new = np.ones(len(b), bool)
    new[1:] = b[1:] != b[:-1]
    s, _, _ = textscan.words(b[new].tobytes())
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), (s >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS)


def _add_contexts(table: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
    words, shapes = (np.concatenate([x[k] for x in held]) for k in (0, 1))
    owner = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
    inside = owner[1:] == owner[:-1]
    flat = np.zeros(ROWS * DIM)
    for row in (words, shapes):
        for context in (words, shapes):
            for at, near in ((row[:-1][inside], context[1:][inside]), (row[1:][inside], context[:-1][inside])):
                for k in range(NONZERO):
                    flat += np.bincount(at * DIM + _PLACE[near, k], _SIGN[near, k], ROWS * DIM)
    table += flat.astype(np.int64)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets, from every document: ROWS x DIM numbers whatever the corpus."""
    def fold(batches):
        table, held, n = np.zeros(ROWS * DIM, np.int64), [], 0
        for batch in batches:
            for text in textscan.texts(batch.column(0)):
                held.append(buckets(text))
                n += len(held[-1][0])
                if n > _FLUSH:
                    _add_contexts(table, held)
                    held, n = [], 0
        if held:
            _add_contexts(table, held)
        yield from sketch.emit({"context": table}, BLOCK)

    summed = sketch.collected(docs.select("text").where("text is not null").mapInArrow(fold, sketch.SCHEMA), ROWS * DIM, BLOCK)
    vectors = summed.get("context", np.zeros(ROWS * DIM)).reshape(ROWS, DIM).astype(np.float64)
    return (vectors / np.maximum(np.sqrt((vectors ** 2).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def pooled(text: bytes | None, vectors: np.ndarray) -> np.ndarray:
    words, shapes = buckets(text)
    out = np.zeros(FEATURES, np.float32)
    n = len(words)
    if not n:
        return out
    for k, tokens in enumerate((words, shapes)):
        total, squares = np.zeros(DIM), np.zeros(DIM)
        for at in range(0, n, _SLICE):
            part = vectors[tokens[at:at + _SLICE]]
            total += part.sum(0)
            squares += np.einsum("ij,ij->j", part, part)
        mean = total / n
        out[2 * k * DIM:(2 * k + 1) * DIM] = mean
        out[(2 * k + 1) * DIM:(2 * k + 2) * DIM] = np.sqrt(np.maximum(squares / n - mean ** 2, 0))
    for k, lag in enumerate(LAGS):
        if n > lag:
            alike = sum(float(np.einsum("ij,ij->", INDEX[words[at:min(at + _SLICE, n - lag)]], INDEX[words[at + lag:min(at + _SLICE, n - lag) + lag]]))
                        for at in range(0, n - lag, _SLICE))
            out[4 * DIM + k] = alike / (NONZERO * (n - lag))
    return out


def _batches(rng: np.random.Generator, rows: np.ndarray, steps: int):
    """``steps`` batches of about ``BATCH`` rows, from one random order of all rows after the other."""
    while steps > 0 and len(rows):
        for batch in np.array_split(rng.permutation(rows), max(1, len(rows) // BATCH))[:steps]:
            steps -= 1
            yield batch


class Network:
    """Standardised inputs, one hidden layer, one output, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = STEPS, seed: int = 5):
        self.prior = 0.5
        self.layers = None
        if not len(y):
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        cut = len(y) - len(y) // 5
        fit, check = order[:cut], order[cut:]
        self.mean, self.spread = x[fit].mean(0), x[fit].std(0) + 1e-3
        z = self._scaled(x)
        shapes = ((x.shape[1], hidden), (hidden,), (hidden, 1), (1,))
        p = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
        m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        for step, rows in enumerate(_batches(rng, fit, steps), start=1):
            a = np.tanh(z[rows] @ p[0] + p[1])
            d = (_sigmoid(a @ p[2] + p[3]) - y[rows, None]) / len(rows)
            back = d @ p[2].T * (1 - a ** 2)
            grads = (z[rows].T @ back + 1e-4 * p[0], back.sum(0), a.T @ d + 1e-4 * p[2], d.sum(0))
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= 0.003 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.layers, self.temperature = p, 1.0
        if len(check):
            logits = self._logits(z[check])
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            self.temperature = float(min(grid, key=lambda t: np.mean(np.logaddexp(0, logits / t) - y[check] * logits / t)))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return (np.tanh(z @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3])[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return _sigmoid(self._logits(self._scaled(x)) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Scorer:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def __call__(self, column) -> np.ndarray:
        rows = [pooled(t, self.vectors) for t in textscan.texts(column)]
        return self.network.scores(np.array(rows, np.float64).reshape(-1, FEATURES))


def in_training(doc_id: str = "doc_id"):
    """Rows whose labels may be learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Scorer:
    """Context vectors from all of ``docs``, the network from labelled training rows."""
    vectors = context_vectors(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vectors)
    known = (
        labels.where(in_training() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("target"))
        .join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows)
    )

    def pool(batches):
        for batch in batches:
            data = [pooled(t, shared.value).tobytes() for t in textscan.texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(2).cast(pa.string()), batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "target", "pooled"])

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("target", "text", "doc_id")  # at most max_fit_rows ids
    told = rows.select("target", "text", "doc_id").mapInArrow(pool, "doc_id string, target double, pooled binary")
    table = told.groupBy("doc_id").agg(F.max("target"), F.min("pooled")).drop("doc_id").collect()  # a row for each id, however often it repeats
    table.sort(key=lambda r: (r[1], r[0]))  # the fit does not depend on the order in which rows arrive
    x = np.array([np.frombuffer(r[1], np.float32) for r in table], np.float64).reshape(-1, FEATURES)
    return Scorer(vectors, Network(x, np.array([r[0] for r in table], float)))


def score(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The probability of label 1 for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_fit_rows))

    def apply(batches):
        scorer = shared.value
        for batch in batches:
            s = scorer(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The documents whose score reaches ``threshold``, as given."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_fit_rows))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = docs.columns.index("text")

    def keep(batches):
        scorer = shared.value
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(text)) >= threshold))

    rows = docs.select(*(F.col(f"`{c}`").alias(names[c]) for c in docs.columns))
    return rows.mapInArrow(keep, rows.schema).select(*(F.col(names[c]).alias(c) for c in docs.columns))
