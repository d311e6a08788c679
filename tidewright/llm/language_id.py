"""Language identification by error-correcting output codes over character n-grams.

Every language gets a codeword of bits. One binary n-gram classifier per bit is learned from the n-gram counts of all
labelled training texts (log odds of the languages whose bit is set against the others, smoothed), so fitting needs one
pass that sums a table of fixed size per language and no sample. A text gives each classifier a margin; its loss
against a codeword is the sum of the logistic losses of the bits, each weighted by how well that bit separates the
languages in training. The codeword of least loss wins; a small lead over the next one flags the text as ambiguous.

Defined cases: null texts and texts without a letter are ``und`` with score 0; training rows with a null language or
without letters teach nothing; with a single known language every text with a letter gets it, with none ``und``; ties go to the
language first in order; repeated rows each get a row (and count as often in training); whole texts are read in pieces;
other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import sketch

BUCKETS = 1 << 12
SMOOTHING = 0.5
LEAD = 0.2  # ambiguous where the best language is less than this much likelier than the next
PIECE = 1 << 18
UNKNOWN = "und"
_PRIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of the letters of a text; a run of other characters is one space."""
    counts = np.zeros(BUCKETS, np.int64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    tail = np.zeros(0, np.uint64)
    for at in range(0, max(len(text), 1), PIECE):
        piece = text[at:at + PIECE].lower()
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        letters = (points >= 97) & (points <= 122) | (points >= 0xC0)
        points = np.where(letters, points, np.uint64(32))
        keep = letters.copy()
        keep[1:] |= letters[:-1]  # of a run of others the first stands for all
        points = np.concatenate((tail, points[keep]))
        h = np.zeros(len(points), np.uint64)
        for n, prime in enumerate(_PRIMES):
            h = (h[:len(points) - n] + points[n:]) * prime
            new = h[max(0, len(tail) - n):] if n else h[len(tail):]  # grams that end in this piece
            counts += np.bincount(((new ^ (new >> np.uint64(31))) * _PRIMES[0] >> shift).astype(np.int64), minlength=BUCKETS)
        tail = points[-(len(_PRIMES) - 1):]
    return counts


def _texts(column) -> Iterator[str | None]:
    for value in column:
        yield value.as_py()


def profiles(training: DataFrame, label: str = "lang") -> dict[str, np.ndarray]:
    """Summed n-gram counts of every language: a table of fixed size each."""
    def fold(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                if has_letter(text):
                    tables.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    tables[lang] += gram_counts(text)
        yield from sketch.emit(tables, BUCKETS)

    rows = training.select(F.col(label).cast("string").alias("lang"), "text").where("lang is not null and text is not null")
    return sketch.collected(rows.mapInArrow(fold, sketch.SCHEMA), BUCKETS, BUCKETS)


def codewords(n: int) -> np.ndarray:
    """Bits (+1, -1) of ``n`` languages: the exhaustive code up to six, seeded random distinct columns beyond."""
    if n <= 6:
        columns = [[1 if (k >> j) & 1 else -1 for j in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(columns).T.reshape(n, -1)
    bits = 10 * int(n).bit_length()
    draws = np.random.default_rng(7).integers(0, 2, (n, 4 * bits)) * 2 - 1
    useful = [j for j in range(draws.shape[1]) if 0 < (draws[:, j] > 0).sum() < n]
    return draws[:, useful[:bits]]


class Model:
    """Weights of the bit classifiers, codewords and bit weights."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        if not self.languages:
            return
        table = np.array([counts[x] for x in self.languages], float)
        shares = (table + SMOOTHING) / (table + SMOOTHING).sum(1, keepdims=True)  # a language counts once, however common
        self.codes = codewords(len(self.languages))
        weights = []
        for j in range(self.codes.shape[1]):
            on = self.codes[:, j] > 0
            weights.append(np.log(shares[on].mean(0)) - np.log(shares[~on].mean(0)))
        self.weights = np.array(weights).reshape(-1, BUCKETS)
        means = shares @ self.weights.T  # the margin of a typical text of each language
        separation = (means * self.codes).min(0) if self.weights.size else np.zeros(0)
        self.bits = np.clip(separation, 0, None) + 1e-3
        self.scale = 4.0 / np.maximum(np.abs(means).mean(0), 1e-9) if self.weights.size else np.zeros(0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        counts = gram_counts(text)
        margins = self.weights @ counts / max(1, counts.sum()) * self.scale
        losses = (np.logaddexp(0, -self.codes * margins) * self.bits).sum(1) / self.bits.sum()
        likely = np.exp(-(losses - losses.min()) * len(self.bits))
        likely /= likely.sum()
        order = np.argsort(-likely, kind="stable")
        best = int(np.argmin(losses))
        return self.languages[best], float(likely[best]), bool(likely[order[0]] - likely[order[1]] < LEAD)


def identify(docs: DataFrame, training: DataFrame, held_out) -> DataFrame:
    """The language of every text of ``docs``; ``held_out`` is a column expression kept beside it."""
    model = Model(profiles(training))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def predict(batches):
        known = shared.value
        for batch in batches:
            found = [known.predict(t) for t in _texts(batch.column(2))]
            langs, scores, doubts = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
