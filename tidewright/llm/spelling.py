"""Spelling variant grouping by blocked Gram matrices of letter counts.

Runs of letters are counted over the whole corpus; words that occur often enough are compared through the vectors of
their letter counts. One inserted or deleted letter moves that vector by a squared distance of 1, one replaced letter by
2, so the Gram matrix of two blocks, a NumPy product, gives squared distances, and only pairs at 2 (equal lengths) or 1
(adjacent lengths) are verified letter by letter.

Blocks are coarse letter counts: letters are dealt into k groups, and a block is the vector of k group counts, which
also fixes the length. One edit moves one letter out of a group, into a group, or from one group to another, so a
word's near words lie in its own block, in the blocks with one letter more, and in those with one letter moved. Two
grids are used. A region of the coarser one is what a task gets, with copies of the words of neighbouring regions; inside,
the products run over blocks of the finer one. Regions hold at most ``REGION`` words: groups are added until that is so, and
what is still larger is split by a hash of the word. The grids decide only what work is done where, never what is found.

Defined cases: null and empty texts have no words; repeated rows count again; a null id writes as an empty string where
ids enter hashes; words of any length are compared; an empty table has no words; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.storage import stored

LETTERS = 26 + 64  # a-z and U+00C0 to U+00FF
_ORDER = "etaonirshdlucmfwgypbvkxqjz" + "".join(map(chr, range(0xC0, 0x100)))  # dealt to groups in this order
_PLACE = {c: k for k, c in enumerate(_ORDER)}
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
MOST_GROUPS = 12
_WIDE = (1 << 61) - 1  # block keys are sums of these marks, one for each group, modulo 2 ** 61
_MARKS = [int(x) for x in np.random.default_rng(77).integers(1 << 50, 1 << 60, 2 * MOST_GROUPS)]
REGION = 4096
HELD = 100_000  # words a task counts before it hands them on
SENT = 10_000  # words in one Arrow batch
CELLS = 1 << 20  # of a product, a comparison or a table of counts held at once
ROWS = CELLS // LETTERS
PAIRS = 1 << 17  # candidates collected before they are verified


def spoil(doc_id, word: str, every: int) -> str:
    """``word`` as read in a document: one letter less where ``every`` divides the hash of both."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def words(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters that occur at least ``least`` times."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)  # a shorter run cannot become long enough

    def fold(batches):
        held = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                found = Counter(runs.findall(text.as_buffer().to_pybytes().translate(_LOWER).decode()))
                for word, n in found.items():
                    held[spoil(doc, word, every) if every else word] += n
                if len(held) > HELD:
                    yield from _counted(held, shortest)
                    held = Counter()
        yield from _counted(held, shortest)

    rows = docs.select(F.col("doc_id").alias("doc"), "text").mapInArrow(fold, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counted(held: Counter, shortest: int) -> Iterator[pa.RecordBatch]:
    kept = ((w, n) for w, n in held.items() if len(w) >= shortest)
    while part := list(islice(kept, SENT)):
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])


class Spelled:
    """Words as arrays: letter places one after the other, and letter counts, as narrow as the longest word lets them be."""

    def __init__(self, texts):
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        table = np.zeros(0x100, np.uint8)
        for c, k in _PLACE.items():
            table[ord(c)] = k
        self.letters = table[codes]
        self.size = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.counts = np.empty((len(texts), LETTERS), np.min_scalar_type(self.size.max(initial=0)))
        ends = np.append(self.first, len(self.letters))
        for at in range(0, len(texts), ROWS):
            size = self.size[at:at + ROWS]
            owner = np.repeat(np.arange(len(size)), size)
            cells = owner * LETTERS + self.letters[ends[at]:ends[at + len(size)]]
            self.counts[at:at + ROWS] = np.bincount(cells, minlength=len(size) * LETTERS).reshape(-1, LETTERS)

    def keys(self, groups: int) -> np.ndarray:
        """The block of each word: group counts folded into one number, so that neighbours differ by known amounts."""
        marks = np.array(_MARKS, np.int64)[np.arange(LETTERS) % groups]
        out = np.empty(len(self.counts), np.int64)
        for at in range(0, len(out), ROWS):
            out[at:at + ROWS] = (self.counts[at:at + ROWS] * marks).sum(1)
        return out & _WIDE

    def row(self, k: np.ndarray, length: int) -> np.ndarray:
        return self.letters[self.first[k][:, None] + np.arange(length)]


def _moves(groups: int) -> list[int]:
    """From a block's key to those of the blocks with one letter moved on to a later group, then with one letter more."""
    m = _MARKS[:groups]
    return [m[j] - m[i] for j in range(groups) for i in range(j)] + m


def _placed(table: DataFrame, groups: int) -> DataFrame:
    """``table`` with the region of each word."""
    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(Spelled(batch.column(0).to_pylist()).keys(groups))], names=["word", "n", "region"])

    return table.select("word", "n").mapInArrow(place, "word string, n long, region long")


def _regions(table: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Words by region, the regions with the number of parts each is split into, and the number of groups."""
    groups = 2
    while True:
        placed = _placed(table, groups)
        sizes = placed.groupBy("region").agg(F.count("*").alias("k"))
        largest = sizes.agg(F.max("k")).first()[0] or 0
        if largest <= REGION or groups >= MOST_GROUPS:
            return placed, sizes.select("region", F.ceil(F.col("k") / REGION).cast("int").alias("parts")), groups
        groups = min(MOST_GROUPS, groups + (2 if largest > 8 * REGION else 1))


def _verified(w: Spelled, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b), b as long as a or one shorter, differ by exactly one edit."""
    out = np.zeros(len(a), bool)
    for length in np.unique(w.size[a]):
        for shorter in (0, 1):
            these = np.flatnonzero((w.size[a] == length) & (w.size[b] == length - shorter))
            step = max(1, CELLS // int(length))
            for at in range(0, len(these), step):
                part = these[at:at + step]
                x, y = w.row(a[part], length), w.row(b[part], length - shorter)
                if shorter:  # the letters before the first difference, then those after the letter too many
                    same, shifted = x[:, :-1] == y, x[:, 1:] == y
                    run = np.logical_and.accumulate
                    out[part] = (run(same, axis=1).sum(1) + run(shifted[:, ::-1], axis=1).sum(1)) >= length - 1
                else:
                    out[part] = (x != y).sum(1) == 1
    return out


def near_pairs(w: Spelled, mine: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs one edit apart of which at least the first is ``mine``, each once: the longer, or else the later word first or mine first."""
    keys = w.keys(groups)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    blocks, starts = np.unique(ranked, return_index=True)
    ends = np.append(starts[1:], len(ranked))
    exact = np.float32 if w.size.max(initial=0) <= 4000 else np.float64  # sums of squares below 2 ** 24
    vectors = w.counts[order]
    own = mine[order]
    moves = np.array(_moves(groups), np.int64)
    wanted = (blocks[:, None] + np.concatenate(([0], moves, -moves))) & _WIDE
    at = np.minimum(np.searchsorted(blocks, wanted), max(len(blocks) - 1, 0))
    there = blocks[at] == wanted
    found, waiting, held = [(np.zeros(0, np.int64),) * 2], [], 0
    for k in range(len(blocks)):
        centre = np.arange(starts[k], ends[k])
        centre = centre[own[centre]]
        if not len(centre):
            continue
        near = np.concatenate([np.arange(starts[j], ends[j]) for j in at[k, there[k]]])
        for top in range(0, len(centre), ROWS):
            some = centre[top:top + ROWS]
            mine_here = vectors[some].astype(exact)
            squares = (mine_here * mine_here).sum(1)[:, None]
            width = max(1, CELLS // max(len(some), LETTERS))
            for cut in range(0, len(near), width):
                part = near[cut:cut + width]
                others = vectors[part].astype(exact)
                gram = mine_here @ others.T
                gram *= -2
                gram += squares
                gram += (others * others).sum(1)
                i, j = np.nonzero((gram <= 2) & (gram > 0))
                waiting.append((order[some[i]], order[part[j]]))
                held += len(i)
                if held > PAIRS:
                    found.append(_edits(w, mine, waiting))
                    waiting, held = [], 0
    if waiting:
        found.append(_edits(w, mine, waiting))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _edits(w: Spelled, mine: np.ndarray, waiting: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the waiting pairs that differ by exactly one edit, the longer word first."""
    a, b = np.concatenate([a for a, _ in waiting]), np.concatenate([b for _, b in waiting])
    # each pair once: two words of mine meet from both sides
    keep = ~mine[b] | (a < b)
    a, b = a[keep], b[keep]
    longer = w.size[b] > w.size[a]
    a, b = np.where(longer, b, a), np.where(longer, a, b)
    ok = _verified(w, a, b)
    return a[ok], b[ok]


def neighbours(table: DataFrame) -> DataFrame:
    """(word, n_near, best): of each word of (word, n) that has near words, their count and (-n, word) of the first."""
    placed, sizes, groups = _regions(table)
    parts = stored(sizes, "regions")
    placed = placed.join(parts, "region").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    # a region gets its own words, those of regions one move or one letter away, and, where it is split, earlier parts
    inside = placed.select("region", F.explode(F.sequence("part", F.col("parts") - 1)).alias("to"), "word", "n", (F.col("part") == F.col("to")).alias("mine"))
    moved = F.explode(F.array(*(F.lit(d) for d in _moves(groups))))
    outside = placed.select("word", "n", "region", moved.alias("move"))
    outside = outside.select("word", "n", F.pmod(F.col("region") + F.col("move"), F.lit(_WIDE + 1)).alias("region")).join(parts, "region")
    outside = outside.select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to"), "word", "n", F.lit(False).alias("mine"))
    fine = min(2 * groups, MOST_GROUPS)

    def compare(group: pa.Table) -> pa.Table:
        n, texts = group["n"].to_numpy(), np.array(group["word"].to_pylist(), object)
        a, b = near_pairs(Spelled(texts), group["mine"].to_numpy().astype(bool), fine)
        x, y = np.concatenate((a, b)), np.concatenate((b, a))
        first = np.lexsort((_ranks(texts)[y], -n[y], x))
        x, y = x[first], y[first]
        who, start, count = np.unique(x, return_index=True, return_counts=True)
        best = y[start]
        return pa.table({"word": pa.array(texts[who], pa.string()), "k": pa.array(count, pa.int64()), "form": pa.array(texts[best], pa.string()), "form_n": pa.array(n[best], pa.int64())})

    found = inside.unionByName(outside).groupBy("region", "to").applyInArrow(compare, "word string, k long, form string, form_n long")
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("least"), "form")).alias("best"))


def _ranks(texts: np.ndarray) -> np.ndarray:
    out = np.empty(len(texts), np.int64)
    out[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): from every word that has a form, forms followed to the last. Each step doubles the way covered."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = stored(reached.join(on, "root", "left"), "roots")
        last = reached.where("next is not null").isEmpty()
        reached = reached.select("word", F.coalesce("next", "root").alias("root"))
        if last:
            return reached


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the corpus.

    A word's form is its most frequent near word, if that occurs at least ``times`` as often; the root is the last form
    in the chain. ``every`` sets which words of a document lose a letter first (0: none).
    """
    table = stored(words(docs, shortest, least, every), "words")
    near = neighbours(table)
    known = stored(
        table.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(-F.col("best.least") >= times * F.col("n"), F.struct("best.form", (-F.col("best.least")).alias("n"))).alias("form")),
        "variants")
    roots = _roots(known.where("form is not null").select("word", F.col("form.form").alias("form")))
    return known.join(roots, "word", "left").select(
        "word", "n", "n_near", F.col("form.form").alias("form"), F.col("form.n").alias("form_n"), F.coalesce("root", "word").alias("root"))
