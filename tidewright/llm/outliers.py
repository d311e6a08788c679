"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Every document is counted once from its whole text. Two limits (few words, many repeated words) are rules of their own.
The others that pass are judged together: the counts become a vector of shares, on scales where their spread does not
depend on their size, and every (language, source) gets a location and a scatter matrix by the minimum covariance
determinant: concentration steps move them to the mean and the covariance of the ``FRACTION`` of the documents nearest to
them. A document is rejected where its Mahalanobis distance exceeds a chi-square quantile.

Vectors are whole numbers, so all sums are exact and do not depend on their order. A step is one aggregation: distances
fall into fixed classes, sums are taken per group and class, and the classes that hold the nearest ``FRACTION`` are
added up (the last class enters whole). Only sums are shuffled. Small groups are no special case: a group's estimate is drawn
towards that of its language, as if that were ``PRIOR`` more documents, and a language's towards fixed spreads.

Defined cases: null and empty texts have no words and fail; null languages and sources are groups of their own; an
estimate needs no least number of documents; repeated rows count again; an empty table has no rows; other columns are
ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.storage import stored
from tidewright.llm import textscan

LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of words inside repeated windows
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
UNIT = 1024  # vectors are whole multiples of 1 / UNIT
#: part of the vector, and the least spread a language is taken to have
SPREADS = {"length": 0.12, "symbols": 0.12, "lines": 0.5, "repeats": 0.5, "capitals": 0.12, "echoes": 0.25}
PARTS = tuple(SPREADS)
FRACTION = 0.75
PRIOR = 50
STEPS = 4
CLASSES = 96
CUT = 1 - 1e-6  # quantile beyond which a document is an outlier
_SPACES = bytes(0x20 if b in (0x20, *range(0x09, 0x0E)) else b for b in range(256))
_KINDS = np.zeros(256, np.int64)  # 1 continuation byte, 2 capital
_KINDS[0x80:0xC0], _KINDS[0x41:0x5B] = 1, 2
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_SLICE = 1 << 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_echoes")


def counts(text: bytes | None) -> tuple[int, ...]:
    """``COUNTS`` of a text."""
    text = text or b""
    h, first, end = textscan.words(text.translate(_SPACES))
    kinds, symbols = np.zeros(3, np.int64), 0
    for at in range(0, len(text), _SLICE):
        b = np.frombuffer(text, np.uint8, min(_SLICE, len(text) - at), at)
        kinds += np.bincount(_KINDS[b], minlength=3)
        symbols += int(_SYMBOL[b].sum())
    seen, lines, again = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    return (len(h), int((end - first).sum()) - int(kinds[1]), symbols, again, repeated(h), lines, int(kinds[2]), int((h[1:] == h[:-1]).sum()))


def repeated(h: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows that occur more than once."""
    w = textscan.windows(h, width)
    if len(w) < 2:
        return 0
    _, at, n = np.unique(w, return_inverse=True, return_counts=True)
    hit = n[at] > 1
    edges = np.zeros(len(h) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(hit), 1)
    np.add.at(edges, np.flatnonzero(hit) + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _shares(n: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The vector of each document that has words, in units: the logarithm of the word length, and angles of shares."""
    def angle(part, whole):
        return 2 * np.arcsin(np.sqrt(np.minimum(part / np.maximum(whole, 1), 1)))

    found = (np.log(n["word_chars"] / np.maximum(n["n_words"], 1) + 1e-9), angle(n["n_symbols"], n["word_chars"]), angle(n["n_dup_lines"], n["n_lines"]),
             angle(n["n_repeat_words"], n["n_words"]), angle(n["n_capitals"], n["word_chars"]), angle(n["n_echoes"], n["n_words"]))
    return [np.rint(np.maximum(x, 0) * UNIT).astype(np.int32) for x in found]


def _measured(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, lang, source, text, ...) with counts and vectors in place of the text."""
    fields = [f for f in rows.schema.fields if f.name != "text"]
    text = rows.columns.index("text")

    def measure(batches):
        for batch in batches:
            told = np.array([counts(t) for t in textscan.texts(batch.column(text))], np.int64).reshape(-1, len(COUNTS))
            given = [c for k, c in enumerate(batch.columns) if k != text]
            n = dict(zip(COUNTS, told.T))
            yield pa.RecordBatch.from_arrays([*given, *(pa.array(n[c]) for c in COUNTS), *(pa.array(x) for x in _shares(n))],
                                             names=[*(f.name for f in fields), *COUNTS, *PARTS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} long" for c in COUNTS), *(f"{c} int" for c in PARTS)])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.mapInArrow(measure, schema).withColumn("base_failed", failed)


# --- estimates -------------------------------------------------------------------------------------------------------
# A table of estimates has the key columns, centre (a double per part), inverse (the upper triangle of the inverse
# scatter, row by row), and scatter itself for those that are drawn towards it.

_PAIRS = [(i, j) for i in range(len(PARTS)) for j in range(i, len(PARTS))]
_ESTIMATE = "centre array<double>, scatter array<double>, inverse array<double>"


def chi_square(x: float, freedom: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def chi_square_quantile(p: float, freedom: int) -> float:
    z = NormalDist().inv_cdf(p)
    low, high = 0.0, 4 * (freedom + z * z + 10)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < p else (low, middle)
    return high


#: the covariance of the nearest FRACTION of normal vectors is too small by this factor
CONSISTENT = FRACTION / chi_square(chi_square_quantile(FRACTION, len(PARTS)), len(PARTS) + 2)


def _full(upper) -> np.ndarray:
    out = np.zeros((len(PARTS), len(PARTS)))
    for (i, j), v in zip(_PAIRS, upper):
        out[i, j] = out[j, i] = v
    return out


def _estimate(n: float, centre: np.ndarray, scatter: np.ndarray, prior_centre: np.ndarray | None, prior: np.ndarray) -> tuple:
    """Centre and scatter of n documents, drawn towards a prior as if that were ``PRIOR`` more."""
    if prior_centre is not None:
        apart = centre - prior_centre
        scatter = scatter + np.outer(apart, apart) * PRIOR / (n + PRIOR)  # seen from the common centre
        centre = (n * centre + PRIOR * prior_centre) / (n + PRIOR)
        scatter = (n * scatter + PRIOR * prior) / (n + PRIOR)
    else:
        scatter = scatter + prior * PRIOR / (n + PRIOR)
    scatter = scatter + prior_floor()
    inverse = np.linalg.inv(scatter)
    return centre.tolist(), [scatter[i, j] for i, j in _PAIRS], [inverse[i, j] for i, j in _PAIRS]


def prior_floor() -> np.ndarray:
    """What every variance has at least: small next to the spreads, so that parts that never vary do not judge alone."""
    return np.diag([(s / 2) ** 2 for s in SPREADS.values()])


def _solved(sums: DataFrame, keys: list[str], fixed: bool) -> DataFrame:
    """Estimates from rows of keys, n, centre, scatter and, unless ``fixed``, prior_centre and prior."""
    spreads = np.diag([s ** 2 for s in SPREADS.values()])

    def solve(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                own = (float(row.n), np.array(row.centre), _full(row.scatter))
                out.append(_estimate(*own, None, spreads) if fixed else _estimate(*own, np.array(row.prior_centre), _full(row.prior)))
            told = pd.DataFrame(out, columns=["centre", "scatter", "inverse"])
            yield pd.concat([frame[keys].reset_index(drop=True), told], axis=1)

    return sums.mapInPandas(solve, ", ".join([*(f"{k} string" for k in keys), _ESTIMATE]))


def _distance() -> Column:
    """Squared Mahalanobis distance of the row's vector to the joined estimate."""
    d = [F.col(p) / F.lit(float(UNIT)) - F.col("centre")[k] for k, p in enumerate(PARTS)]
    return sum((d[i] * d[j] * F.col("inverse")[k] * (1 if i == j else 2) for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


def _medians(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, n, median and median distance from it of each part: the start of the steps."""
    long = vectors.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col(p).alias("x")) for k, p in enumerate(PARTS)))).alias("v"))
    told = stored(long.groupBy(*keys, F.col("v.part").alias("part"), F.col("v.x").alias("x")).agg(F.count("*").alias("k")), "values")  # values are few: whole numbers of a bounded range

    def middle(table: DataFrame, x: str) -> DataFrame:
        w = Window.partitionBy(*keys, "part")
        run = table.withColumn("run", F.sum("k").over(w.orderBy(x))).withColumn("all", F.sum("k").over(w))
        return run.where("2 * run >= all").groupBy(*keys, "part").agg(F.min(x).alias("m"), F.max("all").alias("n"))

    centre = middle(told, "x")
    away = told.join(centre.drop("n"), [*keys, "part"]).withColumn("x", F.abs(F.col("x") - F.col("m")))
    away = middle(away.groupBy(*keys, "part", "x").agg(F.sum("k").alias("k")), "x")
    both = centre.join(away.select(*keys, "part", F.col("m").alias("mad")), [*keys, "part"])
    row = F.sort_array(F.collect_list(F.struct("part", "m", "mad")))  # one for each part
    wide = both.groupBy(*keys).agg(F.max("n").alias("n"), row.alias("r"))
    centre = F.transform("r", lambda v: v["m"] / F.lit(float(UNIT)))
    scatter = F.array(*(F.pow(F.col("r")[i]["mad"] * F.lit(1.4826 / UNIT), 2) if i == j else F.lit(0.0) for i, j in _PAIRS))
    return wide.select(*keys, "n", centre.alias("centre"), scatter.alias("scatter"))


def _nearest(vectors: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, n, mean and covariance of the nearest ``FRACTION`` of each group."""
    near = F.least(F.floor(8 * F.log2(1 + _distance())), F.lit(CLASSES - 1)).cast("int").alias("class")
    x = [F.col(p).cast("long") for p in PARTS]
    sums = [F.sum(x[k]).alias(f"s{k}") for k in range(len(x))] + [F.sum(x[i] * x[j]).alias(f"q{k}") for k, (i, j) in enumerate(_PAIRS)]
    classes = vectors.join(estimates, keys).groupBy(*keys, near).agg(F.count("*").alias("n"), *sums)
    w = Window.partitionBy(*keys)
    run = classes.withColumn("run", F.sum("n").over(w.orderBy("class"))).withColumn("all", F.sum("n").over(w))
    names = [f"s{k}" for k in range(len(x))] + [f"q{k}" for k in range(len(_PAIRS))]
    held = run.where(F.col("run") - F.col("n") < FRACTION * F.col("all")).groupBy(*keys).agg(F.sum("n").alias("h"), F.max("all").alias("n"), *(F.sum(c).alias(c) for c in names))
    mean = [F.col(f"s{k}") / F.col("h") for k in range(len(x))]
    # h * q - s * s is exact; only the division rounds
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    spread = [((wide("h").cast("decimal(18,0)") * wide(f"q{k}").cast("decimal(20,0)") - wide(f"s{i}").cast("decimal(18,0)") * wide(f"s{j}").cast("decimal(18,0)")).cast("double")
               / (F.col("h").cast("double") * F.col("h"))) * F.lit(CONSISTENT / UNIT ** 2) for k, (i, j) in enumerate(_PAIRS)]
    return held.select(*keys, "n", F.array(*(m / F.lit(float(UNIT)) for m in mean)).alias("centre"), F.array(*spread).alias("scatter"))


def _level(vectors: DataFrame, keys: list[str], prior: DataFrame | None) -> DataFrame:
    """Estimates of every group of ``keys``, drawn towards those of ``prior`` by its keys."""
    def solved(sums: DataFrame) -> DataFrame:
        if prior is not None:
            towards = prior.select(*(c for c in prior.columns if c in keys), F.col("centre").alias("prior_centre"), F.col("scatter").alias("prior"))
            sums = sums.join(towards, [c for c in prior.columns if c in keys])
        return stored(_solved(sums, keys, prior is None), "estimates")

    estimates = solved(_medians(vectors, keys))
    for _ in range(STEPS):
        estimates = solved(_nearest(vectors, estimates, keys))
    return estimates


def estimates(measured: DataFrame) -> DataFrame:
    """Minimum covariance determinant estimates of every (lang, source)."""
    vectors = measured.where("not base_failed").select("lang", "source", *PARTS)
    return _level(vectors, ["lang", "source"], _level(vectors.drop("source"), ["lang"], None))


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Counts, the verdict of the limits and the final one for every row: ``distance`` is null where limits have failed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    measured = stored(_measured(rows), "measured")
    found = measured.join(estimates(measured), ["lang", "source"], "left")
    distance = F.when(~F.col("base_failed"), _distance())
    kept = F.coalesce(distance <= chi_square_quantile(cut, len(PARTS)), F.lit(False))
    return found.select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), distance.alias("distance"))


def keep(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that are kept, as given."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    measured = stored(_measured(rows), "measured")
    found = measured.where("not base_failed").join(estimates(measured), ["lang", "source"])
    return found.where(_distance() <= chi_square_quantile(cut, len(PARTS))).select("row.*")
