"""Best-fit packing of token sequences by exact complements, planned on counts of lengths.

A sequence holds at most ``max_tokens``. Longer documents are cut into full pieces, the first of which may be
shorter. Only the histogram of piece lengths, at most ``max_tokens`` counts at any corpus size, reaches the driver.
From the longest length down, the plan looks up one, two or three lengths whose sum is exactly the gap beside it and
consumes the combination as often as the counts allow; what stays is packed best fit, longest first. The plan is a
short list of intervals "the pieces of length L ranked a to b go to these sequences", and pieces find their place by
their rank among the pieces of equal length. Ranks come from counts per (length, bucket), so a length that a third of
all pieces share is still ranked in many tasks.

Defined cases: a null or empty text is the one end token; any text is encoded, however long its runs of white space; equal pieces are interchangeable, so ties and repeated rows
may swap places but never change the packing; an empty table packs to nothing; other columns are left out.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.storage import stored
from tidewright.llm import textscan

MAX_TOKENS = 2048
END = 0
BUCKET_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.cache
def encoder(path: str):
    """Byte-level BPE of a rank file; ``<|endoftext|>`` in a text is its special id, as in the JSON of the same vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def slow_encoder(path: str):
    """The JSON of the same vocabulary, beside the rank file: slower, but without a limit on runs of white space."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")


def token_ids(texts, path: str) -> Iterator[np.ndarray]:
    """Ids of each text and the end token, as 32-bit little-endian numbers. Bytes that are not UTF-8 become U+FFFD."""
    fast, slow = encoder(path), None
    for text in texts:
        text = (text or b"").decode(errors="replace")
        try:
            ids = fast.encode(text, allowed_special="all")
        except ValueError:  # a run of white space beyond the stack of its pattern
            slow = slow or slow_encoder(path)
            ids = slow.encode(text, add_special_tokens=False).ids
        ids.append(END)
        yield np.array(ids, "<u4")


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full but perhaps the first."""
    first = n % limit or limit
    return [(0, first), *((at, limit) for at in range(first, n, limit))]


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document, with a checksum of their ids and, if asked for, the ids."""
    def cut(batches):
        for batch in batches:
            rows, values = [], []
            for doc, ids in zip(batch.column(0).to_pylist(), token_ids(textscan.texts(batch.column(1)), tokenizer)):
                for k, (start, length) in enumerate(cuts(len(ids), max_tokens)):
                    part = ids[start:start + length]
                    rows.append((doc, k, start, length, zlib.crc32(part.tobytes())))
                    if keep_ids:
                        values.append(part.tolist())
            columns = list(zip(*rows)) or [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(values, pa.list_(pa.int32()))] if keep_ids else arrays,
                                             names=[*names, "ids"] if keep_ids else names)

    schema = PIECES + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def plan(counts: dict[int, int], limit: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns (length, copies), … and how many sequences follow each; together they use up ``counts``.

    Every step uses up a length, so there are at most a few patterns for each length, whatever the counts.
    """
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def take(lengths: list[int]) -> None:
        need = {x: lengths.count(x) for x in lengths}
        times = int(min(left[x] // k for x, k in need.items()))
        for x, k in need.items():
            left[x] -= k * times
        done.append((tuple(sorted(need.items(), reverse=True)), times))

    rest = []
    for length in range(limit, 0, -1):
        while left[length]:
            fill = complement(left, length, limit - length)
            if fill is None:
                break
            take([length, *fill])
        if left[length]:
            rest.append((length, int(left[length])))
            left[length] = 0
    return done + best_fit(rest, limit)


def complement(left: np.ndarray, length: int, gap: int) -> list[int] | None:
    """One, two or three available lengths, larger ones first, that add up to ``gap``; none if the gap is nothing."""
    if gap == 0:
        return []
    own = left.copy()
    own[length] -= 1
    have = own > 0
    if have[gap]:
        return [gap]
    low = np.arange(1, gap)
    ok = have[1:gap] & have[gap - low]
    if gap % 2 == 0 and gap > 1:
        ok[gap // 2 - 1] &= own[gap // 2] > 1
    if ok.any():
        a = int(low[np.flatnonzero(ok)[-1]])
        return [a, gap - a]
    flags = have[:gap].astype(float)
    flags[0] = 0
    size = 1 << int(2 * gap).bit_length()
    spectrum = np.fft.rfft(flags, size)
    pair_sums = np.fft.irfft(spectrum * spectrum, size)[:gap] > 0.5
    for a in np.flatnonzero(have[1:gap] & pair_sums[gap - low])[::-1] + 1:
        b = np.arange(1, gap - a)
        for x in b[have[1:gap - a] & have[gap - a - b]][::-1]:
            fill = [int(a), int(x), int(gap - a - x)]
            if all(own[v] >= fill.count(v) for v in fill):
                return fill
    return None


def best_fit(rest: list[tuple[int, int]], limit: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(length, count), longest first, each into the fullest open sequences that have room, all equal ones at once."""
    open_by_gap: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length, n in rest:
        while n:
            gap = min((g for g in open_by_gap if g >= length), default=None)
            if gap is None:
                copies = limit // length
                for k, m in ((copies, n // copies), (n % copies, 1)):
                    if k and m:
                        open_by_gap.setdefault(limit - k * length, []).append(({length: k}, m))
                n = 0
                continue
            held, m = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del open_by_gap[gap]
            copies = min(gap // length, n)  # the longest rest fills a sequence again as long as it fits best there
            used = min(m, n // copies)
            if used < m:
                open_by_gap.setdefault(gap, []).append((held, m - used))
            more = dict(held)
            more[length] = more.get(length, 0) + copies
            open_by_gap.setdefault(gap - copies * length, []).append((more, used))
            n -= used * copies
    return [(tuple(sorted(held.items(), reverse=True)), m) for groups in open_by_gap.values() for held, m in groups]


def intervals(patterns) -> np.ndarray:
    """Rows length, first rank, copies per sequence, first sequence, offset of the first copy; sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for held, times in patterns:
        offset = 0
        for length, copies in held:
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(df: DataFrame, counts: dict[int, int], order: list[str]) -> DataFrame:
    """``rank`` from 0 among the rows of equal ``length``, counted over buckets of bounded size."""
    shares = df.sparkSession.createDataFrame([(k, -(-n // BUCKET_ROWS)) for k, n in counts.items()], "length long, buckets long")
    spread = df.join(F.broadcast(shares), "length").withColumn("bucket", F.pmod(F.xxhash64(*order), F.col("buckets"))).drop("buckets")
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select(
        "length", "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order))
    return (
        spread.withColumn("inside", inside).join(before, ["length", "bucket"])
        .withColumn("rank", F.col("inside") - 1 + F.col("before")).drop("inside", "before", "bucket")
    )


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, keep_ids: bool = False) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``, its place in that sequence, gapless from 0."""
    cut = stored(pieces(docs, tokenizer, max_tokens, keep_ids), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most max_tokens rows
    table = intervals(plan(counts, max_tokens))
    keys = table[:, 0] << 48 | table[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length << 48 | rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            within = rank - row[:, 1]
            kept = batch.select([n for n in batch.schema.names if n != "rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(row[:, 3] + within // np.maximum(row[:, 2], 1)), pa.array(row[:, 4] + within % np.maximum(row[:, 2], 1) * length)],
                names=[*kept.schema.names, "sequence_id", "offset"])

    schema = PIECES + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long"
    order = ["doc_id", "piece", "start", "ids_crc32"]
    if not keep_ids:
        return ranked(cut, counts, order).select(*cut.columns, "rank").mapInArrow(place, schema)
    heads = cut.drop("ids").withColumn("ids", F.lit(None).cast("array<int>"))
    places = ranked(heads, counts, order).select(*cut.columns, "rank").mapInArrow(place, schema).drop("ids")
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))  # repeated rows are interchangeable
    left, right = cut.withColumn("nth", nth), places.withColumn("nth", nth)
    met = [left[c].eqNullSafe(right[c]) for c in [*same, "nth"]]
    return left.join(right, met).select(*(left[c] for c in cut.columns), right["sequence_id"], right["offset"])
