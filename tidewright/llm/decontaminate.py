"""Benchmark decontamination: n-grams of test items looked up in every text.

Method: the hashes of all windows of the benchmark form a set that is broadcast; the word windows of each text are
tested against it, each hit is verified word by word, and the hit words (or their documents) are removed.

The broadcast is used only for a benchmark whose measured size is within ``max_broadcast_bytes``. A larger one is
joined by window instead, with the same result: windows of distinct texts meet windows of items in a salted join.

Defined cases: a null or empty text has no words and no hits; an item without words has no windows; an item of
fewer words than a window is one window; an item without id is removed like others but not listed; repeated
documents each get a row, repeated items count once per id; an empty benchmark hits nothing; other columns pass
through ``decontaminate`` untouched and may have any name but that of the text column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textscan

WINDOW = 10
MAX_BROADCAST_BYTES = 16 << 20
_SALTS = 32
SCAN = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


class WindowSet:
    """Windows of the items: sorted hashes, and the words behind each for verification."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.ids = [i for i, _ in items]
        self.tables: dict[int, tuple] = {}
        found: dict[int, list] = {}
        for k, (_, text) in enumerate(items):
            data = text.translate(textscan.ALNUM)
            h, starts, ends = textscan.words(data)
            if size := min(window, len(h)):
                found.setdefault(size, []).append((textscan.windows(h, size), k, data, starts, ends))
        for size, parts in found.items():
            keys = np.concatenate([p[0] for p in parts])
            owner = np.concatenate([np.full(len(p[0]), k, np.int64) for k, p in enumerate(parts)])
            place = np.concatenate([np.arange(len(p[0])) for p in parts])
            order = np.argsort(keys, kind="stable")
            bits = min(24, max(10, int(len(keys)).bit_length() + 3))
            seen = np.zeros(1 << bits, bool)
            seen[keys >> np.uint64(64 - bits)] = True
            self.tables[size] = (keys[order], owner[order], place[order], parts, seen, np.uint64(64 - bits))

    def find(self, data: bytes, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list, set]:
        """(first word, words) of each hit window, and the ids of the items behind them."""
        hits, ids = [], set()
        for size, (keys, owner, place, parts, seen, shift) in self.tables.items():
            got = textscan.windows(h, size)
            for i in np.flatnonzero(seen[got >> shift]):
                low, high = np.searchsorted(keys, got[i], "left"), np.searchsorted(keys, got[i], "right")
                if low == high:
                    continue
                here, hit = data[starts[i]:ends[i + size - 1]].split(), False
                for j in range(low, high):
                    _, item, text, s, e = parts[owner[j]]
                    if text[s[place[j]]:e[place[j] + size - 1]].split() == here:
                        hit = True
                        ids.add(self.ids[item])
                if hit:
                    hits.append((int(i), size))
        return hits, ids - {None}


def _marked(n: int, hits) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    for start, size in hits:
        steps[start] += 1
        steps[start + size] -= 1
    return np.cumsum(steps[:-1]) > 0


def _without(text: bytes, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The text without its runs of hit words and what stands between the words of a run."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    kept, at = [], 0
    for first, last in zip(edges[::2], edges[1::2]):
        kept.append(text[at:starts[first]])
        at = ends[last - 1]
    return b"".join([*kept, text[at:]])


def _pieces(batch: pa.RecordBatch, find) -> Iterator[tuple]:
    """Row number, text, word bounds, mask of hit words and item ids of each row; ``find`` gives hits and ids."""
    column = batch.column(batch.schema.get_field_index("_text"))
    for row, text in enumerate(textscan.texts(column)):
        data = (text or b"").translate(textscan.ALNUM)
        h, starts, ends = textscan.words(data)
        hits, ids = find(row, data, h, starts, ends)
        yield row, text, starts, ends, _marked(len(h), hits), ids


def _finish(batches, finder, mode: str):
    """Digest rows, or the rows to keep, of a stream of batches; ``finder(batch)`` gives the find function."""
    for batch in batches:
        if mode == "scan":
            out = []
            for row, _, _, _, mask, ids in _pieces(batch, finder(batch)):
                names = sorted(ids)
                out.append((batch.column(0)[row].as_py(), len(mask), int(mask.sum()), len(names),
                            hashlib.sha256(",".join(names).encode()).hexdigest(), bool(mask.any()), names))
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])
            continue
        own = [i for i, f in enumerate(batch.schema) if not f.name.startswith("_hit") and f.name not in ("_items", "_text")]
        at, keep, texts = batch.schema.get_field_index("_text"), [], []
        for row, text, starts, ends, mask, _ in _pieces(batch, finder(batch)):
            if mode == "documents":
                if not mask.any():
                    keep.append(row)
            else:
                texts.append(_without(text, mask, starts, ends) if mask.any() else text)
        if mode == "documents":
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(i) for i in [*own, at]], names=[*(batch.schema[i].name for i in own), "_text"])
        else:
            clean = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), clean], names=[*(batch.schema[i].name for i in own), "_text"])


def _applied(rows: DataFrame, benchmark: DataFrame, mode: str, schema, window: int, max_broadcast_bytes: int) -> DataFrame:
    """``rows`` has the text as ``_text`` and, for a scan, the id first."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("t")).where("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count("*")).first()
    if size[0] + 64 * size[1] <= max_broadcast_bytes:  # what is collected and broadcast is bounded by this test
        listed = [(r[0], r[1].encode()) for r in items.collect()]
        shared = rows.sparkSession.sparkContext.broadcast(listed)

        def scan(batches):
            known = WindowSet(shared.value, window)
            return _finish(batches, lambda _: lambda row, *text: known.find(*text), mode)

        return rows.mapInArrow(scan, schema)
    return _by_join(rows, items, mode, schema, window)


def _by_join(rows: DataFrame, items: DataFrame, mode: str, schema, window: int) -> DataFrame:
    def listed(batches, sizes):
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), textscan.texts(batch.column(1))):
                data = text.translate(textscan.ALNUM)
                _, s, e = textscan.words(data)
                for n in sizes or [min(window, len(s))]:
                    out += [(key, i, n, b" ".join(data[s[i]:e[i + n - 1]].split())) for i in range(len(s) - n + 1) if n]
                if len(out) > 50_000:
                    yield _window_rows(out)
                    out = []
            yield _window_rows(out)

    kind = "key string, place long, size long, words binary"
    known = items.mapInArrow(lambda b: listed(b, None), kind).select("words", "size", F.col("key").alias("item")).distinct()
    sizes = [r[0] for r in known.select("size").distinct().collect()]  # at most ``window`` values
    keyed = rows.withColumn("_hit_key", F.sha2(F.coalesce("_text", F.lit("")), 256))
    distinct = keyed.select("_hit_key", "_text").where("_text is not null").dropDuplicates(["_hit_key"])
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    met = (
        distinct.mapInArrow(lambda b: listed(b, sizes or [window]), kind)
        .withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(_SALTS)).cast("int")).join(spread, ["words", "size", "salt"])
        .groupBy("key").agg(F.collect_set(F.struct("place", "size")).alias("_hits"), F.collect_set("item").alias("_items"))
    )
    joined = keyed.join(met.withColumnRenamed("key", "_hit_key"), "_hit_key", "left").select(*rows.columns, "_hits", "_items")

    def finder(batch):
        hits, ids = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("_hits", "_items"))
        return lambda row, *_: ([(h["place"], h["size"]) for h in hits[row] or ()], set(ids[row] or ()))

    return joined.mapInArrow(lambda batches: _finish(batches, finder, mode), schema)


def _window_rows(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["key", "place", "size", "words"])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Per document: its words, the words hit, and the items (``item_id``) whose windows occur in it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    return _applied(rows, benchmark, "scan", SCAN, window, max_broadcast_bytes)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """The documents without contaminated ones, or with their hit words cut out; columns as given."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    own = [c for c in docs.columns if c != "text"]
    names = {c: f"c{i}" for i, c in enumerate(own)}
    rows = docs.select(*(F.col(f"`{c}`").alias(names[c]) for c in own), F.col("text").alias("_text"))
    done = _applied(rows, benchmark, remove, rows.schema, window, max_broadcast_bytes)
    return done.select(*(F.col("_text").alias("text") if c == "text" else F.col(names[c]).alias(c) for c in docs.columns))
