"""Source divergence audit with late string materialization.

How far the vocabulary of each source stands from that of the other sources of its language, and which terms set it
apart. Terms travel as fixed-width digests: document frequencies, counts, joins and ranks all use (lang, digest). Next
to the counts every task says, once for each digest it kept, the smallest and the largest string it stood for; where these differ
over the corpus, the digest is split: its terms are counted once more by their text and get numbers of their own. Texts
are joined back for the terms in the result only.

Two passes over the texts: one sums document frequencies, the other counts the terms frequent enough; a bitmap of fixed size of
their digests lets tasks drop most others, and a join drops the rest. Divergences between sources are summed over tiles
of at most ``SOURCES`` x ``SOURCES`` sources and about ``TERMS`` terms, so no task holds a language.

Defined cases: null texts, languages and sources are empty strings; a group without terms still has its pairs; a
language without kept terms has divergence 0; repeated rows and ids count as documents of their own; ties go to the
item first in UTF-8 order; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.storage import stored
from tidewright.llm import textscan

#: terms of ASCII letters and all non-ASCII characters
TERM_BYTES = textscan.byte_table([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
BITS = 64
SLOT_BITS = 24  # 2 MB of bitmap
_BUCKET = 1 << 15  # bits of one row of Spark's bitmaps
SOURCES, TERMS = 128, 1024
HELD = 1 << 21
TOP = 50
_SALTS = 16


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _digests(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, first, end = textscan.words(data)
    return h >> np.uint64(64 - bits), first, end


def _frequent(docs: DataFrame, least: int, bits: int) -> DataFrame:
    """(lang, digest): digests in at least ``least`` documents of the language."""
    def fold(batches):
        held, n = {}, 0

        def out():
            for lang, found in held.items():
                d, k = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(d), pa.string()), pa.array(d.view(np.int64)), pa.array(k.astype(np.int64))], names=["lang", "digest", "docs"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), textscan.texts(batch.column(1))):
                d = np.unique(_digests(text.translate(TERM_BYTES), bits)[0])
                held.setdefault(lang, []).append(d)
                n += len(d)
            if n > HELD:
                yield from out()
                held, n = {}, 0
        yield from out()

    rows = docs.select("lang", "text").mapInArrow(fold, "lang string, digest long, docs long")
    return rows.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "digest")


def _bitmap(digests: DataFrame) -> np.ndarray:
    """Which slots hold a digest: ``SLOT_BITS`` say how many there are, whatever the table."""
    slot = F.col("digest").bitwiseAND((1 << SLOT_BITS) - 1) + 1
    rows = digests.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(1 << SLOT_BITS, bool)
    for bucket, bits in rows:
        at = (bucket - 1) * _BUCKET
        out[at:at + _BUCKET] = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little")[:_BUCKET]
    return out


def _unlike(data: np.ndarray, first: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b of a buffer (padded by 8 bytes) differ, eight bytes at a time."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    out = size[a] != size[b]
    left, at = np.flatnonzero(~out), 0
    while len(left):
        room = np.minimum(size[a[left]] - at, 8)
        mask = np.where(room >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * np.minimum(room, 7)).astype(np.uint64)) - np.uint64(1))
        x, y = (eight[first[k[left]] + at].copy().view("<u8")[:, 0] for k in (a, b))
        differ = (x ^ y) & mask != 0
        out[left[differ]] = True
        at += 8
        left = left[~differ & (size[a[left]] > at)]
    return out


class _Counts:
    """Counts of (group, digest) of one task, and the strings each (lang, digest) stands for."""

    def __init__(self, wanted: np.ndarray, bits: int):
        self.wanted, self.bits = wanted, bits
        self.groups: dict[tuple[str, str], int] = {}
        self.langs: dict[str, int] = {}
        self.cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.strings: dict[tuple[int, int], list[bytes]] = {}
        self.clear()

    def clear(self) -> None:
        self.texts: list[bytes] = []
        self.owners: list[tuple[str, str]] = []
        self.room = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        self.texts.append(text.translate(TERM_BYTES))
        self.owners.append((lang, source))
        self.room += len(text) + 1
        if self.room > HELD:
            self.count()

    def count(self) -> None:
        if not self.texts:
            return
        buffer = b" ".join(self.texts)
        d, first, end = _digests(buffer, self.bits)
        ends = np.cumsum([len(t) + 1 for t in self.texts])
        near = self.wanted[(d & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)]
        d, first, size = d[near], first[near], (end - first)[near]
        group = np.array([self.groups.setdefault(o, len(self.groups)) for o in self.owners], np.int64)
        lang = np.array([self.langs.setdefault(o[0], len(self.langs)) for o in self.owners], np.int64)
        doc = np.searchsorted(ends, first, side="right")
        self._strings(buffer, lang[doc], d, first, size)
        self._merge(group[doc], d, np.ones(len(d), np.int64))
        if sum(len(c[0]) for c in self.cells) > HELD:
            merged = [np.concatenate(x) for x in zip(*self.cells)]
            self.cells = []
            self._merge(*merged)
        self.clear()

    def _merge(self, group: np.ndarray, d: np.ndarray, n: np.ndarray) -> None:
        if not len(d):
            return
        order = np.lexsort((d, group))
        group, d, n = group[order], d[order], n[order]
        new = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (d[1:] != d[:-1]))))
        self.cells.append((group[new], d[new], np.add.reduceat(n, new)))

    def _strings(self, buffer: bytes, lang: np.ndarray, d: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        if not len(d):
            return
        order = np.lexsort((d, lang))
        same = (d[order][1:] == d[order][:-1]) & (lang[order][1:] == lang[order][:-1])
        a, b = order[:-1][same], order[1:][same]
        data = np.frombuffer(buffer + b" " * 8, np.uint8)
        odd = b[_unlike(data, first, size, a, b)]
        for k in (*order[np.concatenate(([True], ~same))].tolist(), *odd.tolist()):
            term = buffer[first[k]:first[k] + size[k]]
            held = self.strings.setdefault((int(lang[k]), int(d[k])), [term, term])
            held[0], held[1] = min(held[0], term), max(held[1], term)

    def rows(self):
        self.count()
        names, langs = list(self.groups), list(self.langs)
        cells, self.cells = self.cells, []
        if cells:
            self._merge(*(np.concatenate(x) for x in zip(*cells)))
            group, d, n = self.cells[0]
            for at in range(0, len(d), 1 << 16):
                g = group[at:at + (1 << 16)].tolist()
                none = pa.nulls(len(g), pa.string())
                yield self._batch([names[x][0] for x in g], [names[x][1] for x in g], d[at:at + (1 << 16)], n[at:at + (1 << 16)], none, none)
        told = list(self.strings.items())
        for at in range(0, len(told), 1 << 16):
            part = told[at:at + (1 << 16)]
            yield self._batch([langs[k[0]] for k, _ in part], pa.nulls(len(part), pa.string()), np.array([k[1] for k, _ in part], np.uint64), None,
                              *(pa.array([v[i].decode() for _, v in part], pa.string()) for i in (0, 1)))

    @staticmethod
    def _batch(lang, source, d, n, low, high) -> pa.RecordBatch:
        n = pa.nulls(len(d), pa.int64()) if n is None else pa.array(n)
        columns = [pa.array(lang, pa.string()), source if isinstance(source, pa.Array) else pa.array(source, pa.string()), pa.array(d.view(np.int64)), n, low, high]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "digest", "n", "low", "high"])


def _counted(docs: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """Counts (lang, source, digest, n) of each task, and the strings (lang, digest, low, high) in rows without a count."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(frequent)))

    def fold(batches):
        counts = _Counts(np.unpackbits(shared.value).astype(bool), bits)
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), textscan.texts(batch.column(2))):
                counts.add(lang, source, text)
        yield from counts.rows()

    return docs.mapInArrow(fold, "lang string, source string, digest long, n long, low string, high string")


def _split(docs: DataFrame, shared_digests: DataFrame, least: int, bits: int) -> DataFrame:
    """(lang, source, digest, k, n, term) of the kept terms of digests that stand for several terms, numbered from 1."""
    bitmap = docs.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(shared_digests)))

    def fold(batches):
        wanted = np.unpackbits(bitmap.value).astype(bool)
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), textscan.texts(batch.column(2))):
                data = text.translate(TERM_BYTES)
                d, first, end = _digests(data, bits)
                near = np.flatnonzero(wanted[(d & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)])
                seen: dict[bytes, list[int]] = {}
                for k in near.tolist():
                    seen.setdefault(data[first[k]:end[k]], [int(d[k].astype(np.int64)), 0])[1] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen), pa.string()), pa.array([source] * len(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
                     pa.array([t.decode() for t in seen], pa.string()), pa.array([v[1] for v in seen.values()], pa.int64())],
                    names=["lang", "source", "digest", "term", "n"])

    rows = docs.mapInArrow(fold, "lang string, source string, digest long, term string, n long").join(shared_digests, ["lang", "digest"], "left_semi")
    cells = stored(rows.groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.count("*").alias("docs")), "split")
    kept = cells.groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    number = F.row_number().over(Window.partitionBy("lang", "digest").orderBy("term"))
    return cells.join(kept.select("lang", "digest", "term", number.alias("k")), ["lang", "digest", "term"]).select("lang", "source", "digest", "k", "n", "term")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * terms)), in whole numbers of up to 38 digits."""
    above = (F.lit(1_000_000_000).cast("decimal(10,0)") * (n + F.lit(5)).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.lit(1) + F.call_function("div", above, (total + 5 * terms).cast("decimal(20,0)")).cast("long")


def _distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, more): over the terms that occur in tiles, by how much p of two sources differ beyond their p of no occurrence."""
    blocks = groups.groupBy("lang").agg((F.floor(F.max("at") / SOURCES) + 1).cast("int").alias("blocks"))
    tiles = F.ceil(F.col("known") / TERMS).cast("int").alias("tiles")
    heads = groups.where("known > 0").select("lang", "at", F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("known") / TERMS).cast("int") - 1)).alias("tile"), F.lit(None).cast("long").alias("digest"), F.lit(-1).alias("k"))
    body = cells.join(groups.select("lang", "source", "at", tiles), ["lang", "source"])
    body = body.select("lang", "at", "p", F.pmod(F.xxhash64("digest", "k"), F.col("tiles")).cast("int").alias("tile"), "digest", "k")
    rows = heads.unionByName(body).join(blocks, "lang").withColumn("own", F.floor(F.col("at") / SOURCES).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("lang", "tile", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "at", "p", "digest", "k")

    def add(key, group):
        lang, _, left, right = (k.as_py() for k in key)
        at, p, k = group["at"].to_numpy(), group["p"].to_numpy(), group["k"].to_numpy()
        head = k < 0
        sources = np.unique(at[head])
        none = np.zeros(len(sources), np.int64)
        none[np.searchsorted(sources, at[head])] = p[head]
        d = group["digest"].fill_null(0).to_numpy()[~head]
        term = np.unique(np.stack((d, k[~head])), axis=1, return_inverse=True)[1].ravel()
        table = np.repeat(none[:, None], int(term.max(initial=-1)) + 1, axis=1)
        table[np.searchsorted(sources, at[~head]), term] = p[~head]
        out = []
        for i, a in enumerate(sources.tolist()):
            if a // SOURCES == left:
                others = np.flatnonzero((sources > a) & (sources // SOURCES == right))
                more = np.abs(table[others] - table[i]).sum(1) - np.abs(none[others] - none[i]) * table.shape[1]
                out += [(lang, a, b, m) for b, m in zip(sources[others].tolist(), more.tolist())]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["lang", "a", "b", "more"])

    summed = rows.groupBy("lang", "tile", "left", "right").applyInArrow(add, "lang string, a int, b int, more long")
    return summed.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def audit(docs: DataFrame, least: int = 30, top: int = TOP, bits: int = BITS) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences from the other sources, and the ``top`` terms overused.

    ``bits`` is the width of a digest; the result is the same for any width.
    """
    docs = _given(docs)
    frequent = stored(_frequent(docs, least, bits), "frequent")
    found = stored(_counted(docs, frequent, bits), "counts")
    counts = found.where("n is not null").groupBy("lang", "source", "digest").agg(F.sum("n").alias("n")).join(frequent, ["lang", "digest"], "left_semi")
    names = found.where("n is null").join(frequent, ["lang", "digest"], "left_semi").groupBy("lang", "digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    names = stored(names, "names")
    several = names.where("low <> high").select("lang", "digest")
    cells = counts.select("lang", "source", "digest", F.lit(0).alias("k"), "n")
    texts = names.where("low = high").select("lang", "digest", F.lit(0).alias("k"), F.col("low").alias("term"))
    if not several.isEmpty():
        split = stored(_split(docs, several, least, bits), "split")
        cells = cells.join(several, ["lang", "digest"], "left_anti").unionByName(split.drop("term"))
        texts = texts.unionByName(split.select("lang", "digest", "k", "term").distinct())
    cells = stored(cells, "cells")
    return _ranked(docs, cells, texts, top)


def _ranked(docs: DataFrame, cells: DataFrame, texts: DataFrame, top: int) -> DataFrame:
    terms = stored(cells.groupBy("lang", "digest", "k").agg(F.sum("n").alias("of_lang")), "terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("known"), F.sum("of_lang").alias("of_terms"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "known", "of_terms")]
    groups = docs.groupBy("lang", "source").agg(F.lit(1)).join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *zero)
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stored(groups.select("*", F.when(F.col("known") > 0, _share(F.lit(0), F.col("total"), F.col("known"))).alias("p0"), at.cast("int").alias("at")), "groups")
    shares = stored(
        cells.join(groups.select("lang", "source", "total", "known", "of_terms"), ["lang", "source"]).join(terms, ["lang", "digest", "k"])
        .select("lang", "source", "digest", "k", _share(F.col("n"), F.col("total"), F.col("known")).alias("p"), _share(F.col("of_lang"), F.col("of_terms"), F.col("known")).alias("q")),
        "shares")

    # terms: the first of each part of a group, then of the group; equal values wait for their texts
    fit = shares.where("p > q").select("lang", "source", "digest", "k", (F.col("p") - F.col("q")).alias("value"))
    for part in (["lang", "source", "salt"], ["lang", "source"]):
        nth = F.rank().over(Window.partitionBy(*part).orderBy(F.desc("value")))
        fit = fit.withColumn("salt", F.pmod(F.xxhash64("digest", "k"), F.lit(_SALTS))).withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    named = fit.join(texts, ["lang", "digest", "k"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    named = named.withColumn("rank", rank).where(F.col("rank") <= top)

    # pairs: every other source, in both directions
    more = _distances(shares.select("lang", "source", "digest", "k", "p"), groups)
    more = more.unionByName(more.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "more"))
    left = groups.select("lang", "source", F.col("at").alias("a"), "known", F.col("p0").alias("p"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b"), F.col("p0").alias("q"))
    pairs = left.join(right, "lang").where("a <> b").join(more, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("known") * F.abs(F.col("p") - F.col("q")) + F.coalesce("more", F.lit(0)), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", rank)
    return pairs.unionByName(named).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def oracle(least: int = 30, top: int = TOP) -> str:
    share = "1 + (1000000000::HUGEINT * ({} + 5)) // ({} + 5 * known)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS of_lang FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {least}),
langs AS (SELECT lang, count(*) AS known, sum(of_lang) AS of_terms FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT lang, source, coalesce(sum(n), 0) AS total, any_value(coalesce(known, 0)) AS known, any_value(coalesce(of_terms, 0)) AS of_terms
           FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cells USING (lang, source) LEFT JOIN langs USING (lang) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {share.format('coalesce(c.n, 0)', 'total')} AS p, {share.format('of_lang', 'of_terms')} AS q
      FROM groups AS g JOIN kept ON kept.lang = g.lang LEFT JOIN cells AS c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN
               (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) AS s
               ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
