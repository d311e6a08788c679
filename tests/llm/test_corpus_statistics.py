"""Spelling variants, source divergence and robust outliers against brute force and SQL, on small fixtures."""

import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidewright.llm import divergence, outliers, spelling, textscan

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, word string, n long"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts and words, repeated rows and ids, columns with clashing names."""
    rows = [(1, "Elephants elephants elephant's Élephants elephantz", "en", "a", "x", 1), (1, "Elephants elephants elephant's Élephants elephantz", "en", "a", "x", 1),
            (2, None, "en", None, None, None), (3, "", None, "b", "y", 2), (None, "elephants elephants élephants", "en", "b", "z", 3),
            (4, "z" * 100_000 + " " + "z" * 99_999 + " " + "z" * 100_000 + " " + "z" * 99_999, None, None, "w", 4), (5, "ab " * 40_000, "de", "a", "v", 5), (6, "... 12 \n\n", "de", "c", "u", 6)]
    return spark.createDataFrame(rows, SCHEMA)


# --- 11 --------------------------------------------------------------------------------------------------------------

def variants(rows, every=31):
    counts = Counter()
    for doc, text in rows:
        for w in re.findall("[a-zÀ-ÿ]+", lower(text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[k:] == b[k + 1:]

    by_size = {}
    for w in counts:
        by_size.setdefault(len(w), []).append(w)
    found = {w: [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by_size.get(size, ()) if near(w, x)] for w in counts}
    form = {}
    for w, others in found.items():
        if others and counts[best := min(others, key=lambda x: (-counts[x], x))] >= 10 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, n, len(found[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items()), key=str)


def told(df):
    return sorted((tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


def test_variants_equal_brute_force(documents):
    assert told(spelling.variants(documents)) == variants(documents.select("doc_id", "text").collect())


def test_variants_of_odd_documents(odd):
    assert told(spelling.variants(odd)) == variants(odd.select("doc_id", "text").collect())
    assert spelling.variants(odd.limit(0)).collect() == []


def test_regions_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(spelling, "REGION", 7)
    monkeypatch.setattr(spelling, "MOST_GROUPS", 3)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abé"), rng.integers(6, 10))) for _ in range(600)]
    rows = [(i, " ".join([t] * int(rng.integers(2, 40))), "en", "a", None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = variants(df.select("doc_id", "text").collect(), 0)
    assert told(spelling.variants(df, every=0)) == want and sum(r[2] for r in want) > 100


def test_chains_of_forms_end_at_the_root(spark):
    chain = {"aaaaaaaaaaa": 2, "aaaaaaaaaa": 20, "aaaaaaaaa": 200, "aaaaaaaa": 2000, "aaaaaaa": 20000}
    df = spark.createDataFrame([(1, " ".join(w for w, n in chain.items() for _ in range(n)), "en", "a", None, None)], SCHEMA)
    got = told(spelling.variants(df, every=0))
    assert got == variants(df.select("doc_id", "text").collect(), 0) and {r[-1] for r in got} == {"aaaaaaa"}


def test_comparing_a_region_holds_little_memory():
    rng = np.random.default_rng(5)
    texts = sorted({"".join(w) for w in rng.choice(list("etaonird"), (20_000, 8))})
    mine = np.arange(len(texts)) < 2_000
    tracemalloc.start()
    try:
        w = spelling.Spelled(texts)
        a, _ = spelling.near_pairs(w, mine, 8)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(a) == 71 and peak < 40e6  # the letter counts alone are 14 MB as 64-bit numbers


def test_moves_lead_to_different_blocks():
    moves = spelling._moves(spelling.MOST_GROUPS)
    assert len({m & spelling._WIDE for m in [0, *moves, *(-m for m in moves)]}) == 2 * len(moves) + 1


# --- 12 --------------------------------------------------------------------------------------------------------------

def audited(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def by_sql(df, least, top=50):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang", "source").toArrow())
    return sorted(con.execute(divergence.oracle(least, top)).fetchall())


@pytest.mark.parametrize("least, bits", [(30, 64), (3, 8)])
def test_audit_equals_sql_at_any_width_of_digests(documents, least, bits):
    assert audited(divergence.audit(documents, least, bits=bits)) == by_sql(documents, least)


def test_audit_of_odd_documents(odd):
    assert audited(divergence.audit(odd, 1, bits=2)) == by_sql(odd, 1)
    assert divergence.audit(odd.where("lang = 'en'"), 30).where("value <> 0").isEmpty()  # no term is kept
    assert divergence.audit(odd.limit(0)).collect() == []


def test_audit_over_several_tiles(documents, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 3)
    monkeypatch.setattr(divergence, "TERMS", 16)
    assert audited(divergence.audit(documents, 5, 3)) == by_sql(documents, 5, 3)


def test_unlike_words_of_equal_digests_are_seen():
    words = [b"abcdefgh", b"abcdefgh", b"abcdefghi", b"abcdefgx", b"a", b"a", "é".encode(), b"abcdefghabcdefgh", b"abcdefghabcdefgy"]
    first = np.cumsum([0] + [len(w) + 1 for w in words])[:-1]
    size = np.array([len(w) for w in words])
    data = np.frombuffer(b" ".join(words) + b" " * 9, np.uint8)
    a, b = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words))))
    assert divergence._unlike(data, first, size, a, b).tolist() == [words[i] != words[j] for i, j in zip(a, b)]


# --- 13 --------------------------------------------------------------------------------------------------------------

def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@pytest.fixture
def few_steps(monkeypatch):
    monkeypatch.setattr(outliers, "STEPS", 1)


def test_base_counts_equal_brute_force(documents, odd, few_steps):
    measured = outliers._measured(documents.select("doc_id", "lang", "source", "text"))
    for df, found in ((documents, measured), (odd, outliers.judge(odd))):
        got = sorted((r["doc_id"], *(r[c] for c in BASE)) for r in found.collect() if r["doc_id"] is not None)
        assert got == sorted((d, *counted(t)) for d, t in df.select("doc_id", "text").collect() if d is not None)
    assert outliers.judge(odd.limit(0)).collect() == []


def test_repeated_windows_overlap():
    h = textscan.words(b"a a a a a a a a a b")[0]
    assert outliers.repeated(h) == 9 and outliers.repeated(h[:8]) == 0


def clean(rng):
    """A text like others: words of five letters or so, a line break now and then."""
    words = ["".join(rng.choice(list("etaonirs"), rng.integers(2, 9))) for _ in range(rng.integers(60, 300))]
    return " ".join(w + "\n" * bool(rng.random() < 0.03) for w in words)


def test_outliers_are_rejected_and_all_else_is_kept(spark, few_steps):
    rng = np.random.default_rng(8)
    rows = [(i, clean(rng), "en" if i % 3 else "de", "abc"[i % 2], None, None) for i in range(600)]
    junk = [(1000 + i, re.sub(r"(\w+)", r"\1|%$", clean(rng)) if i % 2 else " ".join(w for w in clean(rng).upper().split()), "en", "a", None, None) for i in range(60)]
    df = spark.createDataFrame(rows + junk, SCHEMA).repartition(5)
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(df).collect()}
    assert not any(got[r[0]] for r in junk) and sum(got[r[0]] for r in rows) >= 598
    again = {r["doc_id"]: r["kept"] for r in outliers.judge(df.repartition(3)).collect()}
    assert again == got
    assert sorted(r["doc_id"] for r in outliers.keep(df).collect()) == sorted(d for d, kept in got.items() if kept)


def test_steps_reach_the_covariance_of_the_nearest(spark):
    """One step against NumPy: mean and covariance of the documents in the classes nearest to the estimate."""
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(400, 60, (500, len(outliers.PARTS)))).astype(int)
    df = spark.createDataFrame([("en", "a", *map(int, row)) for row in x], f"lang string, source string, {', '.join(f'{p} int' for p in outliers.PARTS)}")
    start = outliers._solved(outliers._medians(df, ["lang"]), ["lang"], True)
    row = start.first()
    z = x / outliers.UNIT - np.array(row["centre"])
    d = np.einsum("ni,ij,nj->n", z, outliers._full(row["inverse"]), z)
    level = np.floor(8 * np.log2(1 + d))
    cut = next(c for c in np.unique(level) if (level <= c).sum() >= 0.75 * len(x))
    near = x[level <= cut] / outliers.UNIT
    got = outliers._nearest(df, start, ["lang"]).first()
    assert np.allclose(got["centre"], near.mean(0)) and np.allclose(outliers._full(got["scatter"]), np.cov(near.T, bias=True) * outliers.CONSISTENT)


def test_chi_square_quantiles():
    assert abs(outliers.chi_square_quantile(0.95, 6) - 12.5916) < 1e-3 and abs(outliers.chi_square_quantile(0.5, 2) - 1.38629) < 1e-4


def test_keep_returns_columns_as_given(odd, few_steps):
    kept = outliers.keep(odd)
    assert kept.columns == odd.columns and kept.collect() == []


# --- texts that tokenizers stumble over, ids that repeat ----------------------------------------------------------------

def test_ids_of_any_text_equal_those_of_the_other_library():
    from tidewright.llm import packing, queries

    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    texts = [" " * 1_000_000, " \n" * 500_000, "\n" * 300_000 + "end", "word " * 20 + " " * 400_000 + "tail", "<|endoftext|> x", "", "a   b"]
    slow = packing.slow_encoder(path)
    for text, ids in zip(texts, packing.token_ids([t.encode() for t in texts], path)):
        assert ids.tolist() == [*slow.encode(text, add_special_tokens=False).ids, packing.END]
    assert len(list(packing.token_ids([b"\xff\xfe broken", None], path))) == 2


def test_a_repeated_id_is_fitted_once(spark, documents):
    from tidewright.llm import quality

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = labels.where(quality.in_training()).join(documents, "doc_id").select("doc_id").first()[0]
    again = documents
    for _ in range(3):
        again = again.unionByName(documents.where(f"doc_id = {one}"))
    fitted = quality.fit(again, labels), quality.fit(documents, labels)
    assert [len(f.network.layers) for f in fitted] == [4, 4]
    rows = quality.score(again, labels).where(f"doc_id = {one}").collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1
