"""Secret scan with corpus-wide ownership of every candidate, in DataFrame expressions only.

Three fixed kinds of spans are always reported. Long mixed tokens beside them are further candidates. Every candidate
value is hashed and counted over distinct repositories and owners of the whole corpus: a value that many owners share
is a copied example, one that few hold looks live. Live tokens are added as spans of kind ``live``.

Texts are read once, to a compact table of candidate places and value hashes; all later steps use that. Counts start
from distinct (value, owner) pairs, and the join that brings them back is salted, so a value that a third of all
documents share is no hot key. Spans of a document are put in order by windows over that document alone.

Defined cases: a null text is empty; a null repository is one unnamed repository; repeated rows of one id and text get
the same result each and count once; ids may repeat or be null; an empty table has no rows; extra columns are ignored
by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.storage import stored


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: fixed values: kind, pattern, group of the value, least length of the value
_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
KINDS = (
    ("assign", rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
TOKEN = ("live", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
ORDER = {"assign": 0, "access": 1, "hex": 2, "live": 3}
LEAST_DISTINCT = 10  # characters that differ in a token that looks random
COPIED_OWNERS = 3  # a value of at least so many owners is a copied example
MARK = "[REDACTED]"
_SALTS = 32


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind: number, characters since the match before, size, value hash, whether it counts."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    def one(z: Column, i: Column) -> Column:
        value = z["v"]
        ok = F.length(value) >= least
        if kind == "live":
            ok = ok & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT)
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["g"]).alias("gap"), F.length(z["h"]).alias("size"),
                        F.sha2(value, 256).alias("value"), ok.alias("counts"))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("g"), hits.alias("h"), values.alias("v"))
    return F.when(text.rlike(pattern), F.transform(zipped, one))


def _compact(docs: DataFrame, repository: str) -> DataFrame:
    """(doc_id, key, repository, owner, found) of every row; ``key`` stands for the text."""
    text = F.coalesce("text", F.lit(""))
    arrays = [_found(text, *k) for k in (*KINDS, TOKEN)]
    empty = F.array().cast("array<struct<kind:string,i:int,gap:int,size:int,value:string,counts:boolean>>")
    repo = F.coalesce(F.col(f"`{repository}`").cast("string"), F.lit(""))
    return docs.select(
        "doc_id", F.sha2(text, 256).alias("key"), repo.alias("repository"), F.split_part(repo, F.lit("/"), F.lit(1)).alias("owner"),
        F.concat(*(F.coalesce(a, empty) for a in arrays)).alias("found"))


def _spans(compact: DataFrame) -> DataFrame:
    """(doc_id, key, kind, start, end, copied): base spans, and live tokens that touch none of them."""
    hits = compact.where(F.size("found") > 0).select("doc_id", "key", "repository", "owner", F.explode("found").alias("f")).select(
        "doc_id", "key", "repository", "owner", "f.*")
    shared = (
        hits.where("counts").select("value", "repository", "owner").distinct()
        .groupBy("value").agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"))
    )
    one_each = hits.dropDuplicates(["doc_id", "key", "kind", "i"])
    run = Window.partitionBy("doc_id", "key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = one_each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run)).withColumn("start", F.col("end") - F.col("size")).where("counts")
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    known = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key", "start"), F.lit(_SALTS)).cast("int")).join(salted, ["value", "salt"])
    base = F.col("kind") != "live"
    near = Window.partitionBy("doc_id", "key")
    before = F.max(F.when(base, F.col("end"))).over(near.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(near.orderBy("start").rangeBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (after.isNull() | (after >= F.col("end")))
    copied = F.col("owners") >= COPIED_OWNERS
    return (
        known.withColumns({"free": free, "copied": copied}).where(base | (F.col("free") & ~F.col("copied")))
        .select("doc_id", "key", "kind", "start", "end", "copied", "repositories", "owners")
    )


def spans(docs: DataFrame, repository: str = "source") -> DataFrame:
    """Every span of every distinct (doc_id, text), with the repositories and owners of its value."""
    return _spans(stored(_compact(docs, repository), "candidates"))


def scan(docs: DataFrame, repository: str = "source") -> DataFrame:
    """Counts and digests of the spans of every document."""
    compact = stored(_compact(docs, repository), "candidates")
    order = F.create_map(*(F.lit(x) for k, v in ORDER.items() for x in (k, v)))[F.col("kind")]
    label = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    per_doc = (
        _spans(compact).groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_list(F.struct("start", order.alias("o"), "end", label.alias("s")))).alias("list"),
             *(F.count_if(F.col("kind") == k[0]).alias(f"n_{k[0]}") for k in KINDS),
             F.count_if(F.col("copied")).alias("n_copied"), F.count_if(~F.col("copied")).alias("n_live"))
        .withColumnRenamed("doc_id", "id").withColumnRenamed("key", "k")
    )
    rows = compact.select(F.col("doc_id").cast("long").alias("doc_id"), "key", (F.size("found") > 0).alias("some"))
    # a row without candidates meets nothing: it keeps its own key and finds no partner
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    listed = F.coalesce("list", F.array().cast("array<struct<start:bigint,o:int,end:bigint,s:string>>"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    base = F.array_join(F.transform(F.filter(listed, lambda x: x["o"] < 3), lambda x: x["s"]), ",")
    return joined.select(
        "doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(listed, lambda x: x["s"]), ",").alias("spans"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied")))


def redact(docs: DataFrame, repository: str = "source") -> DataFrame:
    """The documents with every span, and spans that touch as one, replaced by a mark; columns as given."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    seen = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    covered = F.max("end").over(seen.rowsBetween(Window.unboundedPreceding, -1))
    gaps = (
        spans(docs, repository).withColumn("covered", covered).where("covered is null or start > covered or end > covered")
        .withColumn("gap", F.when(F.col("covered").isNull() | (F.col("start") > F.col("covered")), F.struct(F.coalesce("covered", F.lit(0)).alias("a"), F.col("start").alias("b"))))
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.sort_array(F.collect_list("gap")).alias("_gaps"), F.max("end").alias("_last"))
    )
    rows = docs.select(*(F.col(f"`{c}`").alias(names[c]) for c in docs.columns))
    text = F.col(names["text"])
    key = F.when(text.rlike("|".join(f"(?:{k[1]})" for k in (*KINDS, TOKEN))), F.sha2(text, 256))
    joined = rows.withColumn("_k", key).join(gaps, F.col(names["doc_id"]).eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
    kept = F.transform("_gaps", lambda g: F.substring(text, g["a"].cast("int") + 1, (g["b"] - g["a"]).cast("int")))
    tail = F.substring(text, F.col("_last").cast("int") + 1, F.length(text))
    clean = F.when(F.col("_last").isNull(), text).otherwise(F.concat_ws(MARK, kept, tail))
    return joined.select(*(clean.alias(c) if c == "text" else F.col(names[c]).alias(c) for c in docs.columns))


def oracle(table: str = "documents") -> str:
    """The scan in DuckDB's SQL."""
    matches = " UNION ALL ".join(
        f"SELECT rid, source, '{k}' AS kind, {ORDER[k]} AS o, {n} AS least, regexp_extract_all(t, $re${p}$re$) AS hits, "
        f"regexp_extract_all(t, $re${p}$re$, {g}) AS vals, string_split_regex(t, $re${p}$re$) AS gaps FROM d" for k, p, g, n in (*KINDS, TOKEN))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM {table}),
m AS ({matches}),
e AS (SELECT rid, source, kind, o, least, unnest(range(1, len(hits) + 1)) AS i, hits, vals, gaps FROM m WHERE len(hits) > 0),
p AS (SELECT rid, source, kind, o, least, vals[i] AS v, length(hits[i]) AS size,
      sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM e),
c AS (SELECT rid, source, kind, o, v, stop - size AS start, stop FROM p WHERE length(v) >= least AND (kind <> 'live'
      OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {LEAST_DISTINCT}))),
w AS (SELECT v, count(DISTINCT split_part(source, '/', 1)) AS owners FROM c GROUP BY v),
s AS (SELECT c.*, owners >= {COPIED_OWNERS} AS copied FROM c JOIN w USING (v)),
k AS (SELECT * FROM s WHERE kind <> 'live' OR (NOT copied AND NOT EXISTS (
      SELECT 1 FROM c b WHERE b.rid = s.rid AND b.kind <> 'live' AND b.start < s.stop AND b.stop > s.start))),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, o) FILTER (kind <> 'live') AS base,
      string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, o) AS spans,
      count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (rid)"""
