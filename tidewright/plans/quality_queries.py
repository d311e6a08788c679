"""Queries over gauge records: cleaning, parsing and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import columns as fc
from tidewright.operators import quality
from tidewright.plans import views
from tidewright.plans.registry import n, query, r

FIRST = """(SELECT *, row_number() OVER (PARTITION BY station_id, sensor, ts ORDER BY seq) AS rn,
count(*) OVER (PARTITION BY station_id, sensor, ts) AS copies FROM gauge_obs)"""
TAGGED = f"""(SELECT *, CASE WHEN water_level IS NULL THEN 'missing' WHEN qc_flag IN ('3', '4', '5', '9') OR use_flag = '0' THEN 'quality_flag'
WHEN abs(water_level) > 20 THEN 'unreasonable' END AS reject_reason FROM {FIRST} WHERE rn = 1)"""

views.SQL["gauge_clean"] = f"SELECT station_id, sensor, ts, seq, water_level FROM {TAGGED} WHERE reject_reason IS NULL"
views.SQL["gauge_scores"] = f"""
WITH g AS (SELECT *, epoch(ts - lag(ts) OVER (PARTITION BY station_id, sensor ORDER BY ts)) / 3600.0 AS gap FROM gauge_clean),
a AS (SELECT station_id, sensor, count(*) AS valid_records, min(ts) AS "start", max(ts) AS "end",
             least(1.0, count(*) / greatest(1.0, epoch(max(ts) - min(ts)) / 3600.0 + 1)) AS completeness,
             coalesce(avg(CASE WHEN gap <= 1.5 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 1.0) AS continuity,
             count(*) FILTER (WHERE gap > 1.5) AS gaps, min(water_level) AS lo, max(water_level) AS hi,
             quantile_cont(water_level, 0.5) AS mid FROM g GROUP BY 1, 2)
SELECT *, round(0.7 * completeness + 0.3 * continuity, 6) AS score FROM a"""
views.SQL["gauge_channel"] = """
SELECT station_id, sensor FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY score DESC, valid_records DESC, sensor) AS k
FROM gauge_scores) WHERE k = 1"""


def _clean(spark, sf):
    tagged = quality.tag_rejects(views.gauge_obs(spark, sf))
    return tagged.where(F.col("reject_reason").isNull())


@query("dedupe_first", f"""
SELECT station_id, sensor, ts, seq, {r('water_level', 'water_level')}, qc_flag, use_flag, {n('copies', 'copies')} FROM {FIRST} WHERE rn = 1""")
def _(spark, sf):
    return quality.dedupe_first(views.gauge_obs(spark, sf), ["station_id", "sensor", "ts"], ["seq"])


@query("drop_sentinels", f"""SELECT station_id, seq, {r('water_level', 'water_level')} FROM gauge_obs
WHERE water_level IS NOT NULL AND water_level NOT IN (-99, -999, -9999, 9999, 99999)""")
def _(spark, sf):
    return quality.drop_sentinels(views.gauge_obs(spark, sf), "water_level").select("station_id", "seq", "water_level")


@query("flag_filter", "SELECT station_id, seq, qc_flag, use_flag FROM gauge_obs WHERE qc_flag NOT IN ('3', '4', '5', '9') AND use_flag <> '0'")
def _(spark, sf):
    return quality.flag_filter(views.gauge_obs(spark, sf)).select("station_id", "seq", "qc_flag", "use_flag")


@query("flag_filter_strict", "SELECT station_id, seq, qc_flag, use_flag FROM gauge_obs WHERE qc_flag = '0' AND use_flag <> '0'")
def _(spark, sf):
    return quality.flag_filter(views.gauge_obs(spark, sf), quality.BAD_QC_STRICT).select("station_id", "seq", "qc_flag", "use_flag")


@query("use_flag_filter", "SELECT station_id, seq, use_flag FROM gauge_obs WHERE use_flag IS NULL OR use_flag <> '0'")
def _(spark, sf):
    return quality.use_flag_filter(views.gauge_obs(spark, sf)).select("station_id", "seq", "use_flag")


@query("range_filter", f"SELECT station_id, seq, {r('water_level', 'water_level')} FROM gauge_obs WHERE abs(water_level) <= 20")
def _(spark, sf):
    return quality.range_filter(views.gauge_obs(spark, sf), "water_level").select("station_id", "seq", "water_level")


@query("mad_filter", f"""
WITH m AS (SELECT station_id, quantile_cont(water_level, 0.5) AS med FROM gauge_obs GROUP BY 1),
d AS (SELECT g.*, abs(water_level - med) AS dev FROM gauge_obs g JOIN m ON m.station_id = g.station_id),
k AS (SELECT station_id, quantile_cont(dev, 0.5) AS mad FROM d GROUP BY 1)
SELECT d.station_id, seq, {r('water_level', 'water_level')} FROM d JOIN k ON k.station_id = d.station_id
WHERE water_level IS NOT NULL AND (mad = 0 OR 0.6745 * dev / mad <= 5)""")
def _(spark, sf):
    return quality.mad_filter(views.gauge_obs(spark, sf), "water_level", threshold=5.0).select("station_id", "seq", "water_level")


@query("iqr_mask", f"""
WITH q AS (SELECT station_id, quantile_cont(water_level, 0.25) AS a, quantile_cont(water_level, 0.75) AS b FROM gauge_obs GROUP BY 1)
SELECT g.station_id, seq, {r('CASE WHEN water_level BETWEEN a - 3 * (b - a) AND b + 3 * (b - a) THEN water_level END', 'water_level')}
FROM gauge_obs g JOIN q ON q.station_id = g.station_id""")
def _(spark, sf):
    return quality.iqr_mask(views.gauge_obs(spark, sf), "water_level", k=3.0).select("station_id", "seq", "water_level")


@query("canonical_gauge", f"""
SELECT ts, {r('water_level * 0.01', 'water_level')}, qc_flag, use_flag, 'gauge' AS source, sensor, station_id, CAST(NULL AS DOUBLE) AS tide_estimate, seq
FROM gauge_obs""")
def _(spark, sf):
    raw = views.gauge_obs(spark, sf)
    as_text = raw.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("water_level").cast("string").alias("water_level"),
        "qc_flag", "use_flag", "sensor", F.concat_ws("|", "station_id", "seq").alias("station_id"),
    )
    out = quality.canonical_gauge(as_text, "cm")
    parts = F.split("station_id", r"\|")
    return out.withColumn("seq", F.get(parts, F.lit(1)).cast("bigint")).withColumn("station_id", F.get(parts, F.lit(0)))


@query("union_sensors", f"""SELECT station_id, sensor, {n('count(*)', 'rows')}, {r('avg(water_level)', 'mean_m')}
FROM gauge_obs GROUP BY 1, 2""")
def _(spark, sf):
    raw = views.gauge_obs(spark, sf)
    files = {s: raw.where(F.col("sensor") == s).drop("sensor") for s in ("s0", "s1", "s2")}
    return quality.union_sensors(files).groupBy("station_id", "sensor").agg(
        F.count("*").alias("rows"), F.avg("water_level").alias("mean_m")
    )


@query("reject_reasons", f"""SELECT station_id, coalesce(reject_reason, 'kept') AS reject_reason, {n('count(*)', 'rows')} FROM {TAGGED} GROUP BY 1, 2""")
def _(spark, sf):
    tagged = quality.tag_rejects(views.gauge_obs(spark, sf))
    return tagged.groupBy("station_id", F.coalesce("reject_reason", F.lit("kept")).alias("reject_reason")).agg(F.count("*").alias("rows"))


@query("sensor_scores", f"""
SELECT station_id, sensor, {n('valid_records', 'valid_records')}, "start", "end", {r('completeness', 'completeness')},
       {r('continuity', 'hourly_continuity')}, {n('gaps', 'non_hourly_gaps')}, {r('lo', 'minimum_m')}, {r('hi', 'maximum_m')},
       {r('mid', 'median_m')}, {r('score', 'score')} FROM gauge_scores""")
def _(spark, sf):
    return quality.sensor_scores(_clean(spark, sf))


@query("select_channel", "SELECT station_id, sensor FROM gauge_channel")
def _(spark, sf):
    return quality.select_channel(quality.sensor_scores(_clean(spark, sf)))


@query("quality_control", f"""
SELECT c.station_id, c.sensor, c.ts, c.seq, {r('c.water_level', 'water_level')} FROM gauge_clean c
JOIN gauge_channel k ON k.station_id = c.station_id AND k.sensor = c.sensor""")
def _(spark, sf):
    clean, _report = quality.quality_control(views.gauge_obs(spark, sf))
    return clean.select("station_id", "sensor", "ts", "seq", "water_level")


@query("quality_control_report", f"""
WITH raw AS (SELECT station_id, count(*) AS raw_n FROM gauge_obs GROUP BY 1),
t AS (SELECT station_id, sum(copies - 1) AS dup, count(*) FILTER (WHERE reject_reason = 'missing') AS miss,
             count(*) FILTER (WHERE reject_reason = 'quality_flag') AS flag,
             count(*) FILTER (WHERE reject_reason = 'unreasonable') AS far FROM {TAGGED} GROUP BY 1),
f AS (SELECT c.station_id, max(c.sensor) AS sensor, count(*) AS k,
             greatest(0.0, 1.0 - count(*) / greatest(1, floor(epoch(max(ts) - min(ts)) / 3600) + 1)) AS rate
      FROM gauge_clean c JOIN gauge_channel s ON s.station_id = c.station_id AND s.sensor = c.sensor GROUP BY 1)
SELECT raw.station_id, {n('raw_n', 'raw_record_count')}, {n('0', 'invalid_datetime_count')}, {n('dup', 'removed_duplicate_count')},
       {n('miss', 'removed_missing_count')}, {n('flag', 'removed_quality_flag_count')}, {n('far', 'removed_unreasonable_count')},
       {n('k', 'final_record_count')}, f.sensor AS selected_sensor, {r('rate', 'missing_rate')}
FROM raw JOIN t ON t.station_id = raw.station_id JOIN f ON f.station_id = raw.station_id""")
def _(spark, sf):
    _clean_rows, report = quality.quality_control(views.gauge_obs(spark, sf))
    return report


@query("restrict_years", f"SELECT station_id, ts, {r('surge_m', 'surge_m')} FROM surge_daily WHERE year(ts) BETWEEN 1996 AND 1998")
def _(spark, sf):
    return quality.restrict_years(views.surge_daily(spark, sf), 1996, 1998)


@query("time_slice", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-04-15'")
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")  # zone-less times as stored, so the range reaches the scan
    kept = quality.time_slice(orders, "1996-03-01", "1996-04-15", "o_orderdate")
    return kept.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))


@query("locked_year_guard", f"SELECT station_id, year(ts) AS year, {n('count(*)', 'rows')} FROM surge_daily GROUP BY 1, 2")
def _(spark, sf):
    kept = quality.locked_year_guard(views.surge_daily(spark, sf), 2001)
    return kept.groupBy("station_id", F.year("ts").alias("year")).agg(F.count("*").alias("rows"))


@query("to_utc", "SELECT event_id, ts - INTERVAL 8 HOUR AS ts FROM events")
def _(spark, sf):
    return quality.to_utc(views.table(spark, sf, "events").select("event_id", "ts"), "Asia/Shanghai")


@query("array_health", f"""
SELECT station_id, 'water_level' AS "array", {n('count(*)', 'total')}, {n('count(water_level)', 'finite')}, {n('0', 'nan')}, {n('0', 'inf')},
       {n('count(*) - count(water_level)', '"null"')}, {r('min(water_level)', 'min')}, {r('max(water_level)', 'max')}, {r('avg(water_level)', 'mean')}
FROM gauge_obs GROUP BY 1""")
def _(spark, sf):
    return quality.array_health(views.gauge_obs(spark, sf), ["water_level"], ["station_id"])


# --- text and time parsing ----------------------------------------------------------------------------------


@query("normalise_text", """SELECT doc_id, trim(replace(replace(source, 'ａ', 'a'), chr(12288), ' ')) AS source, lang FROM documents""")
def _(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", fc.clean_text("source").alias("source"), fc.clean_text("lang").alias("lang"))


@query("safe_key", r"""SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(trim(url), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .'), 1, 100), ''), 'unnamed') AS key,
regexp_replace(trim(url), '[^0-9A-Za-z一-鿿_-]+', '_', 'g') AS token FROM pages""")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", fc.safe_key("url").alias("key"), fc.safe_token("url").alias("token"))


@query("parse_time", """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS parsed FROM events""")
def _(spark, sf):
    i = F.col("event_id") % 4
    text = (
        F.when(i == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(i == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(i == 2, F.date_format("ts", "yyyy/MM/dd HH:mm")).otherwise(F.lit("soon"))
    )
    return views.table(spark, sf, "events").select("event_id", fc.parse_time(text).alias("parsed"))


@query("blank_to_default", f"""SELECT coalesce(nullif(trim(station_type), ''), 'unknown') AS station_type, {n('count(*)', 'rows')} FROM snapshots GROUP BY 1""")
def _(spark, sf):
    kind = fc.blank_to_default("station_type").alias("station_type")
    return views.snapshots(spark, sf).groupBy(kind).agg(F.count("*").alias("rows"))


@query("normalise_lon", f"""SELECT o_orderkey, {r('((o_orderkey % 721 - 180 + 180) % 360 + 360) % 360 - 180', 'lon')} FROM orders""")
def _(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", fc.normalise_lon((F.col("o_orderkey") % 721 - 180).cast("double")).alias("lon"))


KEYWORDS = ("station", "Error", "tide", "data", "the", "und", "track")
_ANY = " ".join(f"CASE WHEN contains(h, '{k.lower()}') THEN '{k};' ELSE '' END ||" for k in KEYWORDS)


@query("matched_keywords", f"""
SELECT page_id, rtrim({_ANY} '', ';') AS keywords FROM (SELECT page_id, lower(url || ' ' || regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || ' ' ||
  regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g')) AS h FROM pages)""")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", fc.matched_keywords(KEYWORDS, "url", fc.page_title("html"), fc.page_text("html")).alias("keywords"))


@query("matched_keywords_documents", f"""
SELECT doc_id, rtrim({_ANY} '', ';') AS keywords FROM (SELECT doc_id, lower(source || ' ' || text) AS h FROM documents)""")
def _(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", fc.matched_keywords(KEYWORDS, "source", "text").alias("keywords"))


# --- exact quantiles -------------------------------------------------------------------------------------------

@query("quantile_brackets", f"""SELECT event_type, {r('quantile_cont(value, 0.05)', 'low')}, {r('median(value)', 'middle')}, {r('quantile_cont(value, 0.99)', 'high')} FROM events GROUP BY 1""")
def _(spark, sf):
    """A coarse sketch and small slices, so that brackets and their narrowing run at every scale."""
    from tidewright.functions.quantiles import exact_quantiles

    wanted = {"low": ("value", 0.05), "middle": ("value", 0.5), "high": ("value", 0.99)}
    return exact_quantiles(views.table(spark, sf, "events"), ["event_type"], wanted, accuracy=200, most=10)
