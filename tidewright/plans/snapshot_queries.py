"""Queries over crawled snapshots, tracks and peak events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import events, export, snapshots, spatial
from tidewright.plans import views
from tidewright.plans.registry import n, query, r

_TYPED = """SELECT trim(s.city) AS city, trim(s.city_county) AS city_county, trim(s.station_name) AS station_name, s.seq,
{pick} AS station_type, s.reported_at, s.water_level, s.crawl_time FROM snapshots s LEFT JOIN type_map m
ON m.city = trim(s.city) AND m.city_county = trim(s.city_county) AND m.station_name = trim(s.station_name)"""
views.SQL["typed_snapshots"] = _TYPED.format(
    pick="coalesce(m.station_type, CASE WHEN trim(s.station_type) IN ('river', 'reservoir', 'gate', 'tide') THEN trim(s.station_type) END, 'unknown')"
)
views.SQL["water_segments"] = """
WITH t AS (SELECT DISTINCT crawl_time FROM snapshots),
g AS (SELECT crawl_time, CASE WHEN epoch(crawl_time - lag(crawl_time) OVER (ORDER BY crawl_time)) <= 1200 THEN 0 ELSE 1 END AS opens FROM t),
s AS (SELECT crawl_time, sum(opens) OVER (ORDER BY crawl_time) AS segment FROM g)
SELECT CAST(segment AS BIGINT) AS segment, min(crawl_time) AS seg_start, max(crawl_time) AS seg_end FROM s GROUP BY 1"""
KEY3 = "count(DISTINCT (city, city_county, station_name))"


def typed(spark, sf):
    types = snapshots.station_types(views.type_map(spark, sf))
    return snapshots.type_lookup(views.snapshots(spark, sf), types)


@query("read_snapshots", """SELECT seq, station_code, reported_at, crawl_time FROM snapshots
WHERE crawl_time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'""")
def _(spark, sf):
    from tidewright.sources.snapshots import crawl_window

    rows = crawl_window(views.snapshots(spark, sf), "2024-01-05 06:00:00", "2024-01-20 18:00:00")
    return rows.select("seq", "station_code", "reported_at", "crawl_time")


@query("type_lookup", "SELECT seq, city, city_county, station_name, station_type FROM typed_snapshots")
def _(spark, sf):
    return typed(spark, sf).select("seq", "city", "city_county", "station_name", "station_type")


@query("type_lookup_map_only", f"""SELECT station_type, {n('count(*)', 'rows')} FROM ({_TYPED.format(pick="coalesce(m.station_type, 'unknown')")}) GROUP BY 1""")
def _(spark, sf):
    types = snapshots.station_types(views.type_map(spark, sf))
    out = snapshots.type_lookup(views.snapshots(spark, sf), types, keep_stored=False)
    return out.groupBy("station_type").agg(F.count("*").alias("rows"))


@query("crawl_segments", 'SELECT segment, seg_start AS "start", seg_end AS "end" FROM water_segments')
def _(spark, sf):
    return snapshots.crawl_segments(views.snapshots(spark, sf), 1200)


@query("assign_segment", """SELECT s.seq, w.segment FROM snapshots s LEFT JOIN water_segments w
ON s.crawl_time BETWEEN w.seg_start AND w.seg_end""")
def _(spark, sf):
    water = views.snapshots(spark, sf)
    return snapshots.assign_segment(water, snapshots.crawl_segments(water, 1200)).select("seq", "segment")


@query("segment_summary", f"""
SELECT segment, seg_start AS "start", seg_end AS "end", {n('(SELECT count(*) FROM snapshots s WHERE s.crawl_time BETWEEN seg_start AND seg_end)', 'water_rows')},
       {n('(SELECT count(*) FROM rain e WHERE e.crawl_time BETWEEN seg_start AND seg_end)', 'rain_rows')} FROM water_segments""")
def _(spark, sf):
    water = views.snapshots(spark, sf)
    return snapshots.segment_summary(water, views.rain(spark, sf), snapshots.crawl_segments(water, 1200))


@query("snapshot_overview_water", f"""SELECT {n('count(*)', 'record_count')}, {n(KEY3, 'station_count')}, min(reported_at) AS min_reported_at, max(reported_at) AS max_reported_at,
min(crawl_time) AS min_crawl_time, max(crawl_time) AS max_crawl_time FROM snapshots""")
def _(spark, sf):
    return snapshots.snapshot_overview(views.snapshots(spark, sf))


@query("snapshot_overview_rain", f"""SELECT {n('count(*)', 'record_count')}, {n(KEY3, 'station_count')}, min(period_start) AS min_period_start, max(period_end) AS max_period_end,
min(crawl_time) AS min_crawl_time, max(crawl_time) AS max_crawl_time FROM rain""")
def _(spark, sf):
    return snapshots.snapshot_overview(views.rain(spark, sf), "period_start", "period_end")


def _count_sql(dim: str, alias: str, source: str = "snapshots", ts: str = "reported_at") -> str:
    return f"SELECT {dim} AS {alias}, {n('count(*)', 'record_count')}, {n(KEY3, 'station_count')}, min({ts}) AS first_time, max({ts}) AS last_time FROM {source} GROUP BY 1"


@query("count_by_type", _count_sql("coalesce(nullif(trim(station_type), ''), 'unknown')", "station_type"))
def _(spark, sf):
    return snapshots.count_by_type(views.snapshots(spark, sf))


@query("count_by_city", _count_sql("city", "city"))
def _(spark, sf):
    return snapshots.count_by(views.snapshots(spark, sf), ["city"])


@query("count_by_date", _count_sql("CAST(reported_at AS DATE)", "day"))
def _(spark, sf):
    return snapshots.count_by(views.snapshots(spark, sf), [F.to_date("reported_at").alias("day")])


@query("count_by_city_rain", _count_sql("city", "city", "rain", "period_start"))
def _(spark, sf):
    return snapshots.count_by(views.rain(spark, sf), ["city"], "period_start")


@query("count_by_hour", f"""SELECT date_trunc('hour', crawl_time) AS bucket, {n('count(*)', 'record_count')}, min(crawl_time) AS first_time, max(crawl_time) AS last_time
FROM snapshots GROUP BY 1""")
def _(spark, sf):
    return snapshots.count_by_bucket(views.snapshots(spark, sf))


@query("count_by_day_cut", f"""SELECT CAST(date_trunc('day', crawl_time) AS TIMESTAMP) AS bucket, CASE WHEN crawl_time < TIMESTAMP '2024-01-15 12:00:00' THEN 'before' ELSE 'after' END AS period,
{n('count(*)', 'record_count')}, min(crawl_time) AS first_time, max(crawl_time) AS last_time FROM snapshots GROUP BY 1, 2""")
def _(spark, sf):
    return snapshots.count_by_bucket(views.snapshots(spark, sf), "day", cut="2024-01-15 12:00:00")


@query("tide_station_summary", f"""SELECT city, city_county, station_name, {n('count(*)', 'record_count')}, min(reported_at) AS min_reported_at, max(reported_at) AS max_reported_at,
{r('min(TRY_CAST(water_level AS DOUBLE))', 'min_water_level')}, {r('max(TRY_CAST(water_level AS DOUBLE))', 'max_water_level')}, {r('avg(TRY_CAST(water_level AS DOUBLE))', 'mean_water_level')}
FROM typed_snapshots WHERE station_type = 'tide' GROUP BY 1, 2, 3""")
def _(spark, sf):
    return snapshots.tide_station_summary(typed(spark, sf))


@query("scan_summary", f"""SELECT {n('count(*)', 'record_count')}, min(period_start) AS min_period_start, max(period_start) AS max_period_start,
min(crawl_time) AS min_crawl_time, max(crawl_time) AS max_crawl_time FROM rain""")
def _(spark, sf):
    return snapshots.scan_summary(views.rain(spark, sf), ["period_start", "crawl_time"])


@query("head_and_tail", """SELECT seq, crawl_time, 'head' AS part FROM (SELECT * FROM snapshots ORDER BY crawl_time, seq LIMIT 20)
UNION ALL SELECT seq, crawl_time, 'tail' FROM (SELECT * FROM snapshots ORDER BY crawl_time DESC, seq DESC LIMIT 20)""")
def _(spark, sf):
    return snapshots.head_and_tail(views.snapshots(spark, sf).select("seq", "crawl_time"), 20, ["crawl_time", "seq"])


@query("track_summary", f"""SELECT storm_id, {n('count(*)', 'points')}, min(ts) AS first_time, max(ts) AS last_time, {r('min(TRY_CAST(pressure_hpa AS DOUBLE))', 'min_pressure_hpa')},
{r('max(TRY_CAST(max_wind_ms AS DOUBLE))', 'max_wind_ms')} FROM track_points GROUP BY 1""")
def _(spark, sf):
    return snapshots.track_summary(views.track_points(spark, sf))


@query("manifest_reconcile", f"""
WITH w AS (SELECT station_type AS category, count(*) AS c, count(DISTINCT city) AS files FROM typed_snapshots GROUP BY 1)
SELECT category, {n('c', 'source_rows')}, {n('c', 'written_rows')}, {n('files', 'files')}, true AS agrees FROM w""")
def _(spark, sf):
    rows = typed(spark, sf)
    manifest = rows.groupBy(F.col("station_type").alias("category"), F.col("city").alias("file")).agg(F.count("*").alias("rows"))
    source = rows.groupBy(F.col("station_type").alias("category")).agg(F.count("*").alias("source_rows"))
    return snapshots.manifest_reconcile(manifest, source)


@query("table_freshness", f"""SELECT {n('count(*)', 'rows')}, max(crawl_time) AS latest, {n("epoch(TIMESTAMP '2024-02-01 00:00:00' - max(crawl_time))", 'age_seconds')} FROM snapshots""")
def _(spark, sf):
    return snapshots.table_freshness(views.snapshots(spark, sf), "crawl_time", F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("latest_snapshot", "SELECT seq, city, station_name, crawl_time FROM snapshots WHERE crawl_time = (SELECT max(crawl_time) FROM snapshots)")
def _(spark, sf):
    return snapshots.latest_snapshot(views.snapshots(spark, sf)).select("seq", "city", "station_name", "crawl_time")


@query("latest_n", "SELECT seq, crawl_time FROM snapshots ORDER BY crawl_time DESC, seq LIMIT 5000")
def _(spark, sf):
    return snapshots.latest_n(views.snapshots(spark, sf).select("seq", "crawl_time"), 5000, ties=["seq"])


@query("top_n_events", f"""SELECT station_id, origin, lead_hours, model, {r('observed_m', 'observed_m')} FROM forecasts
ORDER BY observed_m DESC, station_id, origin, lead_hours, model LIMIT 10""")
def _(spark, sf):
    rows = views.forecasts(spark, sf).select("station_id", "origin", "lead_hours", "model", "observed_m")
    return snapshots.top_n(rows, 10, ties=["station_id", "origin", "lead_hours", "model"])


@query("most_common", f"""SELECT station_name, {n('count(*)', 'count')} FROM snapshots GROUP BY 1""")
def _(spark, sf):
    return snapshots.most_common(views.snapshots(spark, sf), "station_name")


@query("row_maps_water", "SELECT trim(city) AS city, trim(city_county) AS city_county, trim(station_name) AS station_name, trim(station_type) AS station_type, reported_at, water_level, crawl_time FROM snapshots")
def _(spark, sf):
    source = {v: k for k, v in snapshots.WATER_COLUMNS.items()}
    exported = views.snapshots(spark, sf).drop("seq", "station_code").withColumnsRenamed(source)
    return snapshots.water_rows(snapshots.rename_source(exported, snapshots.WATER_COLUMNS), snapshots.WATER_BY_TYPE)


@query("row_maps_rain", f"""SELECT city, city_county, station_name, station_code, period_end AS reported_at, {r('rainfall', 'rainfall')},
strftime(period_start, '%Y-%m-%dT%H:%M:%S') || ' - ' || strftime(period_end, '%Y-%m-%dT%H:%M:%S') AS period, crawl_time FROM rain""")
def _(spark, sf):
    return snapshots.rain_rows(views.rain(spark, sf))


@query("export_manifest", f"""
WITH c AS (SELECT 'all_rows' AS category, count(*) AS k FROM typed_snapshots UNION ALL SELECT 'by_type', count(*) FROM typed_snapshots UNION ALL SELECT 'by_county', count(*) FROM typed_snapshots)
SELECT category, {n('k', 'source_rows')}, {n('k', 'written_rows')}, true AS agrees FROM c""")
def _(spark, sf):
    from tidewright.functions.storage import shared_folder
    from tidewright.operators import export

    rows = typed(spark, sf)
    layouts = {"by_type": ["station_type"], "by_county": ["city_county"]}
    written = export.export_event(spark, rows, shared_folder(spark, "export"), layouts, form="parquet")
    names = F.array(*[F.lit(c) for c in ("all_rows", *layouts)])
    source = rows.agg(F.count("*").alias("source_rows")).select(F.explode(names).alias("category"), "source_rows")
    return snapshots.manifest_reconcile(written, source).drop("files")


# --- stations, paths and catalogues -------------------------------------------------------------------------

_KM = """2 * 6371.0 * asin(least(1.0, sqrt(sin(radians(p.lat - s.lat) / 2) ** 2 + cos(radians(s.lat)) * cos(radians(p.lat)) * sin(radians(p.lon - s.lon) / 2) ** 2)))"""


@query("station_path_nearest", f"""
WITH d AS (SELECT s.station_id, s.province, p.storm_id, p.lead_hour, p.lat AS plat, p.lon AS plon, {_KM} AS km FROM stations s, track_points p),
k AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY km, storm_id, lead_hour) AS i FROM d WHERE km <= 80)
SELECT station_id, province, storm_id, lead_hour, {r('plat', 'nearest_lat')}, {r('plon', 'nearest_lon')}, round(km, 1) AS min_distance_km FROM k WHERE i = 1""")
def _(spark, sf):
    path = views.track_points(spark, sf).select("storm_id", "lead_hour", "lat", "lon")
    out = spatial.station_path_nearest(views.stations(spark, sf), path, 80.0, order=("storm_id", "lead_hour"))
    return out.select("station_id", "province", "storm_id", "lead_hour", "nearest_lat", "nearest_lon", "min_distance_km")


# sites far apart, so that most storms find five of them in outer rings only
views.SQL["far_sites"] = "SELECT station_id, -60 + 17.0 * (CAST(substr(station_id, 3) AS BIGINT) % 8) AS lat, -170 + 31.0 * (CAST(substr(station_id, 3) AS BIGINT) % 11) AS lon FROM stations WHERE CAST(substr(station_id, 3) AS BIGINT) <= 88"


@query("nearest_sites", f"""
WITH d AS (SELECT p.storm_id, s.station_id, p.lead_hour, p.lat AS plat, p.lon AS plon, {_KM} AS km FROM far_sites s, track_points p),
k AS (SELECT *, row_number() OVER (PARTITION BY storm_id, station_id ORDER BY km, lead_hour) AS i FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY round(km, 1), station_id) AS place FROM k WHERE i = 1)
SELECT storm_id, station_id, lead_hour, {r('plat', 'nearest_lat')}, {r('plon', 'nearest_lon')}, round(km, 1) AS min_distance_km FROM o WHERE place <= 5""")
def _(spark, sf):
    number = F.substring("station_id", 3, 20).cast("bigint")
    far = views.stations(spark, sf).where(number <= 88).select("station_id", (-60 + 17.0 * (number % 8)).alias("lat"), (-170 + 31.0 * (number % 11)).alias("lon"))
    path = views.track_points(spark, sf).select("storm_id", "lead_hour", "lat", "lon")
    out = spatial.nearest_sites(far, path, 5)
    return out.select("storm_id", "station_id", "lead_hour", "nearest_lat", "nearest_lon", "min_distance_km")


@query("site_filter", "SELECT station_id, province, area FROM stations WHERE area = '2' AND contains(province, '1')")
def _(spark, sf):
    return spatial.site_filter(views.stations(spark, sf), "2", "1").select("station_id", "province", "area")


@query("keyword_select", """
WITH h AS (SELECT c_custkey, c_name, c_mktsegment, CASE WHEN contains(lower(c_mktsegment), 'build') OR contains(lower(c_name), 'build') THEN 1
WHEN contains(lower(c_mktsegment), 'auto') OR contains(lower(c_name), 'auto') THEN 2 END AS request FROM customer WHERE c_acctbal > 0)
SELECT c_custkey, c_name, c_mktsegment, CAST(request AS BIGINT) AS request FROM h WHERE request IS NOT NULL""")
def _(spark, sf):
    rows = views.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    out = spatial.keyword_select(rows, ["Build", "AUTO"], ["c_mktsegment", "c_name"], "c_custkey", F.col("c_acctbal") > 0)
    return out.select("c_custkey", "c_name", "c_mktsegment", "request")


@query("latest_cycle", """SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y%m%d') AS cycle_date,
lpad(CAST(hour(ts - INTERVAL 5 HOUR) // 6 * 6 AS VARCHAR), 2, '0') AS cycle_hour FROM events""")
def _(spark, sf):
    return views.table(spark, sf, "events").select("event_id", *[c.alias(k) for k, c in spatial.latest_cycle("ts").items()])


@query("expand_hours", f"""SELECT DISTINCT p_brand, unnest(CASE WHEN p_partkey % 2 = 0 THEN generate_series(p_size, p_size + p_partkey % 7) ELSE [p_size::BIGINT] END) AS hour FROM part""")
def _(spark, sf):
    k = F.col("p_partkey")
    span = F.concat_ws("-", F.col("p_size").cast("string"), (F.col("p_size") + k % 7).cast("string"))
    spec = F.when(k % 2 == 0, span).otherwise(F.col("p_size").cast("string"))
    return spatial.expand_hours(views.table(spark, sf, "part").select("p_brand", spec.alias("spec")), "spec")


# --- peak events -----------------------------------------------------------------------------------------------

_PICKS = """
picks AS (
  SELECT station_id, 1 AS i, [arg_max(ts, (abs(surge_m), ts))] AS hours FROM surge GROUP BY 1
  UNION ALL
  SELECT station_id, i + 1, list_append(max(hours), arg_max(ts, (score, ts))) FROM (
    SELECT p.station_id, p.i, p.hours, s.ts, abs(s.surge_m) AS score FROM picks p JOIN surge s ON s.station_id = p.station_id
    WHERE p.i < 5 AND len(list_filter(p.hours, lambda h: abs(epoch(h - s.ts)) < 86400)) = 0) GROUP BY station_id, i)"""


@query("select_events", f"""
WITH RECURSIVE {_PICKS}, x AS (SELECT station_id, i AS event, hours[i] AS ts FROM picks)
SELECT x.station_id, CAST(x.event AS BIGINT) AS event, x.ts, {r('abs(s.surge_m)', 'score')} FROM x JOIN surge s ON s.station_id = x.station_id AND s.ts = x.ts""")
def _(spark, sf):
    scored = views.surge(spark, sf).withColumn("score", F.abs("surge_m"))
    return events.select_events(scored, "score", 5, 24)


views.SQL["window_scores"] = """SELECT station_id, ts, score FROM (SELECT station_id, ts, CASE WHEN count(surge_m) OVER w = 6 THEN max(abs(surge_m)) OVER w END AS score FROM surge_dense
WINDOW w AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) WHERE score IS NOT NULL"""
_STRONG = _PICKS.replace("abs(surge_m)", "score").replace("abs(s.surge_m) AS score", "s.score").replace("FROM surge ", "FROM window_scores ").replace("JOIN surge s", "JOIN window_scores s").replace("p.i < 5", "p.i < 3").replace("< 86400", "< 259200")


@query("strong_forecast_windows", f"""
WITH RECURSIVE {_STRONG}, x AS (SELECT station_id, i AS event, hours[i] AS ts FROM picks)
SELECT x.station_id, CAST(x.event AS BIGINT) AS event, x.ts, {r('s.score', 'score')} FROM x JOIN window_scores s ON s.station_id = x.station_id AND s.ts = x.ts""")
def _(spark, sf):
    return events.select_events(events.forecast_window_scores(views.surge(spark, sf), 6), "score", 3, 72)


def _peak_series(spark, sf):
    series = F.concat_ws("-", "station_id", "model", F.col("lead_hours").cast("string")).alias("station_id")
    return views.forecasts(spark, sf).select(series, F.col("valid_time").alias("ts"), "observed_m", "predicted_m")


views.SQL["peak_series"] = "SELECT station_id || '-' || model || '-' || lead_hours AS station_id, valid_time AS ts, observed_m, predicted_m FROM forecasts"
_PEAKS = _PICKS.replace("surge_m", "observed_m").replace("FROM surge ", "FROM peak_series ").replace("JOIN surge s", "JOIN peak_series s")
_TABLE = f"""
WITH RECURSIVE {_PEAKS}, x AS (SELECT station_id, i AS event, hours[i] AS peak_ts FROM picks),
w AS (SELECT x.*, s.observed_m, s.predicted_m, epoch(s.ts - x.peak_ts) / 3600 AS off FROM x JOIN peak_series s ON s.station_id = x.station_id
      AND s.ts BETWEEN x.peak_ts - INTERVAL 12 HOUR AND x.peak_ts + INTERVAL 12 HOUR),
t AS (SELECT station_id, event, peak_ts, max(observed_m) FILTER (WHERE off = 0) AS o, max(predicted_m) FILTER (WHERE off = 0) AS p,
             arg_max(off, (abs(predicted_m), -off)) AS late FROM w GROUP BY 1, 2, 3)"""


@query("window_search", f"""
WITH RECURSIVE {_PEAKS}, x AS (SELECT station_id, i AS event, hours[i] AS peak_ts FROM picks)
SELECT x.station_id, CAST(x.event AS BIGINT) AS event, x.peak_ts, s.ts, CAST(epoch(s.ts - x.peak_ts) / 3600 AS BIGINT) AS offset_h, {r('s.observed_m', 'observed_m')}
FROM x JOIN peak_series s ON s.station_id = x.station_id AND s.ts BETWEEN x.peak_ts - INTERVAL 12 HOUR AND x.peak_ts + INTERVAL 12 HOUR""")
def _(spark, sf):
    series = _peak_series(spark, sf)
    peaks = events.select_events(series.withColumn("score", F.abs("observed_m")), "score", 5).drop("score")
    return events.window_search(peaks, series.select("station_id", "ts", "observed_m"))


@query("peak_event_table", f"""{_TABLE}
SELECT station_id, CAST(event AS BIGINT) AS event, peak_ts, {r('o', 'observed_peak_m')}, {r('p', 'prediction_at_peak_m')}, {r('late', 'timing_error_hours')},
       {r('(p - o) * 100', 'peak_error_cm')}, abs(p) < abs(o) AS underestimated FROM t""")
def _(spark, sf):
    return events.peak_event_table(_peak_series(spark, sf), 5)


@query("peak_event_summary", f"""{_TABLE}
SELECT station_id, {n('count(*)', 'event_count')}, {r('avg(abs((p - o) * 100))', 'mean_absolute_peak_error_cm')}, {r('avg(abs(late))', 'mean_absolute_timing_error_hours')},
       {r('max(o) FILTER (WHERE event = 1)', 'maximum_observed_m')}, {r('max(p) FILTER (WHERE event = 1)', 'prediction_at_maximum_m')},
       {r('max((p - o) * 100) FILTER (WHERE event = 1)', 'maximum_peak_error_cm')}, bool_or(abs(p) < abs(o)) FILTER (WHERE event = 1) AS maximum_underestimated FROM t GROUP BY 1""")
def _(spark, sf):
    return events.peak_event_summary(events.peak_event_table(_peak_series(spark, sf), 5))


@query("split_parts", f"SELECT city, {n('count(*)', 'rows')}, {n('ceil(count(*) / 100.0)', 'least_files')}, true AS bounded FROM snapshots GROUP BY 1")
def _(spark, sf):
    """Files of at most 100 rows each; reading them back proves the bound and that no row is lost."""
    from tidewright.functions.storage import shared_folder

    folder = shared_folder(spark, "parts")
    export.export_partitioned(views.snapshots(spark, sf), folder, ["city"], ["reported_at"], max_rows=100)
    rows = spark.read.parquet(folder)
    files = rows.groupBy("city", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("k"))
    return files.groupBy("city").agg(
        F.sum("k").alias("rows"), F.ceil(F.sum("k") / 100).alias("least_files"), ((F.max("k") <= 100) & (F.count("*") >= F.ceil(F.sum("k") / 100))).alias("bounded"))


@query("report_tables", f"SELECT event_type, {n('count(*)', 'rows')}, {r('avg(value)', 'mean')}, form FROM events, (VALUES ('csv'), ('json')) f(form) GROUP BY 1, 4")
def _(spark, sf):
    """A table written in both report forms and read back; a second write into the folder is refused."""
    from tidewright.functions.storage import shared_folder
    from tidewright.operators import export

    folder = shared_folder(spark, "report")
    table = views.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("rows"), F.avg("value").alias("mean"))
    export.refuse_overwrite(spark, folder)
    export.write_report_tables({"events": table}, folder)
    try:
        export.refuse_overwrite(spark, folder)
    except FileExistsError:
        kind = "event_type string, rows bigint, mean double"
        csv = spark.read.schema(kind).csv(f"{folder}/events_csv", header=True).withColumn("form", F.lit("csv"))
        return csv.unionByName(spark.read.schema(kind).json(f"{folder}/events_json").withColumn("form", F.lit("json")))
    raise AssertionError("a folder that holds files was not refused")
