"""Queries that parse text, JSON and result tables built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.plans import views
from tidewright.plans.registry import n, query, r
from tidewright.sources import files, gauge, results, tracks

_E = "event_id"


def _events(spark, sf):
    return views.table(spark, sf, "events")


def _cents():
    return F.round(F.col("value") * 100).cast("bigint")


# every 13th line is a comment and every 17th lacks a number
@query("parse_records", f"""SELECT event_id, date_trunc('minute', ts) AS ts, CAST(cents AS DOUBLE) AS water_level, CAST(event_id % 6 AS VARCHAR) AS qc_flag, '1' AS use_flag,
CASE WHEN event_id % 2 = 0 THEN 's' || user_id % 3 ELSE 'default' END AS sensor, CAST(NULL AS DOUBLE) AS tide_estimate
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) WHERE event_id % 13 <> 0 AND event_id % 17 <> 0""")
def _(spark, sf):
    i = F.col(_E)
    sensor = F.when(i % 2 == 0, F.concat(F.lit(" s"), (F.col("user_id") % 3).cast("string"))).otherwise(F.lit(""))
    line = (
        F.when(i % 13 == 0, F.lit("# comment"))
        .when(i % 17 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" bad 1")))
        .otherwise(F.concat(F.date_format("ts", "yyyy/MM/dd,HH:mm"), F.lit("  "), _cents().cast("string"), F.lit(" "), (i % 6).cast("string"), F.lit(" 1"), sensor))
    )
    return gauge.parse_records(_events(spark, sf).select(_E, line.alias("value")))


@query("parse_records_flexible", """SELECT event_id, CASE event_id % 4 WHEN 3 THEN date_trunc('hour', ts) ELSE date_trunc('minute', ts) END AS ts, CAST(cents + 100 AS DOUBLE) AS water_level,
CAST(event_id % 6 AS DOUBLE) AS qc_flag, 1.0::DOUBLE AS use_flag FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) WHERE event_id % 13 <> 0""")
def _(spark, sf):
    # levels start at 100, so the four-number form never offers a fifth number that could be a minute
    i = F.col(_E)
    forms = ("yyyy-MM-dd HH:mm", "yyyyMMdd HHmm", "yyyy MM dd HH mm", "yyyy MM dd HH")
    stamp = F.coalesce(*[F.when(i % 4 == k, F.date_format("ts", f)) for k, f in enumerate(forms)])
    line = F.concat_ws(" ", stamp, (_cents() + 100).cast("string"), (i % 6).cast("string"), F.lit("1"))
    return gauge.parse_records_flexible(_events(spark, sf).select(_E, F.when(i % 13 == 0, F.lit("# note")).otherwise(line).alias("value")))


@query("canonical_table", f"""SELECT date_trunc('minute', ts) AS ts, {r('value', 'water_level')}, CAST(event_id % 6 AS VARCHAR) AS qc_flag, CAST(NULL AS VARCHAR) AS use_flag,
's' || user_id % 3 AS sensor, CAST(NULL AS VARCHAR) AS tide_estimate FROM events""")
def _(spark, sf):
    raw = _events(spark, sf).select(
        F.date_format("ts", "yyyy/M/d").alias("Date"), F.date_format("ts", "H:mm").alias(" Time "), F.col("value").cast("string").alias("Sea-Level"),
        (F.col(_E) % 6).cast("string").alias("Quality"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("Channel"),
    )
    return gauge.canonical_table(raw)


@query("canonical_grid", f"""SELECT ts, variable, {r('latitude', 'latitude')}, {r('longitude', 'longitude')}, {r('value', 'value')} FROM field""")
def _(spark, sf):
    from tidewright.operators.align import exact_grid_align

    wide = exact_grid_align(views.field(spark, sf)).drop("lat_idx", "lon_idx")
    renamed = wide.withColumnsRenamed({"ts": "valid_time", "latitude": "lat", "longitude": "lon", "u10": "10U", "msl": "mean_sea_level_pressure"})
    return files.canonical_grid(renamed)



@query("group_files_by_year", f"""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'era_' || o_orderkey % 7 ELSE strftime(o_orderdate, '%Y') END AS period, {n('count(*)', 'files')} FROM orders GROUP BY 1""")
def _(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("era_"), F.when(k % 3 == 0, F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy_")), (k % 7).cast("string"), F.lit(".nc"))
    listing = views.table(spark, sf, "orders").select(F.concat(F.lit("/data/"), name).alias("path"), name.alias("file_name"))
    return files.group_files_by_year(listing).groupBy("period").agg(F.count("*").alias("files"))


@query("file_inventory", f"""SELECT suffix, possible_source, possible_station, possible_year, {n('count(*)', 'files')}, {r('sum(round(p_size * 10000 / 1048576, 4))', 'size_mb')} FROM (
SELECT CASE p_partkey % 5 WHEN 0 THEN '.nc' WHEN 1 THEN '.grb' ELSE '.txt' END AS suffix,
CASE p_partkey % 5 WHEN 0 THEN 'ERA5 NetCDF' WHEN 1 THEN 'ERA5 GRIB' WHEN 2 THEN 'GESLA station file' WHEN 3 THEN 'PSMSL/NOC station file' ELSE 'unclassified' END AS possible_source,
CASE WHEN p_partkey % 5 = 3 THEN 'North Pier' ELSE '' END AS possible_station, CASE WHEN p_partkey % 2 = 0 THEN CAST(1990 + p_size AS VARCHAR) ELSE '' END AS possible_year, p_size
FROM part WHERE p_partkey % 11 <> 0) GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    k = F.col("p_partkey")
    kind = (
        F.when(k % 5 == 0, F.lit("x.nc")).when(k % 5 == 1, F.lit("x.GRB")).when(k % 5 == 2, F.lit("gesla.txt"))
        .when(k % 5 == 3, F.lit("pier.txt")).otherwise(F.lit("x.txt"))
    )
    year = F.when(k % 2 == 0, F.concat((1990 + F.col("p_size")).cast("string"), F.lit("-"))).otherwise(F.lit(""))
    name = F.concat(F.when(k % 11 == 0, F.lit("._")).otherwise(F.lit("")), year, kind)
    listing = views.table(spark, sf, "part").select(F.concat(F.lit("/data/"), name).alias("path"), name.alias("file_name"), (F.col("p_size") * 10000).alias("size_bytes"))
    out = files.file_inventory(listing, {"pier": "North Pier"})
    return out.groupBy("suffix", "possible_source", "possible_station", "possible_year").agg(F.count("*").alias("files"), F.sum("size_mb").alias("size_mb"))


# one storm document per order: two observed points, the second with forecasts of two agencies
def _storms(spark, sf):
    k = F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "yyyyMMddHHmm")
    doc = F.format_string(
        'cb(({"typhoon": ["T%d", "EN", null, "c", 1, 2, "m", "start", [[%d, "%s", 1, "TS", %d.5, 20.25, 990, 18, "NW", 12, [["30KTS", 1]], {}, []],'
        '[%d, "later", 1, "TY", %d.5, 21.25, 980, 25, "N", 10, [], {"BABJ": [[24, "x", %d.5, 22.5, 975, 30, 1, "TY"], [48, "x", 130.5, 23.5]], "RJTD": [[24, "x", 1, 2, 3, 4, 5, "g"]]}, ["now", "at noon"]]]]}));',
        k, k, stamp, 100 + k % 50, k + 1, 100 + k % 50, 101 + k % 50,
    )
    return views.table(spark, sf, "orders").select(doc.alias("value"))


@query("read_track", """
SELECT 'T' || o_orderkey AS typhoon_id, CAST(0 AS BIGINT) AS point_index, CAST(o_orderkey AS VARCHAR) AS point_id, strftime(o_orderdate, '%Y%m%d%H%M') AS time_utc,
       strftime(o_orderdate + INTERVAL 8 HOUR, '%Y%m%d%H%M') AS time_bj, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS time_iso, 'TS' AS grade, (100 + o_orderkey % 50) || '.5' AS lon, '20.25' AS lat,
       '990' AS pressure_hpa, '18' AS max_wind_ms, 'NW' AS move_dir, '12' AS move_speed_kmh, '[["30KTS",1]]' AS wind_radii_json, NULL AS issue_time, NULL AS issue_time_text FROM orders
UNION ALL SELECT 'T' || o_orderkey, 1, CAST(o_orderkey + 1 AS VARCHAR), 'later', '', '', 'TY', (100 + o_orderkey % 50) || '.5', '21.25', '980', '25', 'N', '10', '[]', 'now', 'at noon' FROM orders""")
def _(spark, sf):
    return tracks.read_track(_storms(spark, sf))


@query("explode_agency_forecast", """
SELECT 'T' || o_orderkey AS typhoon_id, CAST(1 AS BIGINT) AS point_index, CAST(o_orderkey + 1 AS VARCHAR) AS point_id, 'later' AS base_time_utc, '' AS base_time_bj, org, CAST(step AS BIGINT) AS step, lead_hour,
       CASE WHEN org = 'BABJ' AND step = 0 THEN (101 + o_orderkey % 50) || '.5' ELSE lon END AS forecast_lon, lat AS forecast_lat, p AS forecast_pressure_hpa, w AS forecast_max_wind_ms, g AS forecast_grade
FROM orders, (VALUES ('BABJ', 0, '24', '', '22.5', '975', '30', 'TY'), ('BABJ', 1, '48', '130.5', '23.5', NULL, NULL, NULL), ('RJTD', 0, '24', '1', '2', '3', '4', 'g')) f(org, step, lead_hour, lon, lat, p, w, g)""")
def _(spark, sf):
    return tracks.explode_agency_forecast(_storms(spark, sf))


@query("latest_agency_path", f"""
SELECT 'T' || o_orderkey AS typhoon_id, '' AS base_time_bj, CAST(step AS BIGINT) AS step, CAST(lead_hour AS BIGINT) AS lead_hour, {r("CASE WHEN step = 0 THEN 101.5 + o_orderkey % 50 ELSE 130.5 END", 'lon')}, {r('lat', 'lat')}, p AS pressure_hpa, w AS max_wind_ms, g AS grade
FROM orders, (VALUES (0, 24, 22.5, '975', '30', 'TY'), (1, 48, 23.5, NULL, NULL, NULL)) f(step, lead_hour, lat, p, w, g)""")
def _(spark, sf):
    return tracks.latest_agency_path(_storms(spark, sf), "BABJ")


@query("typhoon_list", """
SELECT CAST(c_custkey AS VARCHAR) AS typhoon_id, c_name AS en_name, c_mktsegment AS cn_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'c' END AS code, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '4' END AS display_no,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '5' END AS international_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'm' END AS meaning, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'stop' END AS status FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    row = F.concat(F.format_string('[%d,"%s","%s"', k, F.col("c_name"), F.col("c_mktsegment")), F.when(k % 3 == 0, F.lit("]")).otherwise(F.lit(',"c",4,"5","m","stop"]')))
    return tracks.typhoon_list(views.table(spark, sf, "customer").select(F.concat(F.lit('{"typhoonList":['), row, F.lit("]}")).alias("value")))


@query("flatten_site_tree", """SELECT 'p' || s_nationkey AS province, s_name AS "siteName", 'c' || s_suppkey || '-' || i AS "siteCode", CAST(NULL AS VARCHAR) AS "siteArea", '10.5' AS lat, '120' AS lon, '1' AS blue, '2' AS yellow, '3' AS orange, CAST(NULL AS VARCHAR) AS red
FROM supplier, (VALUES (0), (1)) v(i)""")
def _(spark, sf):
    site = '{"province":"p%d","siteName":"%s","siteCode":"c%d-%d","lat":"10.5","lon":"120","blue":"1","yellow":"2","orange":"3"}'
    args = [F.col("s_nationkey"), F.col("s_name"), F.col("s_suppkey")]
    doc = F.format_string(f'[{{"children":[{site}]}},{{"children":[{site}]}}]', *args, F.lit(0), *args, F.lit(1))
    return tracks.flatten_site_tree(views.table(spark, sf, "supplier").select(doc.alias("value")))


@query("explode_scenario_path", f"""SELECT 'p' || o_orderkey AS "pathId", CAST(i AS BIGINT) AS lead, {r('20.0 + o_orderkey % 10 + i', 'lat')} FROM orders, (VALUES (0), (1), (2)) v(i)""")
def _(spark, sf):
    k = F.col("o_orderkey")
    points = F.array(*[F.struct(F.lit(i).alias("lead"), (20.0 + k % 10 + i).alias("lat")) for i in range(3)])
    rows = views.table(spark, sf, "orders").select(F.concat(F.lit("p"), k.cast("string")).alias("pathId"), points.alias("pointData"))
    return tracks.explode_scenario_path(rows)


@query("zip_series", f"""
SELECT o_orderkey, o_orderdate AS "initialTime", o_orderdate + i * INTERVAL 1 HOUR AS "forecastTime", CAST(i AS BIGINT) AS lead_index, CASE WHEN i < 2 + o_orderkey % 3 THEN o_orderkey % 50 + i END AS tide_cm,
       CASE WHEN i < 3 THEN o_orderkey % 20 - i END AS surge_cm, CASE WHEN i < o_orderkey % 5 THEN o_orderkey % 9 + i END AS water_level_cm
FROM orders, (SELECT unnest(generate_series(0, 4)) AS i) WHERE i < greatest(2 + o_orderkey % 3, 3, o_orderkey % 5)""")
def _(spark, sf):
    k = F.col("o_orderkey")

    def run(size, make):
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < size), make)

    rows = views.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("initialTime"), run(2 + k % 3, lambda i: k % 50 + i).alias("tides"),
        run(F.lit(3), lambda i: k % 20 - i).alias("surges"), run(k % 5, lambda i: k % 9 + i).alias("wl"),
    )
    return tracks.zip_series(rows, ["o_orderkey"])


_SEA = ", ".join(f"'{i}' AS \"{c}\"" for i, c in enumerate(tracks.WEATHER_FIELDS))
_WIND = ", ".join(f"CAST(NULL AS VARCHAR) AS \"{c}\"" for c in tracks.WIND_FIELDS[2:])


@query("sea_surface_obs", f"""SELECT 'S' || user_id AS "StationID", strftime(ts, '%Y-%m-%dT%H:%M') AS "DateTime", {_SEA}, CAST(event_id % 30 AS VARCHAR) AS "WindSpeed", '3' AS "WindScale", {_WIND} FROM events""")
def _(spark, sf):
    weather = ",".join(f'"{c}":"{i}"' for i, c in enumerate(tracks.WEATHER_FIELDS))
    doc = F.format_string(
        '{"Records":{"SeaSurfaceObs":{"Location":[{"Station":{"StationID":"S%d"},"StationObsTimes":{"StationObsTime":[{"DateTime":"%s","WeatherElements":{'
        + weather + ',"PrimaryAnemometer":{"WindSpeed":"%d","WindScale":"3"}}}]}}]}}}',
        F.col("user_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.col(_E) % 30,
    )
    return tracks.sea_surface_obs(_events(spark, sf).select(doc.alias("value")))


@query("flatten_json", f"""SELECT event_id AS id, event_type AS station_name, user_id AS station_code_main, '[' || event_id % 3 || ',7]' AS station_flags, {r('value', 'items_0_v')}, {r('CASE WHEN event_id % 2 = 0 THEN value + 1 END', 'items_1_v')} FROM events""")
def _(spark, sf):
    v = F.col("value")
    second = F.struct((v + 1).alias("v"))
    nested = _events(spark, sf).select(
        F.col(_E).alias("id"),
        F.struct(F.col("event_type").alias("name"), F.struct(F.col("user_id").alias("main")).alias("code"), F.array(F.col(_E) % 3, F.lit(7)).alias("flags")).alias("station"),
        F.when(F.col(_E) % 2 == 0, F.array(F.struct(v.alias("v")), second)).otherwise(F.array(F.struct(v.alias("v")))).alias("items"),
    )
    flat = tracks.flatten_json(nested)
    return flat.withColumnsRenamed({c: c.replace(".", "_") for c in flat.columns})


@query("code_summary", f"""SELECT CAST(user_id AS VARCHAR) AS station_code, {n('count(*)', 'rows')}, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS start_time, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS end_time,
{r('min(CASE WHEN event_id % 7 <> 0 THEN value END)', 'min_tide')}, {r('max(CASE WHEN event_id % 7 <> 0 THEN value END)', 'max_tide')} FROM events WHERE event_id % 5 <> 0 GROUP BY 1""")
def _(spark, sf):
    rows = _events(spark, sf).select(
        F.when(F.col(_E) % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("code"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.when(F.col(_E) % 7 == 0, F.lit("--")).otherwise(F.col("value").cast("string")).alias("tide"),
    )
    return tracks.code_summary(rows)


@query("normalise_predictions", f"""
WITH k AS (SELECT event_type, quantile_cont(abs(o), 0.95) AS q FROM (SELECT event_type, CASE WHEN event_type < 'd' THEN value / 97 ELSE value END AS o FROM events) GROUP BY 1)
SELECT e.event_type AS run, event_id AS seq, ts AS datetime, CAST(row_number() OVER (PARTITION BY e.event_type ORDER BY event_id) AS DOUBLE) AS lead_time,
       {r("(CASE WHEN e.event_type < 'd' THEN value / 97 ELSE value END) * CASE WHEN q <= 5 THEN 100 ELSE 1 END", 'observed')}, {r('value / 89 * CASE WHEN q <= 5 THEN 100 ELSE 1 END', 'predicted')}, CAST(NULL AS DOUBLE) AS persistence
FROM events e JOIN k ON k.event_type = e.event_type""")
def _(spark, sf):
    v = F.col("value")
    rows = _events(spark, sf).select(
        F.col("event_type").alias("run"), F.col(_E).alias("seq"), F.when(F.col("event_type") < "d", v / 97).otherwise(v).alias("Observed"),
        (v / 89).cast("string").alias("y_pred"), F.col("ts").alias("Timestamp"),
    )
    return results.normalise_predictions(rows, ["seq"], ["run"])


@query("normalise_metrics", f"""SELECT p_partkey, {r('p_retailprice / 1e4', 'pearson_r')}, {r('CASE WHEN p_size / 7.0 <= 5 THEN p_size / 7.0 * 100 ELSE p_size / 7.0 END', 'rmse')},
{r('p_size / 11.0', 'mae')}, {r('CASE WHEN p_size / 17.0 <= 2 THEN p_size / 17.0 * 100 ELSE p_size / 17.0 END', 'rrmse')} FROM part""")
def _(spark, sf):
    size = F.col("p_size")
    rows = views.table(spark, sf, "part").select(
        "p_partkey", (F.col("p_retailprice") / 1e4).alias("Corr"), (size / 7.0).alias("RMSE"), (size / 11.0).alias("mae_cm"), (size / 17.0).alias("rrmse")
    )
    return results.normalise_metrics(rows, ["p_partkey"])


@query("infer_run", """SELECT p_partkey, 'x_t' || p_size || '_n6_cnn_gru' AS run, CAST(p_size AS BIGINT) AS input_steps, CAST(CASE WHEN p_partkey % 2 = 0 THEN 12 ELSE 6 END AS BIGINT) AS forecast_steps,
'cnn_gru' AS model_name, true AS is_rolling FROM part""")
def _(spark, sf):
    name = F.format_string("x_t%d_n6_cnn_gru", "p_size")
    rows = views.table(spark, sf, "part").select("p_partkey", name.alias("run"), F.when(F.col("p_partkey") % 2 == 0, F.lit(12)).alias("steps"))
    return results.infer_run(rows).drop("steps")


@query("collect_model_metrics", f"""SELECT 'm' || p_partkey AS model, s.split, {r('p_retailprice / 970', 'rmse_cm')}, {n('p_size', 'n')}, CASE WHEN s.split = 'test' THEN {r('p_size / 97.0', 'x').rsplit(' AS ', 1)[0]} END AS skill_score_vs_ridge
FROM part, (VALUES ('validation'), ('test')) s(split) WHERE s.split = 'validation' OR p_partkey % 4 <> 0""")
def _(spark, sf):
    k = F.col("p_partkey")
    overall = F.struct((F.col("p_retailprice") / 970).alias("rmse_cm"), F.col("p_size").alias("n"))
    rows = views.table(spark, sf, "part").select(
        F.concat(F.lit("m"), k.cast("string")).alias("model"), F.struct(overall.alias("overall")).alias("validation"),
        F.when(k % 4 != 0, F.struct(overall.alias("overall"), (F.col("p_size") / 97.0).alias("skill_score_vs_ridge"))).alias("test"),
    )
    return results.collect_model_metrics(rows)


@query("find_records", """SELECT event_id AS id, CAST(user_id % 2 AS BIGINT) AS place FROM events UNION ALL SELECT event_id, 2 FROM events WHERE event_id % 3 = 0""")
def _(spark, sf):
    record = F.struct(F.col("event_id").alias("id"), (F.col("user_id") % 2).cast("bigint").alias("place"))
    second = F.struct(F.col("event_id").alias("id"), F.lit(2).cast("bigint").alias("place"))
    lists = F.struct(F.array(F.lit(0)).alias("other"), F.when(F.col("event_id") % 3 == 0, F.array(record, second)).otherwise(F.array(record)).alias("Station"))
    return tracks.find_records(views.table(spark, sf, "events").select(lists.alias("records"))).select("record.*")


@query("read_derived_table", f"SELECT ts, {r('surge_m', 'surge_m')} FROM surge_daily WHERE station_id = '1-URGENT'")
def _(spark, sf):
    """Daily levels of all stations landed as a table, one station read back."""
    from tidewright.functions.storage import shared_folder

    landed = shared_folder(spark, "derived")
    views.surge_daily(spark, sf).select(F.col("station_id").alias("station"), "ts", "surge_m").write.option("header", True).csv(landed)
    return results.read_derived_table(spark, landed, "station string, ts timestamp, surge_m double", "1-URGENT")
