"""Queries building forecast windows and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import field, samples
from tidewright.plans import views
from tidewright.plans.registry import n, query, r

views.SQL["field_hours"] = "SELECT ts, count(value) = 75 AS field_ok FROM field GROUP BY 1"
# physical rows: hours with a level, some of them unknown, with the validity of the field at that hour
views.SQL["rows3"] = """
SELECT s.station_id, s.ts, CASE WHEN CAST(epoch(s.ts) / 3600 AS BIGINT) % 29 <> 5 THEN s.surge_m END AS surge_m, coalesce(f.field_ok, false) AS field_ok
FROM surge s LEFT JOIN field_hours f ON f.ts = s.ts"""


def rows3(spark, sf):
    hour = F.floor(F.unix_seconds("ts") / 3600)
    ok = samples.field_valid(views.field(spark, sf), 25)
    known = views.surge(spark, sf).withColumn("surge_m", F.when(hour % 29 != 5, F.col("surge_m")))
    return known.join(ok, "ts", "left").withColumn("field_ok", F.coalesce("field_ok", F.lit(False)))


@query("field_valid", "SELECT ts, field_ok FROM field_hours")
def _(spark, sf):
    return samples.field_valid(views.field(spark, sf), 25)


_REASON = """CASE WHEN ts - lag(ts, 3) OVER s <> INTERVAL 3 HOUR THEN 'non_contiguous'
WHEN NOT (lag(field_ok, 1) OVER s AND lag(field_ok, 2) OVER s AND lag(field_ok, 3) OVER s) THEN 'missing_atmosphere'
WHEN surge_m + lag(surge_m, 1) OVER s + lag(surge_m, 2) OVER s + lag(surge_m, 3) OVER s IS NULL THEN 'missing_surge' END"""
TARGETS = f"""(SELECT station_id, ts, surge_m, skip_reason FROM (SELECT *, {_REASON} AS skip_reason, row_number() OVER s AS k
FROM rows3 WINDOW s AS (PARTITION BY station_id ORDER BY ts)) WHERE k > 3)"""


@query("valid_targets", f"SELECT station_id, ts, {r('surge_m', 'surge_m')}, skip_reason FROM {TARGETS}")
def _(spark, sf):
    return samples.valid_targets(rows3(spark, sf), 3, valid="field_ok").select("station_id", "ts", "surge_m", "skip_reason")


@query("dataset_audit", f"""
WITH h AS (SELECT station_id, year(ts) AS year, count(*) AS hours, count(*) - count(surge_m) AS miss, min(ts) AS a, max(ts) AS b,
                  epoch(max(ts) - min(ts)) = (count(*) - 1) * 3600 AS strict FROM rows3 GROUP BY 1, 2),
t AS (SELECT station_id, year(ts) AS year, count(*) FILTER (WHERE skip_reason IS NULL) AS ok, count(*) FILTER (WHERE skip_reason = 'non_contiguous') AS nc,
             count(*) FILTER (WHERE skip_reason = 'missing_atmosphere') AS ma, count(*) FILTER (WHERE skip_reason = 'missing_surge') AS ms FROM {TARGETS} GROUP BY 1, 2)
SELECT CASE WHEN grouping(h.station_id) = 1 THEN 'overall' WHEN grouping(h.year) = 1 THEN 'key' ELSE 'year' END AS level, h.station_id, h.year, {n('sum(hours)', 'hours')}, {n('sum(miss)', 'missing_surge_hours')},
       min(a) AS "start", max(b) AS "end", bool_and(strict) AS strictly_hourly, {n('sum(coalesce(ok, 0))', 'valid_samples')}, {n('sum(coalesce(nc, 0))', 'skipped_non_contiguous')},
       {n('sum(coalesce(ma, 0))', 'skipped_missing_atmosphere')}, {n('sum(coalesce(ms, 0))', 'skipped_missing_surge')}
FROM h LEFT JOIN t ON t.station_id = h.station_id AND t.year = h.year GROUP BY ROLLUP (h.station_id, h.year)""")
def _(spark, sf):
    series = rows3(spark, sf).withColumn("calendar_year", F.year("ts"))
    targets = samples.valid_targets(series, 3, valid="field_ok", keys=["station_id", "calendar_year"])
    return field.dataset_audit(targets, series)


_LAGS = ", ".join(f"lag(surge_m, {k}) OVER s AS b{k}, lag(field_ok, {k}) OVER s AS fb{k}" for k in (1, 2, 3))
_LEADS = ", ".join(f"lead(surge_m, {k}) OVER s AS a{k}, lead(field_ok, {k}) OVER s AS fa{k}" for k in range(1, 7))
views.SQL["axis3"] = f"""
SELECT *, {_LAGS}, {_LEADS} FROM (SELECT x.station_id, x.ts, d.surge_m, d.field_ok, d.ts IS NOT NULL AS present FROM
  (SELECT station_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM rows3 GROUP BY 1) x
  LEFT JOIN rows3 d ON d.station_id = x.station_id AND d.ts = x.ts)
WINDOW s AS (PARTITION BY station_id ORDER BY ts)"""
_DIRECT = """surge_m + b1 + b2 + a1 + a2 + a3 + a4 + a5 + a6 IS NOT NULL AND field_ok AND fb1 AND fb2 AND fa1 AND fa2 AND fa3 AND fa4 AND fa5 AND fa6
AND year(ts + INTERVAL 6 HOUR) = year(ts)"""


@query("direct_origins", f"SELECT station_id, ts, {r('surge_m', 'surge_m')} FROM axis3 WHERE {_DIRECT} AND year(ts) = 2024")
def _(spark, sf):
    out = samples.direct_origins(rows3(spark, sf), 3, 6, valid="field_ok", years=[2024])
    return out.select("station_id", "ts", "surge_m")


@query("common_origins", f"""
SELECT station_id, ts, {r('surge_m', 'surge_m')} FROM axis3 WHERE b1 + b2 + b3 IS NOT NULL AND present
AND field_ok AND fb1 AND fb2 AND fb3 AND fa1 AND fa2 AND fa3 AND fa4 AND fa5 IS NOT NULL
AND surge_m + b1 + a2 + a1 + a5 + a4 IS NOT NULL AND year(ts + INTERVAL 5 HOUR) = year(ts)""")
def _(spark, sf):
    out = samples.common_origins(rows3(spark, sf), 3, 6, (1, 3, 6), valid="field_ok")
    return out.select("station_id", "ts", "surge_m")


@query("rollout_origins", f"""
SELECT station_id, ts, {r('surge_m', 'surge_m')} FROM axis3 WHERE b1 + b2 + b3 + surge_m + a1 + a2 + a3 + a4 + a5 IS NOT NULL
AND field_ok AND fb1 AND fb2 AND fb3 AND fa1 AND fa2 AND fa3 AND fa4 AND year(ts) = 2024 AND year(ts + INTERVAL 5 HOUR) = 2024""")
def _(spark, sf):
    out = samples.rollout_origins(rows3(spark, sf), 3, 6, [2024], valid="field_ok")
    return out.select("station_id", "ts", "surge_m")


@query("direct_labels", " UNION ALL ".join(
    f"SELECT station_id, ts AS origin, CAST({k} AS BIGINT) AS lead_hours, {r(f'a{k}', 'label')} FROM axis3 WHERE {_DIRECT}" for k in range(1, 7)))
def _(spark, sf):
    return samples.direct_labels(rows3(spark, sf), 3, 6, valid="field_ok")


WEATHER = [f"{v.lower()}_{name}" for v in field.VARIABLES for name in ("mean", "std", "min", "max")]
_WEATHER_SQL = ", ".join(f"{fn}(value) FILTER (WHERE variable = '{v}') AS {v.lower()}_{name}" for v in field.VARIABLES for fn, name in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max")))
views.SQL["summary3"] = f"SELECT s.*, u.* EXCLUDE (ts) FROM rows3 s LEFT JOIN (SELECT ts, {_WEATHER_SQL} FROM field GROUP BY 1) u ON u.ts = s.ts"


def _with_weather(spark, sf):
    summary = field.spatial_summary(views.field(spark, sf)).select("ts", *WEATHER)
    return rows3(spark, sf).join(summary, "ts", "left")


_FM = """WITH o AS (SELECT station_id, ts FROM axis3 WHERE {d}),
x AS (SELECT o.station_id, o.ts AS origin, s.ts, CAST(epoch(s.ts - o.ts) / 3600 AS BIGINT) AS k, s.* EXCLUDE (station_id, ts) FROM o JOIN summary3 s
      ON s.station_id = o.station_id AND s.ts BETWEEN o.ts - INTERVAL 2 HOUR AND o.ts + INTERVAL 6 HOUR)"""


@query("feature_matrix", _FM.format(d=_DIRECT) + f"""
SELECT station_id, origin, CAST(12 * 9 + 3 AS BIGINT) AS width, {r('max(u10_mean) FILTER (WHERE k = -2)', 'f_first')}, {r('max(msl_max) FILTER (WHERE k = 6)', 'f_weather_last')},
       {r('max(surge_m) FILTER (WHERE k = -2)', 'f_history_first')}, {r('max(surge_m) FILTER (WHERE k = 0)', 'f_last')},
       {', '.join(r(f'sum({c})', f'total_{c}') for c in WEATHER)}, {r('sum(surge_m) FILTER (WHERE k <= 0)', 'total_history')},
       {r('max(surge_m) FILTER (WHERE k = 6)', 'label_last')} FROM x GROUP BY 1, 2""")
def _(spark, sf):
    out = samples.feature_matrix(_with_weather(spark, sf), WEATHER, 3, 6, valid="field_ok")
    at = lambda i: F.get("features", F.lit(i))
    add = lambda a, x: a + x
    hours = F.sequence(F.lit(0), F.lit(8))

    def total(i):
        return F.aggregate(F.transform(hours, lambda h: F.get("features", 12 * h + i)), F.lit(0.0), add)

    totals = [total(i).alias(f"total_{c}") for i, c in enumerate(WEATHER)]
    return out.select(
        "station_id", "origin", F.size("features").alias("width"), at(0).alias("f_first"), at(107).alias("f_weather_last"),
        at(108).alias("f_history_first"), at(110).alias("f_last"), *totals,
        F.aggregate(F.slice("features", 109, 3), F.lit(0.0), add).alias("total_history"), F.get("labels", F.lit(5)).alias("label_last"),
    )


_FIT3 = ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in (*WEATHER, "surge_m"))


@query("sequence_features", _FM.format(d=_DIRECT) + f""",
z AS (SELECT station_id AS sid, {_FIT3} FROM summary3 WHERE day(ts) <= 20 GROUP BY 1)
SELECT station_id, origin, k + 2 AS step, {', '.join(r(f'({c} - m_{c}) / s_{c}', c) for c in WEATHER)}, {r('CASE WHEN k <= 0 THEN (surge_m - m_surge_m) / s_surge_m ELSE 0 END', 'history')},
       CASE WHEN k <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS observed FROM x JOIN z ON sid = station_id""")
def _(spark, sf):
    out = samples.sequence_features(_with_weather(spark, sf), WEATHER, 3, 6, valid="field_ok", training=F.dayofmonth("ts") <= 20)
    steps = out.select("station_id", "origin", F.posexplode("sequence").alias("step", "s"))
    return steps.select("station_id", "origin", "step", *[F.get("s", F.lit(i)).alias(c) for i, c in enumerate((*WEATHER, "history", "observed"))])


@query("split_ratio", """SELECT station_id, ts, CASE WHEN row_number() OVER (PARTITION BY station_id ORDER BY ts) <= floor(count(*) OVER (PARTITION BY station_id) * 0.8)
THEN 'train' ELSE 'validation' END AS split FROM surge""")
def _(spark, sf):
    return samples.split_ratio(views.surge(spark, sf), 0.8).select("station_id", "ts", "split")


@query("split_test_first", """SELECT station_id, CAST(count(*) FILTER (WHERE k <= floor(c * 0.2)) AS BIGINT) AS test_rows, CAST(count(*) AS BIGINT) AS rows FROM (
SELECT station_id, row_number() OVER (PARTITION BY station_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY station_id) AS c FROM surge) GROUP BY 1""")
def _(spark, sf):
    out = samples.split_test_first(views.surge(spark, sf))
    return out.groupBy("station_id").agg(F.count_if(F.col("split") == "test").alias("test_rows"), F.count("*").alias("rows"))


@query("split_years", f"""SELECT station_id, CASE WHEN year(ts) <= 1999 THEN 'train' WHEN year(ts) = 2000 THEN 'validation' ELSE 'test' END AS split,
{n('count(*)', 'rows')}, {r('avg(surge_m)', 'mean')} FROM surge_daily WHERE year(ts) BETWEEN 1995 AND 2001 GROUP BY 1, 2""")
def _(spark, sf):
    out = samples.split_years(views.surge_daily(spark, sf), (1995, 1999), 2000, 2001)
    return out.groupBy("station_id", "split").agg(F.count("*").alias("rows"), F.avg("surge_m").alias("mean"))


@query("split_first_years", """SELECT station_id, ts, CASE WHEN dense_rank() OVER (PARTITION BY station_id ORDER BY year(ts)) <= 2 THEN 'validation' ELSE 'train' END AS split FROM surge_daily""")
def _(spark, sf):
    return samples.split_first_years(views.surge_daily(spark, sf), 2).select("station_id", "ts", "split")


_SCALER = """(SELECT station_id, avg(surge_m) FILTER (WHERE year(ts) <= 1999) AS mean, stddev_pop(surge_m) FILTER (WHERE year(ts) <= 1999) AS scale FROM surge_daily GROUP BY 1)"""


@query("standardise", f"SELECT s.station_id, ts, {r('surge_m', 'surge_m')}, {r('(surge_m - mean) / scale', 'scaled')} FROM surge_daily s JOIN {_SCALER} k ON k.station_id = s.station_id")
def _(spark, sf):
    daily = views.surge_daily(spark, sf)
    scaler = samples.fit_scaler(daily, "surge_m", ["station_id"], F.year("ts") <= 1999)
    return samples.standardise(daily, scaler, "surge_m", ["station_id"])


@query("inverse_standardise", f"SELECT station_id, ts, {r('surge_m', 'restored')} FROM surge_daily")
def _(spark, sf):
    daily = views.surge_daily(spark, sf)
    scaler = samples.fit_scaler(daily, "surge_m", ["station_id"], F.year("ts") <= 1999)
    scaled = samples.standardise(daily, scaler, "surge_m", ["station_id"])
    return samples.inverse_standardise(scaled, scaler, "scaled", ["station_id"]).select("station_id", "ts", "restored")


@query("recover_scaler", f"SELECT station_id, {r('scale', 'scale')}, {r('mean', 'mean')} FROM {_SCALER}")
def _(spark, sf):
    daily = views.surge_daily(spark, sf)
    scaler = samples.fit_scaler(daily, "surge_m", ["station_id"], F.year("ts") <= 1999)
    return samples.recover_scaler(samples.standardise(daily, scaler, "surge_m", ["station_id"]), "scaled", "surge_m", ["station_id"])


@query("minmax", f"""SELECT ts, variable, lat_idx, lon_idx, round((value - min(value) OVER v) / (max(value) OVER v - min(value) OVER v), 6) + 0.0 AS scaled
FROM field WINDOW v AS (PARTITION BY variable)""")
def _(spark, sf):
    return samples.minmax(views.field(spark, sf), "value", ["variable"]).select("ts", "variable", "lat_idx", "lon_idx", "scaled")


@query("fill_mean", f"""SELECT ts, variable, lat_idx, lon_idx, round(coalesce(value, avg(value) OVER (PARTITION BY variable)), 6) + 0.0 AS value FROM field""")
def _(spark, sf):
    return samples.fill_mean(views.field(spark, sf)).select("ts", "variable", "lat_idx", "lon_idx", "value")


@query("available_years", "SELECT year(ts) AS year FROM field GROUP BY 1 HAVING count(DISTINCT variable) = 3")
def _(spark, sf):
    return samples.available_years(views.field(spark, sf), field.VARIABLES)


@query("daily_windows", f"""
WITH p AS (SELECT ts, variable, value FROM field WHERE hour(ts) % 3 = 0),
d AS (SELECT CAST(ts AS DATE) AS day, * FROM p UNION ALL SELECT CAST(ts AS DATE) + 1, * FROM p),
c AS (SELECT day, variable, count(value) AS k FROM d GROUP BY 1, 2)
SELECT CAST(day AS DATE) AS day, {n('count(*) FILTER (WHERE k = 16 * 25)', 'complete_variables')}, {n('min(k)', 'fewest_values')},
       CASE WHEN count(*) FILTER (WHERE k = 16 * 25) < 3 THEN 'incomplete_steps' END AS skip_reason FROM c GROUP BY 1""")
def _(spark, sf):
    return samples.daily_windows(views.field(spark, sf), cells=25)


@query("daily_tensors", f"""
WITH f AS (SELECT CAST(ts AS DATE) AS day, hour(ts) // 3 + 8 AS step, variable, lat_idx, lon_idx, value FROM holed_field WHERE hour(ts) % 3 = 0
           UNION ALL SELECT CAST(ts AS DATE) + 1, hour(ts) // 3, variable, lat_idx, lon_idx, value FROM holed_field WHERE hour(ts) % 3 = 0),
c AS (SELECT day, step * 3 + CASE variable WHEN 'U10' THEN 0 WHEN 'V10' THEN 1 ELSE 2 END AS channel, lat_idx * 5 + lon_idx AS cell, CASE WHEN isfinite(value) AND lat_idx < 3 THEN value END AS value FROM f WHERE lat_idx < 3),
h AS (SELECT day, channel, count(value) AS k FROM c GROUP BY 1, 2),
d AS (SELECT day, count(*) FILTER (WHERE k = 15) AS complete FROM h GROUP BY 1)
SELECT CAST(d.day AS DATE) AS day, {n('complete', 'complete_channels')}, CASE WHEN complete < 48 THEN 'incomplete_steps' END AS skip_reason, {n('channel', 'channel')}, {n('cell', 'cell')}, {r('value', 'value')}
FROM d LEFT JOIN c ON c.day = d.day AND complete = 48""")
def _(spark, sf):
    from tidewright.plans.field_queries import holed

    days = samples.daily_tensors(holed(spark, sf).where("lat_idx < 3"), 3, 5)
    cells = days.select("day", "complete_channels", "skip_reason", F.posexplode_outer("tensor").alias("at", "value"))
    return cells.select("day", "complete_channels", "skip_reason", F.floor(F.col("at") / 15).alias("channel"), (F.col("at") % 15).alias("cell"), "value")


@query("tile", f"""
WITH f AS (SELECT CAST(ts AS DATE) AS day, hour(ts) // 3 + 8 AS step, variable, lat_idx, lon_idx, value FROM field WHERE hour(ts) % 3 = 0
           UNION ALL SELECT CAST(ts AS DATE) + 1, hour(ts) // 3, variable, lat_idx, lon_idx, value FROM field WHERE hour(ts) % 3 = 0)
SELECT CAST(day AS DATE) AS day, variable, {n('step // 4 * 5 + lat_idx', 'row')}, {n('step % 4 * 5 + lon_idx', 'column')}, {r('avg(value)', 'value')} FROM f GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    third = F.floor(F.hour("ts") / 3)
    day = F.to_date("ts")
    places = F.array(F.struct(day.alias("day"), (third + 8).alias("step")), F.struct(F.date_add(day, 1).alias("day"), third.alias("step")))
    slices = views.field(spark, sf).where(F.hour("ts") % 3 == 0).select("variable", "lat_idx", "lon_idx", "value", F.inline(places))
    return samples.tile(slices, size=5).groupBy("day", "variable", "row", "column").agg(F.avg("value").alias("value"))
