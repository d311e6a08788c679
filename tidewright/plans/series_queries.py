"""Queries over hourly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import residuals, series
from tidewright.plans import views
from tidewright.plans.registry import n, query, r

DENSE = "FROM surge_dense WINDOW s AS (PARTITION BY station_id ORDER BY ts)"


@query("hourly_grid", f"SELECT station_id, ts, {r('surge_m', 'surge_m')}, qc_valid FROM surge_dense")
def _(spark, sf):
    return series.hourly_grid(views.surge(spark, sf))


@query("gap_report", f"""
WITH g AS (SELECT station_id, ts, epoch(ts - lag(ts) OVER (PARTITION BY station_id ORDER BY ts)) / 3600.0 AS gap FROM surge)
SELECT station_id, {n('count(*)', 'rows')}, {n('count(*) FILTER (WHERE abs(gap - 1) > 1e-6)', 'non_hourly')},
       {n('count(*) FILTER (WHERE gap > 1.5)', 'gaps')},
       {n('epoch(max(ts) - min(ts)) / 3600 + 1 - count(*)', 'missing_hours')},
       {r('1.0 - count(*) / (epoch(max(ts) - min(ts)) / 3600 + 1)', 'missing_rate')}
FROM g GROUP BY 1""")
def _(spark, sf):
    return series.gap_report(views.surge(spark, sf))


@query("contiguous_segments", f"""
WITH g AS (SELECT station_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY station_id ORDER BY ts) <= INTERVAL 1 HOUR
                  THEN 0 ELSE 1 END AS opens FROM surge),
s AS (SELECT station_id, ts, sum(opens) OVER (PARTITION BY station_id ORDER BY ts) AS segment FROM g)
SELECT station_id, {n('segment', 'segment')}, min(ts) AS "start", max(ts) AS "end", {n('count(*)', 'hours')}
FROM s GROUP BY station_id, segment""")
def _(spark, sf):
    return series.segment_lengths(series.contiguous_segments(views.surge(spark, sf)))


@query("history_array", f"""
WITH w AS (SELECT station_id, ts, surge_m, list(surge_m) OVER h AS past, count(surge_m) OVER h AS known
           FROM surge_dense WINDOW h AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT station_id, ts, {r('past[1]', 'oldest')}, {r('past[6]', 'newest')}, {r('list_sum(past)', 'total')}
FROM w WHERE known = 6 AND surge_m IS NOT NULL""")
def _(spark, sf):
    out = series.history_array(views.surge(spark, sf), 6).where(F.col("history").isNotNull())
    total = F.aggregate("history", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "station_id", "ts", F.get("history", F.lit(0)).alias("oldest"), F.get("history", F.lit(5)).alias("newest"),
        total.alias("total"),
    )


@query("differences", f"""
WITH w AS (SELECT station_id, ts, surge_m, surge_m - lag(surge_m, 1) OVER s AS c1, surge_m - lag(surge_m, 3) OVER s AS c3,
                  surge_m - lag(surge_m, 6) OVER s AS c6 {DENSE})
SELECT station_id, ts, {r('surge_m', 'surge_m')}, {r('c1', 'change_1h')}, {r('c3', 'change_3h')}, {r('c6', 'change_6h')}
FROM w WHERE surge_m IS NOT NULL""")
def _(spark, sf):
    return series.differences(views.surge(spark, sf), (1, 3, 6))


def _integral(hours: int) -> str:
    frame = f"(PARTITION BY station_id ORDER BY ts ROWS BETWEEN {hours - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(surge_m) OVER {frame} = {hours} THEN sum(surge_m) OVER {frame} * 3600 END"


@query("accumulate", f"""
WITH w AS (SELECT station_id, ts, surge_m, {_integral(3)} AS p3, {_integral(6)} AS p6, {_integral(12)} AS p12,
                  {_integral(24)} AS p24 FROM surge_dense)
SELECT station_id, ts, {r('surge_m', 'surge_m')}, {r('p3', 'past_3h')}, {r('p6', 'past_6h')}, {r('p12', 'past_12h')},
       {r('p24', 'past_24h')} FROM w WHERE surge_m IS NOT NULL""")
def _(spark, sf):
    return series.accumulate(views.surge(spark, sf))


@query("future_accumulate", f"""
WITH w AS (SELECT station_id, ts, surge_m, CASE WHEN count(surge_m) OVER f = 6 THEN sum(surge_m) OVER f * 3600 END AS total
           FROM surge_dense WINDOW f AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING))
SELECT station_id, ts, {r('surge_m', 'surge_m')}, {r('total', 'future_sum')} FROM w WHERE surge_m IS NOT NULL""")
def _(spark, sf):
    return series.future_accumulate(views.surge(spark, sf), 6)


@query("future_extremes", f"""
WITH k AS (SELECT a.station_id, a.ts, b.surge_m AS v, epoch(b.ts - a.ts) / 3600 AS lag_h
           FROM surge a JOIN surge b ON b.station_id = a.station_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR),
e AS (SELECT station_id, ts, count(*) AS c, min(v) AS lo, max(v) AS hi FROM k GROUP BY 1, 2),
f AS (SELECT k.station_id, k.ts, min(CASE WHEN v = lo THEN lag_h END) AS lo_at, min(CASE WHEN v = hi THEN lag_h END) AS hi_at
      FROM k JOIN e ON e.station_id = k.station_id AND e.ts = k.ts GROUP BY 1, 2)
SELECT s.station_id, s.ts, {r('s.surge_m', 'surge_m')}, {r('CASE WHEN c = 6 THEN lo END', 'future_min')},
       {n('CASE WHEN c = 6 THEN lo_at END', 'future_min_offset_h')}, {r('CASE WHEN c = 6 THEN hi END', 'future_max')},
       {n('CASE WHEN c = 6 THEN hi_at END', 'future_max_offset_h')}
FROM surge s LEFT JOIN e ON e.station_id = s.station_id AND e.ts = s.ts
LEFT JOIN f ON f.station_id = s.station_id AND f.ts = s.ts""")
def _(spark, sf):
    return series.future_extremes(views.surge(spark, sf), 6, "surge_m", "surge_m")


@query("signed_impulse", f"""
WITH c AS (SELECT station_id, ts, surge_m - 0.5 AS v FROM surge_dense),
w AS (SELECT station_id, ts, v, count(v) OVER f AS k, sum(greatest(v, 0)) OVER f * 3600 AS pos, sum(least(v, 0)) OVER f * 3600 AS neg
      FROM c WINDOW f AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING))
SELECT station_id, ts, {r('v', 'anomaly_m')}, {r('CASE WHEN k = 6 THEN pos END', 'positive_impulse')},
       {r('CASE WHEN k = 6 THEN neg END', 'negative_impulse')} FROM w WHERE v IS NOT NULL""")
def _(spark, sf):
    centred = views.surge(spark, sf).select("station_id", "ts", (F.col("surge_m") - 0.5).alias("anomaly_m"))
    return series.signed_impulse(centred, 6, "anomaly_m")


@query("interpolate_time", f"""
WITH d AS (SELECT station_id, ts, CAST(epoch(ts) / 3600 AS BIGINT) AS h,
                  CASE WHEN CAST(epoch(ts) / 3600 AS BIGINT) % 31 < 19 THEN surge_m END AS v FROM surge_dense),
a AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN h END) OVER (PARTITION BY station_id ORDER BY ts) AS p,
                min(CASE WHEN v IS NOT NULL THEN h END) OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM d),
j AS (SELECT a.*, x.v AS pv, y.v AS qv FROM a LEFT JOIN d x ON x.station_id = a.station_id AND x.h = a.p
      LEFT JOIN d y ON y.station_id = a.station_id AND y.h = a.q)
SELECT station_id, ts, {r('v', 'level_m')},
       {r('coalesce(v, CASE WHEN h - p <= 4 OR q - h <= 4 THEN coalesce(pv + (qv - pv) * ((h - p) / (q - p)), pv, qv) END)', 'filled')}
FROM j WHERE v IS NOT NULL OR h - p <= 4 OR q - h <= 4""")
def _(spark, sf):
    hour = F.floor(F.unix_seconds("ts") / 3600)
    holed = views.surge_dense(spark, sf).select(
        "station_id", "ts", F.when(hour % 31 < 19, F.col("surge_m")).alias("level_m")
    )
    return series.interpolate_time(holed, "level_m", 4, drop_deep=True)


def _acf_sql(trim: bool) -> str:
    cut = "AND a.ts <= m.stop - k.lag_hours * INTERVAL 1 HOUR" if trim else ""
    return f"""
WITH m AS (SELECT station_id, max(ts) AS stop FROM surge GROUP BY 1),
k AS (SELECT unnest(generate_series(0, 168)) AS lag_hours),
p AS (SELECT m.station_id, k.lag_hours, a.surge_m AS x, b.surge_m AS y FROM m CROSS JOIN k
      JOIN surge a ON a.station_id = m.station_id {cut}
      JOIN surge b ON b.station_id = m.station_id AND b.ts = a.ts - k.lag_hours * INTERVAL 1 HOUR)
SELECT station_id, CAST(lag_hours AS BIGINT) AS lag_hours, count(*) AS pair_count,
       CASE WHEN lag_hours = 0 THEN 1.0 ELSE corr(x, y) END AS acf FROM p GROUP BY station_id, lag_hours"""


@query("acf", f"SELECT station_id, lag_hours, {r('acf', 'acf')}, {n('pair_count', 'pair_count')} FROM ({_acf_sql(True)})")
def _(spark, sf):
    return series.acf(views.surge(spark, sf))


@query("acf_full_axis", f"SELECT station_id, lag_hours, {r('acf', 'acf')}, {n('pair_count', 'pair_count')} FROM ({_acf_sql(False)})")
def _(spark, sf):
    return series.acf(views.surge(spark, sf), trim_tail=False)


@query("acf_summary", f"""
SELECT station_id, {', '.join(r(f'max(acf) FILTER (WHERE lag_hours = {k})', f'acf_{k}h') for k in (1, 3, 6, 12, 24, 48, 72))},
       {n('min(lag_hours) FILTER (WHERE lag_hours > 0 AND acf < 0.8)', 'first_below_0_8_h')},
       {n('min(lag_hours) FILTER (WHERE lag_hours > 0 AND acf < 0.5)', 'first_below_0_5_h')},
       {n('min(lag_hours) FILTER (WHERE lag_hours > 0 AND acf < exp(-1))', 'first_below_1_over_e_h')}
FROM ({_acf_sql(True)}) GROUP BY 1""")
def _(spark, sf):
    return series.acf_summary(series.acf(views.surge(spark, sf)))


@query("daily_max", f"SELECT station_id, CAST(ts AS DATE) AS day, {r('max(surge_m)', 'daily_max')} FROM surge GROUP BY 1, 2")
def _(spark, sf):
    return series.daily_max(views.surge(spark, sf))


@query("daily_max_orders", f"SELECT station_id, CAST(ts AS DATE) AS day, {r('max(surge_m)', 'daily_max')} FROM surge_daily GROUP BY 1, 2")
def _(spark, sf):
    return series.daily_max(views.surge_daily(spark, sf))


# --- residual diagnostics of every model and lead -----------------------------------------------

RES = """(SELECT station_id || '-' || model || '-' || lead_hours AS station_id, origin AS ts, (predicted_m - observed_m) * 100 AS e, observed_m, predicted_m
FROM forecasts)"""


def _residuals(spark, sf):
    series = F.concat_ws("-", "station_id", "model", F.col("lead_hours").cast("string"))
    return residuals.residuals(views.forecasts(spark, sf).withColumn("station_id", series).withColumnRenamed("origin", "ts"))


@query("residual_acf", f"""
WITH l AS (SELECT station_id, e, lag(e, 1) OVER w AS l1, lag(e, 24) OVER w AS l24 FROM {RES}
           WINDOW w AS (PARTITION BY station_id ORDER BY ts))
SELECT station_id, {r('corr(e, l1)', 'r_lag_1')}, {r('corr(e, l24)', 'r_lag_24')} FROM l GROUP BY 1""")
def _(spark, sf):
    return series.lagged_correlation(_residuals(spark, sf), (1, 24), "residual")


@query("residual_stats", f"""
WITH l AS (SELECT station_id, e, lag(e, 1) OVER w AS l1, lag(e, 24) OVER w AS l24 FROM {RES}
           WINDOW w AS (PARTITION BY station_id ORDER BY ts)),
m AS (SELECT *, avg(e) OVER (PARTITION BY station_id) AS mu FROM l)
SELECT station_id, {n('count(e)', 'n')}, {r('avg(e)', 'mean_error')}, {r('median(e)', 'median_error')},
       {r('stddev_samp(e)', 'standard_deviation')}, {r('avg((e - mu)**3) / avg((e - mu)**2)**1.5', 'skewness')},
       {r('avg((e - mu)**4) / avg((e - mu)**2)**2 - 3', 'kurtosis')}, {r('corr(e, l1)', 'r_lag_1')}, {r('corr(e, l24)', 'r_lag_24')}
FROM m GROUP BY 1""")
def _(spark, sf):
    return residuals.residual_stats(_residuals(spark, sf), ["station_id"])


@query("residual_stats_unbiased", f"""
WITH m AS (SELECT station_id, ts, e, e - avg(e) OVER (PARTITION BY station_id) AS d FROM {RES}),
l AS (SELECT *, lag(d, 1) OVER w AS l1, lag(d, 24) OVER w AS l24 FROM m WINDOW w AS (PARTITION BY station_id ORDER BY ts))
SELECT station_id, {n('count(e)', 'n')}, {r('avg(e)', 'mean_error')}, {r('stddev_samp(e)', 'standard_deviation')},
       {r('skewness(e)', 'skewness')}, {r('kurtosis(e)', 'kurtosis')},
       {r('sum(d * l1) / sum(d * d)', 'acf_lag_1')}, {r('sum(d * l24) / sum(d * d)', 'acf_lag_24')}
FROM l GROUP BY 1""")
def _(spark, sf):
    return residuals.residual_stats_unbiased(_residuals(spark, sf), ["station_id"])


@query("histogram", f"""
WITH s AS (SELECT station_id, least(25, greatest(6, floor(sqrt(count(e))))) AS bins, min(e) AS lo, max(e) AS hi FROM {RES} GROUP BY 1),
b AS (SELECT x.station_id, bins, lo, hi, least(bins - 1, floor((e - lo) / ((hi - lo) / bins))) AS bin
      FROM {RES} x JOIN s ON s.station_id = x.station_id)
SELECT station_id, {n('bins', 'bins')}, {n('bin', 'bin')}, {r('lo + bin * ((hi - lo) / bins)', 'bin_start')},
       {r('lo + (bin + 1) * ((hi - lo) / bins)', 'bin_end')}, {n('count(*)', 'count')}
FROM b GROUP BY station_id, bins, bin, lo, hi""")
def _(spark, sf):
    return residuals.histogram(_residuals(spark, sf), ["station_id"])


@query("bin_counts_2d", f"""
SELECT station_id, {n('floor(observed_m / 0.05)', 'x_bin')}, {n('floor(predicted_m / 0.05)', 'y_bin')}, {n('count(*)', 'count')}
FROM {RES} GROUP BY station_id, floor(observed_m / 0.05), floor(predicted_m / 0.05)""")
def _(spark, sf):
    return residuals.bin_counts_2d(_residuals(spark, sf), ["station_id"])


@query("qq_points", f"""
SELECT station_id, ts, {n('row_number() OVER (PARTITION BY station_id ORDER BY e, ts)', 'rank')}, {r('e', 'sample')},
       round(avg(e) OVER (PARTITION BY station_id), 6) + 0.0 AS mean FROM {RES}""")
def _(spark, sf):
    # the theoretical quantile has no SQL twin; the test suite checks it against the exact inverse
    points = residuals.qq_points(_residuals(spark, sf), ["station_id"], ["ts"])
    mean = points.groupBy("station_id").agg(F.avg("sample").alias("mean"))
    return points.join(mean, "station_id").select("station_id", "ts", "rank", "sample", "mean")
