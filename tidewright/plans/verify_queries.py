"""Verification queries over the forecast view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.blocks import hour_number
from tidewright.operators import baselines, series, verify
from tidewright.plans import views
from tidewright.plans.registry import n, query, r


def score_sql(relative_to: str = "mean_abs", where: str | None = None, prefix: str = "", only: tuple = ()) -> str:
    """Score columns in SQL over ``observed_m`` / ``predicted_m``."""
    f = f" FILTER (WHERE {where})" if where else ""
    e = "(predicted_m - observed_m)"
    rmse = f"sqrt(avg({e} ** 2){f})"
    denominator = {
        "mean_abs": f"avg(abs(observed_m)){f}",
        "range": f"(max(observed_m){f} - min(observed_m){f})",
        "rms": f"sqrt(avg(observed_m ** 2){f})",
    }[relative_to]
    items = {
        "n": n(f"count({e}){f}", f"{prefix}n"),
        "pearson_r": r(f"CASE WHEN count({e}){f} >= 2 THEN covar_pop(observed_m, predicted_m){f} / nullif(stddev_pop(observed_m){f} * stddev_pop(predicted_m){f}, 0) END", f"{prefix}pearson_r"),
        "r2": r(f"1 - avg({e} ** 2){f} / nullif(var_pop(observed_m){f}, 0)", f"{prefix}r2"),
        "rmse_cm": r(f"{rmse} * 100", f"{prefix}rmse_cm"),
        "mae_cm": r(f"avg(abs({e})){f} * 100", f"{prefix}mae_cm"),
        "bias_cm": r(f"avg({e}){f} * 100", f"{prefix}bias_cm"),
        "rrmse_percent": r(f"{rmse} / nullif({denominator}, 0) * 100", f"{prefix}rrmse_percent"),
    }
    return ", ".join(v for k, v in items.items() if not only or k in only)


RMSE_ONLY = ("n", "rmse_cm")
GROUP = ["station_id", "lead_hours", "model"]

views.SQL["metrics"] = f"""
WITH t AS (SELECT station_id, lead_hours, quantile_cont(abs(observed_m), 0.95) AS top,
                  quantile_cont(observed_m - prior_m, 0.9) FILTER (WHERE observed_m - prior_m > 0) AS fast
           FROM forecasts WHERE model = 'persistence' GROUP BY 1, 2),
j AS (SELECT f.*, t.top, t.fast FROM forecasts f JOIN t ON t.station_id = f.station_id AND t.lead_hours = f.lead_hours),
s AS (SELECT station_id, lead_hours, model, avg((predicted_m - observed_m) ** 2) AS mse, {score_sql()},
             {score_sql(where='abs(observed_m) >= top', prefix='top5_', only=RMSE_ONLY)},
             {score_sql(where='observed_m - prior_m >= fast', prefix='rapid_rise_', only=RMSE_ONLY)},
             {r('max(top) * 100', 'top5_threshold_cm')}, {r('max(fast) * 100', 'rapid_rise_threshold_cm_per_hour')}
      FROM j GROUP BY station_id, lead_hours, model)
SELECT s.* EXCLUDE (mse), {r('1 - s.mse / nullif(b.mse, 0)', 'skill_vs_reference')}
FROM s JOIN s b ON b.station_id = s.station_id AND b.lead_hours = s.lead_hours AND b.model = 'persistence'"""


def metrics(spark, sf):
    return verify.verify_by_lead(views.forecasts(spark, sf), "persistence")


@query("verify_by_lead", "SELECT * FROM metrics")
def _(spark, sf):
    return metrics(spark, sf)


@query("baseline_persistence", f"""
SELECT station_id, origin, lead_hours, valid_time, {r('observed_m', 'observed_m')}, {r('prior_m', 'prior_m')}, model,
       {r('predicted_m', 'predicted_m')} FROM forecasts WHERE model = 'persistence'
UNION ALL
SELECT station_id, origin, lead_hours, valid_time, {r('observed_m', 'observed_m')}, {r('prior_m', 'prior_m')}, 'zero', 0.0
FROM forecasts WHERE model = 'persistence'""")
def _(spark, sf):
    return baselines.baseline_forecasts(views.surge(spark, sf), views.LEADS, 3)


@query("verify", f"SELECT station_id, lead_hours, model, {score_sql()} FROM forecasts GROUP BY ALL")
def _(spark, sf):
    return verify.verify(views.forecasts(spark, sf), GROUP)


@query("verify_range", f"SELECT station_id, lead_hours, model, {score_sql('range')} FROM forecasts GROUP BY ALL")
def _(spark, sf):
    return verify.verify(views.forecasts(spark, sf), GROUP, "range")


@query("verify_rms", f"SELECT station_id, lead_hours, model, {score_sql('rms')} FROM forecasts GROUP BY ALL")
def _(spark, sf):
    return verify.verify(views.forecasts(spark, sf), GROUP, "rms")


@query("subset_verify", f"""
SELECT station_id, lead_hours, model, {score_sql(where='observed_m >= 0.6')}, CAST(60 AS DOUBLE) AS threshold_cm
FROM forecasts GROUP BY station_id, lead_hours, model""")
def _(spark, sf):
    return verify.subset_verify(views.forecasts(spark, sf), GROUP, F.col("observed_m") >= 0.6, F.lit(0.6))


@query("extreme_verify", f"""
WITH t AS (SELECT station_id, lead_hours, model, p.subset, quantile_cont(abs(observed_m), 0.90) AS t90, quantile_cont(abs(observed_m), 0.95) AS t95
           FROM forecasts, (VALUES ('top_absolute_10_percent'), ('top_absolute_5_percent')) p(subset) GROUP BY ALL),
j AS (SELECT f.*, t.subset, CASE WHEN t.subset = 'top_absolute_10_percent' THEN t90 ELSE t95 END AS lim
      FROM forecasts f JOIN t ON t.station_id = f.station_id AND t.lead_hours = f.lead_hours AND t.model = f.model)
SELECT station_id, lead_hours, model, subset, {score_sql()}, {r('max(lim) * 100', 'threshold_cm')}
FROM j WHERE abs(observed_m) >= lim GROUP BY station_id, lead_hours, model, subset""")
def _(spark, sf):
    return verify.extreme_verify(views.forecasts(spark, sf), GROUP)


@query("rapid_rise_verify", f"""
WITH o AS (SELECT station_id, model, lead_hours, valid_time AS ts, observed_m, predicted_m FROM forecasts),
x AS (SELECT a.*, a.observed_m - b.observed_m AS rise FROM o a LEFT JOIN o b
      ON b.station_id = a.station_id AND b.model = a.model AND b.lead_hours = a.lead_hours AND b.ts = a.ts - INTERVAL 1 HOUR),
t AS (SELECT station_id, model, lead_hours, quantile_cont(rise, 0.9) FILTER (WHERE rise > 0) AS lim FROM x GROUP BY 1, 2, 3),
j AS (SELECT x.*, t.lim FROM x JOIN t ON t.station_id = x.station_id AND t.model = x.model AND t.lead_hours = x.lead_hours)
SELECT station_id, model, lead_hours, {score_sql(where='rise >= lim')}, {r('max(lim) * 100', 'threshold_cm')}
FROM j GROUP BY station_id, model, lead_hours""")
def _(spark, sf):
    one = views.forecasts(spark, sf).withColumnRenamed("valid_time", "ts")
    return verify.rapid_rise_verify(one, ["station_id", "model", "lead_hours"])


def _thresholds_sql(cut: str) -> str:
    return f"""
SELECT station_id, lead_hours, {r(f"quantile_cont(abs(observed_m), 0.95) FILTER (WHERE {cut})", 'absolute_top5_m')},
       {r(f"coalesce(quantile_cont(observed_m, 0.95) FILTER (WHERE {cut} AND observed_m > 0), 'infinity')", 'positive_top5_m')},
       {r(f"coalesce(quantile_cont(observed_m - prior_m, 0.9) FILTER (WHERE {cut} AND observed_m > prior_m), 'infinity')", 'rapid_rise_m')}
FROM forecasts WHERE model = 'persistence' GROUP BY 1, 2"""


@query("train_thresholds", _thresholds_sql("year(origin) <= 2024"))
def _(spark, sf):
    one = views.forecasts(spark, sf).where(F.col("model") == "persistence")
    return verify.train_thresholds(one, 2024)


@query("verify_by_forcing", f"""
WITH w AS (SELECT ts AS origin, sqrt(avg(value) FILTER (WHERE variable = 'U10') ** 2 + avg(value) FILTER (WHERE variable = 'V10') ** 2) AS wind
           FROM field GROUP BY 1),
j AS (SELECT f.*, w.wind FROM forecasts f JOIN w ON w.origin = f.origin),
t AS (SELECT station_id, lead_hours, quantile_cont(wind, 0.75) AS lim FROM j
      WHERE model = 'persistence' AND day(origin) <= 20 GROUP BY 1, 2),
g AS (SELECT j.*, t.lim, CASE WHEN wind >= lim THEN 'strong' ELSE 'calm' END AS forcing_group
      FROM j JOIN t ON t.station_id = j.station_id AND t.lead_hours = j.lead_hours)
SELECT station_id, lead_hours, model, forcing_group, {score_sql()}, {r('max(lim)', 'forcing_threshold')}
FROM g GROUP BY station_id, lead_hours, model, forcing_group""")
def _(spark, sf):
    value = F.col("value")
    mean = {v: F.avg(F.when(F.col("variable") == v, value)) for v in ("U10", "V10")}
    wind = views.field(spark, sf).groupBy(F.col("ts").alias("origin")).agg(
        F.sqrt(mean["U10"] * mean["U10"] + mean["V10"] * mean["V10"]).alias("wind")
    )
    joined = views.forecasts(spark, sf).join(wind, "origin")
    return verify.verify_by_forcing(joined, "wind", F.dayofmonth("origin") <= 20)


@query("peak_verify", f"""
WITH p AS (SELECT unnest([90.0, 95.0, 99.0]) AS percentile),
t AS (SELECT station_id, lead_hours, model, quantile_cont(observed_m, 0.9) AS t90, quantile_cont(observed_m, 0.95) AS t95,
             quantile_cont(observed_m, 0.99) AS t99 FROM forecasts GROUP BY 1, 2, 3),
j AS (SELECT f.*, CAST(p.percentile AS DOUBLE) AS percentile, CASE WHEN p.percentile = 90 THEN t90 WHEN p.percentile = 95 THEN t95 ELSE t99 END AS lim
      FROM forecasts f JOIN t ON t.station_id = f.station_id AND t.lead_hours = f.lead_hours AND t.model = f.model CROSS JOIN p)
SELECT station_id, lead_hours, model, percentile, {r('max(lim) * 100', 'threshold_cm')}, {n('count(*)', 'n_peak')},
       {r('sqrt(avg((predicted_m - observed_m) ** 2)) * 100', 'peak_rmse_cm')}, {r('avg(abs(predicted_m - observed_m)) * 100', 'peak_mae_cm')},
       {r('avg(predicted_m - observed_m) * 100', 'peak_bias_cm')},
       {r('avg(CASE WHEN predicted_m < observed_m THEN 1.0 ELSE 0.0 END)', 'underestimation_ratio')},
       {r('CASE WHEN count(*) >= 2 THEN covar_pop(observed_m, predicted_m) / nullif(stddev_pop(observed_m) * stddev_pop(predicted_m), 0) END', 'peak_correlation')}
FROM j WHERE observed_m >= lim GROUP BY station_id, lead_hours, model, percentile""")
def _(spark, sf):
    return verify.peak_verify(views.forecasts(spark, sf), GROUP)


@query("event_verify", f"""
SELECT station_id || '-' || model || '-' || lead_hours || '-' || strftime(valid_time, '%Y%m%d') AS event_id, {n('count(*)', 'n')},
       {r('sqrt(avg((predicted_m - observed_m) ** 2)) * 100', 'rmse_cm')}, {r('avg(abs(predicted_m - observed_m)) * 100', 'mae_cm')},
       {r('avg(predicted_m - observed_m) * 100', 'bias_cm')} FROM forecasts GROUP BY 1""")
def _(spark, sf):
    event = F.concat_ws("-", "station_id", "model", F.col("lead_hours").cast("string"), F.date_format("valid_time", "yyyyMMdd"))
    return verify.event_verify(views.forecasts(spark, sf).withColumn("event_id", event))


@query("series_scale", f"""
SELECT station_id, {n('count(surge_m)', 'n')}, {r('avg(surge_m * 100)', 'mean_cm')}, {r('stddev_pop(surge_m * 100)', 'std_cm')},
       {r('avg(abs(surge_m * 100))', 'mean_absolute_cm')}, {r('min(surge_m * 100)', 'min_cm')}, {r('max(surge_m * 100)', 'max_cm')},
       {r('max(abs(surge_m * 100))', 'max_absolute_cm')}, {r('quantile_cont(abs(surge_m * 100), 0.9)', 'p90_absolute_cm')},
       {r('quantile_cont(abs(surge_m * 100), 0.95)', 'p95_absolute_cm')}, {r('quantile_cont(abs(surge_m * 100), 0.99)', 'p99_absolute_cm')}
FROM surge GROUP BY 1""")
def _(spark, sf):
    return verify.series_scale(views.surge(spark, sf))


@query("ensemble_verify", f"""
WITH m AS (SELECT station_id, lead_hours, origin, max(observed_m) AS observed_m, avg(predicted_m) AS predicted_m FROM forecasts GROUP BY 1, 2, 3),
t AS (SELECT station_id, lead_hours, quantile_cont(observed_m, 0.95) AS lim FROM m GROUP BY 1, 2),
j AS (SELECT m.*, 'all' AS subset FROM m UNION ALL
      SELECT m.*, 'top' FROM m JOIN t ON t.station_id = m.station_id AND t.lead_hours = m.lead_hours WHERE m.observed_m >= t.lim)
SELECT station_id, lead_hours, subset, {score_sql('range')} FROM j GROUP BY station_id, lead_hours, subset""")
def _(spark, sf):
    return verify.ensemble_verify(
        views.forecasts(spark, sf), ["station_id", "lead_hours", "origin"], ["station_id", "lead_hours"]
    )


@query("cumulative_error", f"""
SELECT station_id, origin, model, lead_hours,
       round(sqrt(avg((predicted_m - observed_m) ** 2) OVER w) * 100, 6) + 0.0 AS cumulative_rmse_cm,
       round(avg(abs(predicted_m - observed_m)) OVER w * 100, 6) + 0.0 AS cumulative_mae_cm,
       round(sum(abs(predicted_m - observed_m)) OVER w * 100, 6) + 0.0 AS cumulative_abs_error_cm
FROM forecasts WINDOW w AS (PARTITION BY station_id, origin, model ORDER BY lead_hours)""")
def _(spark, sf):
    out = verify.cumulative_error(views.forecasts(spark, sf), ["station_id", "origin", "model"])
    return out.select("station_id", "origin", "model", "lead_hours", "cumulative_rmse_cm", "cumulative_mae_cm", "cumulative_abs_error_cm")
