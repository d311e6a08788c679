"""Queries that fit a one-step model with all weather columns, roll it 72 hours, and compare it with direct forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import align, compare, field, linear, rollout, series
from tidewright.plans import views
from tidewright.plans.elimination import solve_sql
from tidewright.plans.registry import n, query, r
from tidewright.plans.sample_queries import WEATHER

HOURS = 3
SEA_LEVEL = 101325.0  # pressures count from here before anything is averaged, so that sums keep their digits
_WIDTH = HOURS * len(WEATHER) + HOURS


def _hours(spark, sf):
    """Levels of each station and of all together on a dense axis, with the weather of the hour."""
    levels = series.hourly_grid(views.surge(spark, sf).unionByName(views.surge_all(spark, sf))).select("station_id", "ts", "surge_m")
    cells = views.field(spark, sf).withColumn("value", F.col("value") - F.when(F.col("variable") == "MSL", F.lit(SEA_LEVEL)).otherwise(F.lit(0.0)))
    return levels.join(field.spatial_summary(cells).select("ts", *WEATHER), "ts", "left")


def _models(hours):
    day = F.dayofmonth("origin")
    return rollout.fit_step_model(rollout.step_samples(hours, WEATHER, HOURS), _WIDTH, day <= 15, day.between(16, 25))


def _rolled(spark, sf, leads: int):
    hours = _hours(spark, sf)
    return rollout.rollout(hours, _models(hours), WEATHER, HOURS, leads)


_FUNCTION = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}
_VALUES = ", ".join(f"{_FUNCTION[c.split('_')[1]]}(value) FILTER (WHERE variable = '{c.split('_')[0].upper()}')" for c in WEATHER)
_ALPHAS = "(VALUES " + ", ".join(f"({a}::DOUBLE)" for a in linear.ALPHAS) + ") a(alpha)"
views.SQL["roll_levels"] = "SELECT station_id, ts, surge_m FROM surge UNION ALL SELECT station_id, ts, surge_m FROM surge_all"
views.SQL["roll_axis"] = "SELECT station_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM roll_levels GROUP BY 1"
views.SQL["roll_weather"] = f"SELECT ts, unnest(range({len(WEATHER)})) AS c, unnest([{_VALUES}]) AS u FROM (SELECT ts, variable, value - CASE WHEN variable = 'MSL' THEN {SEA_LEVEL} ELSE 0 END AS value FROM field) GROUP BY ts"
views.SQL["step_inputs"] = f"""
SELECT * FROM (SELECT *, count(x) OVER (PARTITION BY station_id, ts) AS known FROM (
  SELECT a.station_id, a.ts, (hour * {len(WEATHER)} + c) AS i, u AS x FROM roll_axis a, range({HOURS}) h(hour), roll_weather w WHERE w.ts = a.ts + (hour - {HOURS}) * INTERVAL 1 HOUR
  UNION ALL SELECT a.station_id, a.ts, {HOURS * len(WEATHER)} + hour, surge_m FROM roll_axis a, range({HOURS}) h(hour), roll_levels l
            WHERE l.station_id = a.station_id AND l.ts = a.ts + (hour - {HOURS}) * INTERVAL 1 HOUR))"""
# ridge on standardised columns: early rows for every penalty, the penalty of least error on later rows, both for the result
_FITTED = f"""
WITH RECURSIVE sample AS (SELECT s.station_id, s.ts, s.i, s.x, l.surge_m AS y FROM step_inputs s JOIN roll_levels l ON l.station_id = s.station_id AND l.ts = s.ts WHERE known = {_WIDTH} AND surge_m IS NOT NULL),
part AS (SELECT 'early' AS part, * FROM sample WHERE day(ts) <= 15 UNION ALL SELECT 'both', * FROM sample WHERE day(ts) <= 25),
moment AS (SELECT station_id, part, i, avg(x) AS m, CASE WHEN stddev_pop(x) <= 1e-12 * greatest(1, abs(avg(x))) THEN 1 ELSE stddev_pop(x) END AS s, avg(y) AS my, count(*) AS rows FROM part GROUP BY 1, 2, 3),
scaled AS (SELECT p.station_id, p.part, p.ts, p.i, (x - m) / s AS z FROM part p JOIN moment q ON q.station_id = p.station_id AND q.part = p.part AND q.i = p.i
  UNION ALL SELECT p.station_id, p.part, p.ts, {_WIDTH}, y - my FROM part p JOIN moment q ON q.station_id = p.station_id AND q.part = p.part AND q.i = 0 WHERE p.i = 0),
product AS (SELECT a.station_id, a.part, a.i, b.i AS j, sum(a.z * b.z) AS v FROM scaled a JOIN scaled b ON b.station_id = a.station_id AND b.part = a.part AND b.ts = a.ts WHERE a.i < {_WIDTH} GROUP BY ALL),
penalised AS (SELECT station_id, part, alpha, i, j, v + CASE WHEN i = j THEN alpha ELSE 0 END AS v FROM product, {_ALPHAS}),
{solve_sql('penalised', 'station_id, part, alpha', _WIDTH)},
weight AS (SELECT s.station_id, s.part, alpha, s.i, w / q.s AS w, my - sum(w / q.s * m) OVER (PARTITION BY s.station_id, s.part, alpha) AS b, rows
           FROM solved s JOIN moment q ON q.station_id = s.station_id AND q.part = s.part AND q.i = s.i),
missed AS (SELECT p.station_id, p.ts, alpha, (max(b) + sum(w * x) - max(y)) ** 2 AS e FROM sample p JOIN weight w ON w.station_id = p.station_id AND w.part = 'early' AND w.i = p.i WHERE day(p.ts) BETWEEN 16 AND 25 GROUP BY ALL),
scored AS (SELECT station_id, alpha, avg(e) AS mse FROM missed GROUP BY 1, 2),
best AS (SELECT station_id, arg_min(alpha, (round(mse, 12), alpha)) AS alpha, min(mse) AS mse FROM scored GROUP BY 1),
model AS (SELECT w.station_id, w.alpha, w.i, w.w, w.b, w.rows, sqrt(mse) AS tuning FROM weight w LEFT JOIN best t ON t.station_id = w.station_id WHERE part = 'both' AND w.alpha = coalesce(t.alpha, {linear.DEFAULT_ALPHA}))"""


def _rolled_sql(leads: int) -> str:
    return _FITTED + f""",
force AS (SELECT s.station_id, s.ts, max(b) + sum(w * x) AS f FROM step_inputs s JOIN model m ON m.station_id = s.station_id AND m.i = s.i WHERE s.i < {_WIDTH - HOURS} GROUP BY 1, 2 HAVING count(x) = {_WIDTH - HOURS}),
start AS (SELECT station_id, ts, {', '.join(f'max(x) FILTER (WHERE i = {_WIDTH - HOURS + k}) AS l{k}' for k in range(HOURS))} FROM step_inputs WHERE i >= {_WIDTH - HOURS} GROUP BY 1, 2 HAVING count(x) = {HOURS}),
able AS (SELECT station_id, ts, count(*) OVER (PARTITION BY station_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL {leads - 1} HOUR FOLLOWING) AS ahead FROM force),
carry AS (SELECT station_id, {', '.join(f'max(w) FILTER (WHERE i = {_WIDTH - HOURS + k}) AS a{k}' for k in range(HOURS))} FROM model GROUP BY 1),
roll AS (SELECT s.station_id, s.ts AS origin, 0 AS lead_hours, l0, l1, l2 FROM start s JOIN able a ON a.station_id = s.station_id AND a.ts = s.ts AND ahead = {leads}
  UNION ALL SELECT q.station_id, origin, lead_hours + 1, l1, l2, f + a0 * l0 + a1 * l1 + a2 * l2 FROM roll q JOIN carry c ON c.station_id = q.station_id
  JOIN force f ON f.station_id = q.station_id AND f.ts = origin + lead_hours * INTERVAL 1 HOUR WHERE lead_hours < {leads}),
rolled AS (SELECT q.station_id, origin, lead_hours, l2 AS predicted_m, surge_m AS observed_m FROM roll q LEFT JOIN roll_levels l ON l.station_id = q.station_id AND l.ts = origin + (lead_hours - 1) * INTERVAL 1 HOUR WHERE lead_hours > 0)"""


@query("ridge_select_weather", f"""{_FITTED}
SELECT station_id, {r('alpha', 'alpha')}, {n('i', 'position')}, {r('w', 'coefficient')}, {r('b', 'intercept')}, {r('tuning', 'tuning_rmse')}, {n('rows', 'train_rows')} FROM model""")
def _(spark, sf):
    return _models(_hours(spark, sf)).select(
        "station_id", "alpha", F.posexplode("coefficients").alias("position", "coefficient"), "intercept", "tuning_rmse", "train_rows")


@query("recursive_linear", f"{_rolled_sql(72)} SELECT station_id, origin, {n('lead_hours', 'lead_hours')}, {r('predicted_m', 'predicted_m')} FROM rolled")
def _(spark, sf):
    return rollout.lead_rows(_rolled(spark, sf, 72)).select("station_id", "origin", "lead_hours", "predicted_m")


@query("recursive_from", f"""{_rolled_sql(72)},
whole AS (SELECT station_id, min(origin) AS origin FROM (SELECT station_id, origin FROM rolled GROUP BY 1, 2 HAVING count(observed_m) = 72) GROUP BY 1)
SELECT d.station_id, d.origin, {n('lead_hours', 'lead_hours')}, {r('predicted_m', 'predicted_m')}, {r('observed_m', 'observed_m')}, {r('(predicted_m - observed_m) * 100', 'error_cm')},
       {r('abs(predicted_m - observed_m) * 100', 'absolute_error_cm')} FROM rolled d JOIN whole w ON w.station_id = d.station_id AND w.origin = d.origin""")
def _(spark, sf):
    whole = _rolled(spark, sf, 72).where(~F.exists("targets", lambda x: x.isNull()))
    first = whole.groupBy("station_id").agg(F.min_by(F.struct("origin", "predictions", "targets"), "origin").alias("_first")).select("station_id", "_first.*")
    return rollout.lead_rows(first, strict=True)


def _compared(spark, sf):
    """Direct forecasts against the fitted model rolled from the hour after their origin."""
    rolling = rollout.lead_rows(_rolled(spark, sf, max(views.LEADS))).where(F.col("lead_hours").isin(*views.LEADS) & F.col("observed_m").isNotNull())
    return align.direct_vs_recursive(views.forecasts(spark, sf), rolling.withColumn("model", F.lit("ridge")))


_COMPARED = f"""{_rolled_sql(max(views.LEADS))},
pair AS (SELECT f.station_id, f.lead_hours, f.origin, 'direct_' || f.model AS method, f.observed_m, f.predicted_m, d.predicted_m AS rolled_m FROM forecasts f
  JOIN rolled d ON d.station_id = f.station_id AND d.lead_hours = f.lead_hours AND d.origin = f.origin + INTERVAL 1 HOUR),
score AS (SELECT station_id, lead_hours, method, count(*) AS valid_samples, sqrt(avg(((predicted_m - observed_m) * 100) ** 2)) AS rmse_cm FROM (SELECT * FROM pair
  UNION ALL SELECT station_id, lead_hours, origin, 'rolling_ridge', observed_m, rolled_m, rolled_m FROM pair WHERE method = 'direct_persistence') GROUP BY 1, 2, 3)"""


@query("direct_vs_recursive", f"{_COMPARED} SELECT station_id, {n('lead_hours', 'lead_hours')}, method, {n('valid_samples', 'valid_samples')}, {r('rmse_cm', 'rmse_cm')} FROM score")
def _(spark, sf):
    return _compared(spark, sf)


_CHANGES = tuple((f"rolling_over_{m}", f"direct_{m}", "rolling_ridge") for m in ("persistence", "mean3", "damped"))


@query("method_change", f"""{_COMPARED}
SELECT a.station_id, {n('a.lead_hours', 'lead_hours')}, p.comparison, {r('b.rmse_cm', 'direct_rmse_cm')}, {r('a.rmse_cm', 'rolling_rmse_cm')}, {r('100 * (a.rmse_cm / b.rmse_cm - 1)', 'rolling_minus_direct_percent')}
FROM score a JOIN (VALUES {', '.join(map(str, _CHANGES))}) p(comparison, reference_model, model) ON p.model = a.method
JOIN score b ON b.station_id = a.station_id AND b.lead_hours = a.lead_hours AND b.method = p.reference_model""")
def _(spark, sf):
    scores = _compared(spark, sf).withColumnRenamed("method", "model")
    return compare.method_change(scores, compare.pair_table(spark, _CHANGES), views.LEADS)
