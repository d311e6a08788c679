"""Queries fitting and rolling linear models, the tide and the bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import bootstrap, linear, samples, tide, trees
from tidewright.plans import views
from tidewright.plans.elimination import solve_sql
from tidewright.plans.registry import n, query, r

# samples: direct origins with 3 hours of history; one feature = the level at the origin
views.SQL["ar_samples"] = "SELECT station_id, origin, lead_hours, observed_m AS y, b.x FROM forecasts JOIN (SELECT station_id AS sid, origin AS oo, predicted_m AS x FROM forecasts WHERE model = 'persistence' AND lead_hours = 1) b ON b.sid = station_id AND b.oo = origin WHERE model = 'persistence'"
LEADS = views.LEADS


def _samples(spark, sf, width: int = 3):
    matrix = samples.feature_matrix(views.surge(spark, sf), [], 3, 6, mode="none")
    labels = F.array(*[F.get("labels", F.lit(k - 1)) for k in LEADS])
    return matrix.withColumns({"labels": labels, "features": F.slice("features", 4 - width, width)})


def _ridge_sql(alpha: str, rows: str, by: str = "station_id, lead_hours") -> str:
    """One-feature ridge: slope = n cov / sd^2 / (n + alpha)."""
    return f"SELECT {by}, count(*) AS k, count(*) * covar_pop(x, y) / var_pop(x) / (count(*) + {alpha}) AS slope, avg(y) AS my, avg(x) AS mx FROM {rows} GROUP BY ALL"


@query("ridge_fit", f"SELECT station_id, lead_hours, {r('slope', 'slope')}, {r('my - slope * mx', 'intercept')}, {n('k', 'train_rows')} FROM ({_ridge_sql('50', 'ar_samples')})")
def _(spark, sf):
    models = linear.ridge_fit(_samples(spark, sf, 1), ["station_id"], LEADS, 50.0)
    return models.select("station_id", "lead_hours", F.get("coefficients", F.lit(0)).alias("slope"), "intercept", "train_rows")


@query("ridge_predict", f"""
WITH m AS ({_ridge_sql('50', 'ar_samples')})
SELECT s.station_id, s.origin, s.lead_hours, {r('my - slope * mx + slope * x', 'predicted_m')} FROM ar_samples s JOIN m ON m.station_id = s.station_id AND m.lead_hours = s.lead_hours""")
def _(spark, sf):
    rows = _samples(spark, sf, 1)
    models = linear.ridge_fit(rows, ["station_id"], LEADS, 50.0)
    return linear.predict(rows.drop("labels"), models, ["station_id"])


_ALPHA_LIST = "(VALUES " + ", ".join(f"({a}::DOUBLE, {i})" for i, a in enumerate(linear.ALPHAS)) + ") a(alpha, place)"


@query("ridge_select", f"""
WITH e AS (SELECT station_id, lead_hours, count(*) AS k, covar_pop(x, y) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM ar_samples WHERE day(origin) <= 15 GROUP BY 1, 2),
s AS (SELECT t.station_id, t.lead_hours, a.alpha, a.place, avg((my + k * c / v / (k + alpha) * (x - mx) - y) ** 2) AS mse
      FROM ar_samples t JOIN e ON e.station_id = t.station_id AND e.lead_hours = t.lead_hours, {_ALPHA_LIST} WHERE day(origin) BETWEEN 16 AND 31 GROUP BY ALL),
b AS (SELECT station_id, lead_hours, arg_min(alpha, (round(mse, 12), alpha)) AS alpha, min(mse) AS mse FROM s GROUP BY 1, 2),
f AS (SELECT station_id, lead_hours, count(*) AS k, covar_pop(x, y) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM ar_samples WHERE day(origin) <= 31 GROUP BY 1, 2)
SELECT f.station_id, f.lead_hours, {r('alpha', 'alpha')}, {r('k * c / v / (k + alpha)', 'slope')}, {r('my - k * c / v / (k + alpha) * mx', 'intercept')}, {r('sqrt(mse)', 'tuning_rmse')}, {n('k', 'train_rows')}
FROM f JOIN b ON b.station_id = f.station_id AND b.lead_hours = f.lead_hours""")
def _(spark, sf):
    day = F.dayofmonth("origin")
    models = linear.ridge_select(_samples(spark, sf, 1), ["station_id"], LEADS, day <= 15, day.between(16, 31))
    return models.select("station_id", "lead_hours", "alpha", F.get("coefficients", F.lit(0)).alias("slope"), "intercept", "tuning_rmse", "train_rows")


@query("ridge_family")
def _(spark, sf):
    day = F.dayofmonth("origin")
    groups = {"last": [2], "last_two": [1, 2], "history": [0, 1, 2]}
    models = linear.ridge_select(_samples(spark, sf), ["station_id"], LEADS, day <= 15, day.between(16, 31), groups=groups)
    coefficients = [F.get("coefficients", F.lit(i)).alias(f"w{i}") for i in range(3)]
    return models.select("station_id", "family", "lead_hours", "alpha", *coefficients, "intercept", "tuning_rmse")


_ONE = "(SELECT station_id, origin, lead_hours, observed_m AS y, {x} AS x, '{f}' AS family FROM roll_samples)"
views.SQL["roll_samples"] = """
SELECT f.station_id, f.origin, f.lead_hours, f.observed_m, d.b0, d.b1 FROM forecasts f
JOIN (SELECT station_id, ts, surge_m AS b0, lag(surge_m, 1) OVER (PARTITION BY station_id ORDER BY ts) AS b1 FROM surge_dense) d ON d.station_id = f.station_id AND d.ts = f.origin
WHERE f.model = 'persistence'"""
_FAMILIES = "(" + _ONE.format(x="b0", f="last") + " UNION ALL " + _ONE.format(x="b1", f="before") + ")"
_MOMENTS = "count(*) AS k, covar_pop(x, y) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my"


@query("ridge_family_single", f"""
WITH a AS (SELECT * FROM {_FAMILIES}),
e AS (SELECT station_id, lead_hours, family, {_MOMENTS} FROM a WHERE day(origin) <= 15 GROUP BY 1, 2, 3),
s AS (SELECT t.station_id, t.lead_hours, t.family, p.alpha, avg((my + k * c / v / (k + alpha) * (x - mx) - y) ** 2) AS mse
      FROM a t JOIN e ON e.station_id = t.station_id AND e.lead_hours = t.lead_hours AND e.family = t.family, {_ALPHA_LIST.replace(' a(', ' p(')} WHERE day(origin) BETWEEN 16 AND 31 GROUP BY ALL),
b AS (SELECT station_id, lead_hours, family, arg_min(alpha, (round(mse, 12), alpha)) AS alpha FROM s GROUP BY 1, 2, 3),
f AS (SELECT station_id, lead_hours, family, {_MOMENTS} FROM a WHERE day(origin) <= 31 GROUP BY 1, 2, 3)
SELECT f.station_id, f.lead_hours, f.family, {r('alpha', 'alpha')}, {r('k * c / v / (k + alpha)', 'slope')}, {r('my - k * c / v / (k + alpha) * mx', 'intercept')}
FROM f JOIN b ON b.station_id = f.station_id AND b.lead_hours = f.lead_hours AND b.family = f.family""")
def _(spark, sf):
    day = F.dayofmonth("origin")
    models = linear.ridge_select(_samples(spark, sf), ["station_id"], LEADS, day <= 15, day.between(16, 31), groups={"last": [2], "before": [1]})
    slope = F.when(F.col("family") == "last", F.get("coefficients", F.lit(2))).otherwise(F.get("coefficients", F.lit(1)))
    return models.select("station_id", "lead_hours", "family", "alpha", slope.alias("slope"), "intercept")


def _yearly(spark, sf):
    """Daily order series: level yesterday and the day before, today's level as the target."""
    daily = views.surge_daily(spark, sf)
    day = F.floor(F.unix_seconds("ts") / 86400)
    from tidewright.functions.blocks import at_offset, halo_window

    rows = halo_window(daily.withColumn("_d", day), ["station_id"], "_d", {"p1": at_offset("surge_m", -1), "p2": at_offset("surge_m", -2)}, before=2, block=128)
    known = rows.where(F.col("p1").isNotNull() & F.col("p2").isNotNull())
    return known.select("station_id", F.col("ts").alias("origin"), F.array("p1", "p2").alias("features"), F.array("surge_m").alias("labels"))


_DAILY = "(SELECT a.station_id, a.ts AS origin, b.surge_m AS x, a.surge_m AS y FROM surge_daily a JOIN surge_daily b ON b.station_id = a.station_id AND b.ts = a.ts - INTERVAL 1 DAY JOIN surge_daily c ON c.station_id = a.station_id AND c.ts = a.ts - INTERVAL 2 DAY)"


@query("expanding_oof", f"""
WITH folds AS (SELECT unnest([1997, 1998, 1999, 2000, 2001]) AS py),
t AS (SELECT d.*, py, year(origin) < py - 1 AS early FROM {_DAILY} d, folds WHERE year(origin) < py AND origin <= make_timestamp(py, 1, 1, 0, 0, 0) - INTERVAL 72 HOUR),
e AS (SELECT station_id, py, count(*) AS k, covar_pop(x, y) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM t WHERE early GROUP BY 1, 2),
s AS (SELECT t.station_id, t.py, a.alpha, avg((my + coalesce(k * c / nullif(v, 0), 0) / (k + alpha) * (x - mx) - y) ** 2) AS mse FROM t JOIN e ON e.station_id = t.station_id AND e.py = t.py, {_ALPHA_LIST} WHERE NOT early GROUP BY ALL),
b AS (SELECT station_id, py, arg_min(alpha, (round(mse, 12), alpha)) AS alpha FROM s GROUP BY 1, 2),
f AS (SELECT station_id, py, count(*) AS k, covar_pop(x, y) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM t GROUP BY 1, 2)
SELECT d.station_id, d.origin, {n('f.py', 'prediction_year')}, CAST(1 AS BIGINT) AS lead_hours, {r('my + coalesce(k * c / nullif(v, 0), 0) / (k + coalesce(alpha, 10)) * (x - mx)', 'predicted_m')}
FROM {_DAILY} d JOIN f ON f.station_id = d.station_id AND f.py = year(d.origin) LEFT JOIN b ON b.station_id = f.station_id AND b.py = f.py""")
def _(spark, sf):
    rows = _yearly(spark, sf).withColumn("features", F.slice("features", 1, 1))
    models = linear.expanding_oof(rows, ["station_id"], (1,), (1997, 1998, 1999, 2000, 2001))
    return linear.predict_oof(rows.drop("labels"), models, ["station_id"])


@query("residual_boost")
def _(spark, sf):
    rows = _yearly(spark, sf)
    models = linear.expanding_oof(rows, ["station_id"], (1,), (1997, 1998, 1999, 2000, 2001))
    base = linear.predict_oof(rows, models, ["station_id"]).withColumn("observed_m", F.get("labels", F.lit(0)))
    inputs = rows.select("station_id", "origin", "features")
    joined = base.drop("labels").join(inputs, ["station_id", "origin"]).withColumnRenamed("predicted_m", "ridge_m")
    year = F.year("origin")
    fused, _weights = linear.residual_boost(joined, year < 2000, year == 2000)
    return fused.select("station_id", "origin", "observed_m", "ridge_m", "correction", "fused_m")


@query("boosted_direct")
def _(spark, sf):
    made = linear.boosted_direct(_samples(spark, sf), F.dayofmonth("origin") <= 20, LEADS)
    return made.select("station_id", "origin", "lead_hours", "observed_m", "predicted_m")


# one round of depth 1: every quantile cut of the level at the origin, and the penalised means of the best one
@query("boosted_stump", f"""
WITH t AS (SELECT station_id, lead_hours, x, y - avg(y) OVER (PARTITION BY station_id, lead_hours) AS g, avg(y) OVER (PARTITION BY station_id, lead_hours) AS base
           FROM ar_samples WHERE day(origin) <= 20),
c AS (SELECT DISTINCT station_id, lead_hours, unnest(quantile_disc(x, [{', '.join(f'{k}/64' for k in range(1, 64))}])) AS cut FROM t GROUP BY 1, 2),
s AS (SELECT c.station_id, c.lead_hours, cut, max(base) AS base, sum(g) FILTER (WHERE x <= cut) AS lg, count(*) FILTER (WHERE x <= cut) AS ln, sum(g) FILTER (WHERE x > cut) AS rg,
             count(*) FILTER (WHERE x > cut) AS rn, sum(g) AS ag, count(*) AS an FROM c JOIN t ON t.station_id = c.station_id AND t.lead_hours = c.lead_hours GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY station_id, lead_hours ORDER BY round(lg ** 2 / (ln + 1) + rg ** 2 / (rn + 1), 6) DESC, cut) AS place FROM s WHERE rn > 0)
SELECT station_id, lead_hours, {r('cut', 'cut')}, {r('lg / (ln + 1)', 'below')}, {r('rg / (rn + 1)', 'above')}, {r('base', 'base')}, {n('an', 'train_rows')} FROM b WHERE place = 1""")
def _(spark, sf):
    labelled = F.explode(F.array(*(F.struct(F.lit(k).cast("bigint").alias("lead_hours"), F.get("labels", F.lit(i)).alias("label")) for i, k in enumerate(LEADS))))
    rows = _samples(spark, sf, 1).where(F.dayofmonth("origin") <= 20).select("station_id", "origin", "features", labelled.alias("l")).select("*", "l.*")
    models = trees.fit(rows, ["station_id", "lead_hours"], ["origin"], rounds=1, depth=1, rate=1.0, rows=1.0, columns=1.0)
    first = F.get("trees", F.lit(0))
    at = lambda field, i: F.get(first[field], F.lit(i))
    return models.select("station_id", "lead_hours", at("cut", 0).alias("cut"), at("value", 1).alias("below"), at("value", 2).alias("above"), "base", "train_rows")


# --- tide ------------------------------------------------------------------------------------------------------


# stations with a record long enough for the fit: 30 days of at least 20 levels
views.SQL["tide_levels"] = """SELECT station_id, ts, surge_m AS water_level FROM (SELECT *, count(*) OVER w AS hours, max(ts) OVER w - min(ts) OVER w AS span FROM surge WINDOW w AS (PARTITION BY station_id))
WHERE hours >= 600 AND span >= INTERVAL 29 DAY"""


def _tide_input(spark, sf):
    levels = views.surge(spark, sf).withColumnRenamed("surge_m", "water_level")
    days = (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / 86400
    enough = levels.groupBy("station_id").agg(F.count("*").alias("hours"), days.alias("days")).where("hours >= 600 AND days >= 29")
    return levels.join(enough.select("station_id"), "station_id", "left_semi")


_WAVES = "(VALUES " + ", ".join(f"('{name}', {i}, {speed})" for i, (name, speed) in enumerate(tide.SPEEDS.items())) + ") c(constituent, place, speed)"
_UNKNOWNS = 2 * len(tide.SPEEDS) + 1  # cosine and sine of each constituent, then the mean
# least squares by the normal equations of all constituents together, per station
_FIT = f"""
WITH RECURSIVE t AS (SELECT station_id, ts, water_level AS y, epoch(ts - min(ts) OVER (PARTITION BY station_id)) / 3600 AS h FROM tide_levels),
x AS (SELECT station_id, ts, 2 * place AS i, cos(radians(h * speed)) AS x FROM t, {_WAVES} UNION ALL SELECT station_id, ts, 2 * place + 1, sin(radians(h * speed)) FROM t, {_WAVES}
      UNION ALL SELECT station_id, ts, {_UNKNOWNS - 1}, 1.0 FROM t UNION ALL SELECT station_id, ts, {_UNKNOWNS}, y FROM t),
normal AS (SELECT a.station_id, a.i, b.i AS j, sum(a.x * b.x) AS v FROM x a JOIN x b ON b.station_id = a.station_id AND b.ts = a.ts WHERE a.i < {_UNKNOWNS} GROUP BY ALL),
{solve_sql('normal', 'station_id', _UNKNOWNS)},
k AS (SELECT station_id, count(*) AS fit_rows, min(ts) AS t0, max(ts) AS t1 FROM tide_levels GROUP BY 1)"""
_TIDE = f"""{_FIT},
axis AS (SELECT station_id, t0, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS ts FROM k),
wave AS (SELECT a.station_id, a.ts, sum(s.w * CASE WHEN s.i % 2 = 0 THEN cos(radians(epoch(a.ts - t0) / 3600 * speed)) ELSE sin(radians(epoch(a.ts - t0) / 3600 * speed)) END) AS wave
         FROM axis a JOIN solved s ON s.station_id = a.station_id JOIN {_WAVES} ON place = s.i // 2 WHERE s.i < {_UNKNOWNS - 1} GROUP BY 1, 2),
p AS (SELECT v.station_id, v.ts, l.water_level AS o, m.w + wave AS tide FROM wave v JOIN solved m ON m.station_id = v.station_id AND m.i = {_UNKNOWNS - 1}
      LEFT JOIN tide_levels l ON l.station_id = v.station_id AND l.ts = v.ts)"""


@query("tide_harmonics", f"""{_FIT}
SELECT a.station_id, constituent, {r('a.w', 'cosine')}, {r('b.w', 'sine')}, {r('m.w', 'mean_level')}, {n('fit_rows', 'fit_rows')}, t0 AS first_ts FROM {_WAVES}
JOIN solved a ON a.i = 2 * place JOIN solved b ON b.station_id = a.station_id AND b.i = 2 * place + 1
JOIN solved m ON m.station_id = a.station_id AND m.i = {_UNKNOWNS - 1} JOIN k ON k.station_id = a.station_id""")
def _(spark, sf):
    fitted = tide.fit_tide(_tide_input(spark, sf))
    rows = fitted.select("station_id", "mean_level", "fit_rows", "first_ts", "harmonics", F.posexplode("constituents").alias("_i", "constituent"))
    cosine, sine = (F.get("harmonics", F.col("_i") * 2 + k).alias(name) for k, name in enumerate(("cosine", "sine")))
    return rows.select("station_id", "constituent", cosine, sine, "mean_level", "fit_rows", "first_ts")


@query("tide_separation", f"""{_TIDE}
SELECT station_id, ts, {r('o', 'observed_water_level_m')}, {r('tide', 'predicted_tide_m')}, {r('o - tide', 'surge_m')}, o IS NOT NULL AS qc_valid FROM p""")
def _(spark, sf):
    levels = _tide_input(spark, sf)
    return tide.separate_tide(levels, tide.fit_tide(levels))


@query("tide_amplitude", f"""{_FIT}
SELECT a.station_id, constituent, {r('sqrt(a.w * a.w + b.w * b.w)', 'amplitude')}, {r('(degrees(atan2(b.w, a.w)) + 360) % 360', 'phase_deg')} FROM {_WAVES}
JOIN solved a ON a.i = 2 * place JOIN solved b ON b.station_id = a.station_id AND b.i = 2 * place + 1""")
def _(spark, sf):
    return tide.amplitudes(tide.fit_tide(_tide_input(spark, sf)))


@query("tide_record_audit", f"""SELECT station_id, {n('count(*)', 'records')}, {n('count(surge_m)', 'finite_records')}, min(ts) AS "start", max(ts) AS "end" FROM surge_daily WHERE year(ts) <= 1999 GROUP BY 1""")
def _(spark, sf):
    return tide.tide_record_audit(views.surge_daily(spark, sf), 1999, "surge_m")


# --- bootstrap -----------------------------------------------------------------------------------------------

_REPS = 500


@query("block_bootstrap", f"""
WITH p AS (SELECT a.station_id || '-' || a.model || '-' || a.lead_hours AS station_id, a.origin AS ts, (a.predicted_m - a.observed_m) ** 2 AS em, (b.predicted_m - b.observed_m) ** 2 AS er FROM forecasts a
      JOIN forecasts b ON b.station_id = a.station_id AND b.origin = a.origin AND b.lead_hours = a.lead_hours AND b.model = 'persistence' WHERE a.model <> 'persistence'),
q AS (SELECT *, floor(epoch(ts - min(ts) OVER (PARTITION BY station_id)) / (168 * 3600)) AS blk FROM p),
x AS (SELECT *, row_number() OVER w AS take, sum(em) OVER w AS pm, sum(er) OVER w AS pr FROM q WINDOW w AS (PARTITION BY station_id, blk ORDER BY ts ROWS UNBOUNDED PRECEDING)),
s AS (SELECT station_id, blk, count(*) AS k, row_number() OVER (PARTITION BY station_id ORDER BY blk) - 1 AS num FROM q GROUP BY 1, 2),
t AS (SELECT station_id, sum(k) AS n, count(*) AS bc, min(k) AS least, (SELECT sum(em) FROM q WHERE q.station_id = s.station_id) AS tm, (SELECT sum(er) FROM q WHERE q.station_id = s.station_id) AS tr FROM s GROUP BY 1),
d AS (SELECT station_id, n, bc, rep, unnest(generate_series(1, CAST(ceil(n / least) AS BIGINT))) AS dr FROM (SELECT *, unnest(generate_series(1, {_REPS})) AS rep FROM t)),
g AS (SELECT d.*, s.blk, s.k, sum(s.k) OVER (PARTITION BY d.station_id, rep ORDER BY dr ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN s ON s.station_id = d.station_id
      AND s.num = CAST('0x' || substr(md5('42:' || rep || ':' || dr), 1, 12) AS BIGINT) % d.bc),
h AS (SELECT *, least(k, n - upto + k) AS take FROM g WHERE upto - k < n),
v AS (SELECT h.station_id, rep, max(n) AS n, sum(pm) AS m, sum(pr) AS r FROM h JOIN x ON x.station_id = h.station_id AND x.blk = h.blk AND x.take = h.take GROUP BY 1, 2),
z AS (SELECT station_id, (sqrt(m / n) - sqrt(r / n)) * 100 AS dd, 1 - m / r AS sk FROM v)
SELECT t.station_id, {n('max(n)', 'n')}, CAST(168 AS BIGINT) AS block_hours, {n('max(bc)', 'calendar_block_count')}, {n('count(*)', 'repetitions')},
       {r('max((sqrt(tm / n) - sqrt(tr / n)) * 100)', 'rmse_difference_cm')}, {r('quantile_cont(dd, 0.025)', 'rmse_difference_low_cm')}, {r('quantile_cont(dd, 0.975)', 'rmse_difference_high_cm')},
       {r('max(1 - tm / tr)', 'mse_skill')}, {r('quantile_cont(sk, 0.025)', 'mse_skill_low')}, {r('quantile_cont(sk, 0.975)', 'mse_skill_high')}
FROM t JOIN z ON z.station_id = t.station_id GROUP BY 1""")
def _(spark, sf):
    rows = views.forecasts(spark, sf)
    keys = ["station_id", "lead_hours", "origin"]
    base = rows.where(F.col("model") == "persistence").select(*keys, F.col("predicted_m").alias("reference_m"))
    pairs = rows.where(F.col("model") != "persistence").join(base, keys)
    series = F.concat_ws("-", "station_id", "model", F.col("lead_hours").cast("string")).alias("station_id")
    return bootstrap.block_bootstrap(pairs.select(series, F.col("origin").alias("ts"), "observed_m", F.col("predicted_m").alias("model_m"), "reference_m"), 168, _REPS)
