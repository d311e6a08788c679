"""Queries comparing models over the metric table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import align, compare
from tidewright.plans import views
from tidewright.plans.registry import n, query, r
from tidewright.plans.verify_queries import metrics

MODELS = ("persistence", "mean3", "damped")
BASE = "metrics b ON b.station_id = m.station_id AND b.lead_hours = m.lead_hours AND b.model"


@query("reference_join", f"""
SELECT m.station_id, m.lead_hours, m.model, m.rmse_cm, b.rmse_cm AS reference_rmse_cm FROM metrics m JOIN {BASE} = 'persistence'""")
def _(spark, sf):
    return compare.reference_join(metrics(spark, sf).select("station_id", "lead_hours", "model", "rmse_cm"), "persistence")


@query("skill_vs", f"""
SELECT m.station_id, m.lead_hours, m.model, {r('1 - (m.rmse_cm / b.rmse_cm) ** 2', 'skill_mse')}, {r('1 - m.rmse_cm / b.rmse_cm', 'skill_rmse')},
       {r('100 * (1 - m.rmse_cm / b.rmse_cm)', 'gain_percent')} FROM (SELECT station_id, lead_hours, model, sqrt(avg((predicted_m - observed_m) ** 2)) AS rmse_cm FROM forecasts GROUP BY 1, 2, 3) m
JOIN (SELECT station_id, lead_hours, sqrt(avg((predicted_m - observed_m) ** 2)) AS rmse_cm FROM forecasts WHERE model = 'persistence' GROUP BY 1, 2) b
  ON b.station_id = m.station_id AND b.lead_hours = m.lead_hours""")
def _(spark, sf):
    return compare.skill_vs(metrics(spark, sf), "persistence").select("station_id", "lead_hours", "model", "skill_mse", "skill_rmse", "gain_percent")


RAW = "(SELECT station_id, lead_hours, model, count(*) AS n, sqrt(avg((predicted_m - observed_m) ** 2)) * 100 AS rmse_cm FROM forecasts GROUP BY 1, 2, 3)"
PAIRS = (("mean_over_last", "persistence", "mean3"), ("damped_over_last", "persistence", "damped"), ("damped_over_mean", "mean3", "damped"))
_PAIR_SQL = "(VALUES " + ", ".join(str(p) for p in PAIRS) + ") p(comparison, reference_model, model)"


@query("incremental_value", f"""
SELECT a.station_id, a.lead_hours, p.comparison, p.reference_model, p.model, {r('b.rmse_cm', 'reference_rmse_cm')}, {r('a.rmse_cm', 'model_rmse_cm')},
       {r('100 * (1 - a.rmse_cm / b.rmse_cm)', 'gain_percent')}, {r('1 - (a.rmse_cm / b.rmse_cm) ** 2', 'mse_skill')}
FROM {RAW} a JOIN {_PAIR_SQL} ON p.model = a.model
JOIN {RAW} b ON b.station_id = a.station_id AND b.lead_hours = a.lead_hours AND b.model = p.reference_model""")
def _(spark, sf):
    return compare.incremental_value(metrics(spark, sf), compare.pair_table(spark, PAIRS))


_COND = """(SELECT station_id, lead_hours, model, 'top5_absolute_surge' AS condition, top5_rmse_cm AS rmse_cm, top5_threshold_cm AS threshold, top5_n AS n FROM metrics
UNION ALL SELECT station_id, lead_hours, model, 'rapid_rise', rapid_rise_rmse_cm, rapid_rise_threshold_cm_per_hour, rapid_rise_n FROM metrics)"""


@query("extreme_compare", f"""
SELECT c.station_id, c.lead_hours, c.condition, c.model, c.rmse_cm, b.rmse_cm AS reference_rmse_cm, round(1 - c.rmse_cm / b.rmse_cm, 4) + 0.0 AS skill_rmse,
       c.threshold, c.n, rank() OVER (PARTITION BY c.station_id, c.lead_hours, c.condition ORDER BY c.rmse_cm) AS rank_by_rmse
FROM {_COND} c JOIN {_COND} b ON b.station_id = c.station_id AND b.lead_hours = c.lead_hours AND b.condition = c.condition AND b.model = 'persistence'""")
def _(spark, sf):
    out = compare.extreme_compare(metrics(spark, sf), "persistence")
    return out.withColumn("skill_rmse", F.round("skill_rmse", 4))


@query("rank_models", "SELECT station_id, lead_hours, model, rank() OVER (PARTITION BY station_id, lead_hours ORDER BY rmse_cm) AS rank_by_rmse FROM metrics")
def _(spark, sf):
    ranked = compare.rank_models(metrics(spark, sf), ["station_id", "lead_hours"])
    return ranked.select("station_id", "lead_hours", "model", "rank_by_rmse")


@query("best_by_lead", "SELECT station_id, lead_hours, arg_min(model, rmse_cm) AS best_model, min(rmse_cm) AS best_rmse_cm FROM metrics GROUP BY 1, 2")
def _(spark, sf):
    return compare.best_by_lead(metrics(spark, sf))


@query("persistence_decay", "SELECT station_id, lead_hours, n, rmse_cm, rrmse_percent, pearson_r, r2 FROM metrics WHERE model = 'persistence'")
def _(spark, sf):
    return compare.persistence_decay(metrics(spark, sf))


@query("rollout_gain", f"""
SELECT a.station_id, a.lead_hours, {r('a.rmse_cm', 'base_rmse_cm')}, {r('b.rmse_cm', 'tuned_rmse_cm')}, {r('100 * (1 - b.rmse_cm / a.rmse_cm)', 'gain_percent')}
FROM {RAW} a JOIN {RAW} b ON b.station_id = a.station_id AND b.lead_hours = a.lead_hours AND b.model = 'mean3' WHERE a.model = 'persistence'""")
def _(spark, sf):
    return compare.rollout_gain(metrics(spark, sf), "persistence", "mean3")


@query("ordered_models", "SELECT station_id, lead_hours, model, rmse_cm, CASE model WHEN 'damped' THEN 1 WHEN 'mean3' THEN 2 ELSE 3 END::BIGINT AS model_order FROM metrics")
def _(spark, sf):
    ordered = compare.with_model_order(metrics(spark, sf), ("damped", "mean3", "persistence"))
    return ordered.select("station_id", "lead_hours", "model", "rmse_cm", "model_order")


@query("rmse_table", "SELECT station_id, lead_hours, min(n) AS n, " + ", ".join(f"max(rmse_cm) FILTER (WHERE model = '{m}') AS {m}_rmse_cm" for m in MODELS) + " FROM metrics GROUP BY 1, 2")
def _(spark, sf):
    return compare.rmse_table(metrics(spark, sf), MODELS)


_WIDE = ", ".join(
    r(f"max(observed_m) FILTER (WHERE lead_hours = {k})", f"observed_{k:02d}h_m") + ", "
    + ", ".join(r(f"max(predicted_m) FILTER (WHERE lead_hours = {k} AND model = '{m}')", f"{m}_{k:02d}h_m") for m in MODELS)
    for k in views.LEADS
)


@query("long_to_wide", f"SELECT station_id, origin, {_WIDE} FROM forecasts GROUP BY 1, 2")
def _(spark, sf):
    return compare.long_to_wide(views.forecasts(spark, sf), views.LEADS, MODELS)


@query("wide_to_long", f"SELECT station_id, origin, lead_hours, {r('observed_m', 'observed_m')}, model, {r('predicted_m', 'predicted_m')} FROM forecasts")
def _(spark, sf):
    wide = compare.long_to_wide(views.forecasts(spark, sf), views.LEADS, MODELS)
    return compare.wide_to_long(wide, views.LEADS, MODELS)


@query("prune_columns", f"SELECT station_id, lead_hours, model, origin, {r('predicted_m', 'predicted_m')} FROM forecasts")
def _(spark, sf):
    from tidewright.functions.columns import require_columns

    return require_columns(views.forecasts(spark, sf), ["station_id", "lead_hours", "model", "origin", "predicted_m"])


@query("station_union", """
SELECT s.station_id, lead_hours, CASE model WHEN 'persistence' THEN 'Persistence' ELSE 'Mean' END AS model, model AS source_model, metrics.station_id AS part, rmse_cm
FROM metrics, (VALUES ('north'), ('south')) s(station_id) WHERE model = 'persistence' OR (model = 'mean3' AND s.station_id = 'south')""")
def _(spark, sf):
    table = metrics(spark, sf)
    table = table.withColumnRenamed("station_id", "part")
    frames = {"north": table, "south": table.withColumnRenamed("model", "method")}
    named = [("north", "persistence", "Persistence"), ("south", "persistence", "Persistence"), ("south", "mean3", "Mean")]
    mapped = compare.station_union(frames, spark.createDataFrame(named, "station_id string, source_model string, model string"))
    return mapped.select("station_id", "lead_hours", "model", "source_model", "part", "rmse_cm")


@query("result_summary", f"""
SELECT a.station_id, a.lead_hours, row_number() OVER (PARTITION BY a.station_id, a.lead_hours ORDER BY a.rmse_cm, a.model) AS place, a.model,
       {r('a.rmse_cm', 'rmse_cm')}, {r('100 * (1 - a.rmse_cm / b.rmse_cm)', 'gain_percent')}
FROM {RAW} a JOIN {RAW} b ON b.station_id = a.station_id AND b.lead_hours = a.lead_hours AND b.model = 'persistence'""")
def _(spark, sf):
    return compare.result_summary(metrics(spark, sf), "persistence")


@query("evidence_audit", f"""
WITH o AS (SELECT station_id, min(ts) AS a, max(ts) AS b, count(surge_m) AS c, max(year(ts)) AS y FROM surge GROUP BY 1),
m AS (SELECT station_id, min(n) AS k FROM metrics GROUP BY 1)
SELECT o.station_id, CASE WHEN k IS NOT NULL THEN '1,3,6' END AS leads, k AS common_origin_samples, a AS observed_start, b AS observed_end, c AS finite_observed,
       y AS evaluation_year, CASE WHEN k IS NULL THEN 'partial' ELSE 'complete' END AS status
FROM o LEFT JOIN m ON m.station_id = o.station_id""")
def _(spark, sf):
    return compare.evidence_audit(metrics(spark, sf), views.surge(spark, sf))


@query("select_window_runs", """
WITH r AS (SELECT [8, 12, 24, 48][1 + p_partkey % 4] AS input_steps, 'run' || p_partkey AS run, p_size AS validation_rows,
                  p_partkey % 3 = 0 AS has_predictions, p_partkey % 5 = 0 AS is_rolling, p_retailprice AS rmse_cm FROM part)
SELECT CAST(input_steps AS BIGINT) AS input_steps, run, CAST(validation_rows AS BIGINT) AS validation_rows, has_predictions, is_rolling, round(rmse_cm, 6) + 0.0 AS rmse_cm FROM (
  SELECT *, row_number() OVER (PARTITION BY input_steps ORDER BY has_predictions DESC, validation_rows DESC, run) AS k
  FROM r WHERE input_steps IN (8, 12, 24) AND NOT is_rolling AND validation_rows >= 10) WHERE k = 1""")
def _(spark, sf):
    k = F.col("p_partkey")
    steps = F.array(*[F.lit(v) for v in (8, 12, 24, 48)])
    runs = views.table(spark, sf, "part").select(
        F.get(steps, (k % 4).cast("int")).alias("input_steps"), F.concat(F.lit("run"), k.cast("string")).alias("run"),
        F.col("p_size").alias("validation_rows"), (k % 3 == 0).alias("has_predictions"), (k % 5 == 0).alias("is_rolling"),
        F.col("p_retailprice").alias("rmse_cm"),
    )
    return compare.select_window_runs(runs, at_least=10)


# --- alignment ------------------------------------------------------------------------------------------------

# the field view holds every hour seen by any type, so each type lacks some of its hours
HOURS = "(SELECT DISTINCT ts FROM field)"


def _field_hours(spark, sf):
    return views.field(spark, sf).select("ts").distinct()


def _repeated(spark, sf):
    """The levels with a missing first row at 5 o'clock and a second row at 6 o'clock."""
    rows = views.surge(spark, sf).withColumn("seq", F.lit(1))
    missing = rows.where(F.hour("ts") == 5).withColumns({"seq": F.lit(0), "surge_m": F.lit(None).cast("double")})
    second = rows.where(F.hour("ts") == 6).withColumns({"seq": F.lit(2), "surge_m": F.col("surge_m") + 1})
    return rows.unionByName(missing).unionByName(second)


KNOWN = "(SELECT * FROM surge WHERE hour(ts) <> 5)"


@query("align_hourly", f"SELECT s.station_id, s.ts, {r('surge_m', 'surge_m')} FROM {KNOWN} s JOIN {HOURS} h ON h.ts = s.ts")
def _(spark, sf):
    return align.align_hourly(_field_hours(spark, sf), _repeated(spark, sf), order=["seq"]).drop("seq")


@query("alignment_report", f"""
WITH t AS (SELECT s.station_id, s.ts, h.ts AS hit FROM {KNOWN} s LEFT JOIN {HOURS} h ON h.ts = s.ts),
g AS (SELECT station_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY station_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM t WHERE hit IS NOT NULL),
c AS (SELECT station_id, sum(opens) AS segs FROM g GROUP BY 1)
SELECT t.station_id, min(t.ts) AS surge_start, max(t.ts) AS surge_end, (SELECT min(ts) FROM {HOURS}) AS field_start, (SELECT max(ts) FROM {HOURS}) AS field_end, {n('count(hit)', 'matched_times')}, {n('count(*) - count(hit)', 'missing_field_times')},
       {n(f'(SELECT count(*) FROM {HOURS}) - count(hit)', 'missing_surge_times')}, min(hit) AS common_start, max(hit) AS common_end,
       {n('max(c.segs)', 'continuous_segments')} FROM t JOIN c ON c.station_id = t.station_id GROUP BY 1""")
def _(spark, sf):
    return align.alignment_report(_field_hours(spark, sf), _repeated(spark, sf), order=["seq"])


@query("left_fill_align", f"""
SELECT station_id, year(s.ts) AS year, {n('count(*)', 'hours')}, {n('count(h.ts)', 'matched_hours')}
FROM surge s LEFT JOIN {HOURS} h ON h.ts = s.ts GROUP BY 1, 2""")
def _(spark, sf):
    hours = _field_hours(spark, sf).withColumn("in_field", F.lit(1))
    return align.matched_by_year(align.left_fill_align(views.surge(spark, sf), hours), "in_field")


@query("exact_grid_align", f"""
SELECT ts, lat_idx, lon_idx, {r('latitude', 'latitude')}, {r('longitude', 'longitude')}, {r("max(value) FILTER (WHERE variable = 'U10')", 'u10')},
       {r("max(value) FILTER (WHERE variable = 'V10')", 'v10')}, {r("max(value) FILTER (WHERE variable = 'MSL')", 'msl')}
FROM field GROUP BY ts, lat_idx, lon_idx, latitude, longitude""")
def _(spark, sf):
    return align.exact_grid_align(views.field(spark, sf))


@query("join_predictions", f"""
SELECT a.station_id, a.lead_hours, a.origin, {r('a.predicted_m', 'mean3_m')}, {r('b.predicted_m', 'damped_m')} FROM forecasts a JOIN forecasts b
ON b.station_id = a.station_id AND b.origin = a.origin AND b.lead_hours = a.lead_hours WHERE a.model = 'mean3' AND b.model = 'damped'""")
def _(spark, sf):
    one = views.forecasts(spark, sf)
    left = one.where(F.col("model") == "mean3").select("station_id", "lead_hours", "origin", F.col("predicted_m").alias("mean3_m"))
    right = one.where(F.col("model") == "damped").select("station_id", "lead_hours", "origin", F.col("predicted_m").alias("damped_m"))
    return align.join_predictions(left, right, ["station_id", "lead_hours", "origin"])


@query("reindex_strict", f"SELECT station_id, lead_hours, origin, model, {r('predicted_m', 'predicted_m')} FROM forecasts WHERE model <> 'persistence'")
def _(spark, sf):
    table = views.forecasts(spark, sf)
    others = F.explode(F.array(F.lit("mean3"), F.lit("damped"))).alias("model")
    expected = table.where(F.col("model") == "persistence").select("station_id", "lead_hours", "origin", others)
    keys = ["station_id", "lead_hours", "origin", "model"]
    return align.reindex_strict(expected, table.where(F.col("model") != "persistence").select(*keys, "predicted_m"), keys, "predicted_m")


@query("hours_only_in", f"""
SELECT DISTINCT 'levels' AS side, s.ts FROM surge_daily s WHERE s.ts NOT IN (SELECT ts FROM {HOURS})
UNION ALL SELECT DISTINCT 'field', h.ts FROM {HOURS} h WHERE h.ts NOT IN (SELECT ts FROM surge_daily)""")
def _(spark, sf):
    levels, hours = views.surge_daily(spark, sf), _field_hours(spark, sf)
    return align.hours_only_in(levels, hours).select(F.lit("levels").alias("side"), "ts").unionByName(
        align.hours_only_in(hours, levels).select(F.lit("field").alias("side"), "ts"))


@query("common_hours", f"SELECT DISTINCT s.ts FROM surge s JOIN {HOURS} h ON h.ts = s.ts")
def _(spark, sf):
    return align.common_hours(views.surge(spark, sf), _field_hours(spark, sf))


@query("merge_evidence", f"""
SELECT station_id, {n('count(surge_m)', 'n')}, CASE WHEN station_id IN ('view', 'click') THEN 'raw' ELSE 'derived' END AS evidence FROM surge GROUP BY 1""")
def _(spark, sf):
    counts = views.surge(spark, sf).groupBy("station_id").agg(F.count("surge_m").alias("n"))
    raw = counts.where(F.col("station_id").isin("view", "click")).withColumn("evidence", F.lit("raw"))
    return align.merge_evidence(raw, counts.withColumn("evidence", F.lit("derived")))
