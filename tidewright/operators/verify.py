"""Forecast verification: scores by group, lead, extreme condition, forcing and event.

Levels are metres and scores centimetres. A forecast table holds one row per ``(keys, origin, lead_hours,
model)`` with ``observed_m`` and ``predicted_m``; every model covers the same origins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.blocks import at_offset, halo_window, hour_number
from tidewright.functions.columns import finite
from tidewright.functions.quantiles import exact_quantiles
from tidewright.functions.storage import stored

STATION = ("station_id",)


def _pairs(obs: str | Column, pred: str | Column, where: Column | None) -> tuple[Column, Column]:
    o, p = finite(obs), finite(pred)
    usable = o.isNotNull() & p.isNotNull()
    if where is not None:
        usable = usable & where
    return F.when(usable, o), F.when(usable, p)


def correlation(x: Column, y: Column) -> Column:
    """Pearson r in [-1, 1]; null below two pairs or without variance (``corr`` would raise there)."""
    scale = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    r = F.covar_pop(x, y) / scale
    held = F.when(r > 1, F.lit(1.0)).when(r < -1, F.lit(-1.0)).otherwise(r)
    return F.when(F.count(x) >= 2, held)


def scores(
    obs: str | Column = "observed_m", pred: str | Column = "predicted_m", where: Column | None = None,
    relative_to: str = "mean_abs", prefix: str = "",
) -> list[Column]:
    """Aggregate columns over finite pairs: n, r, R2, RMSE, MAE, bias (cm) and relative RMSE (percent).

    ``relative_to`` is the RRMSE denominator: ``mean_abs``, ``range`` (max - min) or ``rms`` of the observed.
    """
    o, p = _pairs(obs, pred, where)
    e = p - o
    rmse = F.sqrt(F.avg(e * e))
    denominator = {
        "mean_abs": F.avg(F.abs(o)),
        "range": F.max(o) - F.min(o),
        "rms": F.sqrt(F.avg(o * o)),
    }[relative_to]
    return [
        F.count(e).alias(f"{prefix}n"),
        correlation(o, p).alias(f"{prefix}pearson_r"),
        (1 - F.avg(e * e) / F.nullif(F.var_pop(o), F.lit(0.0))).alias(f"{prefix}r2"),
        (rmse * 100).alias(f"{prefix}rmse_cm"),
        (F.avg(F.abs(e)) * 100).alias(f"{prefix}mae_cm"),
        (F.avg(e) * 100).alias(f"{prefix}bias_cm"),
        (rmse / F.nullif(denominator, F.lit(0.0)) * 100).alias(f"{prefix}rrmse_percent"),
    ]


def verify(df: DataFrame, by: Sequence[str], relative_to: str = "mean_abs") -> DataFrame:
    """Scores per group."""
    return df.groupBy(*by).agg(*scores(relative_to=relative_to))


def subset_verify(df: DataFrame, by: Sequence[str], mask: Column, threshold: Column | None = None) -> DataFrame:
    """Scores of the rows under ``mask``; groups without such rows report n = 0."""
    extra = [] if threshold is None else [(F.max(threshold) * 100).alias("threshold_cm")]
    return df.groupBy(*by).agg(*scores(where=F.coalesce(mask, F.lit(False))), *extra)


def extreme_verify(
    df: DataFrame, by: Sequence[str], levels: dict[str, float] | None = None
) -> DataFrame:
    """Scores where ``abs(observed)`` reaches its own 90th and 95th percentile."""
    levels = levels or {"top_absolute_10_percent": 0.90, "top_absolute_5_percent": 0.95}
    pairs = df.where(finite("observed_m").isNotNull() & finite("predicted_m").isNotNull())
    limits = exact_quantiles(pairs, by, {k: (F.abs("observed_m"), q) for k, q in levels.items()})
    subsets = F.array(*[F.struct(F.lit(k).alias("subset"), F.col(k).alias("_limit")) for k in levels])
    limits = limits.select(*by, F.inline(subsets))
    hit = pairs.join(limits, list(by)).where(F.abs("observed_m") >= F.col("_limit"))
    return hit.groupBy(*by, "subset").agg(*scores(), (F.max("_limit") * 100).alias("threshold_cm"))


def rapid_rise_verify(
    df: DataFrame, keys: Sequence[str] = STATION, ts: str = "ts", share: float = 0.90
) -> DataFrame:
    """Scores where the one-hour observed rise reaches the 90th percentile of positive rises.

    Rises count only between rows exactly one hour apart; a series without positive rises reports n = 0.
    """
    pairs = df.where(finite("observed_m").isNotNull() & finite("predicted_m").isNotNull())
    risen = halo_window(
        pairs.withColumn("_h", hour_number(ts)), keys, "_h", {"_before": at_offset("observed_m", -1)}, before=1
    ).withColumn("_rise", F.col("observed_m") - F.col("_before"))
    limit = exact_quantiles(risen, keys, {"_limit": (F.when(F.col("_rise") > 0, F.col("_rise")), share)})
    joined = risen.join(limit, list(keys), "left")
    return subset_verify(joined, keys, F.col("_rise") >= F.col("_limit"), F.col("_limit"))


def verify_by_lead(
    df: DataFrame, reference: str, keys: Sequence[str] = STATION, prior: str = "prior_m"
) -> DataFrame:
    """Scores, skill and extreme-condition scores per lead and model.

    Thresholds come from the reference model's rows, which hold each origin once: the 95th percentile of
    ``abs(observed)`` and the 90th percentile of positive rises since ``prior`` (observed one hour before
    the target). Skill is 1 - MSE / MSE of the reference at the same lead.
    """
    group = [*keys, "lead_hours"]
    rise = F.col("observed_m") - F.col(prior)
    df = stored(df.select(*group, "model", "observed_m", "predicted_m", prior), "forecasts")  # thresholds and scores read the same narrow rows
    limits = exact_quantiles(
        df.where(F.col("model") == reference), group,
        {"_top": (F.abs("observed_m"), 0.95), "_fast": (F.when(rise > 0, rise), 0.90)},
    )
    table = df.join(limits, group, "left").groupBy(*group, "model").agg(
        *scores(),
        *_some(scores(where=F.abs("observed_m") >= F.col("_top"), prefix="top5_")),
        *_some(scores(where=F.coalesce(rise >= F.col("_fast"), F.lit(False)), prefix="rapid_rise_")),
        (F.max("_top") * 100).alias("top5_threshold_cm"),
        (F.max("_fast") * 100).alias("rapid_rise_threshold_cm_per_hour"),
    )
    lead = Window.partitionBy(*group)
    base = F.max(F.when(F.col("model") == reference, F.col("rmse_cm"))).over(lead)
    return table.withColumn("_base", F.nullif(base, F.lit(0.0))).withColumn(
        "skill_vs_reference", 1 - F.col("rmse_cm") * F.col("rmse_cm") / (F.col("_base") * F.col("_base"))
    ).drop("_base")


def _some(columns: list[Column]) -> list[Column]:
    """n and RMSE of a score list."""
    return [columns[0], columns[3]]


def train_thresholds(
    df: DataFrame, last_year: int, keys: Sequence[str] = STATION, prior: str = "prior_m"
) -> DataFrame:
    """Extreme limits per lead from origins up to ``last_year``; a limit over nothing is +infinity."""
    o, rise = F.col("observed_m"), F.col("observed_m") - F.col(prior)
    early = F.year("origin") <= last_year
    limits = exact_quantiles(
        df, [*keys, "lead_hours"],
        {
            "absolute_top5_m": (F.when(early, F.abs(o)), 0.95),
            "positive_top5_m": (F.when(early & (o > 0), o), 0.95),
            "rapid_rise_m": (F.when(early & (rise > 0), rise), 0.90),
        },
    )
    return limits.withColumns(
        {c: F.coalesce(c, F.lit(float("inf"))) for c in ("positive_top5_m", "rapid_rise_m")}
    )


def verify_by_forcing(
    df: DataFrame, forcing: str, training: Column, keys: Sequence[str] = STATION, share: float = 0.75
) -> DataFrame:
    """Scores in the calm and strong half, split where ``forcing`` reaches its training 75th percentile.

    Forcing belongs to the origin, so the limit comes from each origin once.
    """
    origins = df.where(training).select(*keys, "lead_hours", "origin", forcing).distinct()
    limit = exact_quantiles(origins, [*keys, "lead_hours"], {"_limit": (forcing, share)})
    grouped = df.join(limit, [*keys, "lead_hours"], "left").withColumn(
        "forcing_group",
        F.when(F.col(forcing) >= F.col("_limit"), F.lit("strong")).otherwise(F.lit("calm")),
    )
    return grouped.groupBy(*keys, "lead_hours", "model", "forcing_group").agg(
        *scores(), F.max("_limit").alias("forcing_threshold")
    )


def peak_verify(
    df: DataFrame, by: Sequence[str], percentiles: Sequence[float] = (90.0, 95.0, 99.0)
) -> DataFrame:
    """Scores where the signed observation reaches its percentile, and how often it is underestimated."""
    names = {f"_p{i}": p for i, p in enumerate(percentiles)}
    limits = exact_quantiles(df, by, {k: ("observed_m", p / 100) for k, p in names.items()})
    choices = F.array(
        *[F.struct(F.lit(float(p)).alias("percentile"), F.col(k).alias("threshold_m")) for k, p in names.items()]
    )
    limits = limits.select(*by, F.inline(choices))
    o, p = _pairs("observed_m", "predicted_m", None)
    e = p - o
    hit = df.join(limits, list(by)).where(F.col("observed_m") >= F.col("threshold_m"))
    return hit.groupBy(*by, "percentile").agg(
        (F.max("threshold_m") * 100).alias("threshold_cm"),
        F.count(e).alias("n_peak"),
        (F.sqrt(F.avg(e * e)) * 100).alias("peak_rmse_cm"),
        (F.avg(F.abs(e)) * 100).alias("peak_mae_cm"),
        (F.avg(e) * 100).alias("peak_bias_cm"),
        F.avg((e < 0).cast("double")).alias("underestimation_ratio"),
        correlation(o, p).alias("peak_correlation"),
    )


def event_verify(df: DataFrame, event: str = "event_id") -> DataFrame:
    """RMSE, MAE and bias per event."""
    o, p = _pairs("observed_m", "predicted_m", None)
    e = p - o
    return df.groupBy(event).agg(
        F.count(e).alias("n"),
        (F.sqrt(F.avg(e * e)) * 100).alias("rmse_cm"),
        (F.avg(F.abs(e)) * 100).alias("mae_cm"),
        (F.avg(e) * 100).alias("bias_cm"),
    )


def series_scale(
    df: DataFrame, value: str = "surge_m", keys: Sequence[str] = STATION
) -> DataFrame:
    """Size of a series in cm: moments, absolute percentiles and extremes."""
    v = finite(value) * 100
    base = df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean_cm"),
        F.stddev_pop(v).alias("std_cm"),
        F.avg(F.abs(v)).alias("mean_absolute_cm"),
        F.min(v).alias("min_cm"),
        F.max(v).alias("max_cm"),
        F.max(F.abs(v)).alias("max_absolute_cm"),
    )
    marks = exact_quantiles(
        df, keys, {f"p{q}_absolute_cm": (F.abs(v), q / 100) for q in (90, 95, 99)}
    )
    return base.join(marks, list(keys), "left")


def ensemble_mean(df: DataFrame, keys: Sequence[str], pred: str = "predicted_m") -> DataFrame:
    """Mean prediction over ensemble members for each target."""
    return df.groupBy(*keys).agg(
        F.max("observed_m").alias("observed_m"), F.avg(pred).alias("predicted_m"), F.count(pred).alias("members")
    )


def ensemble_verify(members: DataFrame, target: Sequence[str], by: Sequence[str], share: float = 0.95) -> DataFrame:
    """Range-relative scores of the ensemble mean over all targets and over the top observed share."""
    mean = ensemble_mean(members, target)
    limit = exact_quantiles(mean, by, {"_limit": ("observed_m", share)})
    joined = mean.join(limit, list(by))
    subsets = F.array(
        F.struct(F.lit("all").alias("subset"), F.lit(True).alias("_in")),
        F.struct(F.lit("top").alias("subset"), (F.col("observed_m") >= F.col("_limit")).alias("_in")),
    )
    return (
        joined.select("*", F.inline(subsets)).where("_in")
        .groupBy(*by, "subset").agg(*scores(relative_to="range"))
    )


def cumulative_error(
    df: DataFrame, keys: Sequence[str], order: str = "lead_hours"
) -> DataFrame:
    """Running RMSE, MAE and summed absolute error along the lead; null pairs are skipped."""
    o, p = _pairs("observed_m", "predicted_m", None)
    e = p - o
    # one forecast is one key: its rows are its leads, so this window is as short as the horizon
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns(
        {
            "cumulative_rmse_cm": F.sqrt(F.avg(e * e).over(w)) * 100,
            "cumulative_mae_cm": F.avg(F.abs(e)).over(w) * 100,
            "cumulative_abs_error_cm": F.sum(F.abs(e)).over(w) * 100,
        }
    )
