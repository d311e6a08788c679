"""Non-overlapping peak events and how well a forecast meets them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.blocks import halo_window, hour_number

STATION = ("station_id",)


def select_events(
    df: DataFrame, score: str, count: int = 10, separation_hours: int = 24, ts: str = "ts", keys: Sequence[str] = STATION
) -> DataFrame:
    """Greedy pick per key: highest score first, each at least ``separation_hours`` from all picked before.

    Rows are hourly and unique per key; equal scores go to the later hour. An accepted event rules out at
    most ``2 * separation - 1`` hours, so event number i lies among the ``(i - 1)(2 * separation - 1) + 1``
    highest scores: only that many rows per key are kept, first of every block of hours and then of the key, and
    the pick runs over this short list. Nothing that could be chosen is dropped.
    """
    enough = (count - 1) * (2 * separation_hours - 1) + 1
    best = [F.col(score).desc(), F.col(ts).desc()]
    ranked = Window.partitionBy(*keys).orderBy(*best)
    block = Window.partitionBy(*keys, F.floor(hour_number(ts) / (8 * enough))).orderBy(*best)
    short = (
        df.where(F.col(score).isNotNull())
        .select(*keys, ts, score)
        .withColumn("_rank", F.row_number().over(block))
        .where(F.col("_rank") <= enough)
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= enough)
    )
    entry = F.struct("_rank", hour_number(ts).alias("_h"), F.col(ts).alias("_t"), F.col(score).alias("_s"))
    rows = short.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    kind = f"array<struct<_rank:int,_h:bigint,_t:{df.schema[ts].dataType.simpleString()},_s:{df.schema[score].dataType.simpleString()}>>"
    picked = F.aggregate(
        "_rows",
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) < count) & F.forall(acc, lambda p: F.abs(p["_h"] - x["_h"]) >= separation_hours),
            F.concat(acc, F.array(x)),
        ).otherwise(acc),
    )
    chosen = rows.select(*keys, F.posexplode(picked).alias("_place", "_pick"))
    return chosen.select(*keys, F.col("_pick._t").alias(ts), F.col("_pick._s").alias(score), (F.col("_place") + 1).alias("event"))


def forecast_window_scores(
    df: DataFrame, hours: int, value: str = "surge_m", ts: str = "ts", keys: Sequence[str] = STATION
) -> DataFrame:
    """``score`` of each rolling origin: the largest absolute level of its ``hours`` long window, if complete."""
    def largest(w):
        frame = w.rangeBetween(0, hours - 1)
        return F.when(F.count(value).over(frame) == hours, F.max(F.abs(value)).over(frame))

    scored = halo_window(df.withColumn("_h", hour_number(ts)), keys, "_h", {"score": largest}, after=hours - 1)
    return scored.where(F.col("score").isNotNull()).drop("_h")


def window_search(peaks: DataFrame, series: DataFrame, hours: int = 12, ts: str = "ts", keys: Sequence[str] = STATION) -> DataFrame:
    """Hourly rows within ``hours`` of each peak; the window is listed hour by hour and equi-joined.

    Result: the peak's columns (its time as ``peak_ts``), the row's columns and ``offset_h``.
    """
    listed = peaks.withColumnRenamed(ts, "peak_ts").withColumn(
        "offset_h", F.explode(F.sequence(F.lit(-hours), F.lit(hours)))
    )
    listed = listed.withColumn(ts, F.col("peak_ts") + F.make_interval(hours=F.col("offset_h")))
    return listed.join(series, [*keys, ts])


def peak_event_table(
    df: DataFrame, count: int = 10, separation_hours: int = 24, search_hours: int = 12, ts: str = "ts",
    keys: Sequence[str] = STATION,
) -> DataFrame:
    """Each observed peak with the forecast there, its error, and the nearby largest forecast's timing error."""
    pairs = df.where(F.col("observed_m").isNotNull() & F.col("predicted_m").isNotNull())
    scored = pairs.withColumn("_score", F.abs("observed_m"))
    peaks = select_events(scored, "_score", count, separation_hours, ts, keys).drop("_score")
    around = window_search(peaks, pairs.select(*keys, ts, "observed_m", "predicted_m"), search_hours, ts, keys)
    local = F.max_by("offset_h", F.struct(F.abs("predicted_m"), -F.col("offset_h")))
    at_peak = F.col("offset_h") == 0
    table = around.groupBy(*keys, "event", "peak_ts").agg(
        F.max(F.when(at_peak, F.col("observed_m"))).alias("observed_peak_m"),
        F.max(F.when(at_peak, F.col("predicted_m"))).alias("prediction_at_peak_m"),
        local.cast("double").alias("timing_error_hours"),
    )
    return table.withColumns(
        {
            "peak_error_cm": (F.col("prediction_at_peak_m") - F.col("observed_peak_m")) * 100,
            "underestimated": F.abs("prediction_at_peak_m") < F.abs("observed_peak_m"),
        }
    )


def peak_event_summary(table: DataFrame, keys: Sequence[str] = STATION) -> DataFrame:
    """Mean absolute peak and timing error, and the highest event on its own."""
    top = F.col("event") == 1
    return table.groupBy(*keys).agg(
        F.count("*").alias("event_count"),
        F.avg(F.abs("peak_error_cm")).alias("mean_absolute_peak_error_cm"),
        F.avg(F.abs("timing_error_hours")).alias("mean_absolute_timing_error_hours"),
        F.max(F.when(top, F.col("observed_peak_m"))).alias("maximum_observed_m"),
        F.max(F.when(top, F.col("prediction_at_peak_m"))).alias("prediction_at_maximum_m"),
        F.max(F.when(top, F.col("peak_error_cm"))).alias("maximum_peak_error_cm"),
        F.max(F.when(top, F.col("underestimated"))).alias("maximum_underestimated"),
    )
