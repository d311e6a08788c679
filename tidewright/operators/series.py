"""Hourly series: dense axis, gaps, runs, trailing and future windows, autocorrelation on the axis.

Inputs hold one row per ``(keys, ts)`` on whole hours. Operators that say *dense* want the full axis
(:func:`hourly_grid`); the others work on physical rows, where a missing hour is an absent row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.blocks import (
    BLOCK_HOURS,
    at_offset,
    global_positions,
    halo_window,
    hour_number,
    hour_timestamp,
    nearest_known,
    sessions,
)
from tidewright.functions.columns import col, finite

STATION = ("station_id",)
SECONDS_PER_HOUR = 3600.0


def hourly_mean(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, name: str, scale: float = 1.0
) -> DataFrame:
    """Mean per hour. Sums run in decimal, so the result does not depend on row order or retries."""
    exact = F.sum(F.col(value).cast("decimal(18,4)")).cast("double")
    return (
        df.groupBy(*keys, F.date_trunc("hour", ts).alias("ts"))
        .agg((exact / F.count(value) / scale).alias(name))
    )


def hourly_grid(df: DataFrame, keys: Sequence[str] = STATION, ts: str = "ts", value: str = "surge_m") -> DataFrame:
    """Dense hourly axis from each key's first to last hour; missing hours null, ``qc_valid`` tells them."""
    # one generated range per 4-week block keeps the explode spread out even for a very long series
    hour = hour_number(ts)
    span = df.groupBy(*keys).agg(F.min(hour).alias("_from"), F.max(hour).alias("_to"))
    blocks = span.withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("_from") / BLOCK_HOURS), F.floor(F.col("_to") / BLOCK_HOURS)))
    )
    axis = blocks.select(
        *keys,
        F.explode(
            F.sequence(
                F.greatest("_from", F.col("_block") * BLOCK_HOURS),
                F.least("_to", (F.col("_block") + 1) * BLOCK_HOURS - 1),
            )
        ).alias("_hour"),
    ).select(*keys, hour_timestamp("_hour").alias(ts))
    return axis.join(df, [*keys, ts], "left").withColumn("qc_valid", F.col(value).isNotNull())


def gap_report(df: DataFrame, keys: Sequence[str] = STATION, ts: str = "ts") -> DataFrame:
    """Per key: rows, non-hourly intervals, gaps over 1.5 h, missing hours and missing rate."""
    step = _previous_interval(df.select(*keys, ts), keys, ts)
    return step.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if(F.abs(F.col("gap_hours") - 1.0) > 1e-6).alias("non_hourly"),
        F.count_if(F.col("gap_hours") > 1.5).alias("gaps"),
        (F.max(hour_number(ts)) - F.min(hour_number(ts)) + 1 - F.count("*")).alias("missing_hours"),
        F.greatest(
            F.lit(0.0), 1.0 - F.count("*") / (F.max(hour_number(ts)) - F.min(hour_number(ts)) + 1)
        ).alias("missing_rate"),
    )


def _previous_interval(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Hours since the previous row of the key, over day blocks with a carried edge."""
    blocked = df.withColumn("_block", F.floor(hour_number(ts) / BLOCK_HOURS))
    seconds = F.unix_micros(ts) / 1e6
    inner = Window.partitionBy(*keys, "_block").orderBy(ts)
    edges = blocked.groupBy(*keys, "_block").agg(F.max(seconds).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block")
    edges = edges.select(*keys, "_block", F.lag("_last").over(before).alias("_carry"))
    return (
        blocked.withColumn("_prev", F.lag(seconds).over(inner))
        .join(edges, [*keys, "_block"])
        .withColumn("gap_hours", (seconds - F.coalesce("_prev", "_carry")) / 3600.0)
        .drop("_block", "_prev", "_carry")
    )


def contiguous_segments(
    df: DataFrame, keys: Sequence[str] = STATION, ts: str = "ts", gap_hours: float = 1.0
) -> DataFrame:
    """Label runs whose rows follow each other by at most ``gap_hours``."""
    return sessions(df, keys, ts, int(gap_hours * 3600), BLOCK_HOURS * 3600)


def segment_lengths(segments: DataFrame, keys: Sequence[str] = STATION, ts: str = "ts") -> DataFrame:
    return segments.groupBy(*keys, "segment").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("hours")
    )


def history_array(
    df: DataFrame, n: int = 24, value: str = "surge_m", keys: Sequence[str] = STATION, ts: str = "ts"
) -> DataFrame:
    """Previous ``n`` hourly values, oldest first; null unless all ``n`` are present."""
    def collected(w):
        pairs = F.collect_list(F.when(F.col(value).isNotNull(), F.struct("_h", value))).over(w.rangeBetween(-n, -1))
        return F.when(F.size(pairs) == n, F.transform(F.array_sort(pairs), lambda p: p[value]))

    return halo_window(
        df.withColumn("_h", hour_number(ts)), keys, "_h", {"history": collected}, before=n
    ).drop("_h")


def differences(
    df: DataFrame, lags: Sequence[int] = (1,), value: str = "surge_m", prefix: str = "change",
    keys: Sequence[str] = STATION, ts: str = "ts",
) -> DataFrame:
    """Change against exactly ``lag`` hours earlier; null when that hour is missing."""
    out = halo_window(
        df.withColumn("_h", hour_number(ts)), keys, "_h",
        {f"_at{k}": at_offset(value, -k) for k in lags}, before=max(lags),
    )
    return out.withColumns({f"{prefix}_{k}h": F.col(value) - F.col(f"_at{k}") for k in lags}).drop(
        "_h", *[f"_at{k}" for k in lags]
    )


def window_sum(value: str | Column, first: int, last: int, scale: float = SECONDS_PER_HOUR):
    """Integral over hours ``first..last`` around a row, null unless every hour has a value."""
    def make(w):
        frame = w.rangeBetween(first, last)
        return F.when(F.count(value).over(frame) == last - first + 1, F.sum(value).over(frame) * scale)

    return make


def accumulate(
    df: DataFrame, hours: Sequence[int] = (3, 6, 12, 24), value: str = "surge_m", prefix: str = "past",
    keys: Sequence[str] = STATION, ts: str = "ts",
) -> DataFrame:
    """Trailing integrals (sum x 3600 s) ending at each row; incomplete windows are null."""
    return halo_window(
        df.withColumn("_h", hour_number(ts)), keys, "_h",
        {f"{prefix}_{n}h": window_sum(value, -n + 1, 0) for n in hours}, before=max(hours) - 1,
    ).drop("_h")


def future_accumulate(
    df: DataFrame, lead: int, value: str = "surge_m", name: str = "future_sum",
    keys: Sequence[str] = STATION, ts: str = "ts",
) -> DataFrame:
    """Integral over the next ``lead`` hours, t+1 to t+lead."""
    return halo_window(
        df.withColumn("_h", hour_number(ts)), keys, "_h", {name: window_sum(value, 1, lead)}, after=lead
    ).drop("_h")


def future_extremes(
    df: DataFrame, lead: int, low: str, high: str, keys: Sequence[str] = STATION, ts: str = "ts"
) -> DataFrame:
    """Minimum of ``low`` and maximum of ``high`` over t+1..t+lead with the hours until each first occurs."""
    def complete(w, column):
        return F.count(column).over(w.rangeBetween(1, lead)) == lead

    def lowest(w):
        pair = F.min(F.when(F.col(low).isNotNull(), F.struct(F.col(low).alias("v"), F.col("_h").alias("h"))))
        return F.when(complete(w, low), pair.over(w.rangeBetween(1, lead)))

    def highest(w):
        pair = F.max(F.when(F.col(high).isNotNull(), F.struct(F.col(high).alias("v"), (-F.col("_h")).alias("h"))))
        return F.when(complete(w, high), pair.over(w.rangeBetween(1, lead)))

    out = halo_window(
        df.withColumn("_h", hour_number(ts)), keys, "_h", {"_low": lowest, "_high": highest}, after=lead
    )
    return out.withColumns(
        {
            "future_min": F.col("_low.v"),
            "future_min_offset_h": F.col("_low.h") - F.col("_h"),
            "future_max": F.col("_high.v"),
            "future_max_offset_h": -F.col("_high.h") - F.col("_h"),
        }
    ).drop("_h", "_low", "_high")


def signed_impulse(
    df: DataFrame, lead: int, value: str, keys: Sequence[str] = STATION, ts: str = "ts"
) -> DataFrame:
    """Integrals of the positive and of the negative part over t+1..t+lead."""
    v = F.col(value)
    parts = df.withColumn("_h", hour_number(ts)).withColumns(
        {"_pos": F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))), "_neg": F.when(v.isNotNull(), F.least(v, F.lit(0.0)))}
    )
    return halo_window(
        parts, keys, "_h",
        {"positive_impulse": window_sum("_pos", 1, lead), "negative_impulse": window_sum("_neg", 1, lead)},
        after=lead,
    ).drop("_h", "_pos", "_neg")


def interpolate_time(
    df: DataFrame, value: str, limit: int = 6, keys: Sequence[str] = STATION, ts: str = "ts", drop_deep: bool = False
) -> DataFrame:
    """Fill gaps on a dense axis linearly in time, at most ``limit`` points in from either side.

    Points before the first or after the last known value take that value, under the same limit. Column
    ``filled`` holds the result, null where a point is too deep inside a gap; ``drop_deep`` leaves such points out.
    """
    near = nearest_known(df.withColumn("_h", hour_number(ts)), keys, "_h", value)
    h, p, n = F.col("_h"), F.col("prev_index"), F.col("next_index")
    reach = (F.coalesce(h - p, F.lit(limit + 1)) <= limit) | (F.coalesce(n - h, F.lit(limit + 1)) <= limit)
    line = F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * ((h - p) / (n - p))
    filled = F.coalesce(
        F.col(value), F.when(reach, F.coalesce(line, F.col("prev_value"), F.col("next_value")))
    )
    out = near.withColumn("filled", filled).drop("_h", "prev_index", "prev_value", "next_index", "next_value")
    return out.where(F.col("filled").isNotNull()) if drop_deep else out


ACF_CHUNK = 1 << 15  # hours of a series that one task takes


def acf(
    df: DataFrame, max_lag: int = 168, value: str = "surge_m", trim_tail: bool = True,
    keys: Sequence[str] = STATION, ts: str = "ts",
) -> DataFrame:
    """Autocorrelation per lag over pairs ``(t, t - lag)`` where both values are known.

    ``trim_tail`` keeps the published definition, which also leaves out the last ``lag`` hours of the axis. No pair is
    ever a row: values, their squares and the mask of known hours are cross-correlated by FFT in padded blocks, whose
    spectra are added before the inverse. A series is cut into chunks that also get the ``max_lag`` hours before them,
    and the sums per lag of all chunks are added.
    """
    clean = df.select(*keys, hour_number(ts).alias("_h"), finite(value).alias("_v"))
    span = clean.groupBy(*keys).agg(F.max("_h").alias("_end"), F.avg("_v").alias("_mean"))
    # centring first keeps the sums of products numerically tame
    centred = clean.where(F.col("_v").isNotNull()).join(span, list(keys)).withColumn("_v", F.col("_v") - F.col("_mean")).drop("_mean")
    first, last = F.floor(F.col("_h") / ACF_CHUNK), F.floor((F.col("_h") + max_lag) / ACF_CHUNK)
    chunks = centred.withColumn("_chunk", F.explode(F.sequence(first, last)))
    names, block = list(keys), 1 << max(10, (4 * max_lag).bit_length())
    sums = [f"_s{i}" for i in range(6)]

    def fold(rows):
        chunk = rows["_chunk"][0].as_py() * ACF_CHUNK
        h, v = rows["_h"].to_numpy() - chunk + max_lag, rows["_v"].to_numpy()
        level, known = np.zeros(ACF_CHUNK + max_lag), np.zeros(ACF_CHUNK + max_lag)
        level[h], known[h] = v, 1.0
        late = level[max_lag:], known[max_lag:]  # the hours of this chunk; all hours may be the earlier of a pair
        end = rows["_end"][0].as_py() - chunk
        total = np.zeros((6, block + 1), complex)
        for at in range(0, ACF_CHUNK, block):
            if known[at + max_lag:at + block + max_lag].any():
                x, m = (np.fft.rfft(a[at:at + block], 2 * block) for a in late)
                y, k = (np.fft.rfft(a[at:at + block + max_lag], 2 * block) for a in (level, known))
                xx, yy = np.fft.rfft(late[0][at:at + block] ** 2, 2 * block), np.fft.rfft(level[at:at + block + max_lag] ** 2, 2 * block)
                total += np.conj([m, x, m, xx, m, x]) * [k, k, y, k, yy, y]
        found = np.fft.irfft(total, 2 * block)[:, max_lag::-1].copy()  # from lag 0 up
        if trim_tail:
            for lag in range(1, max_lag + 1):  # take off the pairs of the last ``lag`` hours
                t = np.arange(max(0, end - lag + 1), min(ACF_CHUNK, end + 1))
                if len(t):
                    x, m, y, k = late[0][t], late[1][t], level[t + max_lag - lag], known[t + max_lag - lag]
                    found[:, lag] -= [m @ k, x @ k, m @ y, x * x @ k, m @ (y * y), x @ y]
        head = {c: pa.array([rows[c][0].as_py()] * (max_lag + 1), rows[c].type) for c in names}
        return pa.table({**head, "lag_hours": pa.array(np.arange(max_lag + 1)), **{c: pa.array(found[i]) for i, c in enumerate(sums)}})

    schema = T.StructType([*(chunks.schema[k] for k in names), *T.StructType.fromDDL("lag_hours long, " + ", ".join(f"{c} double" for c in sums)).fields])
    parts = chunks.groupBy(*keys, "_chunk").applyInArrow(fold, schema)
    added = parts.groupBy(*keys, "lag_hours").agg(F.rint(F.sum("_s0")).cast("long").alias("pair_count"), *(F.sum(c).alias(c) for c in sums[1:]))
    count = F.col("pair_count")
    mean = {c: F.col(c) / count for c in sums[1:]}
    spread = [F.when(v > 1e-12 * square, v) for v, square in ((mean["_s3"] - mean["_s1"] ** 2, mean["_s3"]), (mean["_s4"] - mean["_s2"] ** 2, mean["_s4"]))]
    r = F.when(F.col("lag_hours") == 0, F.lit(1.0)).when(count >= 2, (mean["_s5"] - mean["_s1"] * mean["_s2"]) / F.sqrt(spread[0] * spread[1]))
    lags = span.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max_lag).cast("bigint"))).alias("lag_hours"))
    return lags.join(added, [*keys, "lag_hours"], "left").select(*keys, "lag_hours", r.alias("acf"), F.coalesce("pair_count", F.lit(0)).alias("pair_count"))


# Lags shown in the summary and the levels whose first crossing is reported.
ACF_LAGS = (1, 3, 6, 12, 24, 48, 72)
ACF_LEVELS = {"first_below_0_8_h": 0.8, "first_below_0_5_h": 0.5, "first_below_1_over_e_h": 0.36787944117144233}


def acf_summary(
    table: DataFrame, keys: Sequence[str] = STATION, lags: Sequence[int] = ACF_LAGS,
    levels: dict[str, float] = ACF_LEVELS,
) -> DataFrame:
    """One row per key: the ACF at chosen lags and the first lag below each level."""
    lag, r = F.col("lag_hours"), F.col("acf")
    return table.groupBy(*keys).agg(
        *[F.max(F.when(lag == k, r)).alias(f"acf_{k}h") for k in lags],
        *[F.min(F.when((lag > 0) & (r < level), lag)).alias(name) for name, level in levels.items()],
    )


def lagged_correlation(
    df: DataFrame, lags: Sequence[int], value: str, order: str = "ts", keys: Sequence[str] = STATION
) -> DataFrame:
    """Pearson r of the compacted non-null values against themselves ``lag`` positions later."""
    known = df.where(finite(value).isNotNull()).select(*keys, order, F.col(value).alias("_v"))
    placed = global_positions(known, keys, [order], F.floor(hour_number(order) / BLOCK_HOURS), "_pos")
    shifted = halo_window(
        placed, keys, "_pos", {f"_l{k}": at_offset("_v", -k) for k in lags}, before=max(lags), block=4096
    )
    aggregates = []
    for k in lags:
        x = F.when(F.col(f"_l{k}").isNotNull(), F.col("_v"))
        y = F.col(f"_l{k}")
        scale = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
        aggregates.append(F.when(F.count(y) >= 2, F.covar_pop(x, y) / scale).alias(f"r_lag_{k}"))
    return shifted.groupBy(*keys).agg(*aggregates)


def full_denominator_acf(
    df: DataFrame, lags: Sequence[int], value: str, order: str = "ts", keys: Sequence[str] = STATION
) -> DataFrame:
    """ACF whose denominator is the total sum of squares of the series."""
    known = df.where(finite(value).isNotNull()).select(*keys, order, F.col(value).alias("_v"))
    mean = known.groupBy(*keys).agg(F.avg("_v").alias("_mean"))
    placed = global_positions(known, keys, [order], F.floor(hour_number(order) / BLOCK_HOURS), "_pos")
    centred = placed.join(mean, list(keys)).withColumn("_v", F.col("_v") - F.col("_mean"))
    shifted = halo_window(
        centred, keys, "_pos", {f"_l{k}": at_offset("_v", -k) for k in lags}, before=max(lags), block=4096
    )
    total = F.nullif(F.sum(F.col("_v") * F.col("_v")), F.lit(0.0))
    return shifted.groupBy(*keys).agg(
        *[(F.sum(F.col("_v") * F.col(f"_l{k}")) / total).alias(f"acf_lag_{k}") for k in lags]
    )


def daily_max(df: DataFrame, value: str = "surge_m", keys: Sequence[str] = STATION, ts: str = "ts") -> DataFrame:
    """Highest value per calendar day; days without a value are absent."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.to_date(ts).alias("day"))
        .agg(F.max(value).alias("daily_max"))
    )
