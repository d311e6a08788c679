"""Cleaning gauge records: duplicates, sentinels, flags, ranges, outliers, channel choice, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import col, finite
from tidewright.functions.quantiles import exact_quantiles, with_quantiles
from tidewright.functions.storage import stored
from tidewright.operators.series import _previous_interval

# Missing-value sentinels, and quality and use flags that reject a record. The strict profile
# also rejects quality flags 1 and 2.
SENTINELS = (-99.0, -999.0, -9999.0, 9999.0, 99999.0)
BAD_QC = ("3", "4", "5", "9", "bad", "fail", "failed", "invalid")
BAD_QC_STRICT = ("1", "2", "3", "4", "5", "9", "bad", "fail", "failed", "invalid")
BAD_USE = ("0", "false", "f", "no", "n", "reject", "invalid")

# Metres per input unit.
UNIT_FACTORS = {"m": 1.0, "metre": 1.0, "meter": 1.0, "cm": 0.01, "mm": 0.001}

CANONICAL = ("ts", "water_level", "qc_flag", "use_flag", "source", "sensor", "station_id", "tide_estimate")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``, with ``copies`` rows seen.

    Rows collapse on the map side into one struct per key, so a key with very many copies costs no more
    than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row"), F.count("*").alias("copies")).select(*keys, "_row.*", "copies")


def drop_sentinels(df: DataFrame, value: str, sentinels: Sequence[float] = SENTINELS) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.col(value).isin(list(sentinels)))


def flagged_bad(
    qc: str | Column = "qc_flag", use: str | Column = "use_flag", bad_qc: Sequence[str] = BAD_QC,
    bad_use: Sequence[str] = BAD_USE,
) -> Column:
    """True when the quality or the use flag (trimmed, any case) rejects the record; null flags do not."""
    def hit(c, bad):
        return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(list(bad)), F.lit(False))

    return hit(qc, bad_qc) | hit(use, bad_use)


def flag_filter(df: DataFrame, bad_qc: Sequence[str] = BAD_QC, bad_use: Sequence[str] = BAD_USE) -> DataFrame:
    return df.where(~flagged_bad(bad_qc=bad_qc, bad_use=bad_use))


def use_flag_filter(df: DataFrame, keys: Sequence[str] = ("station_id",), use: str = "use_flag") -> DataFrame:
    """Drop records whose numeric use flag is 0; null counts as usable.

    A key without any use flag keeps all its rows, which the same test gives without looking at the group.
    """
    return df.where(F.coalesce(F.expr(f"try_cast({use} AS DOUBLE)"), F.lit(1.0)) != 0)


def range_filter(df: DataFrame, value: str, limit: float = 20.0) -> DataFrame:
    return df.where(F.abs(value) <= limit)


def mad_filter(df: DataFrame, value: str, keys: Sequence[str] = ("station_id",), threshold: float = 15.0) -> DataFrame:
    """Keep rows whose robust z-score (0.6745 x deviation / MAD) stays within ``threshold``; MAD 0 keeps all."""
    levels = stored(df.select(*keys, finite(value).alias("_level")), "mad-levels")
    median = exact_quantiles(levels, keys, {"_median": ("_level", 0.5)})
    spread = exact_quantiles(levels.join(median, list(keys)), keys, {"_mad": (F.abs(F.col("_level") - F.col("_median")), 0.5)})
    judged = df.join(median.join(spread, list(keys)), list(keys), "left")
    keep = F.col("_mad").isNull() | (F.col("_mad") == 0) | (
        0.6745 * F.abs(F.col(value) - F.col("_median")) / F.nullif(F.col("_mad"), F.lit(0.0)) <= threshold
    )
    return judged.where(keep & F.col(value).isNotNull()).drop("_median", "_mad")


def iqr_mask(df: DataFrame, value: str, keys: Sequence[str] = ("station_id",), k: float = 5.0) -> DataFrame:
    """Null out values beyond k interquartile ranges from the quartiles; rows stay."""
    q = with_quantiles(df, keys, {"_q1": (value, 0.25), "_q3": (value, 0.75)})
    reach = k * (F.col("_q3") - F.col("_q1"))
    inside = F.col(value).between(F.col("_q1") - reach, F.col("_q3") + reach)
    return q.withColumn(value, F.when(inside, F.col(value))).drop("_q1", "_q3")


def canonical_gauge(df: DataFrame, unit: str = "m", source: str = "gauge", station: str | Column | None = None) -> DataFrame:
    """Fixed column order, times and numbers coerced (bad becomes null), levels in metres."""
    factor = UNIT_FACTORS.get(unit.strip().lower())
    if factor is None:
        raise ValueError(f"unsupported water-level unit {unit!r}; expected m, cm or mm")
    have = set(df.columns)

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in have else F.lit(None).cast("string")

    def level(name: str) -> Column:
        number = F.expr(f"try_cast({name} AS DOUBLE)") if name in have else F.lit(None).cast("double")
        return F.when(~F.isnan(number), number * factor)

    when = F.col("ts") if dict(df.dtypes)["ts"] == "timestamp" else F.expr("try_cast(ts AS TIMESTAMP)")
    name = text("station_id") if station is None else (F.lit(station) if isinstance(station, str) else station)
    return df.select(
        when.alias("ts"), level("water_level").alias("water_level"), text("qc_flag").alias("qc_flag"),
        text("use_flag").alias("use_flag"), F.lit(source).alias("source"),
        F.coalesce(text("sensor"), F.lit("default")).alias("sensor"), name.alias("station_id"),
        level("tide_estimate").alias("tide_estimate"),
    )


def union_sensors(frames: dict[str, DataFrame]) -> DataFrame:
    """One station read from several sensor files: rows tagged with their sensor and stacked."""
    if not frames:
        raise ValueError("at least one sensor is required")
    stacked = None
    for sensor, frame in frames.items():
        tagged = frame.withColumn("sensor", F.lit(sensor))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    return stacked


def tag_rejects(
    df: DataFrame, order: Sequence[str] = ("seq",), limit: float = 20.0, bad_qc: Sequence[str] = BAD_QC,
    bad_use: Sequence[str] = BAD_USE, value: str = "water_level",
) -> DataFrame:
    """First record per (station, sensor, time) with ``reject_reason`` (null = good) and ``copies``."""
    first = dedupe_first(df.where(F.col("ts").isNotNull()), ["station_id", "sensor", "ts"], order)
    reason = (
        F.when(F.col(value).isNull(), F.lit("missing"))
        .when(flagged_bad(bad_qc=bad_qc, bad_use=bad_use), F.lit("quality_flag"))
        .when(F.abs(value) > limit, F.lit("unreasonable"))
    )
    return first.withColumn("reject_reason", reason)


def sensor_scores(
    df: DataFrame, value: str = "water_level", keys: Sequence[str] = ("station_id", "sensor"), medians: bool = True
) -> DataFrame:
    """Completeness, continuity and score of every channel of clean records; their medians cost further passes."""
    stepped = _previous_interval(df.select(*keys, "ts", value), keys, "ts")
    gap = F.col("gap_hours")
    span = F.greatest(
        F.lit(1.0), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9 + 1
    )
    table = stepped.groupBy(*keys).agg(
        F.count("*").alias("valid_records"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.least(F.lit(1.0), F.count("*") / span).alias("completeness"),
        F.coalesce(F.avg((gap <= 1.5).cast("double")), F.lit(1.0)).alias("hourly_continuity"),
        F.count_if(gap > 1.5).alias("non_hourly_gaps"),
        F.min(value).alias("minimum_m"),
        F.max(value).alias("maximum_m"),
    )
    table = table.withColumn("score", F.round(0.7 * F.col("completeness") + 0.3 * F.col("hourly_continuity"), 6))
    return table.join(exact_quantiles(df, keys, {"median_m": (value, 0.5)}), list(keys)) if medians else table


def select_channel(scored: DataFrame, station: Sequence[str] = ("station_id",)) -> DataFrame:
    """Best channel per station by score, then record count, then name."""
    best = F.min_by("sensor", F.struct(-F.col("score"), -F.col("valid_records"), F.col("sensor")))
    return scored.groupBy(*station).agg(best.alias("sensor"))


def quality_control(df: DataFrame, order: Sequence[str] = ("seq",), limit: float = 20.0,
                    bad_qc: Sequence[str] = BAD_QC, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Clean records of each station's best channel, and a report of what every step removed.

    A station without any good record is absent from the clean rows and has ``final_record_count`` 0; when ``strict``, it
    fails the job that reads the report.
    """
    tagged = tag_rejects(df, order, limit, bad_qc)
    good = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason", "copies")
    chosen = select_channel(sensor_scores(good, medians=False))
    clean = good.join(chosen, ["station_id", "sensor"])
    reason = F.col("reject_reason")
    removed = tagged.groupBy("station_id").agg(
        F.sum("copies").alias("dated_records"),
        F.sum(F.col("copies") - 1).alias("removed_duplicate_count"),
        F.count_if(reason == "missing").alias("removed_missing_count"),
        F.count_if(reason == "quality_flag").alias("removed_quality_flag_count"),
        F.count_if(reason == "unreasonable").alias("removed_unreasonable_count"),
    )
    raw = df.groupBy("station_id").agg(
        F.count("*").alias("raw_record_count"), F.count_if(F.col("ts").isNull()).alias("invalid_datetime_count")
    )
    expected = F.greatest(F.lit(1), F.floor((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / 3600) + 1)
    final = clean.groupBy("station_id").agg(
        F.count("*").alias("final_record_count"),
        F.max("sensor").alias("selected_sensor"),
        F.greatest(F.lit(0.0), 1.0 - F.count("*") / expected).alias("missing_rate"),
    )
    report = (
        raw.join(removed.drop("dated_records"), "station_id", "left").join(final, "station_id", "left")
        .fillna(0, ["removed_duplicate_count", "removed_missing_count", "removed_quality_flag_count",
                    "removed_unreasonable_count", "final_record_count"])
    )
    if strict:
        nothing = F.raise_error(F.concat(F.lit("quality control left no record of station "), F.col("station_id").cast("string"))).cast("boolean")
        report = report.where(F.when(F.col("final_record_count") == 0, nothing).otherwise(F.lit(True)))
    return clean, report


def restrict_years(df: DataFrame, first: int, last: int, ts: str = "ts") -> DataFrame:
    """Rows of the calendar years first..last, written as a time range so that it reaches the scan."""
    return time_slice(df, f"{first:04d}-01-01 00:00:00", f"{last + 1:04d}-01-01 00:00:00", ts, end_inclusive=False)


def time_slice(df: DataFrame, start: str, end: str, ts: str = "ts", end_inclusive: bool = True) -> DataFrame:
    """Rows in a time range; bounds take the column's own type, so Parquet and JDBC scans receive them."""
    kind = df.schema[ts].dataType
    upper = F.lit(end).cast(kind)
    stop = F.col(ts) <= upper if end_inclusive else F.col(ts) < upper
    return df.where((F.col(ts) >= F.lit(start).cast(kind)) & stop)


def locked_year_guard(df: DataFrame, last_year: int, ts: str = "ts") -> DataFrame:
    """Pass rows through, failing the job on the first row later than the allowed year."""
    late = F.raise_error(F.concat(F.lit("locked period entered: "), F.col(ts).cast("string"))).cast("boolean")
    return df.where(F.when(F.year(ts) > last_year, late).otherwise(F.lit(True)))


def to_utc(df: DataFrame, zone: str, ts: str = "ts") -> DataFrame:
    """Local wall time to UTC; unparseable, non-existent and ambiguous local times fail the job."""
    local = F.col(ts).cast("timestamp")
    utc = F.to_utc_timestamp(local, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    lost = local.isNull() | (F.from_utc_timestamp(utc, zone) != local)
    twice = (F.from_utc_timestamp(utc + hour, zone) == local) | (F.from_utc_timestamp(utc - hour, zone) == local)
    bad = F.raise_error(F.concat(F.lit("not a single local time: "), F.coalesce(F.col(ts).cast("string"), F.lit("null"))))
    return df.withColumn(ts, F.when(lost | twice, bad.cast("timestamp")).otherwise(utc))


def array_health(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per column: total, finite, NaN, infinite and null counts with extremes and mean of the finite part."""
    items = F.array(*[F.struct(F.lit(v).alias("array"), F.col(v).cast("double").alias("x")) for v in values])
    x = F.col("x")
    inf = F.abs(x) == float("inf")
    ok = F.when(~F.isnan(x) & ~inf, x)
    return df.select(*keys, F.inline(items)).groupBy(*keys, "array").agg(
        F.count("*").alias("total"), F.count(ok).alias("finite"), F.count_if(F.isnan(x)).alias("nan"),
        F.count_if(inf).alias("inf"), F.count_if(x.isNull()).alias("null"), F.min(ok).alias("min"),
        F.max(ok).alias("max"), F.avg(ok).alias("mean"),
    )


def require_healthy(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Rows pass unchanged; the first null, NaN or infinite value fails the job."""
    good = F.lit(True)
    for v in values:
        x = F.col(v).cast("double")
        good = good & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return df.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("non-finite value")).cast("boolean")))
