"""Bringing fields, levels and forecasts onto common hours and origins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import finite
from tidewright.operators.quality import dedupe_first
from tidewright.operators.series import contiguous_segments


def _first_known(surge: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """The first row of every station and hour in ``order`` (else in reading order), where its level is known."""
    numbered = surge if order else surge.withColumn("_read", F.monotonically_increasing_id())
    first = dedupe_first(numbered, ["station_id", "ts"], list(order) or ["_read"]).drop("copies", "_read")
    return first.where(finite(value).isNotNull()).select(*surge.columns)


def align_hourly(field_hours: DataFrame, surge: DataFrame, value: str = "surge_m", order: Sequence[str] = ()) -> DataFrame:
    """Inner join on the exact hour; of repeated hours the first counts, and an hour whose first level is missing is out."""
    return _first_known(surge, value, order).join(field_hours.dropDuplicates(["ts"]), "ts")


def alignment_report(field_hours: DataFrame, surge: DataFrame, value: str = "surge_m", order: Sequence[str] = ()) -> DataFrame:
    """Per station: range of either side, matched hours, hours missing on each side, common range and contiguous segments."""
    hours = field_hours.select("ts").distinct()
    known = _first_known(surge, value, order).select("station_id", "ts")
    tagged = known.join(hours.withColumn("_in_field", F.lit(1)), "ts", "left")
    total = hours.agg(F.count("*").alias("_hours"), F.min("ts").alias("field_start"), F.max("ts").alias("field_end"))
    base = tagged.groupBy("station_id").agg(
        F.min("ts").alias("surge_start"), F.max("ts").alias("surge_end"),
        F.count("_in_field").alias("matched_times"),
        F.count_if(F.col("_in_field").isNull()).alias("missing_field_times"),
        F.min(F.when(F.col("_in_field") == 1, F.col("ts"))).alias("common_start"),
        F.max(F.when(F.col("_in_field") == 1, F.col("ts"))).alias("common_end"),
    )
    matched = tagged.where(F.col("_in_field") == 1).select("station_id", "ts")
    runs = contiguous_segments(matched).groupBy("station_id").agg(F.max("segment").alias("continuous_segments"))
    return (
        base.crossJoin(F.broadcast(total))  # one row
        .withColumn("missing_surge_times", F.col("_hours") - F.col("matched_times"))
        .drop("_hours").join(runs, "station_id", "left").fillna(0, ["continuous_segments"])
    )


def left_fill_align(surge: DataFrame, field: DataFrame) -> DataFrame:
    """Every level hour kept; field columns are null where the field has no such hour."""
    return surge.join(field, "ts", "left")


def matched_by_year(aligned: DataFrame, field_column: str) -> DataFrame:
    """Rows and matched rows per station and year of a left-filled alignment."""
    return aligned.groupBy("station_id", F.year("ts").alias("year")).agg(
        F.count("*").alias("hours"), F.count(field_column).alias("matched_hours")
    )


def exact_grid_align(field: DataFrame, variables: Sequence[str] = ("U10", "V10", "MSL")) -> DataFrame:
    """One row per (time, cell) with a column per variable; a cell that lacks a variable fails the job.

    Rows are placed by time, which serves this grouping and the gradients that follow with one shuffle.
    """
    present = [F.count_if(F.col("variable") == v).alias(f"_n{i}") for i, v in enumerate(variables)]
    values = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v.lower()) for v in variables]
    wide = field.repartition("ts").groupBy("ts", "lat_idx", "lon_idx", "latitude", "longitude").agg(*values, *present)
    whole = F.lit(True)
    for i in range(len(variables)):
        whole = whole & (F.col(f"_n{i}") == 1)
    broken = F.raise_error(F.lit("variables do not share one time/latitude/longitude grid")).cast("boolean")
    return wide.where(F.when(whole, F.lit(True)).otherwise(broken)).drop(*[f"_n{i}" for i in range(len(variables))])


def join_predictions(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("origin",)) -> DataFrame:
    """Join two prediction tables that must hold the same, unique origins; any difference fails the job."""
    a = left.withColumn("_left", F.lit(1))
    b = right.withColumn("_right", F.lit(1))
    unique_a = a.groupBy(*keys).agg(F.count("*").alias("_na"))
    unique_b = b.groupBy(*keys).agg(F.count("*").alias("_nb"))
    counted = unique_a.join(unique_b, list(keys), "full_outer")
    same = F.coalesce((F.col("_na") == 1) & (F.col("_nb") == 1), F.lit(False))
    checked = counted.where(
        F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("origins differ or repeat")).cast("boolean"))
    ).select(*keys)
    return checked.join(a.drop("_left"), list(keys)).join(b.drop("_right"), list(keys))


def reindex_strict(expected: DataFrame, df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``df`` on exactly the expected keys; a hole fails the job."""
    joined = expected.select(*keys).join(df, list(keys), "left")
    hole = F.raise_error(F.lit("expected origin has no value"))
    return joined.withColumn(value, F.when(F.col(value).isNull(), hole.cast("double")).otherwise(F.col(value)))


def direct_vs_recursive(direct: DataFrame, rolling: DataFrame, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """RMSE (cm) of direct and rolling forecasts on matched origins (direct origin + 1 h = rolling origin).

    Both inputs: keys, origin, lead_hours, observed_m, model, predicted_m. Observations that disagree fail
    the job.
    """
    shifted = direct.withColumn("origin", F.col("origin") + F.expr("INTERVAL 1 HOUR"))
    match = [*keys, "origin", "lead_hours"]
    shared = rolling.select(*match, F.col("observed_m").alias("_seen")).dropDuplicates(match)
    paired = shifted.join(shared, match)
    disagree = F.abs(F.col("observed_m") - F.col("_seen")) > 1e-8 + 1e-5 * F.abs("_seen")
    mine = paired.where(
        F.when(disagree, F.raise_error(F.lit("targets do not align")).cast("boolean")).otherwise(F.lit(True))
    ).select(*match, "observed_m", F.concat(F.lit("direct_"), "model").alias("method"), "predicted_m")
    kept = shifted.select(*match).distinct()
    other = rolling.join(kept, match, "left_semi").select(
        *match, "observed_m", F.concat(F.lit("rolling_"), "model").alias("method"), "predicted_m"
    )
    e = (F.col("predicted_m") - F.col("observed_m")) * 100
    return mine.unionByName(other).groupBy(*keys, "lead_hours", "method").agg(
        F.count("*").alias("valid_samples"), F.sqrt(F.avg(e * e)).alias("rmse_cm")
    )


def hours_only_in(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("ts",)) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def common_hours(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("ts",)) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")


def merge_evidence(raw: DataFrame, derived: DataFrame, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Raw results first; stations without any are filled from the derived table."""
    return raw.unionByName(
        derived.join(raw.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True
    )


def dedupe_field(field: DataFrame, order: Column | str) -> DataFrame:
    """First value per (time, variable, cell) in ``order``."""
    cell = ["ts", "variable", "lat_idx", "lon_idx"]
    rest = [c for c in field.columns if c not in cell]
    return field.groupBy(*cell).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*cell, "_row.*")
