"""Comparing models: skill against a reference, gains between pairs, ranks, pivots and station tables.

Metric tables hold one row per ``(keys, lead_hours, model)``. They are joined and ranked as they are; a
window over one (station, lead) sees as many rows as there are models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STATION = ("station_id",)


def reference_join(
    metrics: DataFrame, reference: str, keys: Sequence[str] = STATION, value: str = "rmse_cm",
    name: str = "reference_rmse_cm",
) -> DataFrame:
    """Attach the reference model's value at the same key and lead; groups without it are skipped."""
    base = metrics.where(F.col("model") == reference).select(*keys, "lead_hours", F.col(value).alias(name))
    return metrics.join(base, [*keys, "lead_hours"])


def skill_vs(
    metrics: DataFrame, reference: str, keys: Sequence[str] = STATION
) -> DataFrame:
    """Three skills against the reference: by MSE, by RMSE, and RMSE gain in percent; null where it is 0."""
    ratio = F.col("rmse_cm") / F.nullif("reference_rmse_cm", F.lit(0.0))
    return reference_join(metrics, reference, keys).withColumns(
        {"skill_mse": 1 - ratio * ratio, "skill_rmse": 1 - ratio, "gain_percent": 100 * (1 - ratio)}
    )


def pair_table(spark: SparkSession, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``comparison, reference_model, model`` rows from a short list."""
    return spark.createDataFrame(list(pairs), "comparison string, reference_model string, model string")


def incremental_value(metrics: DataFrame, pairs: DataFrame, keys: Sequence[str] = STATION) -> DataFrame:
    """RMSE gain (percent) and MSE skill of each listed (reference, model) pair by key and lead."""
    base = metrics.select(
        *keys, "lead_hours", F.col("model").alias("reference_model"), F.col("rmse_cm").alias("reference_rmse_cm")
    )
    mine = metrics.select(*keys, "lead_hours", "model", F.col("rmse_cm").alias("model_rmse_cm"))
    ratio = F.col("model_rmse_cm") / F.nullif("reference_rmse_cm", F.lit(0.0))
    return (
        mine.join(pairs, "model").join(base, [*keys, "lead_hours", "reference_model"])
        .withColumns({"gain_percent": 100 * (1 - ratio), "mse_skill": 1 - ratio * ratio})
    )


def method_change(metrics: DataFrame, pairs: DataFrame, leads: Sequence[int], keys: Sequence[str] = STATION) -> DataFrame:
    """Rolling against direct RMSE in percent; ``pairs`` names the direct model as reference."""
    chosen = incremental_value(metrics.where(F.col("lead_hours").isin(list(leads))), pairs, keys)
    return chosen.select(
        *keys, "lead_hours", "comparison", F.col("reference_rmse_cm").alias("direct_rmse_cm"),
        F.col("model_rmse_cm").alias("rolling_rmse_cm"),
        (100 * (F.col("model_rmse_cm") / F.nullif("reference_rmse_cm", F.lit(0.0)) - 1)).alias(
            "rolling_minus_direct_percent"
        ),
    )


def extreme_compare(metrics: DataFrame, reference: str, keys: Sequence[str] = STATION) -> DataFrame:
    """Top-5% and rapid-rise RMSE with skill, threshold, count and rank per condition."""
    conditions = F.array(
        F.struct(
            F.lit("top5_absolute_surge").alias("condition"), F.col("top5_rmse_cm").alias("_rmse"),
            F.col("top5_threshold_cm").alias("threshold"), F.col("top5_n").alias("n"),
        ),
        F.struct(
            F.lit("rapid_rise").alias("condition"), F.col("rapid_rise_rmse_cm").alias("_rmse"),
            F.col("rapid_rise_threshold_cm_per_hour").alias("threshold"), F.col("rapid_rise_n").alias("n"),
        ),
    )
    long = metrics.select(*keys, "lead_hours", "model", F.inline(conditions)).withColumnRenamed("_rmse", "rmse_cm")
    joined = skill_vs(long, reference, [*keys, "condition"]) 
    return rank_models(joined, [*keys, "lead_hours", "condition"]).select(
        *keys, "lead_hours", "condition", "model", "rmse_cm", "reference_rmse_cm", "skill_rmse", "threshold", "n",
        "rank_by_rmse",
    )


def rank_models(metrics: DataFrame, by: Sequence[str], value: str = "rmse_cm", name: str = "rank_by_rmse") -> DataFrame:
    """Rank within each group, equal values sharing the lowest rank."""
    return metrics.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(value)))


def best_by_lead(metrics: DataFrame, keys: Sequence[str] = STATION, value: str = "rmse_cm") -> DataFrame:
    """Lowest-RMSE model per lead; equal values go to the first name."""
    return metrics.groupBy(*keys, "lead_hours").agg(
        F.min_by("model", F.struct(value, "model")).alias("best_model"), F.min(value).alias(f"best_{value}")
    )


def persistence_decay(metrics: DataFrame, keys: Sequence[str] = STATION, model: str = "persistence") -> DataFrame:
    """The reference model's scores by station and lead."""
    return metrics.where(F.col("model") == model).select(
        *keys, "lead_hours", "n", "rmse_cm", "rrmse_percent", "pearson_r", "r2"
    )


def rollout_gain(metrics: DataFrame, base: str, tuned: str, keys: Sequence[str] = STATION) -> DataFrame:
    """100 x (1 - tuned / base) by lead."""
    rmse = F.col("rmse_cm")
    wide = metrics.where(F.col("model").isin(base, tuned)).groupBy(*keys, "lead_hours").agg(
        F.max(F.when(F.col("model") == base, rmse)).alias("base_rmse_cm"),
        F.max(F.when(F.col("model") == tuned, rmse)).alias("tuned_rmse_cm"),
    )
    return wide.where(F.col("base_rmse_cm").isNotNull() & F.col("tuned_rmse_cm").isNotNull()).withColumn(
        "gain_percent", 100 * (1 - F.col("tuned_rmse_cm") / F.nullif("base_rmse_cm", F.lit(0.0)))
    )


def with_model_order(metrics: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``model_order``, the 1-based place in a fixed list; models outside it are dropped."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return metrics.withColumn("model_order", place).where(place > 0)


def rmse_table(metrics: DataFrame, models: Sequence[str], keys: Sequence[str] = STATION) -> DataFrame:
    """One row per key and lead: sample count and one RMSE column per model."""
    return metrics.groupBy(*keys, "lead_hours").agg(
        F.min("n").alias("n"),
        *[F.max(F.when(F.col("model") == m, F.col("rmse_cm"))).alias(f"{m}_rmse_cm") for m in models],
    )


def long_to_wide(df: DataFrame, leads: Sequence[int], models: Sequence[str], keys: Sequence[str] = STATION) -> DataFrame:
    """One row per origin with ``observed_01h_m`` … and ``<model>_01h_m`` … columns."""
    lead, columns = F.col("lead_hours"), []
    for k in leads:
        columns.append(F.max(F.when(lead == k, F.col("observed_m"))).alias(f"observed_{k:02d}h_m"))
        columns += [
            F.max(F.when((lead == k) & (F.col("model") == m), F.col("predicted_m"))).alias(f"{m}_{k:02d}h_m")
            for m in models
        ]
    return df.groupBy(*keys, "origin").agg(*columns)


def wide_to_long(df: DataFrame, leads: Sequence[int], models: Sequence[str], keys: Sequence[str] = STATION) -> DataFrame:
    """Inverse of :func:`long_to_wide`."""
    rows = F.array(
        *[
            F.struct(
                F.lit(int(k)).cast("bigint").alias("lead_hours"), F.col(f"observed_{k:02d}h_m").alias("observed_m"),
                F.lit(m).alias("model"), F.col(f"{m}_{k:02d}h_m").alias("predicted_m"),
            )
            for k in leads
            for m in models
        ]
    )
    return df.select(*keys, "origin", F.inline(rows))


def station_union(frames: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    """Stack station metric tables, mapping source model names; models without a name are dropped.

    ``names``: station_id, source_model, model.
    """
    stacked: DataFrame | None = None
    for station, frame in frames.items():
        source = "model" if "model" in frame.columns else "method"
        tagged = frame.withColumnRenamed(source, "source_model").withColumn("station_id", F.lit(station))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("no station tables")
    return map_models(stacked, names)


def map_models(df: DataFrame, names: DataFrame) -> DataFrame:
    return df.join(names, ["station_id", "source_model"])


def result_summary(metrics: DataFrame, base: str, keys: Sequence[str] = STATION) -> DataFrame:
    """Models ranked 1..n by RMSE at each lead, with their gain over ``base``."""
    joined = skill_vs(metrics, base, keys)
    place = F.row_number().over(Window.partitionBy(*keys, "lead_hours").orderBy("rmse_cm", "model"))
    return joined.select(*keys, "lead_hours", place.alias("place"), "model", "rmse_cm", "gain_percent")


def evidence_audit(
    metrics: DataFrame, observed: DataFrame, keys: Sequence[str] = STATION, value: str = "surge_m"
) -> DataFrame:
    """Per station: leads, smallest n, observed range and count, and whether the evidence is complete."""
    seen = observed.groupBy(*keys).agg(
        F.min("ts").alias("observed_start"), F.max("ts").alias("observed_end"),
        F.count(value).alias("finite_observed"), F.max(F.year("ts")).alias("evaluation_year"),
    )
    return (
        metrics.groupBy(*keys)
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_set("lead_hours")), lambda k: k.cast("string")), ",").alias("leads"),
            F.min("n").alias("common_origin_samples"),
        )
        .join(seen, list(keys), "full_outer")
        .withColumn(
            "status",
            F.when(F.col("leads").isNotNull() & (F.coalesce("finite_observed", F.lit(0)) > 0), F.lit("complete"))
            .otherwise(F.lit("partial")),
        )
    )


def select_window_runs(runs: DataFrame, windows: Sequence[int] = (8, 12, 24), at_least: int = 1) -> DataFrame:
    """One non-rolling run per input window with enough validation rows, preferring one with predictions."""
    eligible = runs.where(
        F.col("input_steps").isin(list(windows)) & ~F.col("is_rolling") & (F.col("validation_rows") >= at_least)
    )
    best = F.min_by(
        F.struct(*[c for c in runs.columns if c != "input_steps"]),
        F.struct(~F.col("has_predictions"), -F.col("validation_rows"), F.col("run")),
    )
    return eligible.groupBy("input_steps").agg(best.alias("_run")).select("input_steps", "_run.*")


def column_groups(schema: StructType) -> dict[str, list[str]]:
    """Feature groups as the columns' metadata state them: pressure terms, wind terms, everything."""
    terms = {f.name: f.metadata.get("terms", []) for f in schema.fields}
    return {"ib": [c for c, t in terms.items() if "pressure" in t], "wind": [c for c, t in terms.items() if "wind" in t], "all": [c for c, t in terms.items() if t]}
