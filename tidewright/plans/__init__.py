"""Queries over the given tables, each with an SQL twin where one can be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans import (  # noqa: F401
    compare_queries,
    field_queries,
    quality_queries,
    model_queries,
    registry,
    rollout_queries,
    sample_queries,
    series_queries,
    snapshot_queries,
    source_queries,
    stream_queries,
    verify_queries,
    views,
)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means on a dense axis, persistence one hour ahead, scores by lead with extreme conditions."""
    from tidewright.operators.baselines import baseline_forecasts
    from tidewright.operators.verify import verify_by_lead

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    forecasts = baseline_forecasts(views.surge_all(spark, sf_dir), (1,), 3, models=views.simple_models())
    return registry.tidy(verify_by_lead(forecasts, "persistence")).orderBy("station_id", "lead_hours", "model")
