"""Reference forecasts every model is judged against."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.blocks import at_offset
from tidewright.operators.samples import direct_origins

STATION = ("station_id",)


def baseline_forecasts(
    df: DataFrame, leads: Sequence[int], history: int, value: str = "surge_m", valid: str | None = None,
    models: dict[str, Column] | None = None, keys: Sequence[str] = STATION, horizon: int | None = None,
) -> DataFrame:
    """Long forecast table of simple models at direct origins.

    Models are expressions over ``b0`` (value at the origin), ``b1``, ``b2`` … (hours before it). Default:
    ``persistence`` (last value held) and ``zero``. ``prior_m`` is the observation one hour before the target.
    """
    models = models or {"persistence": F.col("b0"), "zero": F.lit(0.0)}
    m = horizon or max(leads)
    columns = {f"b{k}": at_offset(value, -k) for k in range(history)}
    columns |= {f"a{k}": at_offset(value, k) for k in sorted({x for lead in leads for x in (lead, lead - 1)})}
    origins = direct_origins(df, history, m, value, valid, keys=keys, columns=columns)
    rows = F.array(
        *[
            F.struct(
                F.lit(int(lead)).cast("bigint").alias("lead_hours"),
                F.col(f"a{lead}").alias("observed_m"),
                F.col(f"a{lead - 1}").alias("prior_m"),
                F.lit(name).alias("model"),
                expression.cast("double").alias("predicted_m"),
            )
            for lead in leads
            for name, expression in models.items()
        ]
    )
    table = origins.select(*keys, F.col("ts").alias("origin"), F.inline(rows))
    return table.withColumn("valid_time", F.col("origin") + F.make_interval(hours=F.col("lead_hours").cast("int")))
