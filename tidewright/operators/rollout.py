"""Long recursive forecasts of a linear one-step model, by powers of its companion matrix.

A one-step model takes the weather and levels of the last n hours. What the weather adds to an hour is the same for all origins, so
it is computed once per hour. The levels then follow a linear recursion whose answers to a start and to an addition k
hours ago are the powers of one small matrix per key, shared by all origins: a lead is one product, not a chain of steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.blocks import halo_window, hour_number
from tidewright.functions.storage import stored
from tidewright.operators.linear import dot, ridge_select
from tidewright.operators.samples import ordered_values

STATION = ("station_id",)


def _past_hours(df: DataFrame, weather: Sequence[str], n: int, value: str, keys: Sequence[str], ts: str) -> DataFrame:
    """Adds ``_past`` (n levels) and ``_forced`` (n hours of weather), oldest first and null where an hour is unknown."""
    packed = df.withColumns({"_h": hour_number(ts), "_w": F.array(*[F.col(c).cast("double") for c in weather])})
    made = halo_window(packed, keys, "_h", {"_levels": ordered_values(value, -n, -1), "_hours": ordered_values("_w", -n, -1)}, before=n)
    weathers = F.flatten("_hours")

    def whole(column, size):
        return F.when((F.size(column) == size) & ~F.exists(column, lambda x: x.isNull()), column)

    return made.withColumns({"_past": whole(F.col("_levels"), n), "_forced": whole(weathers, n * len(weather))})


def step_samples(
    df: DataFrame, weather: Sequence[str], n: int, value: str = "surge_m", keys: Sequence[str] = STATION, ts: str = "ts"
) -> DataFrame:
    """Samples of the one-step model: ``features`` are n hours of weather, then n levels; ``labels`` the level of the hour itself."""
    rows = _past_hours(df, weather, n, value, keys, ts).where(F.col("_past").isNotNull() & F.col("_forced").isNotNull() & F.col(value).isNotNull())
    return rows.select(*keys, F.col(ts).alias("origin"), F.concat("_forced", "_past").alias("features"), F.array(value).alias("labels"))


def fit_step_model(samples: DataFrame, width: int, early: Column, tuning: Column, keys: Sequence[str] = STATION) -> DataFrame:
    """The one-step ridge of each key over ``width`` features, taken from their means so that columns of small spread keep their digits."""
    means = F.array(*[F.avg(F.get("features", F.lit(i))) for i in range(width)])
    middle = stored(samples.where(early | tuning).groupBy(*keys).agg(means.alias("_middle")), "means")  # one row per key
    centred = samples.join(middle, list(keys)).withColumn("features", F.zip_with("features", "_middle", lambda x, m: x - m))
    models = ridge_select(centred, keys, (1,), early, tuning)
    return models.join(middle, list(keys)).withColumn("intercept", F.col("intercept") - dot(F.col("coefficients"), F.col("_middle"))).drop("_middle")


def companion_powers(models: DataFrame, n: int, leads: int, keys: Sequence[str] = STATION) -> DataFrame:
    """Per key: ``carry``, what each start level adds to every lead, and ``echo``, what an addition still adds 0 .. leads - 1 hours on, latest first."""
    schema = T.StructType(
        [models.schema[k] for k in keys]
        + [T.StructField("carry", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("echo", T.ArrayType(T.DoubleType()))]
    )

    def powers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            carries, echoes = [], []
            for coefficients in batch["coefficients"]:
                companion = np.eye(n, k=1)
                companion[-1] = np.asarray(coefficients, dtype=float)[-n:]
                power, carry, echo = np.eye(n), [], []
                for _ in range(leads):
                    echo.append(float(power[-1, -1]))
                    power = companion @ power
                    carry.append(power[-1].tolist())
                carries.append(carry)
                echoes.append(echo[::-1])
            yield batch[list(keys)].assign(carry=carries, echo=echoes)

    return models.select(*keys, "coefficients").mapInPandas(powers, schema)


def rollout(
    df: DataFrame, models: DataFrame, weather: Sequence[str], n: int, leads: int, value: str = "surge_m",
    keys: Sequence[str] = STATION, ts: str = "ts",
) -> DataFrame:
    """``origin`` (the first hour predicted), ``predictions`` and ``targets`` (null where unknown) for every origin that can be rolled.

    ``df`` is a dense hourly series per key with its weather; ``models`` hold one model per key, fitted on :func:`step_samples`.
    An origin needs the n levels before it and the weather from n hours before it to the hour before its last lead. Levels from the origin on
    are never used.
    """
    models = stored(models.select(*keys, "coefficients", "intercept"), "models")  # one row per key
    force = F.col("intercept") + dot(F.slice("coefficients", 1, n * len(weather)), F.col("_forced"))
    hours = _past_hours(df, weather, n, value, keys, ts).join(models, list(keys)).select(
        *keys, ts, "_h", F.col(value).alias("_level"), "_past", force.alias("_force"))
    ahead = {"_forces": ordered_values("_force", 0, leads - 1), "targets": ordered_values("_level", 0, leads - 1)}
    origins = halo_window(hours, keys, "_h", ahead, after=leads - 1).where(
        F.col("_past").isNotNull() & (F.size("_forces") == leads) & ~F.exists("_forces", lambda x: x.isNull()))

    def lead(k):
        return dot(F.get("carry", k), F.col("_past")) + dot(F.slice("echo", F.lit(leads) - k, k + 1), F.slice("_forces", F.lit(1), k + 1))

    made = F.transform(F.sequence(F.lit(0), F.lit(leads - 1)), lead)
    return origins.join(companion_powers(models, n, leads, keys), list(keys)).select(*keys, F.col(ts).alias("origin"), made.alias("predictions"), "targets")


def lead_rows(rolled: DataFrame, keys: Sequence[str] = STATION, strict: bool = False) -> DataFrame:
    """One row per origin and lead with its observation and error; an unknown observation fails the job when ``strict``."""
    rows = rolled.select(*keys, "origin", F.posexplode(F.arrays_zip(F.col("predictions").alias("p"), F.col("targets").alias("o"))).alias("_i", "_x"))
    observed = F.col("_x.o")
    if strict:
        observed = F.coalesce(observed, F.raise_error(F.lit("targets are incomplete")).cast("double"))
    error = (F.col("_x.p") - observed) * 100
    return rows.select(
        *keys, "origin", (F.col("_i") + 1).alias("lead_hours"), F.col("_x.p").alias("predicted_m"), observed.alias("observed_m"),
        error.alias("error_cm"), F.abs(error).alias("absolute_error_cm"),
    )
