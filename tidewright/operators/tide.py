"""Harmonic tide by distributed least squares, and the surge that is left.

Nodal and latitude corrections are not applied, so amplitudes can differ slightly from a full harmonic
package over long records.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.linear import _square, dot, gram
from tidewright.operators.series import STATION, hourly_grid

# Constituents and their speeds in degrees per hour (published tables).
SPEEDS = {
    "M2": 28.9841042, "S2": 30.0, "N2": 28.4397295, "K2": 30.0821373, "K1": 15.0410686, "O1": 13.9430356,
    "P1": 14.9589314, "Q1": 13.3986609, "M4": 57.9682084, "MS4": 58.9841042, "MN4": 57.4238337, "2N2": 27.8953548,
    "MU2": 27.9682084, "NU2": 28.5125831, "L2": 29.5284789, "T2": 29.9589333, "J1": 15.5854433, "OO1": 16.1391017,
    "M6": 86.9523127, "M8": 115.9364166,
}


def _waves(hours, names: Sequence[str]):
    """Cosine and sine of every constituent at a number of hours since the first observation."""
    parts = []
    for name in names:
        angle = F.radians(hours * SPEEDS[name])
        parts += [F.cos(angle), F.sin(angle)]
    return F.array(*parts)


def _elapsed(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Adds hours since each key's first observation; large absolute times would ruin the fit."""
    first = df.groupBy(*keys).agg(F.min(ts).alias("_first"))
    return df.join(first, list(keys)).withColumn("_hours", (F.unix_micros(ts) - F.unix_micros("_first")) / 3.6e9)


def fit_tide(
    df: DataFrame, value: str = "water_level", cutoff: str | None = None, minimum_days: int = 30,
    constituents: Sequence[str] = tuple(SPEEDS), keys: Sequence[str] = STATION, ts: str = "ts",
) -> DataFrame:
    """Mean and harmonic coefficients per key from observations up to ``cutoff``.

    Repeated times, or fewer than ``minimum_days`` of at least 20 observations a day, fail the
    job. Nearly collinear constituents of short records get the least-norm solution.
    """
    known = df.where(F.col(value).isNotNull())
    times = known.groupBy(*keys, ts).agg(F.count("*").alias("_copies"), F.first(value).alias(value))
    twice = F.raise_error(F.lit("repeated times; run quality control first")).cast("boolean")
    unique = times.where(F.when(F.col("_copies") > 1, twice).otherwise(F.lit(True))).drop("_copies")
    rows = _elapsed(unique, keys, ts)
    if cutoff is not None:
        rows = rows.where(F.col(ts) <= F.lit(cutoff).cast("timestamp"))
    design = rows.select(
        *keys, _waves(F.col("_hours"), constituents).alias("features"), F.array(F.col(value)).alias("labels")
    )
    span = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), ((F.max("_hours") - F.min("_hours")) / 24).alias("_days"), F.min("_first").alias("first_ts")
    )
    names = list(keys)
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("mean_level", T.DoubleType()), T.StructField("harmonics", T.ArrayType(T.DoubleType())), T.StructField("fit_rows", T.LongType())]
    )

    def solve(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        matrix = _square(part)
        p = len(matrix) - 2
        n = matrix[p, p]
        normal, moment = matrix[: p + 1, : p + 1] / n, matrix[: p + 1, p + 1] / n
        solution = np.linalg.lstsq(normal, moment, rcond=1e-13)[0]
        return pd.DataFrame([(*key, float(solution[p]), solution[:p].tolist(), int(n))], columns=[*names, "mean_level", "harmonics", "fit_rows"])

    fitted = gram(design, keys).groupBy(*keys).applyInPandas(solve, schema)
    short = F.raise_error(
        F.concat(F.lit("too few observations for a tide fit: "), F.col("_n").cast("string"), F.lit(" over days "), F.round("_days", 1).cast("string"))
    ).cast("boolean")
    enough = (F.col("_n") >= minimum_days * 20) & (F.col("_days") >= minimum_days - 1)
    return (
        fitted.join(span, list(keys)).where(F.when(enough, F.lit(True)).otherwise(short))
        .drop("_n", "_days").withColumn("constituents", F.array(*[F.lit(c) for c in constituents]))
    )


def separate_tide(
    df: DataFrame, coefficients: DataFrame, value: str = "water_level", constituents: Sequence[str] = tuple(SPEEDS),
    keys: Sequence[str] = STATION, ts: str = "ts",
) -> DataFrame:
    """Dense hourly series with observed level, predicted tide, surge and validity."""
    dense = hourly_grid(df.select(*keys, ts, value), keys, ts, value).join(coefficients.select(*keys, "first_ts", "mean_level", "harmonics"), list(keys))
    hours = (F.unix_micros(ts) - F.unix_micros("first_ts")) / 3.6e9
    tide = F.col("mean_level") + dot(F.col("harmonics"), _waves(hours, constituents))
    return dense.select(
        *keys, ts, F.col(value).alias("observed_water_level_m"), tide.alias("predicted_tide_m"), "qc_valid"
    ).withColumn("surge_m", F.col("observed_water_level_m") - F.col("predicted_tide_m"))


def amplitudes(coefficients: DataFrame, keys: Sequence[str] = STATION) -> DataFrame:
    """Amplitude and phase lag (degrees, from the first observation) per constituent."""
    rows = coefficients.select(*keys, "harmonics", F.posexplode("constituents").alias("_i", "constituent"))
    a, b = F.get("harmonics", F.col("_i") * 2), F.get("harmonics", F.col("_i") * 2 + 1)
    return rows.select(*keys, "constituent", F.hypot(a, b).alias("amplitude"), F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)).alias("phase_deg"))


def tide_record_audit(series: DataFrame, last_year: int, value: str = "surge_m", keys: Sequence[str] = STATION, ts: str = "ts") -> DataFrame:
    """Records, finite records and time range through the last allowed year."""
    return series.where(F.col(ts) < F.lit(f"{last_year + 1:04d}-01-01").cast("timestamp")).groupBy(*keys).agg(
        F.count("*").alias("records"), F.count(value).alias("finite_records"), F.min(ts).alias("start"), F.max(ts).alias("end")
    )
