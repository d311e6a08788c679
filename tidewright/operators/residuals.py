"""Residual diagnostics as tables: moments, autocorrelation, histogram, density bins and QQ points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.blocks import global_positions
from tidewright.functions.columns import finite, inverse_normal
from tidewright.functions.quantiles import exact_quantiles
from tidewright.functions.storage import stored
from tidewright.operators.series import full_denominator_acf, lagged_correlation


def residuals(df: DataFrame, scale: float = 100.0) -> DataFrame:
    """Adds ``residual`` = predicted - observed (cm), null unless both are finite."""
    return df.withColumn("residual", (finite("predicted_m") - finite("observed_m")) * scale)


def residual_stats(
    df: DataFrame, keys: Sequence[str], order: str = "ts", value: str = "residual", lags: Sequence[int] = (1, 24)
) -> DataFrame:
    """Mean, median, sample std, population skew, excess kurtosis, lag autocorrelations and n."""
    v = finite(value)
    moments = df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean_error"),
        F.when(F.count(v) > 1, F.stddev_samp(v)).alias("standard_deviation"),
        F.when((F.count(v) >= 3) & (F.var_pop(v) > 0), F.skewness(v)).alias("skewness"),
        F.when((F.count(v) >= 4) & (F.var_pop(v) > 0), F.kurtosis(v)).alias("kurtosis"),
    )
    middle = exact_quantiles(df, keys, {"median_error": (v, 0.5)})
    return moments.join(middle, list(keys), "left").join(
        lagged_correlation(df, lags, value, order, keys), list(keys), "left"
    )


def residual_stats_unbiased(
    df: DataFrame, keys: Sequence[str], order: str = "ts", value: str = "residual", lags: Sequence[int] = (1, 24)
) -> DataFrame:
    """Bias-corrected skew and kurtosis with the full-denominator autocorrelation."""
    v = finite(value)
    n = F.col("n").cast("double")
    raw = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean_error"), F.stddev_samp(v).alias("standard_deviation"),
        F.skewness(v).alias("_g1"), F.kurtosis(v).alias("_g2"),
    )
    corrected = raw.withColumns(
        {
            "skewness": F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("_g1")),
            "kurtosis": F.when(
                n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)
            ),
        }
    ).drop("_g1", "_g2")
    return corrected.join(full_denominator_acf(df, lags, value, order, keys), list(keys), "left")


def histogram(
    df: DataFrame, keys: Sequence[str], value: str = "residual", at_least: int = 6, at_most: int = 25
) -> DataFrame:
    """Counts in equal bins over min..max; bins = sqrt(n) held between 6 and 25; the top edge is inclusive."""
    v = finite(value)
    span = df.groupBy(*keys).agg(F.count(v).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi")).select(
        *keys, "_lo", "_hi",
        F.least(F.lit(at_most), F.greatest(F.lit(at_least), F.floor(F.sqrt(F.greatest("_n", F.lit(1)))))).alias("bins"),
    )
    width = (F.col("_hi") - F.col("_lo")) / F.col("bins")
    slot = F.when(
        F.col("_hi") > F.col("_lo"), F.least(F.col("bins") - 1, F.floor((v - F.col("_lo")) / width))
    ).otherwise(F.lit(0))
    counted = (
        df.where(v.isNotNull()).join(span, list(keys))
        .groupBy(*keys, "bins", slot.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("count"))
    )
    return counted.select(
        *keys, "bins", "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"), "count",
    )


def bin_counts_2d(
    df: DataFrame, keys: Sequence[str], x: str = "observed_m", y: str = "predicted_m", size: float = 0.05
) -> DataFrame:
    """Point density: counts per square cell of side ``size``."""
    return (
        df.where(finite(x).isNotNull() & finite(y).isNotNull())
        .groupBy(*keys, F.floor(F.col(x) / size).alias("x_bin"), F.floor(F.col(y) / size).alias("y_bin"))
        .agg(F.count("*").alias("count"))
    )


def qq_points(df: DataFrame, keys: Sequence[str], tie: Sequence[str], value: str = "residual") -> DataFrame:
    """Sorted residuals against normal quantiles at (rank - 0.5) / n, scaled by their own mean and std.

    Ranking runs over thousands of narrow value ranges around the sketched median, so no task sorts a whole
    group; the range width grows away from the middle, which keeps heavy tails apart too. ``tie`` orders
    equal residuals.
    """
    v = finite(value)
    known = df.where(v.isNotNull()).select(*keys, *tie, v.alias("sample"))
    shape = stored(known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("sample").alias("_mean"), F.stddev_pop("sample").alias("_std"),
        F.percentile_approx("sample", [0.25, 0.5, 0.75], 1000).alias("_q"),
    ), "residual-marks")  # sketched once: ranks and rows must see the same blocks
    joined = known.join(shape, list(keys))
    spread = F.coalesce(
        F.nullif(F.get("_q", F.lit(2)) - F.get("_q", F.lit(0)), F.lit(0.0)), F.nullif("_std", F.lit(0.0)), F.lit(1.0)
    )
    block = F.floor(F.asinh((F.col("sample") - F.get("_q", F.lit(1))) / spread) * 4096)
    ranked = global_positions(joined, keys, ["sample", *tie], block, "rank")
    probability = (F.col("rank") - 0.5) / F.col("n")
    return ranked.select(
        *keys, *tie, "rank", "sample",
        (inverse_normal(probability) * F.col("_std") + F.col("_mean")).alias("theoretical"),
    )
