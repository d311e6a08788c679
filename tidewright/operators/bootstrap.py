"""Paired calendar-block bootstrap of a model against a reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.columns import finite
from tidewright.functions.storage import stored

STATION = ("station_id",)


def draw(seed: int, repetition, number, blocks):
    """0-based block of one draw: a hash of (seed, repetition, draw), so a retried task draws the same."""
    text = F.concat_ws(":", F.lit(str(seed)), repetition.cast("string"), number.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint"), blocks)


def block_bootstrap(
    df: DataFrame, block_hours: int = 168, repetitions: int = 500, seed: int = 42, keys: Sequence[str] = STATION,
    observed: str = "observed_m", model: str = "model_m", reference: str = "reference_m", ts: str = "ts",
) -> DataFrame:
    """Confidence limits of the RMSE difference (cm) and MSE skill of ``model`` over ``reference``.

    Time is cut into blocks from the first valid row. Each repetition draws blocks with replacement until
    it holds as many rows as the record and truncates the last block. Blocks enter as sums with prefix
    sums for the truncation, so repetitions never copy rows: per key the work is repetitions x draws.
    """
    if block_hours < 1 or repetitions < 1:
        raise ValueError("block_hours and repetitions must be positive")
    o, m, b = finite(observed), finite(model), finite(reference)
    pairs = df.where(o.isNotNull() & m.isNotNull() & b.isNotNull() & F.col(ts).isNotNull()).select(
        *keys, ts, ((m - o) * (m - o)).alias("_em"), ((b - o) * (b - o)).alias("_er")
    )
    first = pairs.groupBy(*keys).agg(F.min(ts).alias("_first"))
    blocked = pairs.join(first, list(keys)).withColumn(
        "_block", F.floor((F.unix_seconds(ts) - F.unix_seconds("_first")) / (block_hours * 3600))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(ts)
    prefix = blocked.select(
        *keys, "_block", F.row_number().over(inside).alias("_take"), F.sum("_em").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_pm"),
        F.sum("_er").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_pr"),
    )
    order = Window.partitionBy(*keys).orderBy("_block")  # one row per calendar block
    sums = blocked.groupBy(*keys, "_block").agg(
        F.count("*").alias("_rows"), F.sum("_em").alias("_sm"), F.sum("_er").alias("_sr")
    ).withColumn("_number", (F.row_number().over(order) - 1).cast("bigint"))
    totals = sums.groupBy(*keys).agg(
        F.sum("_rows").alias("n"), F.count("*").alias("calendar_block_count"), F.min("_rows").alias("_least"),
        F.sum("_sm").alias("_tm"), F.sum("_sr").alias("_tr"),
    )
    runs = totals.select(*keys, "n", "calendar_block_count", "_least").withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    running = Window.partitionBy(*keys, "_rep").orderBy("_draw").rowsBetween(Window.unboundedPreceding, 0)

    def drawn(some: DataFrame, last: Column) -> DataFrame:
        draws = some.repartition(*keys, "_rep").withColumn("_draw", F.explode(F.sequence(F.lit(1).cast("bigint"), last.cast("bigint"))))
        return (
            draws.withColumn("_number", draw(seed, F.col("_rep"), F.col("_draw"), F.col("calendar_block_count")))
            .join(sums, [*keys, "_number"])
            .withColumn("_upto", F.sum("_rows").over(running))
            .where(F.col("_upto") - F.col("_rows") < F.col("n"))
            .withColumn("_take", F.least(F.col("_rows"), F.col("n") - F.col("_upto") + F.col("_rows")))
        )

    # twice as many draws as there are blocks nearly always suffice; only repetitions still short draw on, to the proven end
    most = stored(drawn(runs, 2 * F.col("calendar_block_count")), "draws")
    full = most.where(F.col("_upto") >= F.col("n")).select(*keys, "_rep")
    short = runs.join(full, [*keys, "_rep"], "left_anti")
    placed = most.join(full, [*keys, "_rep"], "left_semi").unionByName(drawn(short, F.ceil(F.col("n") / F.col("_least"))).select(*most.columns))
    taken = placed.join(prefix, [*keys, "_block", "_take"])
    sampled = taken.groupBy(*keys, "_rep", "n").agg(F.sum("_pm").alias("_m"), F.sum("_pr").alias("_r"))
    difference = (F.sqrt(F.col("_m") / F.col("n")) - F.sqrt(F.col("_r") / F.col("n"))) * 100
    skill = 1 - F.col("_m") / F.nullif("_r", F.lit(0.0))
    # a group here is one key's repetitions, a number the caller sets
    limits = sampled.withColumns({"_d": difference, "_s": skill}).groupBy(*keys).agg(
        F.percentile("_d", F.array(F.lit(0.025), F.lit(0.975))).alias("_dq"), F.percentile("_s", F.array(F.lit(0.025), F.lit(0.975))).alias("_sq"),
        F.count("*").alias("repetitions"),
    )
    n, tm, tr = F.col("n"), F.col("_tm"), F.col("_tr")
    return totals.join(limits, list(keys)).select(
        *keys, "n", F.lit(block_hours).cast("bigint").alias("block_hours"), "calendar_block_count", "repetitions",
        ((F.sqrt(tm / n) - F.sqrt(tr / n)) * 100).alias("rmse_difference_cm"),
        F.get("_dq", F.lit(0)).alias("rmse_difference_low_cm"), F.get("_dq", F.lit(1)).alias("rmse_difference_high_cm"),
        (1 - tm / F.nullif(tr, F.lit(0.0))).alias("mse_skill"),
        F.get("_sq", F.lit(0)).alias("mse_skill_low"), F.get("_sq", F.lit(1)).alias("mse_skill_high"),
    )
