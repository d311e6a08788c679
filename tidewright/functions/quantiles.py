"""Exact quantiles that scale: a sketch finds where the answer lies, ranks inside that slice settle it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.columns import finite
from tidewright.functions.storage import stored

COARSE = 64
SPLITS = 999


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[str | Column, float]],
    accuracy: int = 10_000,
    most: int = 100_000,
) -> DataFrame:
    """One row per key with the linearly interpolated quantile ``name = (value, p)`` for each entry.

    Built-in ``percentile`` holds every distinct value of a group in one task. Here ``df`` is evaluated once, to
    a narrow stored table of keys and values. One aggregate over it takes counts and sketched marks of every
    value; of the marks the two that surely enclose a wanted rank, given the group's size, bracket it. Equal
    values inside a bracket are counted together, and as long as a bracket holds more than ``most`` distinct
    values it is cut at sketched split points and only the slices around the rank stay, so the final ranking
    has a bounded slice per quantile whatever the size of a group. Missing, NaN and infinite values do not
    count; a quantile over no values is null.
    """
    group = list(keys) or ["_all"]
    places: dict[str | int, int] = {}
    at = {name: places.setdefault(v if isinstance(v, str) else id(v), len(places)) for name, (v, _) in wanted.items()}
    values = [finite(next(v for n, (v, _) in wanted.items() if at[n] == i)).alias(f"_v{i}") for i in range(len(places))]
    source = df if keys else df.withColumn("_all", F.lit(0))
    data = stored(source.select(*group, *values), "quantile-values")

    fine = 6 / accuracy
    grids = [sorted({k / COARSE for k in range(COARSE + 1)} | {min(1.0, max(0.0, p + s * fine)) for n, (_, p) in wanted.items() if at[n] == i for s in (-1, 1)})
             for i in range(len(values))]
    marks = stored(data.groupBy(*group).agg(
        *(F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(values))),
        *(F.percentile_approx(f"_v{i}", grid, accuracy).alias(f"_m{i}") for i, grid in enumerate(grids))), "quantile-marks")

    brackets = []
    for name, (_, p) in wanted.items():
        i = at[name]
        n, grid = F.col(f"_n{i}"), F.array(*(F.lit(float(q)) for q in grids[i]))
        rank = F.lit(float(p)) * (n - 1)
        pairs = F.arrays_zip(grid.alias("q"), F.col(f"_m{i}").alias("m"))
        low = F.try_element_at(F.filter(pairs, lambda x: x["q"] * n <= F.floor(rank) + 1 - 4 * n / accuracy), F.lit(-1))["m"]
        high = F.get(F.filter(pairs, lambda x: x["q"] * n >= F.ceil(rank) + 1 + 4 * n / accuracy), F.lit(0))["m"]
        brackets.append(F.struct(F.lit(name).alias("q"), F.lit(i).alias("i"), F.coalesce(low, F.lit(-float("inf"))).alias("low"),
                                 F.coalesce(high, F.lit(float("inf"))).alias("high"), rank.alias("rank")))
    targets = marks.select(*group, F.array(*brackets).alias("_b"))

    # values below a bracket collapse into one null-valued row that only carries their count
    every = F.array(*(F.col(f"_v{i}") for i in range(len(values))))
    inside = F.filter(F.col("_b"), lambda b: F.get(every, b["i"]) <= b["high"])
    picked = F.transform(inside, lambda b: F.struct(b["q"].alias("_q"), b["rank"].alias("_rank"), F.when(F.get(every, b["i"]) >= b["low"], F.get(every, b["i"])).alias("_s")))
    counted = data.join(targets, group).select(*group, F.inline(picked)).groupBy(*group, "_q", "_rank", "_s").agg(F.count("*").alias("_c"))
    slices = stored(counted, "quantile-slices")
    by = [*group, "_q"]
    while (slices.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0) > most:
        slices = stored(_narrowed(slices, by), "quantile-slices")

    ordered = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_s"))
    cumulative = slices.withColumn("_cum", F.sum("_c").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    floor, ceil = F.floor("_rank"), F.ceil("_rank")
    found = cumulative.groupBy(*by, "_rank").agg(
        F.min(F.when(F.col("_cum") > floor, F.col("_s"))).alias("_a"),
        F.min(F.when(F.col("_cum") > ceil, F.col("_s"))).alias("_b"),
        F.max("_cum").alias("_seen"),
        F.coalesce(F.max(F.when(F.col("_s").isNull(), F.col("_c"))), F.lit(0)).alias("_below"),
    )
    settled = F.when(
        (F.col("_below") <= floor) & (F.col("_seen") > ceil), F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - floor)
    ).otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
    wide = found.select(*by, settled.alias("_value")).groupBy(*group).agg(*[F.max(F.when(F.col("_q") == name, F.col("_value"))).alias(name) for name in wanted])
    return wide if keys else wide.drop("_all")


def _narrowed(slices: DataFrame, by: list[str]) -> DataFrame:
    """The slices around each rank only; what lies below joins the row of counts below."""
    grid = [k / (SPLITS + 1) for k in range(1, SPLITS + 1)]
    splits = slices.groupBy(*by).agg(F.percentile_approx("_s", grid, 4 * (SPLITS + 1)).alias("_cuts"))
    binned = slices.join(splits, by).withColumn("_bin", F.when(F.col("_s").isNull(), F.lit(-1)).otherwise(F.size(F.filter("_cuts", lambda x: x < F.col("_s"))))).drop("_cuts")
    order = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = binned.groupBy(*by, "_rank", "_bin").agg(F.sum("_c").alias("_k")).withColumn("_hi", F.sum("_k").over(order)).withColumn("_lo", F.col("_hi") - F.col("_k"))
    kept = bins.where("_hi > floor(_rank) and _lo <= ceil(_rank) and _bin >= 0")
    low = kept.groupBy(*by).agg(F.min("_lo").alias("_below"), F.collect_set("_bin").alias("_bins"))
    rows = binned.where("_s is not null").join(low, by).where(F.array_contains("_bins", F.col("_bin")))
    under = bins.select(*by, "_rank").distinct().join(low, by).select(*by, "_rank", F.lit(None).cast("double").alias("_s"), F.col("_below").alias("_c")).where("_c > 0")
    return rows.select(*by, "_rank", "_s", "_c").unionByName(under)


def with_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str | Column, float]], accuracy: int = 10_000
) -> DataFrame:
    """``df`` with the quantile columns attached to every row of its group."""
    if keys:
        return df.join(exact_quantiles(df, keys, wanted, accuracy), list(keys), "left")
    return df.join(F.broadcast(exact_quantiles(df, [], wanted, accuracy)), F.lit(True), "left")  # one row at most
