"""Leakage-safe forecast windows: which origins are usable, what they may see, and how they are split.

Inputs are physical rows (one per key and hour; a missing hour is an absent row). Two conventions:
*direct* origin = last observed hour t with targets t+1..t+m; *rolling* origin = first predicted hour o
with targets o..o+lead-1.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.blocks import (
    BLOCK_HOURS,
    at_offset,
    global_positions,
    halo_window,
    hour_number,
)
from tidewright.functions.columns import finite
from tidewright.functions.storage import stored

STATION = ("station_id",)


def _hours(n: int) -> Column:
    return F.make_interval(hours=F.lit(n))


def field_valid(field: DataFrame, cells: int, variables: int = 3) -> DataFrame:
    """Hours where every cell of every variable is finite."""
    v = F.col("value").cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return field.groupBy("ts").agg((F.count_if(good) == cells * variables).alias("field_ok"))


def _flagged(df: DataFrame, value: str, valid: str | None) -> DataFrame:
    return df.withColumns(
        {
            "_h": hour_number("ts"),
            "_v": F.when(finite(value).isNotNull(), F.lit(1)),
            "_f": F.lit(1) if valid is None else F.when(F.col(valid), F.lit(1)),
        }
    )


def _full(column: str, first: int, last: int):
    return lambda w: F.count(column).over(w.rangeBetween(first, last)) == last - first + 1


def valid_targets(
    df: DataFrame, n: int, value: str = "surge_m", valid: str | None = None, keys: Sequence[str] = STATION
) -> DataFrame:
    """Adds ``skip_reason`` to every candidate target: null when usable, else the first failing test.

    Tests in order: ``non_contiguous`` (n+1 exactly hourly rows), ``missing_atmosphere`` (the n hours
    before), ``missing_surge`` (all n+1 hours). The first n rows of a key are not candidates.
    """
    marked = halo_window(
        _flagged(df, value, valid), keys, "_h",
        {"_rows": _full("_h", -n, 0), "_field": _full("_f", -n, -1), "_surge": _full("_v", -n, 0)}, before=n,
    )
    placed = global_positions(marked, keys, ["ts"], F.floor(F.col("_h") / BLOCK_HOURS), "_pos")
    reason = (
        F.when(~F.col("_rows"), F.lit("non_contiguous"))
        .when(~F.col("_field"), F.lit("missing_atmosphere"))
        .when(~F.col("_surge"), F.lit("missing_surge"))
    )
    return (
        placed.where(F.col("_pos") > n).withColumn("skip_reason", reason)
        .drop("_h", "_v", "_f", "_rows", "_field", "_surge", "_pos")
    )


def direct_origins(
    df: DataFrame, n: int, m: int, value: str = "surge_m", valid: str | None = None,
    years: Sequence[int] | None = None, keys: Sequence[str] = STATION,
    columns: dict | None = None,
) -> DataFrame:
    """Origins t with hourly, field-valid, known history t-n+1..t and future t+1..t+m in one calendar year.

    ``columns`` adds further window columns computed in the same shuffle.
    """
    marked = halo_window(
        _flagged(df, value, valid), keys, "_h",
        {
            "_rows": _full("_h", -n + 1, m), "_field": _full("_f", -n + 1, m), "_surge": _full("_v", -n + 1, m),
            **(columns or {}),
        },
        before=n - 1, after=m,
    )
    keep = F.col("_rows") & F.col("_field") & F.col("_surge") & (F.year(F.col("ts") + _hours(m)) == F.year("ts"))
    if years is not None:
        keep = keep & F.year("ts").isin(list(years))
    return marked.where(keep).drop("_h", "_v", "_f", "_rows", "_field", "_surge")


def common_origins(
    df: DataFrame, n: int, max_lead: int, leads: Sequence[int], value: str = "surge_m",
    valid: str | None = None, year: int | None = None, keys: Sequence[str] = STATION,
) -> DataFrame:
    """Rolling origins usable by every model at all ``leads``.

    History o-n..o-1 known, window o-n..o+max_lead-1 hourly, field valid over o-n..o+max_lead-2, and
    of the targets only the requested ones and the hour before each need be observed.
    """
    wanted = sorted({k for lead in leads for k in (lead - 1, lead - 2)})
    marked = halo_window(
        _flagged(df, value, valid), keys, "_h",
        {
            "_rows": _full("_h", -n, max_lead - 1),
            "_field": _full("_f", -n, max_lead - 2),
            "_history": _full("_v", -n, -1),
            **{f"_t{i}": at_offset("_v", k) for i, k in enumerate(wanted)},
        },
        before=n, after=max_lead - 1,
    )
    keep = F.col("_rows") & F.col("_field") & F.col("_history")
    for i in range(len(wanted)):
        keep = keep & F.col(f"_t{i}").isNotNull()
    keep = keep & (F.year(F.col("ts") + _hours(max_lead - 1)) == F.year("ts"))
    if year is not None:
        keep = keep & (F.year("ts") == year)
    return marked.where(keep).select(*df.columns)


def rollout_origins(
    df: DataFrame, n: int, k: int, years: Sequence[int], value: str = "surge_m", valid: str | None = None,
    keys: Sequence[str] = STATION,
) -> DataFrame:
    """k-step training origins o: history o-n..o-1 and targets o..o+k-1 complete, both ends in ``years``."""
    marked = halo_window(
        _flagged(df, value, valid), keys, "_h",
        {"_rows": _full("_h", -n, k - 1), "_field": _full("_f", -n, k - 2), "_surge": _full("_v", -n, k - 1)},
        before=n, after=k - 1,
    )
    inside = list(years)
    keep = (
        F.col("_rows") & F.col("_field") & F.col("_surge")
        & F.year("ts").isin(inside) & F.year(F.col("ts") + _hours(k - 1)).isin(inside)
    )
    return marked.where(keep).select(*df.columns)


def ordered_values(value: str, first: int, last: int):
    """Array of ``value`` over hours first..last around a row, in time order (window column maker)."""
    def make(w):
        pairs = F.collect_list(F.struct(F.col("_h").alias("h"), F.col(value).alias("v"))).over(w.rangeBetween(first, last))
        return F.transform(F.array_sort(pairs), lambda p: p["v"])

    return make


def direct_labels(
    df: DataFrame, n: int, m: int, value: str = "surge_m", valid: str | None = None, keys: Sequence[str] = STATION
) -> DataFrame:
    """One row per (origin, lead): the label vector in long form."""
    origins = direct_origins(
        df, n, m, value, valid, keys=keys, columns={"_labels": ordered_values(value, 1, m)}
    )
    return origins.select(*keys, F.col("ts").alias("origin"), F.posexplode("_labels").alias("_i", "label")).select(
        *keys, "origin", (F.col("_i") + 1).alias("lead_hours"), "label"
    )


def feature_matrix(
    df: DataFrame, weather: Sequence[str], n: int, m: int, include_surge: bool = True, mode: str = "past_future",
    value: str = "surge_m", valid: str | None = None, keys: Sequence[str] = STATION,
) -> DataFrame:
    """``features`` array per direct origin: past weather, future weather, surge history, in that order.

    ``mode`` is ``none``, ``past`` or ``past_future``; each weather hour contributes the columns of
    ``weather`` in order.
    """
    if mode not in ("none", "past", "past_future"):
        raise ValueError("mode must be none, past or past_future")
    packed = df.withColumn("_w", F.array(*[F.col(c).cast("double") for c in weather])) if weather else df
    columns = {"_labels": ordered_values(value, 1, m)}
    parts = []
    if mode != "none":
        columns["_past"] = ordered_values("_w", -n + 1, 0)
        parts.append(F.flatten("_past"))
    if mode == "past_future":
        columns["_future"] = ordered_values("_w", 1, m)
        parts.append(F.flatten("_future"))
    if include_surge:
        columns["_history"] = ordered_values(value, -n + 1, 0)
        parts.append(F.col("_history"))
    origins = direct_origins(packed, n, m, value, valid, keys=keys, columns=columns)
    return origins.select(
        *keys, F.col("ts").alias("origin"), F.concat(*parts).alias("features"), F.col("_labels").alias("labels")
    )


def sequence_features(
    df: DataFrame, weather: Sequence[str], n: int, m: int, value: str = "surge_m", valid: str | None = None,
    keys: Sequence[str] = STATION, training: Column | None = None,
) -> DataFrame:
    """(n+m) steps per origin, each: weather columns, surge history (0 ahead of the origin), observed flag.

    With ``training``, weather columns and surge are standardised by the mean and population std of each key over these
    rows (a std of zero scales by 1), all fitted in one aggregate; the 0 ahead of the origin is then that mean.
    """
    scaled = [*weather, value]
    if training is not None:
        fitted = []
        for i, c in enumerate(scaled):
            v = F.when(training, finite(c))
            fitted += [F.avg(v).alias(f"_m{i}"), F.when(F.stddev_pop(v) > 0, F.stddev_pop(v)).otherwise(1.0).alias(f"_s{i}")]
        scaler = stored(df.groupBy(*keys).agg(*fitted), "scaler")  # one row per key
        df = df.join(scaler, list(keys)).withColumns({c: (F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}") for i, c in enumerate(scaled)})
    packed = df.withColumn("_w", F.array(*[F.col(c).cast("double") for c in weather]))
    steps = direct_origins(
        packed, n, m, value, valid, keys=keys,
        columns={"_ww": ordered_values("_w", -n + 1, m), "_hh": ordered_values(value, -n + 1, 0)},
    )
    sequence = F.transform(
        "_ww",
        lambda w, i: F.concat(
            w,
            F.array(
                F.when(i < n, F.get("_hh", i)).otherwise(F.lit(0.0)),
                F.when(i < n, F.lit(1.0)).otherwise(F.lit(0.0)),
            ),
        ),
    )
    return steps.select(*keys, F.col("ts").alias("origin"), sequence.alias("sequence"))


# --- splits -------------------------------------------------------------------------------------------


def split_ratio(df: DataFrame, ratio: float, keys: Sequence[str] = STATION, ts: str = "ts") -> DataFrame:
    """First ``ratio`` of each key's rows in time train, the rest validate."""
    if not 0.5 <= ratio < 1:
        raise ValueError("ratio must be in [0.5, 1)")
    total = df.groupBy(*keys).agg(F.count("*").alias("_total"))
    placed = global_positions(df, keys, [ts], F.floor(hour_number(ts) / BLOCK_HOURS), "_pos")
    return placed.join(total, list(keys)).withColumn(
        "split", F.when(F.col("_pos") <= F.floor(F.col("_total") * ratio), F.lit("train")).otherwise(F.lit("validation"))
    ).drop("_total", "_pos")


def split_test_first(
    df: DataFrame, seed: int = 42, test_share: float = 0.2, validation_share: float = 0.125,
    keys: Sequence[str] = STATION, ts: str = "ts",
) -> DataFrame:
    """First 20% test; the rest goes to train or validation by a hash draw that retries cannot change."""
    total = df.groupBy(*keys).agg(F.count("*").alias("_total"))
    placed = global_positions(df, keys, [ts], F.floor(hour_number(ts) / BLOCK_HOURS), "_pos").join(total, list(keys))
    draw = F.pmod(F.xxhash64(F.lit(seed), *keys, ts), F.lit(1_000_000)) / 1_000_000
    return placed.withColumn(
        "split",
        F.when(F.col("_pos") <= F.floor(F.col("_total") * test_share), F.lit("test"))
        .when(draw < validation_share, F.lit("validation")).otherwise(F.lit("train")),
    ).drop("_total", "_pos")


def split_years(
    df: DataFrame, train: tuple[int, int], validation: int, test: int, ts: str = "ts"
) -> DataFrame:
    """Adds ``split`` by calendar year; the years must strictly increase."""
    if not train[0] <= train[1] < validation < test:
        raise ValueError("train, validation and test years must strictly increase")
    year = F.year(ts)
    return df.withColumn(
        "split",
        F.when(year.between(*train), F.lit("train"))
        .when(year == validation, F.lit("validation"))
        .when(year == test, F.lit("test")),
    ).where(F.col("split").isNotNull())


def require_splits(
    df: DataFrame, splits: Sequence[str] = ("train", "validation", "test"), keys: Sequence[str] = STATION
) -> DataFrame:
    """Pass rows through, failing the job when a key lacks one of the splits."""
    counts = [F.count_if(F.col("split") == s).alias(f"_n{i}") for i, s in enumerate(splits)]
    whole = F.lit(True)
    for i in range(len(splits)):
        whole = whole & (F.col(f"_n{i}") > 0)
    empty = F.raise_error(F.lit(f"empty split among {list(splits)}")).cast("boolean")
    kept = df.groupBy(*keys).agg(*counts).where(F.when(whole, F.lit(True)).otherwise(empty)).select(*keys)
    return df.join(kept, list(keys))


def split_first_years(
    df: DataFrame, k: int, keys: Sequence[str] = STATION, ts: str = "ts", fallback_ratio: float = 0.8
) -> DataFrame:
    """Earliest ``k`` years validate, the rest train; keys with at most ``k`` years split 80/20 in time."""
    year = F.year(ts)
    years = df.groupBy(*keys, year.alias("_year")).agg(F.count("*").alias("_rows"))
    order = Window.partitionBy(*keys).orderBy("_year")  # one row per calendar year
    ranked = years.select(
        *keys, "_year", F.row_number().over(order).alias("_rank"),
        F.count("*").over(Window.partitionBy(*keys)).alias("_years"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("_total"),
    )
    placed = global_positions(
        df.withColumn("_year", year), keys, [ts], F.floor(hour_number(ts) / BLOCK_HOURS), "_pos"
    )
    by_time = F.when(F.col("_pos") <= F.floor(F.col("_total") * fallback_ratio), F.lit("train")).otherwise(
        F.lit("validation")
    )
    by_year = F.when(F.col("_rank") <= k, F.lit("validation")).otherwise(F.lit("train"))
    return (
        placed.join(ranked, [*keys, "_year"])
        .withColumn("split", F.when(F.col("_years") <= k, by_time).otherwise(by_year))
        .drop("_year", "_rank", "_years", "_total", "_pos")
    )


# --- scaling ------------------------------------------------------------------------------------------


def fit_scaler(df: DataFrame, value: str, keys: Sequence[str], training: Column | None = None) -> DataFrame:
    """Population mean and std over training rows; a std of zero scales by 1."""
    v = F.col(value) if training is None else F.when(training, F.col(value))
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean"),
        F.when(F.stddev_pop(v) == 0, F.lit(1.0)).otherwise(F.stddev_pop(v)).alias("scale"),
    )


def standardise(df: DataFrame, scaler: DataFrame, value: str, keys: Sequence[str], name: str = "scaled") -> DataFrame:
    return df.join(scaler, list(keys)).withColumn(name, (F.col(value) - F.col("mean")) / F.col("scale")).drop(
        "mean", "scale"
    )


def inverse_standardise(
    df: DataFrame, scaler: DataFrame, scaled: str, keys: Sequence[str], name: str = "restored"
) -> DataFrame:
    return df.join(scaler, list(keys)).withColumn(name, F.col(scaled) * F.col("scale") + F.col("mean")).drop(
        "mean", "scale"
    )


def recover_scaler(df: DataFrame, scaled: str, original: str, keys: Sequence[str]) -> DataFrame:
    """Least-squares (scale, mean) with original = scale * scaled + mean."""
    return df.groupBy(*keys).agg(
        F.regr_slope(original, scaled).alias("scale"), F.regr_intercept(original, scaled).alias("mean")
    )


def minmax(df: DataFrame, value: str, keys: Sequence[str], name: str = "scaled") -> DataFrame:
    """(x - min) / (max - min) over each whole group; a constant group gives null."""
    span = stored(df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")), "span")  # of known size when the join is planned
    return df.join(span, list(keys)).withColumn(
        name, (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    ).drop("_lo", "_hi")


def fill_mean(df: DataFrame, value: str = "value", keys: Sequence[str] = ("variable",)) -> DataFrame:
    """Missing values become their group's mean (aggregate and join; no group gathers in a window)."""
    mean = stored(df.groupBy(*keys).agg(F.avg(value).alias("_mean")), "means")  # of known size when the join is planned
    return df.join(mean, list(keys)).withColumn(value, F.coalesce(value, "_mean")).drop("_mean")


def available_years(df: DataFrame, variables: Sequence[str], ts: str = "ts") -> DataFrame:
    """Years in which every variable occurs."""
    return (
        df.where(F.col("variable").isin(list(variables)))
        .groupBy(F.year(ts).alias("year"))
        .agg(F.count_distinct("variable").alias("_found"))
        .where(F.col("_found") == len(set(variables)))
        .select("year")
    )


def daily_windows(
    df: DataFrame, cells: int, steps: int = 16, step_hours: int = 3, variables: int = 3, keys: Sequence[str] = ()
) -> DataFrame:
    """Status of each day's sample: 3-hourly steps from the day before 00:00 through the day's last step.

    A day is usable when all ``variables`` are finite in each of ``cells`` cells at each of ``steps`` steps; otherwise
    ``skip_reason``. Rows are unique per time, variable and cell.
    """
    on_step = df.where((F.hour("ts") % step_hours == 0) & (F.minute("ts") == 0))
    days = on_step.withColumn(
        "day", F.explode(F.array(F.to_date("ts"), F.date_add(F.to_date("ts"), 1)))
    )
    counts = days.groupBy(*keys, "day", "variable").agg(
        F.count(finite("value")).alias("_values")
    )
    return counts.groupBy(*keys, "day").agg(
        F.count_if(F.col("_values") == steps * cells).alias("complete_variables"), F.min("_values").alias("fewest_values")
    ).withColumn(
        "skip_reason",
        F.when(F.col("complete_variables") < variables, F.lit("incomplete_steps")),
    )


def daily_tensors(
    df: DataFrame, rows: int, columns: int, steps: int = 16, step_hours: int = 3, variables: Sequence[str] = ("U10", "V10", "MSL"),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Each day's sample as one flat array of floats: steps x variables channels of rows x columns cells, row major.

    The steps run every ``step_hours`` from the day before; a channel is ``step * len(variables) + variable``. Cells
    are written to their place, so nothing is sorted; ``present`` is a bitmap of the places that hold a finite value (bit
    k % 8 of byte k // 8), ``complete_channels`` counts channels without a hole, and ``tensor`` is null, with a
    ``skip_reason``, unless all are. A group is one day: ``steps`` x ``variables`` x cells, whatever the length of the field.
    """
    cells, channels = rows * columns, steps * len(variables)
    names, per_day = [*keys, "day"], 24 // step_hours
    on_step = df.where((F.hour("ts") % step_hours == 0) & (F.minute("ts") == 0) & F.col("variable").isin(list(variables)))
    step = F.floor(F.hour("ts") / step_hours)
    before = steps - per_day  # steps that lie before the day's own
    days = F.array(*(F.struct(F.date_add(F.to_date("ts"), k).alias("day"), (step + before - k * per_day).alias("step")) for k in range(-(-before // per_day) + 1)))
    variable = F.array_position(F.array(*(F.lit(v) for v in variables)), F.col("variable")) - 1
    placed = on_step.select(*keys, F.inline(days), variable.alias("_v"), (F.col("lat_idx") * columns + F.col("lon_idx")).alias("_cell"), finite("value").alias("_x"))
    placed = placed.where(F.col("step") >= 0).withColumn("_place", (F.col("step") * len(variables) + F.col("_v")) * cells + F.col("_cell"))
    schema = T.StructType([*(placed.schema[k] for k in names), *T.StructType.fromDDL("complete_channels int, present binary, tensor array<float>").fields])

    def assemble(group):
        known = group.filter(group["_x"].is_valid())
        at = known["_place"].to_numpy()
        tensor, present = np.zeros(channels * cells, np.float32), np.zeros(channels * cells, bool)
        tensor[at], present[at] = known["_x"].to_numpy(), True
        complete = int(present.reshape(channels, cells).all(1).sum())
        return pa.table({
            **{k: group[k][:1] for k in names}, "complete_channels": pa.array([complete], pa.int32()),
            "present": pa.array([np.packbits(present, bitorder="little").tobytes()], pa.binary()),
            "tensor": pa.array([tensor if complete == channels else None], pa.list_(pa.float32())),
        })

    made = placed.drop("step", "_v", "_cell").groupBy(*names).applyInArrow(assemble, schema)
    return made.withColumn("skip_reason", F.when(F.col("complete_channels") < channels, F.lit("incomplete_steps")))


def tile(df: DataFrame, step: str = "step", size: int = 40, across: int = 4) -> DataFrame:
    """Place step slices side by side, row major: cell (i, j) of step s moves to the big layout."""
    s = F.col(step)
    return df.withColumns(
        {
            "row": F.floor(s / across) * size + F.col("lat_idx"),
            "column": s % across * size + F.col("lon_idx"),
        }
    )
