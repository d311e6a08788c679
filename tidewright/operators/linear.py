"""Ridge regressions from sums of products, recursion with fitted coefficients, and boosted corrections.

Every linear fit needs only the matrix of sums of products of [features, 1, targets]. Tasks build it for
their own rows, Spark adds the matrices per key, and a solve of fixed size per key follows. The rows are
read once, however many penalties, targets or feature groups are tried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators import trees

# Ridge penalties tried, the penalty used when none can be tried, and correction weights.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10_000.0, 100_000.0, 1_000_000.0)
DEFAULT_ALPHA = 10.0
CORRECTION_WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0, 1.25)

_FLUSH = 64  # matrices a task holds before it passes them on


def gram(df: DataFrame, keys: Sequence[str], features: str = "features", targets: str = "labels") -> DataFrame:
    """Upper triangle of the sums of products of [features, 1, targets] per key: ``keys, i, j, v``.

    Rows with a null or non-finite entry do not count.
    """
    chosen = df.select(*keys, features, targets)
    schema = T.StructType(
        [chosen.schema[k] for k in keys]
        + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("v", T.DoubleType())]
    )
    names = list(keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for key, matrix in held.items():
                i, j = np.triu_indices(len(matrix))
                part = pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": matrix[i, j]})
                for at, (name, value) in enumerate(zip(names, key, strict=True)):
                    part.insert(at, name, value)
                yield part
            held.clear()

        for batch in batches:
            for key, rows in batch.groupby(names, sort=False, dropna=False):
                x = np.vstack(rows[features].to_numpy()).astype(float)
                y = np.vstack(rows[targets].to_numpy()).astype(float)
                a = np.hstack([x, np.ones((len(x), 1)), y])
                a = a[np.isfinite(a).all(axis=1)]
                product = a.T @ a
                key = key if isinstance(key, tuple) else (key,)
                held[key] = held[key] + product if key in held else product
            if len(held) >= _FLUSH:
                yield from flush()
        yield from flush()

    return chosen.mapInPandas(partial, schema).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def _square(rows: pd.DataFrame) -> np.ndarray:
    """Full symmetric matrix from its upper triangle."""
    size = int(rows["j"].max()) + 1
    matrix = np.zeros((size, size))
    i, j, v = rows["i"].to_numpy(), rows["j"].to_numpy(), rows["v"].to_numpy()
    matrix[i, j] = v
    matrix[j, i] = v
    return matrix


def _ridge(matrix: np.ndarray, p: int, alpha: float, columns: Sequence[int], target: int) -> tuple[np.ndarray, float]:
    """Coefficients in original units and intercept of one target on standardised ``columns``."""
    n = matrix[p, p]
    index = np.asarray(columns, dtype=int)
    mean = matrix[index, p] / n
    cross = matrix[np.ix_(index, index)] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cross), 0.0) / n)
    # below this share of its sum of squares a spread is rounding: the column is constant
    constant = np.diag(cross) <= 1e-13 * np.diag(matrix)[index]
    scale[constant | (scale <= 1e-12 * np.maximum(1.0, np.abs(mean)))] = 1.0
    y_mean = matrix[p, p + 1 + target] / n
    moment = matrix[index, p + 1 + target] - n * mean * y_mean
    weights = np.linalg.solve(cross / np.outer(scale, scale) + alpha * np.eye(len(index)), moment / scale)
    coefficients = weights / scale
    return coefficients, float(y_mean - mean @ coefficients)


def _sse(matrix: np.ndarray, p: int, columns: Sequence[int], coefficients: np.ndarray, intercept: float, target: int) -> float:
    """Squared error of a linear forecast over the rows behind ``matrix``."""
    index = np.append(np.asarray(columns, dtype=int), p)
    w = np.append(coefficients, intercept)
    t = p + 1 + target
    return float(matrix[t, t] - 2 * w @ matrix[index, t] + w @ matrix[np.ix_(index, index)] @ w)


def _first_best(errors: Sequence[float]) -> int:
    """Position of the least error; errors equal but for rounding go to the first."""
    values = np.asarray(errors)
    return int(np.argmax(values <= values.min() + 1e-12 * abs(values.min())))


def _model_schema(df: DataFrame, keys: Sequence[str], extra: str = "") -> T.StructType:
    fields = [df.schema[k] for k in keys]
    tail = T.StructType(
        [
            T.StructField("lead_hours", T.LongType()), T.StructField("alpha", T.DoubleType()),
            T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType())),
            T.StructField("tuning_rmse", T.DoubleType()), T.StructField("train_rows", T.LongType()),
        ]
    )
    named = [T.StructField(name, kind) for name, kind in (("family", T.StringType()), ("prediction_year", T.LongType())) if name in extra]
    return T.StructType([*fields, *named, *tail.fields])


def ridge_fit(
    df: DataFrame, keys: Sequence[str], leads: Sequence[int], alpha: float = 1.0, features: str = "features", targets: str = "labels"
) -> DataFrame:
    """One ridge model per key and lead; ``leads[t]`` names target position t."""
    names, wanted = list(keys), list(leads)

    def solve(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        matrix = _square(rows)
        p = len(matrix) - 1 - len(wanted)
        out = []
        for t, lead in enumerate(wanted):
            w, b = _ridge(matrix, p, alpha, range(p), t)
            out.append((*key, lead, alpha, b, w.tolist(), None, int(matrix[p, p])))
        return pd.DataFrame(out, columns=[*names, "lead_hours", "alpha", "intercept", "coefficients", "tuning_rmse", "train_rows"])

    return gram(df, keys, features, targets).groupBy(*keys).applyInPandas(solve, _model_schema(df, keys))


def ridge_select(
    df: DataFrame, keys: Sequence[str], leads: Sequence[int], early: Column, tuning: Column,
    alphas: Sequence[float] = ALPHAS, groups: dict[str, Sequence[int]] | None = None,
    features: str = "features", targets: str = "labels",
) -> DataFrame:
    """Per key, feature group and lead: fit on early rows, keep the penalty of least tuning RMSE, refit on both.

    Rows that are neither early nor tuning are ignored. ``groups`` maps a family name to feature positions
    and costs no further pass. Coefficients of features outside a group are 0.
    """
    part = df.withColumn("_part", F.when(early, F.lit(0)).when(tuning, F.lit(1))).where(F.col("_part").isNotNull())
    names, wanted, penalties = list(keys), list(leads), list(alphas)
    chosen = {k: list(v) for k, v in groups.items()} if groups else None

    def solve(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        parts = {k: _square(g) for k, g in rows.groupby("_part")}
        columns = [*names, "family", "lead_hours", "alpha", "intercept", "coefficients", "tuning_rmse", "train_rows"]
        some = next(iter(parts.values()))
        p = len(some) - 1 - len(wanted)
        both = sum(parts.values())
        out = []
        for family, index in (chosen or {"all": range(p)}).items():
            for t, lead in enumerate(wanted):
                alpha, best = DEFAULT_ALPHA, None
                if 0 in parts and 1 in parts:
                    errors = []
                    for candidate in penalties:
                        w, b = _ridge(parts[0], p, candidate, index, t)
                        errors.append(_sse(parts[1], p, index, w, b, t) / parts[1][p, p])
                    alpha = penalties[_first_best(errors)]
                    best = float(np.sqrt(max(min(errors), 0.0)))
                w, b = _ridge(both, p, alpha, index, t)
                full = np.zeros(p)
                full[list(index)] = w
                out.append((*key, family, lead, alpha, b, full.tolist(), best, int(both[p, p])))
        return pd.DataFrame(out, columns=columns)

    table = gram(part, [*keys, "_part"], features, targets)
    return table.groupBy(*keys).applyInPandas(solve, _model_schema(df, keys, "family"))


def expanding_oof(
    df: DataFrame, keys: Sequence[str], leads: Sequence[int], years: Sequence[int], gap_hours: int = 72,
    alphas: Sequence[float] = ALPHAS, origin: str = "origin", features: str = "features", targets: str = "labels",
) -> DataFrame:
    """One model per key, prediction year and lead, trained on origins at least ``gap_hours`` before 1 January.

    The penalty is chosen on the year before the prediction year against all earlier ones, and is 10 when
    either side is empty. Sums are taken once per calendar year (and its tail inside the gap); each fold
    adds up the years it may see.
    """
    next_year = F.make_timestamp(F.year(origin) + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    tail = F.col(origin) > next_year - F.make_interval(hours=F.lit(gap_hours))
    tagged = df.withColumns({"_year": F.year(origin), "_tail": tail.cast("int")})
    names, wanted, folds, penalties = list(keys), list(leads), list(years), list(alphas)

    def solve(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        parts = {(int(y), int(t)): _square(g) for (y, t), g in rows.groupby(["_year", "_tail"])}
        p = len(next(iter(parts.values()))) - 1 - len(wanted)
        columns = [*names, "prediction_year", "lead_hours", "alpha", "intercept", "coefficients", "tuning_rmse", "train_rows"]
        out = []
        for fold in folds:
            early = [m for (y, _), m in parts.items() if y < fold - 1]
            last = [m for (y, t), m in parts.items() if y == fold - 1 and t == 0]
            if not (early or last) or not any(y == fold for y, _ in parts):
                continue
            both = sum(early + last)
            for t, lead in enumerate(wanted):
                alpha, best = DEFAULT_ALPHA, None
                if early and last:
                    first, second = sum(early), sum(last)
                    errors = []
                    for candidate in penalties:
                        w, b = _ridge(first, p, candidate, range(p), t)
                        errors.append(_sse(second, p, range(p), w, b, t) / second[p, p])
                    alpha = penalties[_first_best(errors)]
                    best = float(np.sqrt(max(min(errors), 0.0)))
                w, b = _ridge(both, p, alpha, range(p), t)
                out.append((*key, fold, lead, alpha, b, w.tolist(), best, int(both[p, p])))
        return pd.DataFrame(out, columns=columns)

    table = gram(tagged, [*keys, "_year", "_tail"], features, targets)
    return table.groupBy(*keys).applyInPandas(solve, _model_schema(df, keys, "prediction_year"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def predict(df: DataFrame, models: DataFrame, keys: Sequence[str], features: str = "features") -> DataFrame:
    """One row per sample and model of its key with ``predicted_m``; expressions only, no Python."""
    value = F.col("intercept") + dot(F.col("coefficients"), F.col(features))
    kept = [c for c in df.columns if c != features]
    named = [c for c in models.columns if c in ("family", "prediction_year") and c not in df.columns]
    return df.join(models, list(keys)).select(*kept, *named, "lead_hours", value.alias("predicted_m"))


def predict_oof(df: DataFrame, models: DataFrame, keys: Sequence[str], origin: str = "origin", features: str = "features") -> DataFrame:
    """Predict each row with the fold of its own year."""
    dated = df.withColumn("prediction_year", F.year(origin).cast("bigint"))
    return predict(dated, models, [*keys, "prediction_year"], features)


def recursive_linear(
    df: DataFrame, leads: int, weather: str | None, history: str, coefficients: str | Column, intercept: str | Column,
    name: str = "predictions",
) -> DataFrame:
    """Roll a one-step linear model forward: predict, drop the oldest hour, append the own prediction.

    ``history``: array of the last n levels, oldest first. ``weather``: array over hours target-n of the first
    lead up to target-1 of the last lead, each an array of that hour's columns (null for none).
    ``coefficients`` follow [n hours of weather, n levels]. Observed future levels are never used.
    """
    past = F.col(history)
    n = F.size(past)
    w = F.col(coefficients) if isinstance(coefficients, str) else coefficients
    b = F.col(intercept) if isinstance(intercept, str) else intercept
    start = F.struct(past.alias("levels"), F.array().cast("array<double>").alias("made"))

    def step(state, k):
        known = F.concat(F.flatten(F.slice(F.col(weather), k, n)), state["levels"]) if weather else state["levels"]
        value = b + dot(w, known)
        return F.struct(
            F.concat(F.slice(state["levels"], F.lit(2), n - 1), F.array(value)).alias("levels"),
            F.concat(state["made"], F.array(value)).alias("made"),
        )

    made = F.aggregate(F.sequence(F.lit(1), F.lit(leads)), start, step, lambda s: s["made"])
    return df.withColumn(name, made)


def recursive_from(
    df: DataFrame, start: str | None, steps: int, weather: str | None, history: str, observed: str, coefficients: Column, intercept: Column,
    keys: Sequence[str] = ("station_id",), origin: str = "origin",
) -> DataFrame:
    """One start: prediction, observation and error per lead. ``steps`` is 12, 24, 48 or 72 hours.

    ``start`` None takes the origins as given. A history, forcing or target array with a hole fails the job.
    """
    if steps not in (12, 24, 48, 72):
        raise ValueError("steps must be 12, 24, 48 or 72")
    one = df if start is None else df.where(F.col(origin) == F.lit(start).cast("timestamp"))
    hole = F.exists(F.col(history), lambda v: v.isNull()) | (F.size(observed) < steps)
    if weather:
        hole = hole | F.exists(F.flatten(weather), lambda v: v.isNull())
    failed = F.raise_error(F.lit("history, forcing or targets are incomplete")).cast("boolean")
    checked = one.where(F.when(hole, failed).otherwise(F.lit(True)))
    rolled = recursive_linear(checked, steps, weather, history, coefficients, intercept)
    rows = rolled.select(
        *keys, origin, F.posexplode(F.arrays_zip(F.col("predictions").alias("p"), F.slice(observed, 1, steps).alias("o"))).alias("_i", "_x")
    )
    error = (F.col("_x.p") - F.col("_x.o")) * 100
    return rows.select(
        *keys, origin, (F.col("_i") + 1).alias("lead_hours"), F.col("_x.p").alias("predicted_m"), F.col("_x.o").alias("observed_m"),
        error.alias("error_cm"), F.abs(error).alias("absolute_error_cm"),
    )


# --- boosted trees ---------------------------------------------------------------------------------------


def boosted_direct(
    df: DataFrame, training: Column, leads: Sequence[int], features: str = "features", targets: str = "labels",
    keys: Sequence[str] = ("station_id",), origin: str = "origin", **settings,
) -> DataFrame:
    """One tree ensemble per key and lead, trained on ``training`` rows and applied to all; rows keep their columns.

    All ensembles grow in the same jobs (:func:`tidewright.operators.trees.fit`, which takes the ``settings``).
    """
    labelled = F.explode(F.array(*(F.struct(F.lit(int(lead)).cast("bigint").alias("l"), F.get(targets, F.lit(i)).alias("y")) for i, lead in enumerate(leads))))
    rows = df.withColumn("_label", labelled).withColumns({"lead_hours": F.col("_label.l"), "observed_m": F.col("_label.y")}).drop("_label")
    group = [*keys, "lead_hours"]
    return trees.predict(rows, trees.fit(rows.where(training), group, [origin], features, "observed_m", **settings), group, features)


def residual_boost(
    df: DataFrame, training: Column, validation: Column, base: str = "ridge_m", observed: str = "observed_m", features: str = "features",
    weights: Sequence[float] = CORRECTION_WEIGHTS, keys: Sequence[str] = ("station_id",), origin: str = "origin", **settings,
) -> tuple[DataFrame, DataFrame]:
    """Trees per key, fitted to what an out-of-sample linear forecast misses, and the weight each key gives them.

    ``base`` must hold predictions made without the row itself on training rows. Returns rows with
    ``correction`` and ``fused_m``, and the weights. The squared error is quadratic in the weight, so three
    sums settle every candidate.
    """
    group = list(keys)
    labelled = df.withColumns({"_inputs": F.concat(F.col(features), F.array(F.col(base))), "_label": F.col(observed) - F.col(base)})
    models = trees.fit(labelled.where(training), group, [origin], "_inputs", "_label", **settings)
    rows = trees.predict(labelled, models, group, "_inputs", "correction").drop("_inputs")
    miss, c = F.col("_label"), F.col("correction")
    sums = rows.where(validation).groupBy(*group).agg(
        F.sum(miss * miss).alias("_mm"), F.sum(miss * c).alias("_mc"), F.sum(c * c).alias("_cc"), F.count(miss).alias("_n")
    )
    tried = sums.select(*group, "_mm", "_mc", "_cc", "_n", F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("weight"))
    mse = (F.col("_mm") - 2 * F.col("weight") * F.col("_mc") + F.col("weight") * F.col("weight") * F.col("_cc")) / F.col("_n")
    scored = tried.withColumn("_mse", F.greatest(mse, F.lit(0.0)))
    best = scored.groupBy(*group).agg(
        F.min_by("weight", F.struct("_mse", "weight")).alias("correction_weight"),
        (F.sqrt(F.min("_mse")) * 100).alias("validation_rmse_cm"), (F.sqrt(F.max(F.col("_mm") / F.col("_n"))) * 100).alias("base_rmse_cm"),
    )
    fused = rows.join(best.select(*group, "correction_weight"), group).withColumn(
        "fused_m", F.col(base) + F.col("correction_weight") * F.col("correction")
    ).drop("_label", "correction_weight")
    return fused, best
