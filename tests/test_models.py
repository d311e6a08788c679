import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import baselines, bootstrap, linear, rollout, tide, verify

T0 = dt.datetime(2014, 1, 1)


def closed_form(x, y, alpha):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean(axis=0)))
    w = w / scale[:, None]
    return w, y.mean(axis=0) - mean @ w


def frame(spark, x, y, origins):
    rows = [("st", t, [float(v) for v in a], [float(v) for v in b]) for t, a, b in zip(origins, x, y, strict=True)]
    return spark.createDataFrame(rows, "station_id string, origin timestamp, features array<double>, labels array<double>").repartition(6)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 4)) * [1, 10, 300, 0] + [0, 5, 101_000, 2]
    y = np.column_stack([x[:, 0] + 0.01 * x[:, 2], x[:, 1] - x[:, 0]]) + rng.normal(0, 0.3, (400, 2))
    return x, y, [T0 + dt.timedelta(hours=6 * i) for i in range(400)]


def test_ridge_equals_closed_form_with_a_constant_feature(spark, sample):
    x, y, origins = sample
    for r in linear.ridge_fit(frame(spark, x, y, origins), ["station_id"], (1, 2), 10.0).collect():
        w, b = closed_form(x, y, 10.0)
        assert np.allclose(r.coefficients, w[:, r.lead_hours - 1], rtol=1e-6, atol=1e-8)
        assert r.intercept == pytest.approx(b[r.lead_hours - 1], rel=1e-5, abs=1e-5)


def test_selection_matches_brute_force_and_ignores_later_rows(spark, sample):
    x, y, origins = sample
    early, tuning = slice(0, 200), slice(200, 300)
    at = lambda i: F.lit(origins[i]).cast("timestamp")

    def fitted(x, y):
        df = frame(spark, x, y, origins)
        models = linear.ridge_select(
            df, ["station_id"], (1, 2), F.col("origin") < at(200), (F.col("origin") >= at(200)) & (F.col("origin") < at(300)),
            groups={"all": [0, 1, 2, 3], "first": [0]},
        )
        return {(r.family, r.lead_hours): r for r in models.collect()}

    got = fitted(x, y)
    changed = x.copy()
    changed[300:] += 1000
    again = fitted(changed, y)
    for key, r in got.items():
        columns = [0, 1, 2, 3] if key[0] == "all" else [0]
        errors = []
        for alpha in linear.ALPHAS:
            w, b = closed_form(x[early][:, columns], y[early], alpha)
            errors.append(np.mean((x[tuning][:, columns] @ w + b - y[tuning]) ** 2, axis=0)[key[1] - 1])
        assert r.alpha == linear.ALPHAS[int(np.argmin(errors))]
        assert r.tuning_rmse == pytest.approx(np.sqrt(min(errors)), rel=1e-4)
        assert np.allclose(r.coefficients, again[key].coefficients, rtol=1e-9) and r.alpha == again[key].alpha
        if key[0] == "first":
            assert list(r.coefficients[1:]) == [0.0, 0.0, 0.0]


def test_folds_end_before_the_gap(spark):
    rng = np.random.default_rng(6)
    origins = [dt.datetime(2011, 1, 1) + dt.timedelta(hours=12 * i) for i in range(4 * 730)]
    x, y = rng.normal(0, 1, (len(origins), 2)), rng.normal(0, 1, (len(origins), 1))

    def fitted(y):
        models = linear.expanding_oof(frame(spark, x, y, origins), ["station_id"], (1,), (2013, 2014), 72)
        return {r.prediction_year: r for r in models.collect()}

    base = fitted(y)
    inside = np.array([dt.datetime(2012, 12, 29) < t < dt.datetime(2013, 1, 1) for t in origins])
    changed = y.copy()
    changed[inside] += 1e6
    late = fitted(changed)
    assert np.allclose(base[2013].coefficients, late[2013].coefficients, rtol=1e-9) and base[2013].alpha == late[2013].alpha
    assert not np.allclose(base[2014].coefficients, late[2014].coefficients, rtol=1e-2)
    assert base[2013].train_rows == sum(t <= dt.datetime(2012, 12, 29) for t in origins)
    train = np.array([t <= dt.datetime(2012, 12, 29) for t in origins])
    w, b = closed_form(x[train], y[train], base[2013].alpha)
    assert np.allclose(base[2013].coefficients, w[:, 0], atol=1e-9)


def test_recursion_equals_a_loop_and_sees_no_future(spark):
    rng = np.random.default_rng(7)
    history, weather = rng.normal(0, 1, 3), rng.normal(0, 1, (3 + 4, 2))
    w, b = rng.normal(0, 0.3, 9), 0.2
    want, h = [], list(history)
    for k in range(5):
        value = b + np.dot(w, np.concatenate([weather[k : k + 3].ravel(), h]))
        want.append(value)
        h = [*h[1:], value]
    df = spark.createDataFrame([(weather.tolist(), history.tolist())], "weather array<array<double>>, history array<double>")
    out = linear.recursive_linear(df, 5, "weather", "history", F.array(*[F.lit(float(v)) for v in w]), F.lit(b)).first()
    assert out.predictions == pytest.approx(want)


def test_recursive_from_rejects_holes(spark):
    df = spark.createDataFrame([("a", T0, [1.0, None, 3.0], [1.0] * 12)], "station_id string, origin timestamp, history array<double>, targets array<double>")
    with pytest.raises(Exception, match="incomplete"):
        linear.recursive_from(df, None, 12, None, "history", "targets", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.lit(0.0)).collect()


def test_residual_boost_weight_is_the_best_listed(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        f = rng.normal()
        rows.append(("a", i, [float(f)], 0.0, float(np.sign(f) + rng.normal(0, 0.1))))
    df = spark.createDataFrame(rows, "station_id string, i long, features array<double>, ridge_m double, observed_m double")
    fused, weights = linear.residual_boost(df, F.col("i") < 400, F.col("i") >= 400, origin="i", rounds=3)
    best = weights.first()
    held = [(r.observed_m, r.ridge_m, r.correction, r.fused_m) for r in fused.where(F.col("i") >= 400).collect()]
    rmse = {w: np.sqrt(np.mean([(b + w * c - o) ** 2 for o, b, c, _ in held])) * 100 for w in linear.CORRECTION_WEIGHTS}
    assert best.correction_weight == min(rmse, key=rmse.get) and best.validation_rmse_cm == pytest.approx(rmse[best.correction_weight])
    assert best.base_rmse_cm == pytest.approx(rmse[0.0])


# --- tide ------------------------------------------------------------------------------------------------


def levels(spark, days=60, extra=0.0, skip=()):
    rows = []
    for h in range(days * 24):
        if h in skip:
            continue
        v = 2.0
        for name, (a, g) in {"M2": (1.5, 40.0), "K1": (0.4, 200.0), "M4": (0.1, 300.0)}.items():
            v += a * np.cos(np.radians(tide.SPEEDS[name] * h - g))
        rows.append(("st", T0 + dt.timedelta(hours=h), float(v + (extra if h >= 45 * 24 else 0.0))))
    return spark.createDataFrame(rows, "station_id string, ts timestamp, water_level double")


def test_tide_recovers_known_amplitudes(spark):
    df = levels(spark, skip={100, 101, 700})
    fitted = tide.fit_tide(df)
    found = {r.constituent: (r.amplitude, r.phase_deg) for r in tide.amplitudes(fitted).collect()}
    for name, want in {"M2": (1.5, 40.0), "K1": (0.4, 200.0), "M4": (0.1, 300.0)}.items():
        assert found[name] == pytest.approx(want, abs=0.02)
    out = tide.separate_tide(df, fitted).collect()
    assert len(out) == 60 * 24 and sum(not r.qc_valid for r in out) == 3
    assert max(abs(r.surge_m) for r in out if r.qc_valid) < 1e-4


def test_tide_cutoff_hides_later_levels(spark):
    a = tide.fit_tide(levels(spark), cutoff="2014-02-10 00:00:00").first()
    b = tide.fit_tide(levels(spark, extra=5.0), cutoff="2014-02-10 00:00:00").first()
    assert np.allclose(a.harmonics, b.harmonics, atol=1e-9) and a.fit_rows == 40 * 24 + 1


def test_tide_refuses_short_or_repeated_records(spark):
    with pytest.raises(Exception, match="too few"):
        tide.fit_tide(levels(spark, days=20)).collect()
    df = levels(spark)
    with pytest.raises(Exception, match="repeated times"):
        tide.fit_tide(df.unionByName(df.limit(1))).collect()


# --- bootstrap -----------------------------------------------------------------------------------------------


def test_bootstrap_equals_brute_force_over_the_same_draws(spark):
    import hashlib

    rng = np.random.default_rng(9)
    kept = [h for h in range(400) if not 100 <= h < 171 and h != 399]
    obs, model, ref = rng.normal(0, 1, len(kept)), rng.normal(0, 0.5, len(kept)), rng.normal(0, 0.8, len(kept))
    rows = [("st", T0 + dt.timedelta(hours=h), float(o), float(o + m), float(o + r)) for h, o, m, r in zip(kept, obs, model, ref, strict=True)]
    df = spark.createDataFrame(rows, "station_id string, ts timestamp, observed_m double, model_m double, reference_m double")
    got = bootstrap.block_bootstrap(df, 48, 60, 7).first()
    block = np.array(kept) // 48
    blocks = [np.flatnonzero(block == b) for b in np.unique(block)]
    differences, skills = [], []
    for rep in range(1, 61):
        taken, number = [], 0
        while len(taken) < len(kept):
            number += 1
            digest = int(hashlib.md5(f"7:{rep}:{number}".encode()).hexdigest()[:12], 16)
            taken.extend(blocks[digest % len(blocks)])
        p = np.array(taken[: len(kept)])
        m, r = np.mean(model[p] ** 2), np.mean(ref[p] ** 2)
        differences.append((np.sqrt(m) - np.sqrt(r)) * 100)
        skills.append(1 - m / r)
    assert got.calendar_block_count == len(blocks) and got.n == len(kept) and got.repetitions == 60
    assert got.rmse_difference_low_cm == pytest.approx(np.quantile(differences, 0.025))
    assert got.mse_skill_high == pytest.approx(np.quantile(skills, 0.975))
    assert got.mse_skill == pytest.approx(1 - np.mean(model**2) / np.mean(ref**2))


# --- verification ----------------------------------------------------------------------------------------------


def test_half_the_reference_error_is_skill_three_quarters(spark, hours):
    df = hours({"a": [float(i % 11) / 10 + i / 1000 for i in range(200)]})
    models = {"far": F.lit(None).cast("double"), "near": F.lit(None).cast("double")}
    table = baselines.baseline_forecasts(df, (1,), 1, models=models).withColumn(
        "predicted_m", F.col("observed_m") + F.when(F.col("model") == "far", 0.02).otherwise(0.01)
    )
    rows = {r.model: r for r in verify.verify_by_lead(table, "far").collect()}
    assert rows["near"].skill_vs_reference == pytest.approx(0.75) and rows["far"].rmse_cm == pytest.approx(2.0)
    assert rows["near"].bias_cm == pytest.approx(1.0) and rows["near"].pearson_r == pytest.approx(1.0)


def test_scores_without_variance_or_pairs_are_null(spark):
    rows = [("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("none", None, 1.0), ("none", float("nan"), 2.0), ("one", 1.0, 1.5)]
    out = {r.k: r for r in verify.verify(spark.createDataFrame(rows, "k string, observed_m double, predicted_m double"), ["k"]).collect()}
    assert out["flat"].pearson_r is None and out["flat"].r2 is None and out["flat"].n == 2
    assert out["none"].n == 0 and out["none"].rmse_cm is None and out["one"].pearson_r is None


def test_rapid_rise_without_rises_reports_zero(spark, hours):
    falling = hours({"a": [5.0 - i for i in range(10)]}, value="observed_m").withColumn("predicted_m", F.col("observed_m"))
    assert verify.rapid_rise_verify(falling).first().n == 0


def test_persistence_does_not_see_its_target(spark, hours):
    df = hours({"a": [float(i) for i in range(30)]})
    changed = hours({"a": [float(i) if i < 20 else -7.0 for i in range(30)]})
    cut = dt.datetime(2024, 1, 1, 18)

    def made(d):
        return {(r.origin, r.lead_hours): r.predicted_m for r in baselines.baseline_forecasts(d, (1, 3), 3).where(F.col("model") == "persistence").collect()}

    a, b = made(df), made(changed)
    assert all(a[k] == b[k] for k in a if k[0] <= cut)


# --- rollout by companion powers -------------------------------------------------------------------------


def _rolled_series(spark, change=0.0):
    rng = np.random.default_rng(11)
    start, count, hole = dt.datetime(2024, 1, 1), 60, 20
    levels, weather = rng.normal(0, 1, count), rng.normal(0, 1, (count, 2))
    rows = [("a", start + dt.timedelta(hours=i), None if i == hole else float(v + (change if i >= 30 else 0.0)), *map(float, w))
            for i, (v, w) in enumerate(zip(levels, weather, strict=True))]
    w, b = rng.normal(0, 0.3, 9), 0.2
    models = spark.createDataFrame([("a", [float(x) for x in w], b)], "station_id string, coefficients array<double>, intercept double")
    return spark.createDataFrame(rows, "station_id string, ts timestamp, surge_m double, u double, v double"), models, levels, weather, w, b, start


def test_rollout_by_powers_equals_a_loop(spark):
    df, models, levels, weather, w, b, start = _rolled_series(spark)
    got = {r.origin: r for r in rollout.rollout(df, models, ["u", "v"], 3, 12).collect()}
    want = {}
    for t in range(3, 60 - 11):
        if 20 in (t - 3, t - 2, t - 1):
            continue
        h, made = list(levels[t - 3 : t]), []
        for k in range(12):
            value = b + np.dot(w, np.concatenate([weather[t + k - 3 : t + k].ravel(), h]))
            made.append(value)
            h = [*h[1:], value]
        want[start + dt.timedelta(hours=t)] = made
    assert set(got) == set(want)
    assert all(np.allclose(got[t].predictions, want[t], atol=1e-12) for t in want)
    assert got[start + dt.timedelta(hours=15)].targets[5] is None  # the hole is a target, not an input


def test_rollout_sees_no_level_from_the_origin_on(spark):
    origin = dt.datetime(2024, 1, 2, 6)
    made = []
    for change in (0.0, 100.0):
        df, models, *_ = _rolled_series(spark, change)
        made.append(rollout.rollout(df, models, ["u", "v"], 3, 24).where(F.col("origin") == F.lit(origin)).first())
    assert list(made[0].predictions) == list(made[1].predictions) and list(made[0].targets) != list(made[1].targets)


def test_lead_rows_refuse_unknown_targets(spark):
    df, models, *_ = _rolled_series(spark)
    rolled = rollout.rollout(df, models, ["u", "v"], 3, 12)
    assert rollout.lead_rows(rolled).where("observed_m IS NULL").count() > 0
    with pytest.raises(Exception, match="targets are incomplete"):
        rollout.lead_rows(rolled, strict=True).collect()


def test_step_samples_need_every_hour(spark):
    df, _, levels, weather, *_ , start = _rolled_series(spark)
    rows = {r.origin: r for r in rollout.step_samples(df, ["u", "v"], 3).collect()}
    assert set(rows) == {start + dt.timedelta(hours=t) for t in range(3, 60) if t not in (20, 21, 22, 23)}
    one = rows[start + dt.timedelta(hours=40)]
    assert np.allclose(one.features, [*weather[37:40].ravel(), *levels[37:40]]) and one.labels == [pytest.approx(levels[40])]


def test_constant_columns_are_no_features(spark):
    x = np.array([[0.1, 1.0], [0.1, 2.0], [0.1, 4.0]])  # three times 0.1 does not add up exactly
    y = np.array([[1.0], [3.0], [2.0]])
    origins = [T0 + dt.timedelta(hours=i) for i in range(3)]
    model = linear.ridge_fit(frame(spark, x, y, origins), ["station_id"], (1,), 0.01).first()
    w, b = closed_form(x[:, 1:], y, 0.01)
    assert abs(model.coefficients[0]) < 1e-9 and model.coefficients[1] == pytest.approx(w[0, 0]) and model.intercept == pytest.approx(b[0])
