import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.operators import samples


def test_36_hours_with_24_steps_give_12_samples(hours):
    df = hours({"a": range(36)})
    out = samples.valid_targets(df, 24)
    assert out.count() == 12 and out.where(F.col("skip_reason").isNull()).count() == 12
    split = samples.split_ratio(out, 0.75).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": 9, "validation": 3}


def test_missing_hour_is_non_contiguous(hours):
    values = [float(i) for i in range(30)]
    values[10] = ...
    reasons = {r.skip_reason: r["count"] for r in samples.valid_targets(hours({"a": values}), 4).groupBy("skip_reason").count().collect()}
    assert reasons["non_contiguous"] == 4


def test_reasons_come_in_order(hours):
    df = hours({"a": [0, 1, None, 3, 4, 5, 6, 7]}).withColumn("ok", F.hour("ts") != 4)
    got = {r.ts.hour: r.skip_reason for r in samples.valid_targets(df, 2, valid="ok").collect()}
    assert got == {2: "missing_surge", 3: "missing_surge", 4: "missing_surge", 5: "missing_atmosphere", 6: "missing_atmosphere", 7: None}


def test_common_origins_need_only_requested_targets(hours):
    values = [float(i) for i in range(130)]
    values[30] = None
    out = samples.common_origins(hours({"a": values}), 24, 72, (1, 3, 6, 12, 24, 48, 72), year=2024)
    index = sorted((r.ts - dt.datetime(2024, 1, 1)).total_seconds() / 3600 for r in out.collect())
    assert 24 in index and 28 not in index and 30 not in index and index[-1] == 58


def test_rollout_origins_stay_inside_the_year(hours):
    df = hours({"a": range(36)}, start="1995-12-31 12:00:00")
    out = [r.ts for r in samples.rollout_origins(df, 4, 3, [1996]).collect()]
    assert min(out) == dt.datetime(1996, 1, 1) and all(t.year == 1996 and (t + dt.timedelta(hours=2)).year == 1996 for t in out)


def test_direct_origins_do_not_cross_the_year(hours):
    df = hours({"a": range(72)}, start="2015-12-30 12:00:00")
    out = [r.ts for r in samples.direct_origins(df, 6, 24).collect()]
    assert dt.datetime(2015, 12, 30, 23) in out and all((t + dt.timedelta(hours=24)).year == t.year for t in out)
    labels = samples.direct_labels(df, 6, 24).where(F.col("origin") == "2015-12-30 20:00:00").orderBy("lead_hours").collect()
    assert [r.label for r in labels] == [float(i) for i in range(9, 33)]


def test_features_ignore_the_future(hours):
    base = [float(i % 7) for i in range(60)]
    changed = base[:40] + [99.0] * 20

    def made(values):
        df = hours({"a": values}).withColumn("wind", F.col("surge_m") * 2)
        rows = samples.feature_matrix(df, ["wind"], 6, 4, mode="past").collect()
        return {r.origin: list(r.features) for r in rows}

    a, b = made(base), made(changed)
    cut = dt.datetime(2024, 1, 2, 15)
    assert a and all(a[t] == b[t] for t in a if t <= cut)
    width = {len(v) for v in a.values()}
    assert width == {12}


def test_sequence_hides_future_levels(hours):
    df = hours({"a": range(20)}).withColumn("wind", F.lit(1.0))
    row = samples.sequence_features(df, ["wind"], 4, 3).orderBy("origin").first()
    assert [s[1] for s in row.sequence] == [0.0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0] and [s[2] for s in row.sequence] == [1.0] * 4 + [0.0] * 3


def test_year_splits(spark):
    rows = [("a", dt.datetime(y, 6, 1) + dt.timedelta(hours=h), 1.0) for y in (2011, 2012, 2013, 2014) for h in range(48)]
    df = spark.createDataFrame(rows, "station_id string, ts timestamp, surge_m double")
    got = {r.split: r["count"] for r in samples.split_years(df, (2011, 2012), 2013, 2014).groupBy("split").count().collect()}
    assert got == {"train": 96, "validation": 48, "test": 48}
    with pytest.raises(ValueError):
        samples.split_years(df, (2011, 2013), 2013, 2014)
    assert samples.require_splits(samples.split_years(df, (2011, 2012), 2013, 2014)).count() == 192
    with pytest.raises(Exception, match="empty split"):
        samples.require_splits(samples.split_years(df, (2011, 2012), 2013, 2015)).collect()
    few = samples.split_first_years(df, 4).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in few} == {"train": 153, "validation": 39}


def test_scaler_uses_training_rows_and_survives_zero_spread(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 1), ("a", 100.0, 0), ("b", 5.0, 1)], "k string, v double, train int")
    fitted = {r.k: (r.mean, r.scale) for r in samples.fit_scaler(df, "v", ["k"], F.col("train") == 1).collect()}
    assert fitted == {"a": (2.0, 1.0), "b": (5.0, 1.0)}


def test_daily_tensors_place_every_cell(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=h), v, i, j, float(1000 * k + 10 * h + 2 * i + j)) for h in range(0, 72, 3) for k, v in enumerate(("U10", "V10", "MSL")) for i in range(2) for j in range(2)]
    rows[-1] = (*rows[-1][:4], float("nan"))
    field = spark.createDataFrame(rows, "ts timestamp, variable string, lat_idx int, lon_idx int, value double")
    days = {r.day: r for r in samples.daily_tensors(field.repartition(4), 2, 2).collect()}
    whole = days[dt.date(2024, 1, 2)]
    want = [1000 * k + 10 * 3 * s + 2 * i + j for s in range(16) for k in range(3) for i in range(2) for j in range(2)]
    assert whole.tensor == want and whole.complete_channels == 48 and whole.skip_reason is None and whole.present == bytes([255] * 24)
    assert days[dt.date(2024, 1, 3)].complete_channels == 47 and days[dt.date(2024, 1, 3)].tensor is None
    assert days[dt.date(2024, 1, 1)].complete_channels == 24 and days[dt.date(2024, 1, 4)].skip_reason == "incomplete_steps"
