import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.operators import quality

GAUGE = "station_id string, sensor string, ts timestamp, seq long, water_level double, qc_flag string, use_flag string"
T0 = dt.datetime(2011, 1, 1)


def rows(spark, items):
    return spark.createDataFrame([("st", s, T0 + dt.timedelta(hours=h), i, v, q, u) for i, (s, h, v, q, u) in enumerate(items)], GAUGE)


def test_duplicate_and_flagged_records_are_removed(spark):
    df = rows(spark, [("1", 0, 1.2, "0", "1"), ("1", 0, 9.99, "0", "1"), ("1", 1, 1.3, "1", "1"), ("1", 2, -99.0, "1", "0")])
    clean, report = quality.quality_control(df)
    assert sorted(r.water_level for r in clean.collect()) == [1.2, 1.3]
    r = report.first()
    assert (r.raw_record_count, r.removed_duplicate_count, r.removed_quality_flag_count, r.final_record_count) == (4, 1, 1, 2)


def test_flag_profiles(spark):
    df = rows(spark, [("1", i, 1.0, q, u) for i, (q, u) in enumerate([("0", "1"), ("1", "1"), (" 2 ", "1"), ("3", "1"), ("1", "0"), ("BAD", "1"), (None, None)])])
    assert quality.flag_filter(df).count() == 4
    assert quality.flag_filter(df, quality.BAD_QC_STRICT).count() == 2


def test_mad_of_zero_keeps_everything(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 1.0, 50.0)] + [("b", v) for v in (1.0, 2.0, 3.0, 4.0, 500.0)], "station_id string, v double")
    kept = quality.mad_filter(df, "v").groupBy("station_id").count().collect()
    assert {r.station_id: r["count"] for r in kept} == {"a": 4, "b": 4}


def test_channel_choice_prefers_score_then_count_then_name(spark):
    items = [("b", h, 1.0, "0", "1") for h in range(10)] + [("a", h, 1.0, "0", "1") for h in range(10)] + [("c", h * 3, 1.0, "0", "1") for h in range(20)]
    scores = quality.sensor_scores(rows(spark, items))
    assert quality.select_channel(scores).first().sensor == "a"
    by = {r.sensor: r for r in scores.collect()}
    assert by["c"].non_hourly_gaps == 19 and by["c"].hourly_continuity == 0.0 and by["a"].score == 1.0


def test_dedupe_keeps_first_of_a_hot_key(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), (19_999 - F.col("id")).alias("seq"), F.col("id").alias("v")).repartition(8)
    out = quality.dedupe_first(df, ["k"], ["seq"]).collect()
    assert len(out) == 1 and out[0].v == 19_999 and out[0].copies == 20_000


def test_local_times_that_do_not_exist_or_repeat_fail(spark):
    def one(text):
        return quality.to_utc(spark.createDataFrame([(text,)], "ts string"), "America/New_York").first().ts

    assert one("2024-01-15 12:00:00") == dt.datetime(2024, 1, 15, 17)
    for text in ("2024-03-10 02:30:00", "2024-11-03 01:30:00"):
        with pytest.raises(Exception, match="not a single local time"):
            one(text)


def test_locked_year_guard(spark):
    df = spark.createDataFrame([(dt.datetime(2017, 12, 31, 23),), (dt.datetime(2018, 1, 1),)], "ts timestamp")
    assert quality.locked_year_guard(df.where(F.year("ts") < 2018), 2017).count() == 1
    with pytest.raises(Exception, match="locked period"):
        quality.locked_year_guard(df, 2017).collect()


def test_unit_scaling_and_unknown_unit(spark):
    raw = spark.createDataFrame([("2011-01-01 00:00:00", "125", "0", "1"), ("soon", "x", "0", "1")], "ts string, water_level string, qc_flag string, use_flag string")
    out = quality.canonical_gauge(raw, "cm", station="st").collect()
    assert out[0].water_level == pytest.approx(1.25) and out[1].ts is None and out[1].water_level is None and out[0].sensor == "default"
    with pytest.raises(ValueError):
        quality.canonical_gauge(raw, "ft")


def test_nothing_left_fails_the_job_when_strict(spark):
    df = rows(spark, [("a", h, None, "0", "1") for h in range(5)])
    _, report = quality.quality_control(df)
    assert report.first().final_record_count == 0
    with pytest.raises(Exception, match="left no record"):
        quality.quality_control(df, strict=True)[1].collect()
