import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import blocks
from tidewright.operators import series


def scattered(spark, seed, count=400, span=900):
    rng = random.Random(seed)
    rows = []
    for key in ("a", "b"):
        for i in sorted(rng.sample(range(-100, span), count)):
            rows.append((key, i, None if rng.random() < 0.2 else rng.uniform(-3, 3)))
    return spark.createDataFrame(rows, "k string, i long, v double")


@pytest.mark.parametrize("block", [1, 7, 64, 5000])
def test_halo_window_equals_one_window_per_key(spark, block):
    df = scattered(spark, 1)
    columns = {
        "total": lambda w: F.sum("v").over(w.rangeBetween(-5, 3)),
        "seen": lambda w: F.count("*").over(w.rangeBetween(-5, 3)),
        "two_back": blocks.at_offset("v", -2),
    }
    whole = Window.partitionBy("k").orderBy("i")
    want = df.withColumns({n: f(whole) for n, f in columns.items()})
    got = blocks.halo_window(df, ["k"], "i", columns, before=5, after=3, block=block).select(*want.columns)
    key = lambda r: (r.k, r.i)
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert a[:3] == b[:3] and a.seen == b.seen and a.two_back == b.two_back
        assert (a.total is None) == (b.total is None) and (a.total is None or abs(a.total - b.total) < 1e-12)


@pytest.mark.parametrize("block", [3, 50])
def test_global_positions_and_nearest_known(spark, block):
    df = scattered(spark, 2)
    placed = blocks.global_positions(df, ["k"], ["i"], F.floor(F.col("i") / block))
    for key in ("a", "b"):
        rows = sorted(placed.where(F.col("k") == key).collect(), key=lambda r: r.i)
        assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    local = {k: sorted((r.i, r.v) for r in df.collect() if r.k == k and r.v is not None) for k in ("a", "b")}
    for r in blocks.nearest_known(df, ["k"], "i", "v", block).collect():
        before = [x for x in local[r.k] if x[0] <= r.i]
        after = [x for x in local[r.k] if x[0] >= r.i]
        assert (r.prev_index, r.prev_value) == (before[-1] if before else (None, None))
        assert (r.next_index, r.next_value) == (after[0] if after else (None, None))


def test_sessions_split_only_beyond_the_gap(spark):
    base = dt.datetime(2024, 1, 1, 22, 0)
    minutes = [0, 60, 120, 181, 181, 400, 3000]  # 60 merges, 61 splits, across midnight and empty days
    rows = [(base + dt.timedelta(minutes=m),) for m in minutes]
    out = blocks.sessions(spark.createDataFrame(rows, "t timestamp"), [], "t", 3600).collect()
    assert [r.segment for r in sorted(out, key=lambda r: r.t)] == [1, 1, 1, 2, 3, 4]


def test_interpolation_limit_from_both_sides(hours):
    df = hours({"a": [None, 1.0, None, None, None, None, None, 7.0, None]}, value="v")
    got = [r.filled for r in sorted(series.interpolate_time(df, "v", 2).collect(), key=lambda r: r.ts)]
    assert got == [1.0, 1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0, 7.0]


def test_acf_counts_trimmed_pairs(hours):
    rng = random.Random(3)
    walk, v = [], 0.0
    for _ in range(300):
        v += rng.gauss(0, 1)
        walk.append(v)
    out = {r.lag_hours: r for r in series.acf(hours({"a": walk}), 24).collect()}
    assert len(out) == 25 and out[0].acf == 1.0 and out[1].acf > 0.8
    assert all(out[k].pair_count == 300 - 2 * k for k in range(1, 25))
    full = {r.lag_hours: r.pair_count for r in series.acf(hours({"a": walk}), 24, trim_tail=False).collect()}
    assert full[24] == 276


def test_future_extremes_take_the_first_of_equal_values(hours):
    df = hours({"a": [5, 1, 3, 1, 9, 9, 0]}, value="v")
    first = sorted(series.future_extremes(df, 5, "v", "v").collect(), key=lambda r: r.ts)[0]
    assert (first.future_min, first.future_min_offset_h, first.future_max, first.future_max_offset_h) == (1, 1, 9, 4)


def test_a_hot_station_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hot = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"), F.lit(1.0).alias("v"))
        out = blocks.halo_window(hot, ["k"], "i", {"n": lambda w: F.count("v").over(w.rangeBetween(-23, 0))}, before=23)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 40_000 and len(sizes) == 8 and max(sizes) < 12_000
        assert out.where(F.col("n") == 24).count() == 40_000 - 23
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
