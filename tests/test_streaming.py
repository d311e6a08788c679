import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.functions.storage import shared_folder
from tidewright.operators import snapshots
from tidewright.streaming import snapshots as live

T0 = dt.datetime(2024, 1, 1)


def land(spark, folder, batches, schema):
    """One file per micro-batch, in order."""
    import time

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # file order follows the modification time
    return live.snapshot_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_repeats_across_batches_are_dropped(spark):
    batches = [[("a", at(0)), ("a", at(0)), ("b", at(5))], [("a", at(0)), ("a", at(30))], [("b", at(5)), ("c", at(600))]]
    stream = land(spark, shared_folder(spark, "in"), batches, "station_name string, reported_at timestamp")
    out = live.run_available(live.stream_dedupe(stream, ["station_name", "reported_at"], late="2 hours"), shared_folder(spark, "out"))
    want = {(r.station_name, r.reported_at) for r in spark.createDataFrame([x for b in batches for x in b], "station_name string, reported_at timestamp").distinct().collect()}
    got = [(r.station_name, r.reported_at) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sessions_equal_batch_segments(spark):
    minutes = [0, 20, 80, 141, 150, 400, 402, 2000]
    batches = [[(at(m),) for m in minutes[i : i + 3]] for i in range(0, len(minutes), 3)]
    folder = shared_folder(spark, "in")
    out = live.run_available(live.stream_sessions(land(spark, folder, batches, "crawl_time timestamp")), shared_folder(spark, "out"))
    batch = snapshots.crawl_segments(spark.read.parquet(folder)).where(F.col("end") < at(1900))
    assert sorted((r.start, r.end) for r in out.collect()) == sorted((r.start, r.end) for r in batch.collect())


def test_buckets_and_sums_over_several_batches(spark):
    batches = [[("a", at(60 * h), 1.0) for h in range(i, i + 8)] for i in (0, 8, 16)]
    folder = shared_folder(spark, "in")
    stream = land(spark, folder, batches, "station_id string, ts timestamp, surge_m double")
    sums = live.run_available(live.stream_accumulate(stream, 3), shared_folder(spark, "out"))
    got = {r.ts: r.past_3h for r in sums.collect()}
    assert got[at(60 * 10)] == 3 * 3600 and got[at(0)] is None and max(got) == at(60 * 21)
    counts = live.run_available(live.stream_bucket_counts(stream, "ts"), shared_folder(spark, "out2"))
    assert counts.count() == 22 and all(r.record_count == 1 for r in counts.collect())


def test_silent_station_raises_one_alert(spark):
    batches = [[("a", at(0)), ("b", at(10))], [("b", at(300))], [("b", at(600))]]
    stream = land(spark, shared_folder(spark, "in"), batches, "station_name string, reported_at timestamp")
    rows = live.run_available(live.stream_freshness(stream, 120, late="10 minutes"), shared_folder(spark, "out")).collect()
    alerts = [(r.station_name, r.last_report, r.reports) for r in rows if r.silent]
    assert ("a", at(0), 1) in alerts and sum(1 for x in alerts if x[0] == "a") == 1


def test_export_restarts_without_repeating_rows(spark):
    folder, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    schema = "station_type string, v int"
    stream = land(spark, folder, [[("tide", 1)], [("river", 2)]], schema)
    live.stream_export(stream, f"{out}/rows", f"{out}/checkpoint", once=True).awaitTermination()
    again = land(spark, folder, [[("tide", 3)]], schema)
    live.stream_export(again, f"{out}/rows", f"{out}/checkpoint", once=True).awaitTermination()
    assert sorted((r.station_type, r.v) for r in spark.read.parquet(f"{out}/rows").collect()) == [("river", 2), ("tide", 1), ("tide", 3)]


def test_shared_folder_needs_the_setting_on_a_cluster(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(Elsewhere(), "x")
