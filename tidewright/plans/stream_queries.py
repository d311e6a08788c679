"""Streaming queries over the event file: everything available is processed and the emitted rows returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.storage import shared_folder
from tidewright.operators import snapshots
from tidewright.plans import views
from tidewright.plans.registry import n, query, r
from tidewright.streaming import snapshots as live


def _events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return live.snapshot_stream(spark, sf, schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df, name):
    return live.run_available(df, shared_folder(df.sparkSession, name))


@query("snapshot_stream", "SELECT seq, station_code, reported_at, crawl_time FROM snapshots")
def _(spark, sf):
    rows = views.snapshot_rows(_events(spark, sf))
    return _run(rows.select("seq", "station_code", "reported_at", "crawl_time"), "snapshot_stream")


@query("stream_dedupe", "SELECT DISTINCT city, crawl_time FROM snapshots")
def _(spark, sf):
    rows = views.snapshot_rows(_events(spark, sf)).select("city", "crawl_time")
    return _run(live.stream_dedupe(rows, ["city", "crawl_time"], "crawl_time"), "stream_dedupe")


_CLOSED = "(SELECT max(crawl_time) - INTERVAL 1 HOUR FROM snapshots)"


@query("stream_bucket_counts", f"""SELECT date_trunc('hour', crawl_time) AS bucket, {n('count(*)', 'record_count')}, min(crawl_time) AS first_time, max(crawl_time) AS last_time FROM snapshots
GROUP BY 1 HAVING date_trunc('hour', crawl_time) + INTERVAL 1 HOUR <= {_CLOSED}""")
def _(spark, sf):
    return _run(live.stream_bucket_counts(views.snapshot_rows(_events(spark, sf))), "stream_bucket_counts")


@query("stream_sessions", f"""SELECT seg_start AS "start", seg_end AS "end", {n('(SELECT count(*) FROM snapshots s WHERE s.crawl_time BETWEEN seg_start AND seg_end)', 'record_count')}
FROM water_segments WHERE seg_end + INTERVAL 20 MINUTE <= {_CLOSED}""")
def _(spark, sf):
    return _run(live.stream_sessions(views.snapshot_rows(_events(spark, sf)), "20 minutes"), "stream_sessions")


@query("stream_accumulate", f"""
WITH x AS (SELECT station_id, unnest(generate_series(min(ts), max(ts) + INTERVAL 5 HOUR, INTERVAL 1 HOUR)) AS ts FROM surge GROUP BY 1),
w AS (SELECT x.station_id, x.ts, count(s.surge_m) AS k, sum(s.surge_m) * 3600 AS total FROM x JOIN surge s ON s.station_id = x.station_id AND s.ts BETWEEN x.ts - INTERVAL 5 HOUR AND x.ts GROUP BY 1, 2)
SELECT station_id, ts, {r('CASE WHEN k = 6 THEN total END', 'past_6h')} FROM w WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM surge)""")
def _(spark, sf):
    landed = shared_folder(spark, "hourly")
    views.surge(spark, sf).write.parquet(landed)
    hourly = live.snapshot_stream(spark, landed, spark.read.parquet(landed).schema)
    return _run(live.stream_accumulate(hourly, 6), "stream_accumulate")


@query("stream_freshness", f"""
WITH s AS (SELECT trim(station_name) AS station_name, max(reported_at) AS last_report, count(*) AS reports FROM snapshots GROUP BY 1)
SELECT station_name, last_report, {n('reports', 'reports')}, false AS silent FROM s
UNION ALL SELECT station_name, last_report, reports, true FROM s WHERE epoch_ms(last_report) + 3 * 86400000 <= (SELECT epoch_ms(max(reported_at)) - 3600000 FROM snapshots)""")
def _(spark, sf):
    rows = views.snapshot_rows(_events(spark, sf)).withColumn("station_name", F.trim("station_name"))
    return _run(live.stream_freshness(rows, 3 * 24 * 60), "stream_freshness")


@query("stream_type_lookup", "SELECT seq, city, city_county, station_name, station_type FROM typed_snapshots")
def _(spark, sf):
    types = snapshots.station_types(views.type_map(spark, sf))
    out = live.stream_type_lookup(views.snapshot_rows(_events(spark, sf)), types)
    return _run(out.select("seq", "city", "city_county", "station_name", "station_type"), "stream_type_lookup")


@query("stream_export", f"SELECT station_type, {n('count(*)', 'rows')} FROM typed_snapshots GROUP BY 1")
def _(spark, sf):
    types = snapshots.station_types(views.type_map(spark, sf))
    out = live.stream_type_lookup(views.snapshot_rows(_events(spark, sf)), types)
    folder = shared_folder(spark, "stream_export")
    live.stream_export(out, f"{folder}/rows", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("station_type").agg(F.count("*").alias("rows"))
