"""Structured Streaming over landed snapshot files: the batch rules on an unbounded table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidewright.operators.snapshots import STATION_KEY, type_lookup

WATERMARK = "1 hour"


def snapshot_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100, pattern: str | None = None) -> DataFrame:
    """Parquet files landing in a folder as an unbounded table."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def stream_dedupe(
    df: DataFrame, keys: Sequence[str] = (*STATION_KEY, "reported_at"), ts: str = "reported_at", late: str = WATERMARK
) -> DataFrame:
    """First sight of each report; repeats within the watermark are dropped and state older than it is freed."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def stream_bucket_counts(df: DataFrame, ts: str = "crawl_time", width: str = "1 hour", late: str = WATERMARK) -> DataFrame:
    """Rows and time range per crawl bucket, emitted once the bucket is closed."""
    counted = df.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(
        F.count("*").alias("record_count"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time")
    )
    return counted.select(F.col("window.start").alias("bucket"), "record_count", "first_time", "last_time")


def stream_sessions(
    df: DataFrame, gap: str = "60 minutes", ts: str = "crawl_time", keys: Sequence[str] = (), late: str = WATERMARK
) -> DataFrame:
    """Crawl segments: a run ends when nothing is crawled for ``gap``.

    Without ``keys`` all rows share one constant key (streams have no keyless sessions). Sessions are merged
    inside each input partition first, so that key receives one row per run and partition, not every row.
    """
    df.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    group = list(keys) or [(F.year(ts) * 0).alias("_all")]  # a literal would be folded away
    runs = df.withWatermark(ts, late).groupBy(*group, F.session_window(ts, gap)).agg(F.max(ts).alias("end"), F.count("*").alias("record_count"))
    return runs.select(*keys, F.col("session_window.start").alias("start"), "end", "record_count")


def stream_accumulate(
    df: DataFrame, hours: int, value: str = "surge_m", ts: str = "ts", keys: Sequence[str] = ("station_id",), late: str = WATERMARK
) -> DataFrame:
    """Trailing integral over ``hours`` per station, stamped with its last hour; null unless every hour came.

    Input is hourly, one row per station and hour.
    """
    summed = df.withWatermark(ts, late).groupBy(*keys, F.window(ts, f"{hours} hours", "1 hour")).agg(
        F.count(value).alias("_n"), F.sum(value).alias("_total")
    )
    return summed.select(
        *keys, (F.col("window.end") - F.expr("INTERVAL 1 HOUR")).alias("ts"), F.when(F.col("_n") == hours, F.col("_total") * 3600).alias(f"past_{hours}h")
    )


FRESHNESS_SCHEMA = "station_name string, last_report timestamp, reports long, silent boolean"


def stream_freshness(df: DataFrame, silence_minutes: int = 120, station: str = "station_name", ts: str = "reported_at", late: str = WATERMARK) -> DataFrame:
    """Last report and count per station on every update, and an alert row when a station falls silent.

    Silence is measured in event time against the watermark, so replaying the feed gives the same alerts.
    """
    silence = silence_minutes * 60_000

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"station_name": [key[0]], "last_report": [pd.Timestamp(last, unit="us")], "reports": [count], "silent": [True]})
            return
        for batch in batches:
            if len(batch):
                last = max(last, int(batch["us"].max()))
                count += len(batch)
        state.update((last, count))
        state.setTimeoutTimestamp(max(last // 1000 + silence, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"station_name": [key[0]], "last_report": [pd.Timestamp(last, unit="us")], "reports": [count], "silent": [False]})

    rows = df.withWatermark(ts, late).select(F.col(station).alias("station_name"), ts, F.unix_micros(ts).alias("us"))
    return rows.groupBy("station_name").applyInPandasWithState(
        follow, FRESHNESS_SCHEMA, "last long, reports long", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_type_lookup(df: DataFrame, types: DataFrame, keep_stored: bool = True) -> DataFrame:
    """The batch station-type lookup against a static mapping."""
    return type_lookup(df, types, keep_stored)


def stream_export(df: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ("station_type",), once: bool = False):
    """Append to a partitioned Parquet table exactly once; ``once`` processes what is there and stops."""
    writer = df.writeStream.format("parquet").partitionBy(*by).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_available(df: DataFrame, folder: str) -> DataFrame:
    """Process everything that has landed, then read the emitted rows back as a table."""
    query = (
        df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
