"""Crawled water and rain snapshots: station types, crawl segments, overviews, counts and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.blocks import sessions
from tidewright.functions.columns import blank_to_default, clean_text

# Station types a mapping may assign, with the source spelling of each.
TYPE_NAMES = {"河道": "river", "水库": "reservoir", "堰闸": "gate", "潮汐": "tide"}
VALID_TYPES = tuple(TYPE_NAMES.values())
STATION_KEY = ("city", "city_county", "station_name")

# Source column names of the exported tables.
WATER_COLUMNS = {
    "地级市": "city", "市县": "city_county", "站名": "station_name", "站点类型": "station_type",
    "上报时间": "reported_at", "水位_m": "water_level", "抓取时间": "crawl_time",
}
RAIN_COLUMNS = {
    "地级市": "city", "市县": "city_county", "站名": "station_name", "统计开始时间": "period_start",
    "统计结束时间": "period_end", "雨量_mm": "rainfall", "抓取时间": "crawl_time",
}
WATER_ALL = ("city", "city_county", "station_name", "station_code", "station_type", "reported_at", "water_level", "crawl_time")
WATER_BY_TYPE = ("city", "city_county", "station_name", "station_type", "reported_at", "water_level", "crawl_time")
RAIN_ALL = ("city", "city_county", "station_name", "station_code", "reported_at", "rainfall", "period", "crawl_time")


def rename_source(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def water_rows(df: DataFrame, layout: Sequence[str] = WATER_ALL) -> DataFrame:
    """One of the water layouts with normalised text; a missing station code becomes empty."""
    have = df if "station_code" in df.columns else df.withColumn("station_code", F.lit(""))
    texts = [c for c in ("city", "city_county", "station_name", "station_code", "station_type") if c in layout]
    return have.withColumns({c: clean_text(c) for c in texts}).select(*layout)


def rain_rows(df: DataFrame) -> DataFrame:
    """Rain layout: reported at the end of the interval, with the interval as ``start - end``."""
    have = df if "station_code" in df.columns else df.withColumn("station_code", F.lit(""))
    form = "yyyy-MM-dd'T'HH:mm:ss"
    period = F.concat_ws(" - ", F.date_format("period_start", form), F.date_format("period_end", form))
    texts = {c: clean_text(c) for c in (*STATION_KEY, "station_code")}
    return have.withColumns({**texts, "reported_at": F.col("period_end"), "period": period}).select(*RAIN_ALL)


def normalise_keys(df: DataFrame) -> DataFrame:
    """Station keys in normal form, worked out once per distinct key."""
    raw = df.select(*(F.col(c).alias(f"_raw_{c}") for c in STATION_KEY)).distinct()
    clean = raw.withColumns({f"_{c}": clean_text(f"_raw_{c}") for c in STATION_KEY})
    same = [F.col(c).eqNullSafe(F.col(f"_raw_{c}")) for c in STATION_KEY]
    return df.join(clean, same).select(*(F.col(f"_{c}").alias(c) if c in STATION_KEY else c for c in df.columns))


def english_type(c: str) -> Column:
    """The type in normal form, translated where it has its source spelling."""
    names = F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair))
    text = F.when(F.col(c).isin(*TYPE_NAMES, *TYPE_NAMES.values()), F.col(c)).otherwise(clean_text(c))
    return F.coalesce(F.try_element_at(names, text), text)


def station_types(mapping: DataFrame, order: str | None = None, valid: Sequence[str] = VALID_TYPES) -> DataFrame:
    """One valid type per normalised station; among repeats the last in ``order`` wins."""
    clean = normalise_keys(mapping).withColumn("station_type", english_type("station_type"))
    kept = clean.where(F.col("station_type").isin(list(valid)))
    last = F.max_by("station_type", order) if order else F.max("station_type")
    return kept.groupBy(*STATION_KEY).agg(last.alias("_mapped"))


def type_lookup(
    df: DataFrame, types: DataFrame, keep_stored: bool = True, valid: Sequence[str] = VALID_TYPES, default: str = "unknown"
) -> DataFrame:
    """Station type from the mapping; else the stored type when valid (``keep_stored``); else ``default``."""
    stored = english_type("station_type")
    fallback = F.when(stored.isin(list(valid)), stored) if keep_stored else F.lit(None).cast("string")
    return (
        normalise_keys(df).join(types, list(STATION_KEY), "left")
        .withColumn("station_type", F.coalesce("_mapped", fallback, F.lit(default))).drop("_mapped")
    )


def crawl_segments(df: DataFrame, gap_seconds: int = 3600, ts: str = "crawl_time") -> DataFrame:
    """Sessions over distinct crawl times: ``segment, start, end``."""
    runs = sessions(df, [], ts, gap_seconds)
    return runs.groupBy("segment").agg(F.min(ts).alias("start"), F.max(ts).alias("end"))


def assign_segment(df: DataFrame, segments: DataFrame, ts: str = "crawl_time") -> DataFrame:
    """Attach the segment whose [start, end] holds the crawl time; null outside all of them.

    Segments do not overlap. They are listed by the hours they touch, so the interval test becomes an
    equi-join on the hour.
    """
    hours = segments.withColumn(
        "_hour", F.explode(F.sequence(F.floor(F.unix_seconds("start") / 3600), F.floor(F.unix_seconds("end") / 3600)))
    )
    rows = df.withColumn("_hour", F.floor(F.unix_seconds(ts) / 3600))
    hit = (rows["_hour"] == hours["_hour"]) & (rows[ts] >= hours["start"]) & (rows[ts] <= hours["end"])
    return rows.join(hours, hit, "left").drop("_hour", "start", "end")


def segment_summary(water: DataFrame, rain: DataFrame, segments: DataFrame) -> DataFrame:
    """Water and rain rows per segment; a segment without rows reports 0."""
    counts = [
        assign_segment(df.select("crawl_time"), segments).where(F.col("segment").isNotNull())
        .groupBy("segment").agg(F.count("*").alias(name))
        for name, df in (("water_rows", water), ("rain_rows", rain))
    ]
    return segments.join(counts[0], "segment", "left").join(counts[1], "segment", "left").fillna(0, ["water_rows", "rain_rows"])


def snapshot_overview(df: DataFrame, first: str = "reported_at", last: str = "reported_at") -> DataFrame:
    """Records, distinct stations, and the range of report and crawl times."""
    return df.agg(
        F.count("*").alias("record_count"), F.count_distinct(*STATION_KEY).alias("station_count"),
        F.min(first).alias(f"min_{first}"), F.max(last).alias(f"max_{last}"),
        F.min("crawl_time").alias("min_crawl_time"), F.max("crawl_time").alias("max_crawl_time"),
    )


def count_by(df: DataFrame, by: Sequence[str | Column], ts: str = "reported_at") -> DataFrame:
    """Records, stations and time range per dimension."""
    return df.groupBy(*by).agg(
        F.count("*").alias("record_count"), F.count_distinct(*STATION_KEY).alias("station_count"),
        F.min(ts).alias("first_time"), F.max(ts).alias("last_time"),
    )


def count_by_type(df: DataFrame) -> DataFrame:
    return count_by(df, [blank_to_default("station_type").alias("station_type")])


def count_by_bucket(df: DataFrame, unit: str = "hour", ts: str = "crawl_time", cut: str | None = None) -> DataFrame:
    """Rows per crawl hour or day, split before and after a cut time when given."""
    by = [F.date_trunc(unit, ts).alias("bucket")]
    if cut is not None:
        by.append(F.when(F.col(ts) < F.lit(cut).cast("timestamp"), F.lit("before")).otherwise(F.lit("after")).alias("period"))
    return df.groupBy(*by).agg(F.count("*").alias("record_count"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time"))


def tide_station_summary(df: DataFrame, kind: str = "tide") -> DataFrame:
    """Per tide station: records, report range and level range; levels that are not numbers are skipped."""
    level = F.expr("try_cast(water_level AS DOUBLE)")
    return df.where(F.col("station_type") == kind).groupBy(*STATION_KEY).agg(
        F.count("*").alias("record_count"), F.min("reported_at").alias("min_reported_at"),
        F.max("reported_at").alias("max_reported_at"), F.min(level).alias("min_water_level"),
        F.max(level).alias("max_water_level"), F.avg(level).alias("mean_water_level"),
    )


def scan_summary(df: DataFrame, times: Sequence[str]) -> DataFrame:
    """Row count with the range of every time column."""
    ranges = [x for c in times for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]
    return df.agg(F.count("*").alias("record_count"), *ranges)


def head_and_tail(df: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """First and last ``size`` rows in ``order``, tagged; both are top-k scans, not sorts."""
    first = df.orderBy(*order).limit(size).withColumn("part", F.lit("head"))
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(size).withColumn("part", F.lit("tail"))
    return first.unionByName(last)


def track_summary(points: DataFrame, storm: str = "storm_id", ts: str = "ts") -> DataFrame:
    """Per storm: points, first and last time, lowest pressure and strongest wind; text values are ignored."""
    return points.groupBy(storm).agg(
        F.count("*").alias("points"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time"),
        F.min(F.expr("try_cast(pressure_hpa AS DOUBLE)")).alias("min_pressure_hpa"),
        F.max(F.expr("try_cast(max_wind_ms AS DOUBLE)")).alias("max_wind_ms"),
    )


def manifest_reconcile(manifest: DataFrame, source_rows: DataFrame) -> DataFrame:
    """Rows written per category against the source count, with whether they agree.

    ``manifest``: category, file, rows. ``source_rows``: category, source_rows.
    """
    written = manifest.groupBy("category").agg(F.sum("rows").alias("written_rows"), F.count("*").alias("files"))
    return source_rows.join(written, "category", "full_outer").withColumn(
        "agrees", F.coalesce(F.col("written_rows") == F.col("source_rows"), F.lit(False))
    )


def table_freshness(df: DataFrame, ts: str, now: Column) -> DataFrame:
    """Row count, latest time and its age in seconds."""
    return df.agg(
        F.count("*").alias("rows"), F.max(ts).alias("latest"),
        (F.unix_seconds(now) - F.unix_seconds(F.max(ts))).alias("age_seconds"),
    )


def latest_snapshot(df: DataFrame, ts: str = "crawl_time") -> DataFrame:
    """Rows of the newest crawl."""
    return df.join(df.agg(F.max(ts).alias(ts)), ts)


def latest_n(df: DataFrame, size: int, ts: str = "crawl_time", ties: Sequence[str] = ()) -> DataFrame:
    """Newest ``size`` rows; ``ties`` settle equal times."""
    return df.orderBy(F.col(ts).desc(), *ties).limit(size)


def top_n(df: DataFrame, size: int, value: str = "observed_m", ties: Sequence[str] = ()) -> DataFrame:
    """Highest ``size`` rows."""
    return df.orderBy(F.col(value).desc(), *ties).limit(size)


def most_common(df: DataFrame, dim: str, size: int | None = None) -> DataFrame:
    """Counts per value, most frequent first."""
    counted = df.groupBy(dim).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), dim)
    return counted if size is None else counted.limit(size)
