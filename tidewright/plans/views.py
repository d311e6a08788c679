"""Station, field, track and snapshot views derived from the given tables, in Spark and in SQL.

Levels divide by 97 rather than 100, so that no derived value sits exactly on a rounding tie.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType

from tidewright.functions.blocks import global_positions, hour_number
from tidewright.operators import series

SQL: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it mentions (and those they mention), in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(SQL[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    listed = ",\n".join(f"{name} AS ({SQL[name].strip()})" for name in ordered)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        tail = stripped[5:].lstrip()
        if tail[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {listed},\n{tail[10:]}"
        return f"WITH {listed},\n{tail}"
    return f"WITH {listed}\n{stripped}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with its zone-less timestamps read as UTC."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    zoned = StructType([StructField(f.name, TimestampType() if f.dataType == TimestampNTZType() else f.dataType, f.nullable) for f in schema])
    return spark.read.schema(zoned).parquet(path)


# --- gauge observations -------------------------------------------------------------------------

SQL["gauge_obs"] = """
SELECT event_type AS station_id, 's' || CAST(user_id % 3 AS VARCHAR) AS sensor, date_trunc('hour', ts) AS ts,
       event_id AS seq,
       CASE WHEN event_id % 97 = 0 THEN -99.0 WHEN event_id % 211 = 0 THEN NULL ELSE value / 97 END AS water_level,
       CAST(event_id % 6 AS VARCHAR) AS qc_flag,
       CASE WHEN event_id % 41 = 0 THEN '0' ELSE '1' END AS use_flag
FROM events"""


def gauge_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station_id"),
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("sensor"),
        F.date_trunc("hour", "ts").alias("ts"),
        i.alias("seq"),
        F.when(i % 97 == 0, F.lit(-99.0)).when(i % 211 == 0, F.lit(None)).otherwise(F.col("value") / 97).alias("water_level"),
        (i % 6).cast("string").alias("qc_flag"),
        F.when(i % 41 == 0, F.lit("0")).otherwise(F.lit("1")).alias("use_flag"),
    )


# --- hourly surge -------------------------------------------------------------------------------

SQL["surge"] = """
SELECT event_type AS station_id, date_trunc('hour', ts) AS ts,
       CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) / 97 AS surge_m
FROM events GROUP BY 1, 2"""


def surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "station_id")
    return series.hourly_mean(events, ["station_id"], "ts", "value", "surge_m", 97.0)


SQL["surge_dense"] = """
SELECT a.station_id, a.ts, s.surge_m, s.surge_m IS NOT NULL AS qc_valid
FROM (SELECT station_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM surge GROUP BY 1) a
LEFT JOIN surge s ON s.station_id = a.station_id AND s.ts = a.ts"""


def surge_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.hourly_grid(surge(spark, sf_dir))


SQL["surge_all"] = """
SELECT 'all' AS station_id, date_trunc('hour', ts) AS ts,
       CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) / 97 AS surge_m
FROM events GROUP BY 1, 2"""


def surge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("station_id", F.lit("all"))
    return series.hourly_mean(events, ["station_id"], "ts", "value", "surge_m", 97.0)


SQL["surge_daily"] = """
SELECT o_orderpriority AS station_id, o_orderdate AS ts,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(*) / 97000 AS surge_m
FROM orders GROUP BY 1, 2"""


def surge_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("station_id"), F.col("o_orderdate").alias("ts"))
        .agg((exact / F.count("*") / 97000).alias("surge_m"))
    )


# --- gridded field: 5 x 5 cells, three variables, every hour that has an observation -----------------

SQL["field"] = """
WITH hours AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events),
     base AS (SELECT ts, CAST(epoch(ts) / 3600 AS BIGINT) AS h, CAST(n_nationkey // 5 AS BIGINT) AS i, CAST(n_nationkey % 5 AS BIGINT) AS j
              FROM hours, nation WHERE n_nationkey < 25),
     wide AS (SELECT ts, i, j, 10.0 + i AS latitude, -64.0 + j AS longitude,
                     ((h * 7 + i * 3 + j * 5) % 41 - 20) / 4.0 AS u10,
                     ((h * 5 + i * 11 + j * 2) % 37 - 18) / 4.0 AS v10,
                     101325.0 + ((h * 13 + i * 17 + j * 19) % 101 - 50) * 10 AS msl, h
              FROM base)
SELECT ts, 'U10' AS variable, i AS lat_idx, j AS lon_idx, CAST(latitude AS DOUBLE) AS latitude,
       CAST(longitude AS DOUBLE) AS longitude, CAST(u10 AS DOUBLE) AS value FROM wide
UNION ALL
SELECT ts, 'V10', i, j, CAST(latitude AS DOUBLE), CAST(longitude AS DOUBLE), CAST(v10 AS DOUBLE) FROM wide
UNION ALL
SELECT ts, 'MSL', i, j, CAST(latitude AS DOUBLE), CAST(longitude AS DOUBLE),
       CASE WHEN (h * 25 + i * 5 + j) % 997 = 0 THEN NULL ELSE CAST(msl AS DOUBLE) END FROM wide"""


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long field table; the cells are generated per hour, not cross-joined."""
    h, i, j = F.col("h"), F.col("lat_idx"), F.col("lon_idx")
    hours = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("ts")).distinct()
    cells = (
        hours.withColumn("h", hour_number("ts"))
        .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(24))))
        .withColumns({"lat_idx": F.floor(F.col("cell") / 5), "lon_idx": F.col("cell").cast("bigint") % 5})
    )
    u = ((h * 7 + i * 3 + j * 5) % 41 - 20) / 4.0
    v = ((h * 5 + i * 11 + j * 2) % 37 - 18) / 4.0
    p = F.when((h * 25 + i * 5 + j) % 997 != 0, 101325.0 + ((h * 13 + i * 17 + j * 19) % 101 - 50) * 10)
    values = F.array(
        *[F.struct(F.lit(name).alias("variable"), x.cast("double").alias("value"))
          for name, x in (("U10", u), ("V10", v), ("MSL", p))]
    )
    return cells.select(
        "ts", "lat_idx", "lon_idx", (10.0 + i).alias("latitude"), (-64.0 + j).alias("longitude"), F.inline(values)
    ).select("ts", "variable", "lat_idx", "lon_idx", "latitude", "longitude", "value")


# --- stations and tracks ----------------------------------------------------------------------------

SQL["stations"] = """
SELECT 'st' || CAST(s_suppkey AS VARCHAR) AS station_id, CAST(10 + s_suppkey % 5 AS DOUBLE) AS lat,
       -64 + (s_suppkey % 7) / 2.0 AS lon, 'p' || CAST(s_nationkey AS VARCHAR) AS province,
       CAST(s_suppkey % 4 AS VARCHAR) AS area
FROM supplier"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("st"), k.cast("string")).alias("station_id"),
        (10 + k % 5).cast("double").alias("lat"),
        (-64 + (k % 7) / 2.0).alias("lon"),
        F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("province"),
        (k % 4).cast("string").alias("area"),
    )


# one storm per customer, one forecast point per order
SQL["track_points"] = """
SELECT 'ty' || CAST(o_custkey AS VARCHAR) AS storm_id,
       6 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS lead_hour,
       9 + (o_orderkey % 61) / 10.0 AS lat, -66 + (o_orderkey % 53) / 10.0 AS lon,
       CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(940 + o_orderkey % 67 AS VARCHAR) END AS pressure_hpa,
       CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE CAST(15 + o_orderkey % 41 AS VARCHAR) END AS max_wind_ms,
       o_orderdate AS ts, o_orderkey AS seq
FROM orders"""


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    placed = global_positions(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.year("o_orderdate"), "place")
    return placed.select(
        F.concat(F.lit("ty"), F.col("o_custkey").cast("string")).alias("storm_id"),
        (6 * F.col("place")).alias("lead_hour"),
        (9 + (k % 61) / 10.0).alias("lat"),
        (-66 + (k % 53) / 10.0).alias("lon"),
        F.when(k % 17 == 0, F.lit("n/a")).otherwise((940 + k % 67).cast("string")).alias("pressure_hpa"),
        F.when(k % 19 == 0, F.lit("")).otherwise((15 + k % 41).cast("string")).alias("max_wind_ms"),
        F.col("o_orderdate").alias("ts"),
        k.alias("seq"),
    )


# --- crawled snapshots ---------------------------------------------------------------------------------

SQL["snapshots"] = """
SELECT ' ' || event_type AS city, 'c' || CAST(user_id % 10 AS VARCHAR) AS city_county,
       'u' || CAST(user_id AS VARCHAR) || ' ' AS station_name, CAST(user_id AS VARCHAR) AS station_code,
       CASE WHEN user_id % 7 = 0 THEN ' ' WHEN user_id % 7 < 3 THEN 'tide' WHEN user_id % 7 < 5 THEN 'river'
            ELSE 'other' END AS station_type,
       ts AS reported_at,
       CASE WHEN event_id % 89 = 0 THEN 'n/a' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS water_level,
       time_bucket(INTERVAL 10 MINUTE, ts) AS crawl_time, event_id AS seq
FROM events"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_rows(table(spark, sf_dir, "events"))


def snapshot_rows(events: DataFrame) -> DataFrame:
    u = F.col("user_id")
    return events.select(
        F.concat(F.lit(" "), F.col("event_type")).alias("city"),
        F.concat(F.lit("c"), (u % 10).cast("string")).alias("city_county"),
        F.concat(F.lit("u"), u.cast("string"), F.lit(" ")).alias("station_name"),
        u.cast("string").alias("station_code"),
        F.when(u % 7 == 0, F.lit(" ")).when(u % 7 < 3, F.lit("tide")).when(u % 7 < 5, F.lit("river"))
        .otherwise(F.lit("other")).alias("station_type"),
        F.col("ts").alias("reported_at"),
        F.when(F.col("event_id") % 89 == 0, F.lit("n/a")).otherwise(F.round(F.col("value") * 100).cast("bigint").cast("string")).alias("water_level"),
        F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 600) * 600).alias("crawl_time"),
        F.col("event_id").alias("seq"),
    )


SQL["type_map"] = """
SELECT DISTINCT event_type AS city, 'c' || CAST(user_id % 10 AS VARCHAR) AS city_county,
       'u' || CAST(user_id AS VARCHAR) AS station_name,
       CASE user_id % 4 WHEN 0 THEN 'river' WHEN 1 THEN 'reservoir' WHEN 2 THEN 'gate' ELSE 'tide' END AS station_type
FROM events WHERE user_id % 5 <> 0"""


def type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    kinds = F.array(*[F.lit(k) for k in ("河道", "水库", " 堰闸", "tide")])  # the source spelling of most types
    return (
        table(spark, sf_dir, "events")
        .where(u % 5 != 0)
        .select(
            F.col("event_type").alias("city"),
            F.concat(F.lit("c"), (u % 10).cast("string")).alias("city_county"),
            F.concat(F.lit("u"), u.cast("string")).alias("station_name"),
            F.get(kinds, (u % 4).cast("int")).alias("station_type"),
        )
        .distinct()
    )


SQL["rain"] = """
SELECT l_returnflag AS city, l_linestatus AS city_county, 'r' || CAST(l_suppkey AS VARCHAR) AS station_name,
       CAST(l_suppkey AS VARCHAR) AS station_code, l_shipdate AS period_start,
       l_shipdate + INTERVAL 1 DAY AS period_end, l_quantity AS rainfall,
       l_shipdate + INTERVAL 1 DAY + CAST(l_linenumber AS INTEGER) * INTERVAL 3 HOUR AS crawl_time
FROM lineitem"""


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("INTERVAL 1 DAY")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("city"),
        F.col("l_linestatus").alias("city_county"),
        F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("station_name"),
        F.col("l_suppkey").cast("string").alias("station_code"),
        F.col("l_shipdate").alias("period_start"),
        (F.col("l_shipdate") + day).alias("period_end"),
        F.col("l_quantity").alias("rainfall"),
        (F.col("l_shipdate") + day + F.col("l_linenumber").cast("int") * F.expr("INTERVAL 3 HOURS")).alias("crawl_time"),
    )


# --- forecasts: history 3, leads 1, 3 and 6 at direct origins --------------------------------------------

LEADS = (1, 3, 6)

SQL["forecasts"] = """
WITH w AS (SELECT station_id, ts, surge_m AS b0, lag(surge_m, 1) OVER s AS b1, lag(surge_m, 2) OVER s AS b2,
                  lead(surge_m, 1) OVER s AS a1, lead(surge_m, 2) OVER s AS a2, lead(surge_m, 3) OVER s AS a3,
                  lead(surge_m, 4) OVER s AS a4, lead(surge_m, 5) OVER s AS a5, lead(surge_m, 6) OVER s AS a6
           FROM surge_dense WINDOW s AS (PARTITION BY station_id ORDER BY ts)),
o AS (SELECT * FROM w WHERE b0 + b1 + b2 + a1 + a2 + a3 + a4 + a5 + a6 IS NOT NULL
        AND year(ts + INTERVAL 6 HOUR) = year(ts)),
l AS (SELECT *, 1 AS lead_hours, a1 AS observed_m, b0 AS prior_m FROM o
      UNION ALL SELECT *, 3, a3, a2 FROM o UNION ALL SELECT *, 6, a6, a5 FROM o)
SELECT station_id, ts AS origin, CAST(lead_hours AS BIGINT) AS lead_hours, observed_m, prior_m,
       ts + lead_hours * INTERVAL 1 HOUR AS valid_time, m.model,
       CASE m.model WHEN 'persistence' THEN b0 WHEN 'mean3' THEN (b0 + b1 + b2) / 3 ELSE b0 * 0.5 END AS predicted_m
FROM l, (VALUES ('persistence'), ('mean3'), ('damped')) m(model)"""


def simple_models() -> dict:
    return {
        "persistence": F.col("b0"),
        "mean3": (F.col("b0") + F.col("b1") + F.col("b2")) / 3,
        "damped": F.col("b0") * 0.5,
    }


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.baselines import baseline_forecasts

    return baseline_forecasts(surge(spark, sf_dir), LEADS, 3, models=simple_models())
