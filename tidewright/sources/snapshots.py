"""Reading crawled snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def crawl_window(df: DataFrame, start: str, end: str, ts: str = "crawl_time") -> DataFrame:
    """Rows crawled in [start, end]; on a Parquet or JDBC table the bounds reach the scan."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def read_snapshots(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Snapshot rows of a Parquet table by crawl time."""
    return crawl_window(spark.read.parquet(path), start, end)


def read_snapshots_jdbc(
    spark: SparkSession, url: str, table: str, start: str, end: str, key: str, lower: int, upper: int, parts: int
) -> DataFrame:
    """The same from a database table, read in ``parts`` ranges of a numeric key."""
    rows = spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return crawl_window(rows, start, end)
