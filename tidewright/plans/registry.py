"""Registry of runnable queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.plans import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
HOME: dict[str, str] = {}  # query name -> module that registers it
DIGITS = 6


def tidy(df: DataFrame) -> DataFrame:
    """Comparison form: doubles rounded to 6 digits without negative zero, whole numbers as BIGINT."""
    shaped = {}
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in ("double", "float"):
            shaped[field.name] = F.round(F.col(field.name).cast("double"), DIGITS) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            shaped[field.name] = F.col(field.name).cast("bigint")
    return df.withColumns(shaped) if shaped else df


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use any shared view of :mod:`tidewright.plans.views` by name."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return tidy(fn(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        HOME[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            ORACLES[name] = views.with_views(sql)
        return fn

    return register


def r(expression: str, alias: str) -> str:
    """SQL for a double in comparison form."""
    return f"round(CAST({expression} AS DOUBLE), {DIGITS}) + 0.0 AS {alias}"


def n(expression: str, alias: str) -> str:
    """SQL for a whole number in comparison form."""
    return f"CAST({expression} AS BIGINT) AS {alias}"
