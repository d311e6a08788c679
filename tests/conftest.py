import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hours(spark):
    """Build an hourly frame from {station: [value, …]}; an Ellipsis leaves the hour out."""
    def build(series, start="2024-01-01 00:00:00", value="surge_m"):
        rows = []
        first = dt.datetime.fromisoformat(start)
        for station, values in series.items():
            rows += [(station, first + dt.timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values) if v is not ...]
        return spark.createDataFrame(rows, f"station_id string, ts timestamp, {value} double")

    return build
