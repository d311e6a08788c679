"""Storm tracks, agency forecasts, surge scenarios and sea-surface observations from landed JSON.

A document is parsed once, to a VARIANT; positions of its arrays of mixed types are paths in it, so a short or
malformed row gives nulls instead of failing its neighbours. Each level is a generated row, which keeps Spark from
walking the same path once per column. Numbers come out as texts without trailing zeros (18.0 as 18).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.columns import track_time

# Names of the positions of a storm list row and of a track point.
LIST_COLUMNS = ("typhoon_id", "en_name", "cn_name", "code", "display_no", "international_id", "meaning", "status")
POINT_POSITIONS = {"grade": 3, "lon": 4, "lat": 5, "pressure_hpa": 6, "max_wind_ms": 7, "move_dir": 8, "move_speed_kmh": 9}
FORECAST_POSITIONS = {
    "lead_hour": 0, "forecast_lon": 2, "forecast_lat": 3, "forecast_pressure_hpa": 4, "forecast_max_wind_ms": 5, "forecast_grade": 7,
}


def strip_jsonp(c: str | Column) -> Column:
    """JSON inside ``callback(( … ));``: from the first to the last bracket; plain JSON passes through."""
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)^[^{\[]*(.*[}\]])", 1), F.lit("")), text)


def _once(c: Column) -> Column:
    """One generated row holding ``c``: its value is computed once however often it is used."""
    return F.explode(F.array(c))


def _items(c: str | Column) -> Column:
    """JSON list as an array of texts; nested values stay JSON text."""
    return F.from_json(c, "array<string>")


def _at(c: str | Column, i: int) -> Column:
    return F.get(c, F.lit(i))


def _path(c: str, path: str, kind: str = "string") -> Column:
    """What stands at a path of a VARIANT, null where nothing does; lists and objects as text are JSON."""
    return F.try_variant_get(F.col(c), path, kind)


def _storms(df: DataFrame, json: str) -> DataFrame:
    """One row per document: storm id and its list of points."""
    parsed = df.select(_once(F.try_parse_json(strip_jsonp(json))).alias("_doc"))
    storms = parsed.select(_once(F.coalesce(_path("_doc", "$.typhoon", "variant"), F.col("_doc"))).alias("_storm"))
    return storms.select(_path("_storm", "$[0]").alias("typhoon_id"), _once(_path("_storm", "$[8]", "array<variant>")).alias("_list"))


def _points(df: DataFrame, json: str) -> DataFrame:
    """One row per track point with the storm id; ``_p`` is the point."""
    return _storms(df, json).select("typhoon_id", F.posexplode("_list").alias("point_index", "_p"))


def read_track(df: DataFrame, json: str = "value") -> DataFrame:
    """Observed points: ids, UTC and UTC+8 times, position, intensity, motion, wind radii (JSON), issue."""
    rows = _points(df, json).select("*", _path("_p", "$[1]").alias("_time"))
    return rows.select(
        "typhoon_id", "point_index", _path("_p", "$[0]").alias("point_id"), *[c.alias(k) for k, c in track_time("_time").items()],
        *[_path("_p", f"$[{i}]").alias(k) for k, i in POINT_POSITIONS.items()],
        F.coalesce(_path("_p", "$[10]"), F.lit("[]")).alias("wind_radii_json"),
        _path("_p", "$[12][0]").alias("issue_time"), _path("_p", "$[12][1]").alias("issue_time_text"),
    )


def explode_agency_forecast(df: DataFrame, json: str = "value") -> DataFrame:
    """One row per (point, agency, forecast step)."""
    return _agency_steps(_points(df, json))


def _agency_steps(points: DataFrame, agency: str | None = None) -> DataFrame:
    agencies = _path("_p", "$[11]", "map<string,variant>")
    if agency is not None:
        agencies = F.map_filter(agencies, lambda org, _: org == agency)
    rows = points.select(
        "typhoon_id", "point_index", _path("_p", "$[0]").alias("point_id"), _path("_p", "$[1]").alias("_time"), F.explode(agencies).alias("org", "_steps")
    )
    parts = rows.select("typhoon_id", "point_index", "point_id", "_time", "org", F.posexplode(_path("_steps", "$", "array<variant>")).alias("step", "_f"))
    times = track_time("_time")
    return parts.select(
        "typhoon_id", "point_index", "point_id", times["time_utc"].alias("base_time_utc"), times["time_bj"].alias("base_time_bj"),
        "org", "step", *[_path("_f", f"$[{i}]").alias(k) for k, i in FORECAST_POSITIONS.items()],
    )


def latest_agency_path(df: DataFrame, agency: str, json: str = "value") -> DataFrame:
    """Forecast path of one agency from the last observed point of each document; nothing is shuffled."""
    storms = _storms(df, json).where(F.size("_list") > 0)
    last = storms.select(
        "typhoon_id", (F.size("_list") - 1).alias("point_index"), F.element_at("_list", -1).alias("_p")
    )
    return _agency_steps(last, agency).select(
        "typhoon_id", "base_time_bj", "step", F.col("lead_hour").try_cast("int").alias("lead_hour"),
        F.col("forecast_lon").try_cast("double").alias("lon"), F.col("forecast_lat").try_cast("double").alias("lat"),
        F.col("forecast_pressure_hpa").alias("pressure_hpa"), F.col("forecast_max_wind_ms").alias("max_wind_ms"),
        F.col("forecast_grade").alias("grade"),
    )


def typhoon_list(df: DataFrame, json: str = "value") -> DataFrame:
    """Storm list rows as eight named columns; short rows are padded with null."""
    rows = F.from_json(strip_jsonp(json), "struct<typhoonList:array<string>>")["typhoonList"]
    listed = df.select(F.explode(rows).alias("_row")).select(_once(_items("_row")).alias("_r"))
    return listed.select(*[_at("_r", i).alias(c) for i, c in enumerate(LIST_COLUMNS)])


SITE_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField(
                "children",
                T.ArrayType(
                    T.StructType(
                        [T.StructField(c, T.StringType()) for c in ("province", "siteName", "siteCode", "siteArea", "lat", "lon", "blue", "yellow", "orange", "red")]
                    )
                ),
            )
        ]
    )
)


def flatten_site_tree(df: DataFrame, json: str = "value") -> DataFrame:
    """Province groups to their warning sites."""
    groups = df.select(F.explode(F.from_json(F.col(json), SITE_SCHEMA)).alias("g"))
    return groups.select(F.inline("g.children"))


def explode_scenario_path(df: DataFrame, path_id: str = "pathId", points: str = "pointData") -> DataFrame:
    """One row per point of each scenario's path."""
    return df.select(path_id, F.inline(points))


def zip_series(
    df: DataFrame, keys: Sequence[str], initial: str = "initialTime", tides: str = "tides", surges: str = "surges", levels: str = "wl"
) -> DataFrame:
    """Parallel tide, surge and level arrays to hourly rows; shorter arrays give null."""
    zipped = F.arrays_zip(F.col(tides).alias("tide_cm"), F.col(surges).alias("surge_cm"), F.col(levels).alias("water_level_cm"))
    rows = df.select(*keys, initial, F.posexplode(zipped).alias("lead_index", "_z"))
    return rows.withColumn("forecastTime", F.col(initial) + F.make_interval(hours=F.col("lead_index"))).select(
        *keys, initial, "forecastTime", "lead_index", "_z.*"
    )


# Observation fields of a sea-surface record and of its anemometer.
WEATHER_FIELDS = (
    "TideHeight", "TideLevel", "WaveHeight", "WaveDirection", "WaveDirectionDescription", "WavePeriod", "SeaTemperature",
    "Temperature", "StationPressure",
)
WIND_FIELDS = ("WindSpeed", "WindScale", "WindDirection", "WindDirectionDescription", "MaximumWindSpeed", "MaximumWindScale")


def _observation_schema(root: str) -> T.StructType:
    def struct(fields: dict[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField(k, v) for k, v in fields.items()])

    wind = struct({c: T.StringType() for c in WIND_FIELDS})
    weather = struct({**{c: T.StringType() for c in WEATHER_FIELDS}, "PrimaryAnemometer": wind})
    times = struct({"StationObsTime": T.ArrayType(struct({"DateTime": T.StringType(), "WeatherElements": weather}))})
    location = struct({"Station": struct({"StationID": T.StringType()}), "StationObsTimes": times})
    return struct({root: struct({"SeaSurfaceObs": struct({"Location": T.ArrayType(location)})})})


def sea_surface_obs(df: DataFrame, json: str = "value") -> DataFrame:
    """Location → station → times, one row per observation with 17 columns."""
    locations = F.coalesce(
        *[F.from_json(F.col(json), _observation_schema(root))[root]["SeaSurfaceObs"]["Location"] for root in ("Records", "records")]
    )
    places = df.select(F.explode(locations).alias("l"))
    times = places.select(F.col("l.Station.StationID").alias("StationID"), F.explode("l.StationObsTimes.StationObsTime").alias("o"))
    return times.select(
        "StationID", F.col("o.DateTime").alias("DateTime"), *[F.col(f"o.WeatherElements.{c}").alias(c) for c in WEATHER_FIELDS],
        *[F.col(f"o.WeatherElements.PrimaryAnemometer.{c}").alias(c) for c in WIND_FIELDS],
    )


# Record lists probed in this order.
RECORD_KEYS = ("SeaSurfaceObs", "Station", "location", "locations", "records")


def find_records(df: DataFrame, root: str = "records") -> DataFrame:
    """One row per record: of the lists under ``root`` the one whose name ranks first in RECORD_KEYS, unnamed ones last."""
    kind = df.schema[root].dataType
    fields = kind.fields if isinstance(kind, T.StructType) else [T.StructField("", kind)]
    rank = dict(zip(RECORD_KEYS, range(len(RECORD_KEYS))))
    lists = sorted((f.name for f in fields if isinstance(f.dataType, T.ArrayType)), key=lambda n: rank.get(n, len(rank)))
    if not lists:
        raise ValueError(f"no record list under {root}")
    return df.select(F.explode(F.col(root if lists[0] == "" else f"{root}.`{lists[0]}`")).alias("record"))


def flatten_json(df: DataFrame) -> DataFrame:
    """Nested columns to dotted names, walked once over the schema.

    Lists of scalars stay JSON text. Lists of objects get index keys from 0 to the longest of that list in the table,
    which one aggregate finds for the lists of each nesting level.
    """
    def lists(c: Column, kind: T.DataType, name: str, widths: dict[str, int], found: dict[str, Column]) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in lists(c.getField(f.name), f.dataType, f"{name}.{f.name}", widths, found)]
        if not isinstance(kind, T.ArrayType):
            return [c.alias(name)]
        if not isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return [F.to_json(c).alias(name)]
        if name not in widths:
            found[name] = F.coalesce(F.max(F.size(c)), F.lit(0))
            return []
        return [x for i in range(widths[name]) for x in lists(F.get(c, F.lit(i)), kind.elementType, f"{name}.{i}", widths, found)]

    widths: dict[str, int] = {}
    while True:
        found: dict[str, Column] = {}
        columns = [x for f in df.schema.fields for x in lists(F.col(f"`{f.name}`"), f.dataType, f.name, widths, found)]
        if not found:
            return df.select(*columns)
        sizes = df.agg(*(c.alias(f"w{i}") for i, c in enumerate(found.values()))).first()
        widths |= {name: max(0, size) for name, size in zip(found, sizes)}


def code_summary(df: DataFrame, code: str = "code", ts: str = "time", tide: str = "tide") -> DataFrame:
    """Rows, time range and tide range per station code; blank codes or times do not count."""
    level = F.trim(tide).try_cast("double")
    rows = df.where((F.trim(F.coalesce(code, F.lit(""))) != "") & (F.trim(F.coalesce(ts, F.lit(""))) != ""))
    return rows.groupBy(F.trim(code).alias("station_code")).agg(
        F.count("*").alias("rows"), F.min(F.trim(ts)).alias("start_time"), F.max(F.trim(ts)).alias("end_time"),
        F.min(level).alias("min_tide"), F.max(level).alias("max_tide"),
    )


def read_code_table(spark: SparkSession, path: str, encoding: str = "gbk") -> DataFrame:
    """Headed CSV (any, code, time, tide) in a legacy Chinese encoding; rows with fewer fields are left out.

    Spark reads only a few charsets, so bytes come in one to one as Latin-1: separators and line ends never
    occur inside a two-byte character. Only fields that are not ASCII are decoded again, in Arrow batches.
    """
    @F.pandas_udf(T.StringType())
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else v.encode("latin-1").decode(encoding, errors="replace"))

    names = ("first", "code", "time", "tide")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = spark.read.csv(path, header=True, encoding="ISO-8859-1", schema=schema, enforceSchema=True).where(F.col("tide").isNotNull())

    def field(c: str) -> Column:
        plain = F.col(c).rlike(r"^[\x00-\x7f]*$")
        return F.when(plain, F.col(c)).otherwise(decode(F.when(~plain, F.col(c)))).alias(c)

    return rows.select(*[field(c) for c in names])
