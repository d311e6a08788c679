"""Gridded wind and pressure fields as long tables: cropping, regridding, moments, gradients, regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.columns import EARTH_RADIUS_M, finite, lon_distance, normalise_lon

VARIABLES = ("U10", "V10", "MSL")


def crop_region(df: DataFrame, stations: DataFrame, half: float, strict: bool = False) -> DataFrame:
    """Cells within ``half`` degrees of each station (lat, circular lon); ``stations``: station_id, lat, lon.

    A station without any cell is absent, or fails the job when ``strict``.

    Stations are copied to the degree bins their box touches, so cells and stations meet in an equi-join.
    """
    around = int(360 // half) if half < 180 else 1
    width = 360.0 / around
    lat_bin = F.floor(F.col("latitude") / half)
    lon_bin = F.floor((normalise_lon("longitude") + 180.0) / width)
    boxes = (
        stations.select("station_id", F.col("lat").alias("station_lat"), F.col("lon").alias("station_lon"))
        .withColumn("_i", F.floor(F.col("station_lat") / half))
        .withColumn("_j", F.floor((normalise_lon("station_lon") + 180.0) / width))
        .withColumn("_lat_bin", F.explode(F.sequence(F.col("_i") - 1, F.col("_i") + 1)))
        .withColumn(
            "_lon_bin",
            F.explode(F.array_distinct(F.transform(F.sequence(F.col("_j") - 1, F.col("_j") + 1), lambda b: F.pmod(b, F.lit(around))))),
        )
        .drop("_i", "_j")
    )
    joined = df.withColumns({"_lat_bin": lat_bin, "_lon_bin": lon_bin}).join(boxes, ["_lat_bin", "_lon_bin"])
    inside = (F.abs(F.col("latitude") - F.col("station_lat")) <= half) & (
        lon_distance("longitude", "station_lon") <= half
    )
    cropped = joined.where(inside).drop("_lat_bin", "_lon_bin")
    if not strict:
        return cropped
    found = cropped.select("station_id", F.lit(1).alias("_found")).distinct()
    outside = F.raise_error(F.concat(F.lit("no field cell near station "), F.col("station_id").cast("string"))).cast("boolean")
    checked = stations.select("station_id").join(found, "station_id", "left").where(
        F.when(F.col("_found") == 1, F.lit(True)).otherwise(outside)
    )
    return cropped.join(checked.select("station_id"), "station_id")


def grid_coordinates(field: DataFrame) -> DataFrame:
    """Axis table: one row per axis position with its coordinate, position count and range."""
    axis = F.array(
        F.struct(F.lit("latitude").alias("axis"), F.col("lat_idx").alias("position"), F.col("latitude").alias("coordinate")),
        F.struct(F.lit("longitude").alias("axis"), F.col("lon_idx").alias("position"), F.col("longitude").alias("coordinate")),
    )
    points = field.select(F.inline(axis)).distinct()
    shape = points.groupBy("axis").agg(
        F.count("*").alias("size"), F.min("coordinate").alias("low"), F.max("coordinate").alias("high")
    )
    return points.join(shape, "axis")


def _axis_weights(field: DataFrame, index: str, coordinate: str, size: int, target: str) -> DataFrame:
    """Source position -> target position with its linear weight, for an even axis of ``size`` points.

    An axis has at most a few hundred positions, so one window over it is bounded by the grid, not the data.
    """
    axis = field.select(F.col(index), F.col(coordinate).alias("_c")).distinct()
    span = axis.agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).withColumn("_one", F.lit(1))
    w = Window.partitionBy("_one").orderBy("_c")
    step = (F.col("_hi") - F.col("_lo")) / (size - 1)

    def place(c: str) -> Column:
        return F.ceil((F.col(c) - F.col("_lo")) / step - 1e-9)

    cells = (
        axis.withColumn("_one", F.lit(1)).join(span, "_one")
        .withColumns({"_next": F.lead("_c").over(w), "_next_idx": F.lead(index).over(w)})
        .where(F.col("_next").isNotNull())
        .withColumn("_stop", F.when(F.col("_next") == F.col("_hi"), F.lit(size - 1)).otherwise(place("_next") - 1))
        .where(F.col("_stop") >= place("_c"))
        .withColumn(target, F.explode(F.sequence(place("_c"), F.col("_stop"))))
        .withColumn("_w", (F.col("_lo") + F.col(target) * step - F.col("_c")) / (F.col("_next") - F.col("_c")))
    )
    both = F.array(
        F.struct(F.col(index).alias("s"), (1 - F.col("_w")).alias("w")),
        F.struct(F.col("_next_idx").alias("s"), F.col("_w").alias("w")),
    )
    value = (F.col("_lo") + F.col(target) * step).alias(f"{target}_coordinate")
    return (
        cells.select(target, value, F.inline(both)).where(F.col("w") > 1e-12)
        .select(F.col("s").alias(index), target, f"{target}_coordinate", F.col("w").alias(f"{target}_w"))
    )


def regrid_bilinear(field: DataFrame, rows: int = 40, columns: int = 40) -> DataFrame:
    """Linear interpolation onto an even ``rows x columns`` grid over the field's own extent.

    Every source cell sends its weighted share to the targets around it; a target that touches a missing
    cell is null.
    """
    lat = _axis_weights(field, "lat_idx", "latitude", rows, "row")
    lon = _axis_weights(field, "lon_idx", "longitude", columns, "column")
    shares = field.join(lat, "lat_idx").join(lon, "lon_idx")
    weight = F.col("row_w") * F.col("column_w")
    total = F.when(F.count("value") == F.count("*"), F.sum(F.col("value") * weight))
    return shares.groupBy("ts", "variable", "row", "column").agg(
        F.first("row_coordinate").alias("latitude"), F.first("column_coordinate").alias("longitude"), total.alias("value")
    )


def field_moments(field: DataFrame, training: Column | None = None) -> DataFrame:
    """Mean and population std per variable over finite training cells; a std below 1e-8 becomes 1."""
    v = finite("value") if training is None else F.when(training, finite("value"))
    std = F.stddev_pop(v)
    return field.groupBy("variable").agg(
        F.count(v).alias("cells"), F.avg(v).alias("mean"), F.when(std < 1e-8, F.lit(1.0)).otherwise(std).alias("std")
    )


def spatial_summary(field: DataFrame, variables: Sequence[str] = VARIABLES) -> DataFrame:
    """Per hour: mean, population std, min and max over the cells of each variable."""
    columns = []
    for name in variables:
        v = F.when(F.col("variable") == name, F.col("value"))
        prefix = name.lower()
        columns += [
            F.avg(v).alias(f"{prefix}_mean"), F.stddev_pop(v).alias(f"{prefix}_std"),
            F.min(v).alias(f"{prefix}_min"), F.max(v).alias(f"{prefix}_max"),
        ]
    return field.groupBy("ts").agg(*columns)


def field_audit(field: DataFrame, pressure: str = "MSL") -> DataFrame:
    """Per variable: finite cells and all others, range and mean of the finite, and whether pressure looks like Pa."""
    v = finite("value")
    sane = F.when(
        F.col("variable") == pressure, (F.min(v) >= 80_000) & (F.max(v) <= 120_000)
    )
    return field.groupBy("variable").agg(
        F.count("*").alias("cells"), F.count(v).alias("finite"), (F.count("*") - F.count(v)).alias("missing"),
        (F.count(v) / F.count("*")).alias("finite_fraction"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), sane.alias("pressure_in_pa"),
    )


def pressure_gradient(wide: DataFrame, pressure: str = "msl", keys: Sequence[str] = ("ts",), placed: bool = False) -> DataFrame:
    """East and north pressure gradients in Pa/m on an uneven grid.

    Second-order central differences inside and one-sided at the edges, along index order; longitude steps
    are taken the short way round. Repeated coordinates and poles fail the job. Both directions run on one
    shuffle by ``keys``: a single field is bounded by the grid. ``placed`` says the rows already lie by
    ``keys``, as :func:`tidewright.operators.align.exact_grid_align` leaves them.
    """
    east_axis = Window.partitionBy(*keys, "lat_idx").orderBy("lon_idx")
    north_axis = Window.partitionBy(*keys, "lon_idx").orderBy("lat_idx")

    def slope(axis, step_back: Column, step_ahead: Column) -> Column:
        f, before, after = F.col(pressure), F.lag(pressure).over(axis), F.lead(pressure).over(axis)
        hs, hd = F.radians(step_back), F.radians(step_ahead)
        clash = F.raise_error(F.lit("coordinates must be unique")).cast("double")
        hs, hd = F.when(hs == 0, clash).otherwise(hs), F.when(hd == 0, clash).otherwise(hd)
        inner = (hs * hs * after + (hd * hd - hs * hs) * f - hd * hd * before) / (hs * hd * (hd + hs))
        return F.when(hs.isNull(), (after - f) / hd).when(hd.isNull(), (f - before) / hs).otherwise(inner)

    lon_back = normalise_lon(F.col("longitude") - F.lag("longitude").over(east_axis))
    lon_ahead = normalise_lon(F.lead("longitude").over(east_axis) - F.col("longitude"))
    lat_back = F.col("latitude") - F.lag("latitude").over(north_axis)
    lat_ahead = F.lead("latitude").over(north_axis) - F.col("latitude")
    cosine = F.cos(F.radians("latitude"))
    pole = F.raise_error(F.lit("longitude gradient is unstable at the poles")).cast("double")
    safe = F.when(F.abs(cosine) < 1e-6, pole).otherwise(cosine)
    rows = wide if placed else wide.repartition(*keys)
    return rows.withColumns(
        {
            "gradient_east": slope(east_axis, lon_back, lon_ahead) / (EARTH_RADIUS_M * safe),
            "gradient_north": slope(north_axis, lat_back, lat_ahead) / EARTH_RADIUS_M,
        }
    )


def station_cells(cells: DataFrame) -> DataFrame:
    """Nearest cell of each station: nearest latitude and nearest longitude, first index on ties.

    ``cells`` are cropped cells: station_id, station_lat, station_lon, lat_idx, lon_idx, latitude, longitude.
    """
    return cells.groupBy("station_id").agg(
        F.min_by("lat_idx", F.struct(F.abs(F.col("latitude") - F.col("station_lat")), "lat_idx")).alias("station_lat_idx"),
        F.min_by("lon_idx", F.struct(lon_distance("longitude", "station_lon"), "lon_idx")).alias("station_lon_idx"),
    )


# Places of a stencil, the station's cell first.
STENCIL = ("centre", "west", "east", "south", "north")


def station_stencil(grid: DataFrame, stations: DataFrame) -> DataFrame:
    """(station_id, lat_idx, lon_idx, place): each station's cell and the cells next to it along both axes of the grid.

    ``grid``: lat_idx, lon_idx of every cell, once; ``stations``: :func:`station_cells`. Places beyond an edge are absent.
    """
    east_axis, north_axis = Window.partitionBy("lat_idx").orderBy("lon_idx"), Window.partitionBy("lon_idx").orderBy("lat_idx")
    i, j = F.col("lat_idx"), F.col("lon_idx")
    around = {"centre": (i, j), "west": (i, F.lag(j).over(east_axis)), "east": (i, F.lead(j).over(east_axis)),
              "south": (F.lag(i).over(north_axis), j), "north": (F.lead(i).over(north_axis), j)}
    beside = grid.select(i.alias("station_lat_idx"), j.alias("station_lon_idx"), F.array(*(
        F.struct(F.lit(place).alias("place"), a.alias("lat_idx"), b.alias("lon_idx")) for place, (a, b) in around.items())).alias("_cells"))
    met = stations.select("station_id", "station_lat_idx", "station_lon_idx").join(beside, ["station_lat_idx", "station_lon_idx"])
    return met.select("station_id", F.inline("_cells")).where(F.col("lat_idx").isNotNull() & F.col("lon_idx").isNotNull())


def stencil_values(pressure: str = "msl", place: str = "place") -> list[Column]:
    """Aggregates over the stencil of a station and time: pressure and coordinates at its places."""
    wanted = [(place_, c) for place_ in STENCIL for c in (pressure, "latitude", "longitude")]
    return [F.max(F.when(F.col(place) == where, F.col(c))).alias(f"_{where}_{'f' if c == pressure else c}") for where, c in wanted]


def stencil_gradient() -> dict[str, Column]:
    """``gradient_east`` and ``gradient_north`` in Pa/m from :func:`stencil_values`, by the differences of :func:`pressure_gradient`."""
    f, lat, lon = F.col("_centre_f"), F.col("_centre_latitude"), F.col("_centre_longitude")

    def slope(back: str, ahead: str, step_back: Column, step_ahead: Column) -> Column:
        before, after = F.col(f"_{back}_f"), F.col(f"_{ahead}_f")
        clash = F.raise_error(F.lit("coordinates must be unique")).cast("double")
        hs, hd = (F.when(h == 0, clash).otherwise(F.radians(h)) for h in (step_back, step_ahead))
        inner = (hs * hs * after + (hd * hd - hs * hs) * f - hd * hd * before) / (hs * hd * (hd + hs))
        return F.when(step_back.isNull(), (after - f) / hd).when(step_ahead.isNull(), (f - before) / hs).otherwise(inner)

    pole = F.raise_error(F.lit("longitude gradient is unstable at the poles")).cast("double")
    cosine = F.when(F.abs(F.cos(F.radians(lat))) < 1e-6, pole).otherwise(F.cos(F.radians(lat)))
    east = slope("west", "east", normalise_lon(lon - F.col("_west_longitude")), normalise_lon(F.col("_east_longitude") - lon))
    north = slope("south", "north", lat - F.col("_south_latitude"), F.col("_north_latitude") - lat)
    return {"gradient_east": east / (EARTH_RADIUS_M * cosine), "gradient_north": north / EARTH_RADIUS_M}


def local_gradient(wide: DataFrame, stencil: DataFrame, pressure: str = "msl") -> DataFrame:
    """(station_id, ts, gradient_east, gradient_north) from at most five cells per station and time."""
    met = wide.select("ts", "lat_idx", "lon_idx", "latitude", "longitude", pressure).join(stencil, ["lat_idx", "lon_idx"])
    values = met.groupBy("station_id", "ts").agg(*stencil_values(pressure))
    return values.select("station_id", "ts", *(c.alias(name) for name, c in stencil_gradient().items()))


def region_masks(cells: DataFrame, regions: dict[str, float]) -> DataFrame:
    """Adds ``at_station`` and ``in_<region>`` flags: cells within r degrees of the station in lat and lon.

    The nearest cell always belongs; radius 0 keeps only that cell.
    """
    if any(radius < 0 for radius in regions.values()):
        raise ValueError("region radius cannot be negative")
    tagged = cells.join(station_cells(cells), "station_id").withColumn(
        "at_station",
        (F.col("lat_idx") == F.col("station_lat_idx")) & (F.col("lon_idx") == F.col("station_lon_idx")),
    )
    flags = {}
    for name, radius in regions.items():
        near = (F.abs(F.col("latitude") - F.col("station_lat")) <= radius) & (
            lon_distance("longitude", "station_lon") <= radius
        )
        flags[f"in_{name}"] = F.col("at_station") | (near & F.lit(radius > 0))
    return tagged.withColumns(flags).drop("station_lat_idx", "station_lon_idx")


def forcing_unit_audit(metadata: DataFrame) -> DataFrame:
    """First source file, name and units seen per variable; ``metadata``: variable, source_file, name, units."""
    first = F.min_by(F.struct("source_file", "name", "units"), F.struct("source_file", "name"))
    return metadata.groupBy("variable").agg(
        first.alias("_first"), F.count_distinct("units").alias("unit_spellings")
    ).select("variable", "_first.*", "unit_spellings")


def dataset_audit(targets: DataFrame, series: DataFrame, value: str = "surge_m", keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Hours, missing values and usable or skipped targets by reason: per key and year, per key, and overall.

    ``level`` is ``year``, ``key`` or ``overall``; keys and year are null where a row sums over them. The totals come
    from one rollup of the rows per year. A total is strictly hourly where each of its years is.

    ``targets`` comes from :func:`tidewright.operators.samples.valid_targets` applied with the year among
    its keys, so windows do not reach into the year before.
    """
    year = F.year("ts").alias("year")
    hours = series.groupBy(*keys, year).agg(
        F.count("*").alias("hours"), F.count_if(finite(value).isNull()).alias("missing_surge_hours"),
        F.min("ts").alias("start"), F.max("ts").alias("end"),
        (F.max(F.unix_seconds("ts")) - F.min(F.unix_seconds("ts")) == (F.count("*") - 1) * 3600).alias("strictly_hourly"),
    )
    reason = F.col("skip_reason")
    counted = ["valid_samples", *(f"skipped_{k}" for k in ("non_contiguous", "missing_atmosphere", "missing_surge"))]
    counts = targets.groupBy(*keys, year).agg(
        F.count_if(reason.isNull()).alias(counted[0]), *[F.count_if(reason == c.removeprefix("skipped_")).alias(c) for c in counted[1:]]
    )
    by_year = hours.join(counts, [*keys, "year"], "left").fillna(0, counted)
    totals = by_year.rollup(F.struct(*keys).alias("_key"), "year").agg(
        F.grouping_id().alias("_level"), *(F.sum(c).alias(c) for c in ("hours", "missing_surge_hours")), F.min("start").alias("start"),
        F.max("end").alias("end"), F.every("strictly_hourly").alias("strictly_hourly"), *(F.sum(c).alias(c) for c in counted))
    level = F.when(F.col("_level") == 0, "year").when(F.col("_level") == 1, "key").otherwise("overall")
    return totals.select(level.alias("level"), *(F.col(f"_key.{k}").alias(k) for k in keys), *(c for c in totals.columns if c[0] != "_"))
