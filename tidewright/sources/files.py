"""File listings and field tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names accepted for field variables and coordinates, field file suffixes, and the year pattern.
VARIABLE_ALIASES = {
    "U10": ("u10", "10u", "u_component_of_wind_10m"),
    "V10": ("v10", "10v", "v_component_of_wind_10m"),
    "MSL": ("msl", "slp", "mean_sea_level_pressure"),
}
COORDINATE_ALIASES = {
    "ts": ("time", "valid_time", "datetime"),
    "latitude": ("latitude", "lat", "y"),
    "longitude": ("longitude", "lon", "x"),
}
NETCDF_SUFFIXES = (".nc", ".nc4", ".cdf")
GRIB_SUFFIXES = (".grib", ".grb", ".grib2", ".grb2")
YEAR = r"(?<!\d)(19\d{2}|20\d{2})(?!\d)"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, name and size of every file below ``root`` (contents are not read)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        F.col("path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size_bytes")
    )


def file_period(name: str | Column) -> Column:
    """Four-digit year in a file name that does not touch other digits; else the stem."""
    c = F.col(name) if isinstance(name, str) else name
    year = F.regexp_extract(c, YEAR, 1)
    return F.when(year != "", year).otherwise(F.regexp_extract(c, r"^(.*?)(?:\.[^.]*)?$", 1))


def group_files_by_year(files: DataFrame, suffixes: Sequence[str] = NETCDF_SUFFIXES + GRIB_SUFFIXES) -> DataFrame:
    """Files with their period, side-car files left out; group or sort by ``period, path``."""
    wanted = _suffix().isin(list(suffixes)) & ~F.col("file_name").startswith("._")
    return files.where(wanted).withColumn("period", file_period("file_name")).orderBy("period", "path")


def _suffix() -> Column:
    return F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1))


# Labels of a file listing, by suffix and by words of the path, in order.
SUFFIX_LABELS = ((NETCDF_SUFFIXES, "ERA5 NetCDF"), (GRIB_SUFFIXES, "ERA5 GRIB"))
WORD_LABELS = ((("metadata", "gesla"), "GESLA metadata"), (("gesla",), "GESLA station file"), (("psmsl",), "PSMSL/NOC station file"), (("noc",), "PSMSL/NOC station file"))
STATION_LABEL, OTHER_LABEL = "PSMSL/NOC station file", "unclassified"


def _rules(stations: dict[str, str]) -> Column:
    """Rule table of a listing: (suffixes or null, words that must all occur, label)."""
    rows = [(list(s), [], label) for s, label in SUFFIX_LABELS] + [(None, list(w), label) for w, label in WORD_LABELS]
    rows += [(None, [t], STATION_LABEL) for t in stations]
    return F.array(*(
        F.struct((F.array(*map(F.lit, s)) if s else F.lit(None).cast("array<string>")).alias("suffixes"),
                 (F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")).alias("words"), F.lit(label).alias("label")) for s, w, label in rows))


def file_inventory(files: DataFrame, stations: dict[str, str]) -> DataFrame:
    """Suffix, size in MB, guessed source, station and year per file; ``._`` entries at any depth are left out.

    ``stations`` maps a token of the path to a station name; the first token found wins.
    """
    text = F.lower("path")
    tokens = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(s).alias("s")) for t, s in stations.items())) if stations else F.array().cast("array<struct<t:string,s:string>>")
    station = F.coalesce(F.get(F.filter(tokens, lambda x: F.contains(text, x["t"])), F.lit(0))["s"], F.lit(""))
    fits = F.filter(_rules(stations), lambda r: (r["suffixes"].isNull() | F.array_contains(r["suffixes"], _suffix())) & F.forall(r["words"], lambda w: F.contains(text, w)))
    source = F.coalesce(F.get(fits, F.lit(0))["label"], F.lit(OTHER_LABEL))
    return files.where(~F.col("path").rlike(r"(^|/)\._")).select(
        F.col("path").alias("file_path"), "file_name", _suffix().alias("suffix"),
        F.round(F.col("size_bytes") / (1024 * 1024), 4).alias("size_mb"), source.alias("possible_source"),
        station.alias("possible_station"), F.regexp_extract("file_name", YEAR, 1).alias("possible_year"),
    )


def _pick(names: Sequence[str], columns: Sequence[str], what: str, required: bool = True) -> str | None:
    lower = {c.lower(): c for c in columns}
    hits = [lower[n] for n in names if n in lower]
    if len(hits) > 1:
        raise ValueError(f"{what} found more than once: {hits}")
    if not hits and required:
        raise ValueError(f"cannot identify {what} among {list(columns)}")
    return hits[0] if hits else None


def canonical_grid(df: DataFrame, variables: Sequence[str] = ("U10", "V10", "MSL")) -> DataFrame:
    """Field columns renamed by alias into the long table (ts, variable, latitude, longitude, value).

    Accepts a wide table (a column per variable) or a long one (``variable``, ``value``). A variable that is
    missing or appears twice is an error.
    """
    coordinates = {t: _pick(names, df.columns, t) for t, names in COORDINATE_ALIASES.items()}
    axes = [F.col(f"`{c}`").alias(t) for t, c in coordinates.items()]
    if "variable" in df.columns and "value" in df.columns:
        name = F.lower("variable")
        mapped = F.coalesce(*[F.when(name.isin(list(VARIABLE_ALIASES[v])), F.lit(v)) for v in variables])
        kept = [c for c in ("lat_idx", "lon_idx") if c in df.columns]
        return df.select(*axes, mapped.alias("variable"), *kept, F.col("value").cast("double").alias("value")).where(F.col("variable").isNotNull())
    found = {v: _pick(VARIABLE_ALIASES[v], df.columns, v) for v in variables}
    values = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"`{c}`").cast("double").alias("value")) for v, c in found.items()])
    return df.select(*axes, F.inline(values))


def read_grid(spark: SparkSession, paths: Sequence[str] | str, variables: Sequence[str] = ("U10", "V10", "MSL")) -> DataFrame:
    """Parquet field table by alias."""
    return canonical_grid(spark.read.parquet(*([paths] if isinstance(paths, str) else paths)), variables)


# Fields a station registry may define.
STATION_FIELDS = (
    "station_id", "station_name", "source", "latitude", "longitude", "start_time", "end_time", "timezone", "water_level_unit",
    "water_level_datum", "file_path", "sensor_files", "selected_sensor", "era5_path", "physics",
)


def station_registry(df: DataFrame, required: Sequence[str] = ("station_id", "station_name")) -> DataFrame:
    """Station dimension: unknown columns are an error, absent ones null; a blank required field fails the job."""
    unknown = sorted(set(df.columns) - set(STATION_FIELDS))
    if unknown:
        raise ValueError(f"unknown station fields: {unknown}")
    absent = {c: F.lit(None).cast("string") for c in STATION_FIELDS if c not in df.columns}
    whole = F.lit(True)
    for c in required:
        whole = whole & (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    failed = F.raise_error(F.concat(F.lit("station lacks required fields: "), F.coalesce("station_id", F.lit("?")))).cast("boolean")
    return df.withColumns(absent).where(F.when(whole, F.lit(True)).otherwise(failed)).select(*STATION_FIELDS)
