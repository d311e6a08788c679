"""Queries over gridded fields and physical forcing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.storage import stored
from tidewright.operators import align, field, physics
from tidewright.plans import views
from tidewright.plans.registry import n, query, r

views.SQL["sites"] = "SELECT min(station_id) AS station_id, lat, lon FROM stations GROUP BY lat, lon"
views.SQL["wide_field"] = """
SELECT ts, lat_idx, lon_idx, latitude, longitude, max(value) FILTER (WHERE variable = 'U10') AS u10,
       max(value) FILTER (WHERE variable = 'V10') AS v10, max(value) FILTER (WHERE variable = 'MSL') AS msl
FROM field GROUP BY ts, lat_idx, lon_idx, latitude, longitude"""
views.SQL["site_cells"] = """
SELECT s.station_id, s.lat AS station_lat, s.lon AS station_lon, c.lat_idx, c.lon_idx, c.latitude, c.longitude
FROM sites s JOIN (SELECT DISTINCT lat_idx, lon_idx, latitude, longitude FROM field) c
  ON abs(c.latitude - s.lat) <= 2 AND abs(c.longitude - s.lon) <= 2"""
views.SQL["site_masks"] = """
WITH k AS (SELECT station_id, arg_min(lat_idx, abs(latitude - station_lat) + lat_idx * 1e-9) AS si,
                  arg_min(lon_idx, abs(longitude - station_lon) + lon_idx * 1e-9) AS sj FROM site_cells GROUP BY 1)
SELECT c.station_id, c.lat_idx, c.lon_idx, c.lat_idx = si AND c.lon_idx = sj AS at_station,
       (c.lat_idx = si AND c.lon_idx = sj) OR (abs(latitude - station_lat) <= 1 AND abs(longitude - station_lon) <= 1) AS in_near
FROM site_cells c JOIN k ON k.station_id = c.station_id"""
_RAD = "radians(1.0)"
_EARTH = "6371000.0"


def _slope(axis: str, order: str) -> str:
    w = f"(PARTITION BY ts, {axis} ORDER BY {order})"
    back, ahead = f"lag(msl) OVER {w}", f"lead(msl) OVER {w}"
    first, last = f"lag({order}) OVER {w} IS NULL", f"lead({order}) OVER {w} IS NULL"
    return f"CASE WHEN {first} THEN ({ahead} - msl) / {_RAD} WHEN {last} THEN (msl - {back}) / {_RAD} ELSE ({ahead} - {back}) / (2 * {_RAD}) + 0 * msl END"


views.SQL["gradient_field"] = f"""
SELECT *, {_slope('lat_idx', 'lon_idx')} / ({_EARTH} * cos(radians(latitude))) AS ge, {_slope('lon_idx', 'lat_idx')} / {_EARTH} AS gn FROM wide_field"""

_CD = "least(0.003, greatest(0, (0.75 + 0.067 * sp) * 1e-3))"
_WU = "least(0.003, greatest(0, CASE WHEN sp < 7.5 THEN 1.2875e-3 ELSE (0.8 + 0.065 * sp) * 1e-3 END))"
views.SQL["stress_field"] = f"""
SELECT *, {_CD} AS cd, 1.225 * {_CD} * sp * u10 AS te, 1.225 * {_CD} * sp * v10 AS tn, 1.225 * {_CD} * sp * sp AS tm
FROM (SELECT *, sqrt(u10 * u10 + v10 * v10) AS sp FROM gradient_field)"""
views.SQL["physics_hourly"] = """
WITH j AS (SELECT m.station_id, m.at_station, m.in_near, f.* FROM stress_field f JOIN site_masks m ON m.lat_idx = f.lat_idx AND m.lon_idx = f.lon_idx),
h AS (SELECT station_id, ts, max(msl) FILTER (WHERE at_station) AS p, avg(msl) AS pr, max(ge) FILTER (WHERE at_station) AS ge, max(gn) FILTER (WHERE at_station) AS gn,
             max(sp) FILTER (WHERE at_station) AS sp, max(cd) FILTER (WHERE at_station) AS cd, max(te) FILTER (WHERE at_station) AS te,
             max(tn) FILTER (WHERE at_station) AS tn, max(tm) FILTER (WHERE at_station) AS tm,
             avg(msl) FILTER (WHERE in_near) AS np, min(msl) FILTER (WHERE in_near) AS npmin, avg(tm) FILTER (WHERE in_near) AS nt, max(tm) FILTER (WHERE in_near) AS ntmax
      FROM j GROUP BY 1, 2),
c AS (SELECT station_id, avg(p) FILTER (WHERE day(ts) <= 20) AS clim FROM h GROUP BY 1)
SELECT h.*, p - clim AS pa, p - pr AS par, -(p - clim) / (1025.0 * 9.80665) AS ib, -(p - pr) / (1025.0 * 9.80665) AS ibr,
       te * sin(radians(30)) + tn * cos(radians(30)) AS ton, tn * sin(radians(30)) - te * cos(radians(30)) AS tal
FROM h JOIN c ON c.station_id = h.station_id"""


def sites(spark, sf):
    return views.stations(spark, sf).groupBy("lat", "lon").agg(F.min("station_id").alias("station_id"))


def _grid(spark, sf):
    return views.field(spark, sf).select("lat_idx", "lon_idx", "latitude", "longitude").distinct()


def _site_cells(spark, sf):
    return field.crop_region(_grid(spark, sf), sites(spark, sf), 2.0)


def hourly(spark, sf):
    grid = stored(_grid(spark, sf), "grid")  # a few cells, used in several joins
    cells = stored(field.crop_region(grid, sites(spark, sf), 2.0), "site-cells")
    return physics.hourly_physics(align.exact_grid_align(views.field(spark, sf)), cells, F.dayofmonth("ts") <= 20, {"station": 0.0, "near": 1.0}, bearing_deg=30.0, grid=grid)


@query("crop_region", f"""
SELECT s.station_id, c.lat_idx, c.lon_idx FROM stations s JOIN (SELECT DISTINCT lat_idx, lon_idx, latitude, longitude FROM field) c
ON abs(c.latitude - s.lat) <= 2 AND abs(c.longitude - s.lon) <= 2""")
def _(spark, sf):
    return field.crop_region(_grid(spark, sf), views.stations(spark, sf), 2.0).select("station_id", "lat_idx", "lon_idx")


@query("grid_coordinates", f"""
SELECT axis, position, {r('coordinate', 'coordinate')}, {n('count(*) OVER (PARTITION BY axis)', 'size')}, round(min(coordinate) OVER (PARTITION BY axis), 6) + 0.0 AS low,
       round(max(coordinate) OVER (PARTITION BY axis), 6) + 0.0 AS high
FROM (SELECT DISTINCT 'latitude' AS axis, lat_idx AS position, latitude AS coordinate FROM field UNION SELECT DISTINCT 'longitude', lon_idx, longitude FROM field)""")
def _(spark, sf):
    return field.grid_coordinates(views.field(spark, sf))


@query("regrid_bilinear", f"""
WITH t AS (SELECT y."row", x."column", 10 + y."row" * 4.0 / 8 AS la, -64 + x."column" * 4.0 / 8 AS lo FROM (SELECT unnest(generate_series(0, 8)) AS "row") y, (SELECT unnest(generate_series(0, 8)) AS "column") x),
k AS (SELECT t.*, c.lat_idx, c.lon_idx, (1 - abs(c.latitude - la)) * (1 - abs(c.longitude - lo)) AS w FROM t
      JOIN (SELECT DISTINCT lat_idx, lon_idx, latitude, longitude FROM field) c ON abs(c.latitude - la) < 1 AND abs(c.longitude - lo) < 1)
SELECT f.ts, f.variable, k."row", k."column", {r('max(la)', 'latitude')}, {r('max(lo)', 'longitude')},
       {r('CASE WHEN count(value) = count(*) THEN sum(value * w) END', 'value')}
FROM field f JOIN k ON k.lat_idx = f.lat_idx AND k.lon_idx = f.lon_idx GROUP BY f.ts, f.variable, k."row", k."column" """)
def _(spark, sf):
    return field.regrid_bilinear(views.field(spark, sf), 9, 9)


# some cells are not numbers or not finite, as in files with fill values
views.SQL["holed_field"] = """
SELECT * REPLACE (CASE WHEN (day(ts) * 31 + lat_idx * 7 + lon_idx) % 53 = 0 AND day(ts) % 5 = 0 THEN 'NaN'::DOUBLE WHEN (day(ts) * 31 + lat_idx * 7 + lon_idx) % 59 = 0 AND day(ts) % 5 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS value) FROM field"""


def holed(spark, sf):
    place = F.dayofmonth("ts") * 31 + F.col("lat_idx") * 7 + F.col("lon_idx")
    some = F.dayofmonth("ts") % 5 == 0
    value = F.when(some & (place % 53 == 0), F.lit(float("nan"))).when(some & (place % 59 == 0), F.lit(float("inf"))).otherwise(F.col("value"))
    return views.field(spark, sf).withColumn("value", value)


_GOOD = "CASE WHEN isfinite(value) THEN value END"


@query("field_moments", f"""
SELECT variable, {n(f'count({_GOOD}) FILTER (WHERE day(ts) <= 20)', 'cells')}, {r(f'avg({_GOOD}) FILTER (WHERE day(ts) <= 20)', 'mean')},
       {r(f'stddev_pop({_GOOD}) FILTER (WHERE day(ts) <= 20)', 'std')} FROM holed_field GROUP BY 1""")
def _(spark, sf):
    return field.field_moments(holed(spark, sf), F.dayofmonth("ts") <= 20)


_SUMMARY = ", ".join(
    r(f"{fn}(value) FILTER (WHERE variable = '{v}')", f"{v.lower()}_{name}")
    for v in field.VARIABLES for fn, name in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"))
)


@query("spatial_summary", f"SELECT ts, {_SUMMARY} FROM field GROUP BY 1")
def _(spark, sf):
    return field.spatial_summary(views.field(spark, sf))


@query("field_audit", f"""
SELECT variable, {n('count(*)', 'cells')}, {n('count(value)', 'finite')}, {n('count(*) - count(value)', 'missing')}, {r('count(value) / count(*)', 'finite_fraction')},
       {r('min(value)', 'min')}, {r('max(value)', 'max')}, {r('avg(value)', 'mean')}, CASE WHEN variable = 'MSL' THEN min(value) >= 80000 AND max(value) <= 120000 END AS pressure_in_pa
FROM (SELECT variable, {_GOOD} AS value FROM holed_field) GROUP BY 1""")
def _(spark, sf):
    return field.field_audit(holed(spark, sf))


@query("forcing_unit_audit", f"""SELECT variable, 'f' || min(day(ts)) || '.nc' AS source_file, lower(variable) AS name, CASE WHEN variable = 'MSL' THEN 'Pa' ELSE 'm/s' END AS units, {n('1', 'unit_spellings')} FROM field GROUP BY 1""")
def _(spark, sf):
    v = F.col("variable")
    metadata = views.field(spark, sf).select(
        v, F.concat(F.lit("f"), F.dayofmonth("ts").cast("string"), F.lit(".nc")).alias("source_file"), F.lower(v).alias("name"),
        F.when(v == "MSL", F.lit("Pa")).otherwise(F.lit("m/s")).alias("units"),
    )
    return field.forcing_unit_audit(metadata)


@query("inverse_barometer", f"SELECT ts, lat_idx, lon_idx, {r('-(value - 101325) / (1025.0 * 9.80665)', 'height_m')} FROM field WHERE variable = 'MSL'")
def _(spark, sf):
    msl = views.field(spark, sf).where(F.col("variable") == "MSL")
    return msl.select("ts", "lat_idx", "lon_idx", physics.inverse_barometer("value", F.lit(101325.0)).alias("height_m"))


@query("drag_coefficient", f"""
SELECT ts, lat_idx, lon_idx, {r(f'{_CD} * 1000', 'garratt')}, {r(f'{_WU} * 1000', 'wu')} FROM (SELECT *, sqrt(u10 * u10 + v10 * v10) AS sp FROM wide_field)""")
def _(spark, sf):
    wide = align.exact_grid_align(views.field(spark, sf))
    speed = F.hypot("u10", "v10")
    return wide.select(
        "ts", "lat_idx", "lon_idx", (physics.drag_coefficient(speed) * 1000).alias("garratt"),
        (physics.drag_coefficient(speed, "wu") * 1000).alias("wu"),
    )


@query("wind_stress", f"SELECT ts, lat_idx, lon_idx, {r('sp', 'speed')}, {r('cd', 'cd')}, {r('te', 'stress_east')}, {r('tn', 'stress_north')}, {r('tm', 'stress')} FROM stress_field")
def _(spark, sf):
    wide = align.exact_grid_align(views.field(spark, sf))
    parts = physics.wind_stress("u10", "v10")
    return wide.select("ts", "lat_idx", "lon_idx", *[c.alias(k) for k, c in parts.items()])


@query("project_stress", f"""SELECT ts, lat_idx, lon_idx, {r('te * sin(radians(30)) + tn * cos(radians(30))', 'onshore')},
{r('tn * sin(radians(30)) - te * cos(radians(30))', 'alongshore')} FROM stress_field""")
def _(spark, sf):
    wide = align.exact_grid_align(views.field(spark, sf))
    parts = physics.wind_stress("u10", "v10")
    both = physics.project_stress(parts["stress_east"], parts["stress_north"], 30.0)
    return wide.select("ts", "lat_idx", "lon_idx", *[c.alias(k) for k, c in both.items()])


@query("pressure_gradient", f"SELECT ts, lat_idx, lon_idx, {r('ge * 1000', 'east_pa_per_km')}, {r('gn * 1000', 'north_pa_per_km')} FROM gradient_field")
def _(spark, sf):
    out = field.pressure_gradient(align.exact_grid_align(views.field(spark, sf)), placed=True)
    return out.select("ts", "lat_idx", "lon_idx", (F.col("gradient_east") * 1000).alias("east_pa_per_km"), (F.col("gradient_north") * 1000).alias("north_pa_per_km"))


@query("local_gradient", f"""SELECT m.station_id, g.ts, {r('ge * 1000', 'east_pa_per_km')}, {r('gn * 1000', 'north_pa_per_km')}
FROM gradient_field g JOIN site_masks m ON m.at_station AND m.lat_idx = g.lat_idx AND m.lon_idx = g.lon_idx""")
def _(spark, sf):
    grid = stored(_grid(spark, sf), "grid")
    stencil = stored(field.station_stencil(grid, field.station_cells(field.crop_region(grid, sites(spark, sf), 2.0))), "stencil")
    out = field.local_gradient(align.exact_grid_align(views.field(spark, sf)), stencil)
    return out.select("station_id", "ts", (F.col("gradient_east") * 1000).alias("east_pa_per_km"), (F.col("gradient_north") * 1000).alias("north_pa_per_km"))


@query("region_masks", "SELECT station_id, lat_idx, lon_idx, at_station, at_station AS in_station, in_near FROM site_masks")
def _(spark, sf):
    masks = field.region_masks(_site_cells(spark, sf), {"station": 0.0, "near": 1.0})
    return masks.select("station_id", "lat_idx", "lon_idx", "at_station", "in_station", "in_near")


_HOURLY = {
    "pressure_local_pa": "p", "pressure_regional_mean_pa": "pr", "pressure_gradient_east_pa_m": "ge", "pressure_gradient_north_pa_m": "gn",
    "wind_speed_local_ms": "sp", "drag_coefficient_local": "cd", "wind_stress_east_local_pa": "te", "wind_stress_north_local_pa": "tn",
    "wind_stress_magnitude_local_pa": "tm", "near_pressure_mean_pa": "np", "near_pressure_min_pa": "npmin", "near_wind_stress_mean_pa": "nt",
    "near_wind_stress_max_pa": "ntmax", "pressure_anomaly_clim_pa": "pa", "pressure_anomaly_regional_pa": "par", "inverse_barometer_clim_m": "ib",
    "inverse_barometer_regional_m": "ibr", "wind_stress_onshore_local_pa": "ton", "wind_stress_alongshore_local_pa": "tal",
}


@query("hourly_physics", "SELECT station_id, ts, " + ", ".join(r(v, k) for k, v in _HOURLY.items()) + " FROM physics_hourly")
def _(spark, sf):
    return hourly(spark, sf)


_FORCES = {k: v for k, v in _HOURLY.items() if v in ("te", "tn", "tm", "nt", "ntmax", "ton", "tal", "pa", "par")}


def _w(expr: str, first: int, last: int) -> str:
    a = f"{-first} PRECEDING" if first < 0 else ("CURRENT ROW" if first == 0 else f"{first} FOLLOWING")
    b = f"{-last} PRECEDING" if last < 0 else ("CURRENT ROW" if last == 0 else f"{last} FOLLOWING")
    return f"{expr} OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN {a} AND {b})"


_FEATURES = {f"pressure_change_{k}h_pa": f"p - lag(p, {k}) OVER (PARTITION BY station_id ORDER BY ts)" for k in (1, 3, 6)}
_FEATURES |= {f"past_{k}h_integral_{c}_s": _w(f"sum({v})", 1 - k, 0) + " * 3600" for k in (3, 6) for c, v in _FORCES.items()}
_FEATURES |= {f"future_6h_integral_{c}_s": _w(f"sum({v})", 1, 6) + " * 3600" for c, v in _FORCES.items()}
_FEATURES |= {
    "future_6h_positive_onshore_impulse_pa_s": _w("sum(greatest(ton, 0))", 1, 6) + " * 3600",
    "future_6h_negative_onshore_impulse_pa_s": _w("sum(least(ton, 0))", 1, 6) + " * 3600",
    "future_6h_min_pressure_pa": _w("min(p)", 1, 6),
    "future_6h_max_wind_stress_pa": _w("max(tm)", 1, 6),
}
_OFFSETS = {
    "future_6h_min_pressure_offset_h": ("p", "mn"), "future_6h_max_wind_stress_offset_h": ("tm", "mx"),
}
_COALESCED = {
    name: "CASE " + " ".join(f"WHEN lead({v}, {k}) OVER s = {e} THEN {k}" for k in range(1, 7)) + " END" for name, (v, e) in _OFFSETS.items()
}


@query("origin_physics", f"""
WITH axis AS (SELECT station_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM physics_hourly GROUP BY 1),
d AS (SELECT a.station_id, a.ts, h.* EXCLUDE (station_id, ts) FROM axis a LEFT JOIN physics_hourly h ON h.station_id = a.station_id AND h.ts = a.ts),
e AS (SELECT *, {_w('min(p)', 1, 6)} AS mn, {_w('max(tm)', 1, 6)} AS mx FROM d),
f AS (SELECT station_id, ts, p, {_w('count(p + ge + gn + par + np)', 0, 0)} AS own, {_w('count(p)', 1, 6)} AS ahead, {_w('count(p)', -5, 0)} AS past,
             lag(p, 6) OVER s AS before, {', '.join(f'{v} AS {k}' for k, v in _FEATURES.items())}, {', '.join(f'{v} AS {k}' for k, v in _COALESCED.items())}
      FROM e WINDOW s AS (PARTITION BY station_id ORDER BY ts))
SELECT station_id, ts AS origin, {r('p', 'current_pressure_local_pa')}, {', '.join(f'round({k}, 3) + 0.0 AS {k}' for k in _FEATURES)}, {', '.join(n(k, k) for k in _COALESCED)}
FROM f WHERE own = 1 AND ahead = 6 AND past = 6 AND before IS NOT NULL""")
def _(spark, sf):
    out = physics.origin_physics(hourly(spark, sf), 6, (3, 6), strict=False)
    keep = [F.round(c, 3).alias(c) for c in _FEATURES]
    return out.select("station_id", "origin", "current_pressure_local_pa", *keep, *_COALESCED)
