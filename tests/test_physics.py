import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import field, physics

T0 = dt.datetime(2024, 1, 1)


def grid(spark, pressure, lat, lon, wind=None):
    """pressure: (time, lat, lon)."""
    rows = []
    for t in range(pressure.shape[0]):
        for i, a in enumerate(lat):
            for j, o in enumerate(lon):
                u, v = (3.0, 4.0) if wind is None else wind(t, i, j)
                rows.append((T0 + dt.timedelta(hours=t), i, j, float(a), float(o), float(u), float(v), float(pressure[t, i, j])))
    return spark.createDataFrame(rows, "ts timestamp, lat_idx int, lon_idx int, latitude double, longitude double, u10 double, v10 double, msl double")


def test_one_hectopascal_is_about_one_centimetre(spark):
    row = spark.range(1).select(physics.inverse_barometer(F.lit(101225.0), F.lit(101325.0)).alias("h")).first()
    assert row.h == pytest.approx(0.00995, abs=2e-4)


def test_stress_and_projection(spark):
    parts = physics.wind_stress(F.lit(6.0), F.lit(8.0))
    p = physics.project_stress(parts["stress_east"], parts["stress_north"], 90.0)
    row = spark.range(1).select(*[c.alias(k) for k, c in parts.items()], *[c.alias(k) for k, c in p.items()]).first()
    assert row.speed == pytest.approx(10) and row.cd == pytest.approx(1.42e-3)
    assert row.stress == pytest.approx(np.hypot(row.stress_east, row.stress_north))
    assert row.onshore == pytest.approx(row.stress_east) and row.alongshore == pytest.approx(row.stress_north)
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(physics.drag_coefficient(F.lit(-1.0))).collect()


def test_gradient_equals_numpy_on_uneven_axes(spark):
    rng = np.random.default_rng(1)
    lat, lon = np.array([10.0, 10.5, 11.7, 12.0, 14.0]), np.array([358.0, 359.0, 0.5, 1.0])
    p = rng.normal(101_000, 300, (2, 5, 4))
    got = np.zeros((2, 2, 5, 4))
    for r in field.pressure_gradient(grid(spark, p, lat, lon)).collect():
        got[:, r.ts.hour, r.lat_idx, r.lon_idx] = (r.gradient_east, r.gradient_north)
    radius = 6_371_000.0
    north = np.gradient(p, np.deg2rad(lat), axis=-2) / radius
    east = np.gradient(p, np.unwrap(np.deg2rad(lon)), axis=-1) / (radius * np.cos(np.deg2rad(lat))[None, :, None])
    assert np.allclose(got[0], east, rtol=1e-9) and np.allclose(got[1], north, rtol=1e-9)


def test_gradient_does_not_depend_on_latitude_order_or_longitude_convention(spark):
    lat, lon = np.array([10.0, 11.0, 12.0]), np.array([-61.0, -60.0, -59.0])
    plane = np.array([[[5.0 * a + 7.0 * o for o in lon] for a in lat]])

    def at_centre(df):
        r = field.pressure_gradient(df).where((F.col("lat_idx") == 1) & (F.col("lon_idx") == 1)).first()
        return r.gradient_east, r.gradient_north

    a = at_centre(grid(spark, plane, lat, lon))
    b = at_centre(grid(spark, plane[:, ::-1], lat[::-1], lon + 360))
    assert a == pytest.approx(b, rel=1e-9)
    assert a[1] == pytest.approx(5.0 / (np.deg2rad(1) * 6_371_000), rel=1e-9)
    with pytest.raises(Exception, match="unique"):
        field.pressure_gradient(grid(spark, plane, np.array([10.0, 10.0, 12.0]), lon)).collect()


def stations(spark):
    return spark.createDataFrame([("st", 11.1, -60.1)], "station_id string, lat double, lon double")


def test_region_masks(spark):
    cells = grid(spark, np.zeros((1, 3, 3)), [10, 11, 12], [-61, -60, -59]).select("lat_idx", "lon_idx", "latitude", "longitude")
    masks = field.region_masks(field.crop_region(cells, stations(spark), 5.0), {"station": 0.0, "near": 1.0})
    rows = masks.collect()
    assert [(r.lat_idx, r.lon_idx) for r in rows if r.in_station] == [(1, 1)]
    assert sorted((r.lat_idx, r.lon_idx) for r in rows if r.in_near) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_crop_meets_across_the_date_line(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 179.5), (0, 1, 0.0, -179.8), (0, 2, 0.0, 170.0)], "lat_idx int, lon_idx int, latitude double, longitude double")
    st = spark.createDataFrame([("x", 0.2, -179.9)], "station_id string, lat double, lon double")
    for half in (1.0, 0.7, 50.0):
        got = sorted(r.lon_idx for r in field.crop_region(cells, st, half).collect())
        assert got == ([0, 1, 2] if half == 50.0 else [0, 1])
    assert field.crop_region(cells, st, 1.0, strict=True).count() == 2
    far = st.unionByName(spark.createDataFrame([("far", 60.0, 0.0)], st.schema))
    with pytest.raises(Exception, match="no field cell near station far"):
        field.crop_region(cells, far, 1.0, strict=True).collect()


def hourly_from(spark, pressure, training_hours):
    df = grid(spark, pressure, [10, 11, 12], [-61, -60, -59])
    cells = field.crop_region(df.select("lat_idx", "lon_idx", "latitude", "longitude").distinct(), stations(spark), 5.0)
    return physics.hourly_physics(df, cells, F.hour("ts") < training_hours, {"station": 0.0, "regional": 5.0}, bearing_deg=45.0)


def test_climatology_ignores_hours_outside_training(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(101_000, 200, (12, 3, 3))
    q = p.copy()
    q[8:] += 5_000
    a = {r.ts: r for r in hourly_from(spark, p, 8).collect()}
    b = {r.ts: r for r in hourly_from(spark, q, 8).collect()}
    early = [t for t in a if t.hour < 8]
    assert all(a[t].pressure_anomaly_clim_pa == pytest.approx(b[t].pressure_anomaly_clim_pa) for t in early)
    assert a[T0].pressure_anomaly_clim_pa == pytest.approx(p[0, 1, 1] - p[:8, 1, 1].mean())
    assert a[T0].regional_pressure_min_pa == pytest.approx(p[0].min())


def test_origin_features_stop_at_the_lead(spark, hours):
    def made(late):
        rng = np.random.default_rng(3)
        values = rng.normal(0, 1, (80, 4))
        if late:
            values[37:55] += 50
        rows = [("st", T0 + dt.timedelta(hours=i), 101_000 + float(v[0]), float(v[1]), float(v[2]), abs(float(v[3]))) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "station_id string, ts timestamp, pressure_local_pa double, wind_stress_east_local_pa double, wind_stress_north_local_pa double, wind_stress_magnitude_local_pa double")
        out = physics.origin_physics(df, 6, strict=False, forces=[c for c in df.columns if c.startswith("wind_stress")])
        return {r.origin: r.asDict() for r in out.collect()}, values

    a, values = made(False)
    b, _ = made(True)
    t = T0 + dt.timedelta(hours=30)
    assert a[t] == b[t] and a[t + dt.timedelta(hours=1)] != b[t + dt.timedelta(hours=1)]
    assert a[t]["future_6h_integral_wind_stress_east_local_pa_s"] == pytest.approx(values[31:37, 1].sum() * 3600)
    assert a[t]["past_24h_integral_wind_stress_east_local_pa_s"] == pytest.approx(values[7:31, 1].sum() * 3600)
    assert a[t]["future_6h_min_pressure_offset_h"] == np.argmin(values[31:37, 0]) + 1


def test_regrid_keeps_a_plane(spark):
    rows = [(T0, "MSL", i, j, 10.0 + a, 20.0 + o, 3 * a + 2 * o) for i, a in enumerate((0.0, 1.0, 4.0)) for j, o in enumerate((0.0, 2.0, 3.0))]
    df = spark.createDataFrame(rows, "ts timestamp, variable string, lat_idx int, lon_idx int, latitude double, longitude double, value double")
    out = field.regrid_bilinear(df, 40, 40).collect()
    assert len(out) == 1600
    assert all(r.value == pytest.approx(3 * (r.latitude - 10) + 2 * (r.longitude - 20), abs=1e-9) for r in out)
