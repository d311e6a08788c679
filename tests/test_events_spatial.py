import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import compare, events, snapshots, spatial

T0 = dt.datetime(2024, 1, 1)


def greedy(scores, count, separation):
    order = sorted(scores, key=lambda h: (-scores[h], -h))
    picked = []
    for h in order:
        if all(abs(h - p) >= separation for p in picked):
            picked.append(h)
        if len(picked) == count:
            break
    return picked


@pytest.mark.parametrize(("count", "separation"), [(10, 24), (3, 72), (4, 1), (6, 5)])
def test_selection_equals_the_greedy_rule(spark, hours, count, separation):
    rng = random.Random(count)
    walks = {}
    for name in ("smooth", "ties"):
        v, out = 0.0, []
        for _ in range(900):
            v = 0.98 * v + rng.gauss(0, 1)
            out.append(... if rng.random() < 0.05 else (round(v) if name == "ties" else v))
        walks[name] = out
    df = hours(walks, value="score")
    got = {}
    for r in events.select_events(df, "score", count, separation).collect():
        got.setdefault(r.station_id, []).append((r.event, (r.ts - T0).total_seconds() / 3600))
    for name, values in walks.items():
        want = greedy({h: v for h, v in enumerate(values) if v is not ...}, count, separation)
        assert [h for _, h in sorted(got[name])] == want


def test_peak_table(spark, hours):
    observed = [0.0] * 60
    observed[20], observed[50] = 2.0, -3.0
    predicted = [0.0] * 60
    predicted[22], predicted[20], predicted[50] = 1.9, 1.0, -3.5
    a = hours({"st": observed}, value="observed_m")
    b = hours({"st": predicted}, value="predicted_m")
    table = events.peak_event_table(a.join(b, ["station_id", "ts"]), 2)
    rows = {r.event: r for r in table.collect()}
    assert rows[1].observed_peak_m == -3.0 and rows[1].timing_error_hours == 0 and not rows[1].underestimated
    assert rows[2].timing_error_hours == 2 and rows[2].peak_error_cm == pytest.approx(-100) and rows[2].underestimated
    summary = events.peak_event_summary(table).first()
    assert summary.event_count == 2 and summary.maximum_observed_m == -3.0 and summary.mean_absolute_timing_error_hours == 1


def haversine(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(x))


@pytest.mark.parametrize("max_km", [30.0, 400.0, 3000.0, 25_000.0])
def test_nearest_point_equals_brute_force_over_the_globe(spark, max_km):
    rng = random.Random(int(max_km))
    sites = [(f"s{i}", rng.uniform(-89.5, 89.5), rng.uniform(-180, 180), "p") for i in range(60)]
    sites += [("pole", 89.9, 10.0, "p"), ("seam", 0.0, 179.95, "p")]
    path = [(i, rng.uniform(-89.5, 89.5), rng.uniform(-180, 360)) for i in range(80)] + [(80, 0.01, -179.98), (81, 0.01, -179.98)]
    got = spatial.station_path_nearest(
        spark.createDataFrame(sites, "station_id string, lat double, lon double, province string"),
        spark.createDataFrame(path, "lead_hour int, lat double, lon double"), max_km,
    ).collect()
    want = {}
    for name, lat, lon, _ in sites:
        km, lead = min((haversine(lat, lon, b, c), i) for i, b, c in path)
        if km <= max_km:
            want[name] = (lead, round(km, 1))
    assert {r.station_id: (r.lead_hour, r.min_distance_km) for r in got} == want


def test_nearest_limit_and_province(spark):
    sites = spark.createDataFrame([("a", 10.0, 20.0, "north"), ("b", 10.2, 20.0, "south"), ("c", 10.1, 20.0, "north")], "station_id string, lat double, lon double, province string")
    path = spark.createDataFrame([(0, 10.0, 20.0)], "lead_hour int, lat double, lon double")
    got = spatial.station_path_nearest(sites, path, 100.0, limit=1, provinces=["nor"]).collect()
    assert [r.station_id for r in got] == ["a"]


def test_hour_specs(spark):
    df = spark.createDataFrame([("g", "0-3"), ("g", "2"), ("g", "30")], "k string, spec string")
    assert sorted(r.hour for r in spatial.expand_hours(df, "spec").collect()) == [0, 1, 2, 3, 30]


def test_type_lookup_modes_and_last_wins(spark):
    rows = spark.createDataFrame([("ａ ", "b", "c", "river"), ("x", "b", "c", "river"), ("y", "b", "c", "odd")], "city string, city_county string, station_name string, station_type string")
    mapping = spark.createDataFrame([("a", "b", "c", "gate", 1), ("a", "b", "c", "tide", 2), ("y", "b", "c", "nonsense", 3)], "city string, city_county string, station_name string, station_type string, seq int")
    types = snapshots.station_types(mapping, "seq")
    stored = {r.city: r.station_type for r in snapshots.type_lookup(rows, types).collect()}
    only = {r.city: r.station_type for r in snapshots.type_lookup(rows, types, keep_stored=False).collect()}
    assert stored == {"a": "tide", "x": "river", "y": "unknown"} and only == {"a": "tide", "x": "unknown", "y": "unknown"}


def test_metric_table_skills(spark):
    rows = []
    for station in ("a", "b"):
        for lead in (1, 6, 24):
            for model, rmse in (("persistence", 4.0), ("ridge", 2.0), ("deep", 3.0), ("tuned", 2.5)):
                rows.append((station, lead, model, 100, rmse, rmse, 1.0, 5, rmse * 2, 2.0, 6))
    table = spark.createDataFrame(rows, "station_id string, lead_hours long, model string, n long, rmse_cm double, top5_rmse_cm double, top5_threshold_cm double, top5_n long, rapid_rise_rmse_cm double, rapid_rise_threshold_cm_per_hour double, rapid_rise_n long")
    skills = {(r.model, r.lead_hours): r for r in compare.skill_vs(table, "persistence").where("station_id = 'a'").collect()}
    assert skills["ridge", 6].skill_rmse == 0.5 and skills["ridge", 6].skill_mse == 0.75 and skills["ridge", 6].gain_percent == 50
    extreme = compare.extreme_compare(table, "persistence").where("condition = 'rapid_rise' AND model = 'ridge' AND station_id = 'b'").collect()
    assert len(extreme) == 3 and all(r.rank_by_rmse == 1 and r.skill_rmse == 0.5 and r.n == 6 for r in extreme)
    assert compare.best_by_lead(table).first().best_model == "ridge"
    gain = compare.rollout_gain(table, "deep", "tuned").first()
    assert gain.gain_percent == pytest.approx(100 * (1 - 2.5 / 3))
    kinds = {"p": ["pressure"], "ib": ["pressure"], "speed": ["wind"], "stress": ["wind", "force"], "ts": []}
    named = table.select(*(F.lit(1).alias(c, metadata={"terms": t} if t else {}) for c, t in kinds.items()))
    assert compare.column_groups(named.schema) == {"ib": ["p", "ib"], "wind": ["speed", "stress"], "all": ["p", "ib", "speed", "stress"]}


def test_nearest_sites_equal_brute_force_on_the_globe(spark):
    rng = random.Random(5)

    sites = [(f"s{i}", float(rng.uniform(-89, 89)), float(rng.uniform(-180, 180))) for i in range(40)] + [("twin", 10.0, 179.9), ("none", None, 3.0)]
    path = [(f"t{k}", 6 * j, float(rng.uniform(-85, 85)), float(rng.uniform(-180, 180))) for k in range(6) for j in range(5)] + [("t9", 0, 10.0, -179.9)]

    def km(a, b, c, d):
        half = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(half)))

    want = []
    for storm in sorted({p[0] for p in path}):
        best = [(*min((km(lat, lon, p[2], p[3]), p[1]) for p in path if p[0] == storm), s) for s, lat, lon in sites if lat is not None]
        want += [(storm, s, lead, round(d, 1)) for d, lead, s in sorted(best, key=lambda x: (round(x[0], 1), x[2]))[:7]]
    a = spark.createDataFrame(sites, "station_id string, lat double, lon double")
    b = spark.createDataFrame(path, "storm_id string, lead_hour int, lat double, lon double")
    got = spatial.nearest_sites(a, b, 7)
    assert sorted((r.storm_id, r.station_id, r.lead_hour, r.min_distance_km) for r in got.collect()) == sorted(want)
    near = spatial.nearest_sites(a, b, 7, max_km=900.0)
    assert sorted((r.storm_id, r.station_id) for r in near.collect()) == sorted((w[0], w[1]) for w in want if w[3] <= 900.0)
    assert spatial.nearest_sites(a, b, 100).count() == 41 * 7


def test_nearest_sites_join_few_positions_and_keep_ties(spark, monkeypatch):
    sites = [(f"s{i:02}", 10.0 + 0.25 * i, 5.0) for i in range(40)] + [("a1", 9.75, 5.0), ("a0", 10.25, 5.0), ("z", 9.75, 5.0)]
    a = spark.createDataFrame(sites, "station_id string, lat double, lon double")
    b = spark.createDataFrame([("t", 0, 10.0, 5.0)], "storm_id string, lead_hour int, lat double, lon double")
    joined, best = [], spatial._nearest_within

    def ranked(*args, **more):
        return best(*args, **more).transform(lambda df: (joined.append(df.count()), df)[1])

    written = []
    monkeypatch.setattr(spatial, "_nearest_within", ranked)
    store = spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, name, out=False: (written.append(name), store(df, name, out))[1])
    got = [(r.station_id, r.min_distance_km) for r in spatial.nearest_sites(a, b, 3).orderBy("min_distance_km", "station_id").collect()]
    assert got == [("s00", 0.0), ("a0", 27.8), ("a1", 27.8)]
    assert written.count("points") == 1 and "sites" in written and "unsettled" in written  # one ring settles the storm
    assert len(joined) == 1
