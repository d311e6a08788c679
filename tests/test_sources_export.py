import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewright.functions.columns import clean_text, inverse_normal, safe_key
from tidewright.operators import export
from tidewright.sources import files, gauge, results, tracks


def test_text_records(spark, tmp_path):
    (tmp_path / "alpha.txt").write_text(
        "# header\n2011/01/01 00:00 1.2 0 1 s1\n2011-1-1,01:00,9.99,3,0\n2011-01-01 x 5.5\nbad line here\n2011-01-01 02:00 none\n"
    )
    got = sorted(gauge.read_records(spark, str(tmp_path)).collect(), key=lambda r: r.seq)
    assert [(r.station_id, r.ts, r.water_level, r.qc_flag, r.sensor) for r in got] == [
        ("alpha", dt.datetime(2011, 1, 1), 1.2, "0", "s1"), ("alpha", dt.datetime(2011, 1, 1, 1), 9.99, "3", "default"),
        ("alpha", dt.datetime(2011, 1, 1), 5.5, None, "default"),
    ]


def test_flexible_records(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# x\n2011 1 2 3 4 1.5 0 1\n20110102 0304 1.6 2\n2011 1 2 3 99.5\n2011-01-02 03:04:05 1.7\nname: pier\n")
    got = sorted(gauge.read_records_flexible(spark, str(tmp_path)).collect(), key=lambda r: r.seq)
    assert [(r.ts, r.water_level, r.qc_flag, r.use_flag) for r in got] == [
        (dt.datetime(2011, 1, 2, 3, 4), 1.5, 0.0, 1.0), (dt.datetime(2011, 1, 2, 3, 4), 1.6, 2.0, None),
        (dt.datetime(2011, 1, 2, 3), 99.5, None, None), (dt.datetime(2011, 1, 2, 3, 4, 5), 1.7, None, None),
    ]


def test_table_by_alias(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# note\ntimestamp,sea_level,quality,valid,channel\n2011-01-01 00:00,125,0,1,A\n")
    row = gauge.read_table(spark, str(tmp_path / "t.csv")).first()
    assert row.ts == dt.datetime(2011, 1, 1) and row.water_level == 125.0 and (row.qc_flag, row.use_flag, row.sensor) == ("0", "1", "A")
    with pytest.raises(ValueError):
        gauge.resolve_columns(["when", "level"])


def test_inventory_and_periods(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("u10_2011.nc", "._u10_2011.nc", "a120115.nc", "sub/GESLA_pier.txt"):
        (tmp_path / name).write_text("x" * 10)
    listing = files.list_files(spark, str(tmp_path))
    periods = {r.file_name: r.period for r in files.group_files_by_year(listing).collect()}
    assert periods == {"u10_2011.nc": "2011", "a120115.nc": "a120115"}
    got = {r.file_name: (r.possible_source, r.possible_station, r.possible_year) for r in files.file_inventory(listing, {"pier": "Pier"}).collect()}
    assert got["GESLA_pier.txt"] == ("GESLA station file", "Pier", "") and "._u10_2011.nc" not in got and got["u10_2011.nc"][2] == "2011"


def test_grid_errors(spark):
    with pytest.raises(ValueError, match="more than once"):
        files.canonical_grid(spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "time int, lat double, lon double, u10 double, `10u` double, v10 double, msl double"))
    with pytest.raises(ValueError, match="MSL"):
        files.canonical_grid(spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0)], "time int, lat double, lon double, u10 double, v10 double"))


def test_registry(spark):
    ok = spark.createDataFrame([("a", "A", 10.0)], "station_id string, station_name string, latitude double")
    assert files.station_registry(ok).first().timezone is None
    with pytest.raises(ValueError, match="unknown"):
        files.station_registry(ok.withColumn("colour", F.lit("red")))
    with pytest.raises(Exception, match="lacks required"):
        files.station_registry(ok.withColumn("station_name", F.lit(" "))).collect()


def test_jsonp_and_short_rows(spark):
    texts = ['cb_1((\n{"typhoonList":[[1,"A"],[]]}\n));', '{"typhoonList":[[2,"B","乙"]]}', "broken("]
    got = tracks.typhoon_list(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert sorted((r.typhoon_id or "", r.en_name, r.cn_name) for r in got) == [("", None, None), ("1", "A", None), ("2", "B", "乙")]


def test_flatten_takes_the_longest_list(spark):
    df = spark.createDataFrame([([{"a": 1, "b": []}, {"a": 2, "b": [{"c": 5}]}],), ([{"a": 3, "b": None}] * 11,), (None,)], "rows array<struct<a:int,b:array<struct<c:int>>>>")
    flat = tracks.flatten_json(df)
    assert flat.columns[:3] == ["rows.0.a", "rows.1.a", "rows.1.b.0.c"] and flat.columns[-1] == "rows.10.a" and flat.count() == 3
    assert tracks.flatten_json(df.limit(0)).columns == []


def test_find_records(spark):
    df = spark.createDataFrame([(([1], [5, 6]),)], "records struct<other:array<int>,Station:array<int>>")
    assert [r.record for r in tracks.find_records(df).collect()] == [5, 6]


def test_legacy_encoded_codes(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("序号,站码,时间,潮位\n1, 6348 ,2020-01-01 00:00,1.5\n2,6348,2020-01-01 01:00,无\n3,,2020-01-01 02:00,9\n4,6348\n".encode("gbk"))
    row = tracks.code_summary(tracks.read_code_table(spark, str(tmp_path / "c.csv"))).collect()
    assert len(row) == 1 and (row[0].station_code, row[0].rows, row[0].min_tide, row[0].max_tide) == ("6348", 2, 1.5, 1.5)


def test_experiment_results(spark, tmp_path):
    a = tmp_path / "x_t24_cnn_gru"
    b = tmp_path / "rolling_t8_n6"
    a.mkdir(), b.mkdir(), (tmp_path / "other").mkdir()
    (a / "metrics.json").write_text(json.dumps({"rmse": 0.05, "r": 0.9, "mae_cm": 3.0, "rrmse": 0.2}, indent=1))
    (b / "rolling_forecast.csv").write_text("lead\n1\n")
    (tmp_path / "other" / "notes.txt").write_text("x")
    rows = {r.run: r for r in results.read_experiment_results(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x_t24_cnn_gru", "rolling_t8_n6"}
    x, y = rows["x_t24_cnn_gru"], rows["rolling_t8_n6"]
    assert (x.input_steps, x.model_name, x.is_rolling) == (24, "cnn_gru", False) and x.rmse == pytest.approx(5.0) and x.rrmse == pytest.approx(20.0)
    assert (y.input_steps, y.forecast_steps, y.is_rolling, y.rmse) == (8, 6, True, None)


def test_derived_table(spark, tmp_path):
    (tmp_path / "acf.csv").write_text("station,lag_hours,acf\na,1,0.9\nb,1,0.8\n")
    got = results.read_derived_table(spark, str(tmp_path / "acf.csv"), "station string, lag_hours int, acf double", "b").collect()
    assert [tuple(r) for r in got] == [(1, 0.8)]


def test_text_helpers(spark):
    df = spark.createDataFrame([(" ＡＢ１ ",), (None,), ("plain ",), ('a<b>:"/c. ',)], "t string")
    rows = df.select(clean_text("t").alias("c"), safe_key("t").alias("k")).collect()
    assert [r.c for r in rows][:3] == ["AB1", "", "plain"] and rows[3].k == "a_b____c" and rows[1].k == "unnamed"


def test_inverse_normal(spark):
    from statistics import NormalDist

    p = [0.0001, 0.01, 0.02425, 0.3, 0.5, 0.77, 0.98, 0.9999]
    got = spark.createDataFrame([(v,) for v in p], "p double").select(inverse_normal("p").alias("z")).collect()
    assert [r.z for r in got] == pytest.approx([NormalDist().inv_cdf(v) for v in p], abs=1e-7)


def test_export_layouts_manifest_and_refusal(spark, tmp_path):
    df = spark.range(5_000).select(
        F.col("id").alias("reported_at"), F.when(F.col("id") % 10 < 7, F.lit("ti/de")).otherwise(F.lit(None).cast("string")).alias("kind"), F.col("id").alias("v")
    )
    root = str(tmp_path / "out")
    export.refuse_overwrite(spark, root)
    table = export.export_event(spark, df, root, {"by_kind": ["kind"]}, max_rows=400)
    counts = {r.category: (r.rows, r.most) for r in table.groupBy("category").agg(F.sum("rows").alias("rows"), F.max("rows").alias("most")).collect()}
    assert counts["all_rows"][0] == counts["by_kind"][0] == 5_000 and counts["by_kind"][1] <= 400
    assert sorted(p.name for p in (tmp_path / "out" / "by_kind").iterdir() if p.is_dir()) == ["by_kind=ti_de", "by_kind=unnamed"]
    with pytest.raises(FileExistsError):
        export.refuse_overwrite(spark, root)
    with pytest.raises(Exception, match="(?i)exists"):
        export.export_partitioned(df, f"{root}/by_kind", ["kind"])
    export.write_report_tables({"scores": df.limit(3)}, f"{root}/report")
    assert spark.read.json(f"{root}/report/scores_json").count() == 3


@pytest.mark.parametrize("by", [["kind"], []])
def test_small_files_of_one_value_are_written_by_several_tasks(spark, tmp_path, by):
    rows = spark.range(5_000).select(
        F.when(F.col("id") % 50 > 0, F.lit("tide")).alias("kind"), F.col("id").alias("reported_at"),
        F.create_map(F.lit("v"), F.col("id")).alias("more")
    )
    path = str(tmp_path / "out")
    export.export_partitioned(rows, path, by, ["reported_at"], max_rows=10)
    back = spark.read.parquet(path)
    files = export.manifest(back, "all").collect()
    assert back.select("reported_at").distinct().count() == back.count() == 5_000 and back.where("more['v'] = reported_at").count() == 5_000
    assert max(f.rows for f in files) <= 10 and len(files) <= 520
    tasks = [f.file.rsplit("/", 1)[1].split("-")[1] for f in files]
    assert len(set(tasks)) >= 3 and max(map(tasks.count, tasks)) <= 260


def test_small_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "out")
    export.export_partitioned(spark.range(0).selectExpr("cast(id as string) AS kind", "id"), path, ["kind"], max_rows=10)
    assert not list((tmp_path / "out").rglob("*.parquet"))
