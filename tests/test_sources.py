import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from finescale.functions.time import to_utc
from finescale.operators import tables as T
from finescale.sources import inventory as I
from finescale.sources import readers as R
from finescale.sources import writers as W
from tests.helpers import at, column, rows


def test_observations_take_the_station_from_the_file_name(spark, tmp_path):
    (tmp_path / "007_a_202001.csv").write_text("dt_regis,md_valor,md_final\n2020-01-01 00:00:00,10.5,4\n2020-01-01 01:00:00,bad,9\n")
    (tmp_path / "12_202002.csv").write_text("dt_regis,md_valor,md_final\n2020-02-01 00:00:00,11,5\n")
    out = R.read_observations(spark, str(tmp_path))
    assert rows(out, "station", "ts") == [("007_a", datetime(2020, 1, 1), "10.5", "4"), ("007_a", datetime(2020, 1, 1, 1), "bad", "9"),
                                          ("12", datetime(2020, 2, 1), "11", "5")]
    assert rows(out.select(to_utc("ts").alias("u")), "u")[0] == (datetime(2020, 1, 1, 3),)
    found = I.months_of_files(spark, str(tmp_path))
    assert rows(found, "mes") == [(2020, 1), (2020, 2)]


def test_observations_by_header_name(spark, tmp_path):
    (tmp_path / "a_1_202001.csv").write_text('extra,md_final,"dt_regis",md_valor\nx,4,2020-01-01 00:00:00,10.5\ny,,2020-01-01 01:00:00,"7"\n')
    (tmp_path / "b.csv").write_text("\ufeffdt_regis,md_valor,md_final\r\n2020-01-02 00:00:00,1,5\r\n", encoding="utf-8", newline="")
    assert rows(R.read_observations(spark, str(tmp_path)), "station", "ts") == [
        ("a_1", datetime(2020, 1, 1), "10.5", "4"), ("a_1", datetime(2020, 1, 1, 1), "7", None), ("b", datetime(2020, 1, 2), "1", "5")]


def test_quoted_fields_keep_separators_and_quotes(spark, tmp_path):
    (tmp_path / "a_1_202001.csv").write_text('dt_regis,nota,md_valor,md_final\n2020-01-01 00:00:00,"a, b",21.5,4\n2020-01-01 01:00:00,"say ""x, y""", 7 ,\n')
    (tmp_path / "a_1_202002.csv").write_text('md_final,md_valor,dt_regis\n5,"1,5",2020-02-01 00:00:00\n9\n')
    assert rows(R.read_observations(spark, str(tmp_path)), "md_final") == [
        ("a_1", datetime(2020, 1, 1, 1), "7", None), ("a_1", datetime(2020, 1, 1), "21.5", "4"), ("a_1", datetime(2020, 2, 1), "1,5", "5"), ("a_1", None, None, "9")]


def test_other_separators(spark, tmp_path):
    (tmp_path / "m.csv").write_text('Latitude;Estacao;Altitude;Longitude\n-27;"0;1";10;-50\n')
    assert rows(R.read_station_meta(spark, str(tmp_path / "m.csv"), sep=";")) == [("0;1", 10.0, -50.0, -27.0)]


def test_months_without_a_row_are_reported(spark):
    hours = [(s, datetime(2020, m, d, h)) for s, m in (("a", 1), ("a", 3), ("b", 2)) for d in range(1, {1: 32, 2: 30, 3: 32}[m]) for h in range(24)]
    df = spark.createDataFrame(hours, "station STRING, ts TIMESTAMP_NTZ")
    assert rows(I.axis_problems(df, ["station"]).drop("extra")) == [("a", datetime(2020, 2, 1), 0, 696, 696)]
    assert rows(I.axis_problems(df, ["station"], span=("2020-01-15", "2020-03-02")).select("station", "month"), "station", "month") == [
        ("a", datetime(2020, 2, 1)), ("b", datetime(2020, 1, 1)), ("b", datetime(2020, 3, 1))]
    assert I.axis_problems(df.filter("station = 'b'")).isEmpty()
    assert rows(I.axis_problems(df).select("month")) == []
    with pytest.raises(ValueError):
        I.check_hourly_axis(df, span=("2020-01-01", "2020-04-01"))


def test_observations_without_a_column_fail(spark, tmp_path):
    (tmp_path / "1_202001.csv").write_text("dt_regis,valor,md_final\n2020-01-01 00:00:00,10.5,4\n")
    with pytest.raises(Exception):
        R.read_observations(spark, str(tmp_path)).collect()


def test_metadata_keeps_the_first_of_duplicates(spark, tmp_path):
    f = tmp_path / "meta.csv"
    f.write_text("Estacao,Altitude,Longitude,Latitude\n01,10,-50.1,-27\n01,99,-50.1,-27\n02,x,-49,-26\n")
    assert rows(R.read_station_meta(spark, str(f)), "station") == [("01", 10.0, -50.1, -27.0), ("02", None, -49.0, -26.0)]


def test_class_map(spark, tmp_path):
    f = tmp_path / "map.csv"
    f.write_text("code;grupo\n3;T1\n4;T1\n27;NA\n9;T2\n")
    assert rows(R.codes_per_group(R.read_class_map(spark, str(f))), "grupo") == [("T1", [3, 4]), ("T2", [9])]


def test_json_records(spark, tmp_path):
    lz = tmp_path / "lz.json"
    lz.write_text(json.dumps({"metodo": "idw", "lz_por_hora": {str(h): 100.0 * h for h in range(24)}}, indent=1))
    assert rows(R.read_lz_by_hour(spark, str(lz)), "hora")[23] == (23, 2300.0)
    table = spark.createDataFrame([(h, 50.0 * h) for h in range(24)], "hora INT, lz_m DOUBLE")
    W.write_lz_by_hour(table, str(tmp_path / "written"))
    assert rows(R.read_lz_by_hour(spark, str(tmp_path / "written")), "hora") == rows(table, "hora")
    meta = tmp_path / "meta.json"
    meta.write_text(json.dumps({"features": ["a", "b"], "lapse_rate": 0.0065, "corte": {"var": "t2m_1km", "t_lo_K": 280.0, "t_hi_K": 295.0},
                                "ramos": {"frio": {"modelo": "m", "saida_var": "t2m_p16"}}}, indent=1))
    r = R.read_model_meta(spark, str(meta)).first()
    assert r["features"] == ["a", "b"] and r["corte"]["t_hi_K"] == 295.0 and r["ramos"]["frio"]["saida_var"] == "t2m_p16"


DAYS = [datetime(2026, 1, d) for d in range(1, 6)]


def test_replace_window(spark):
    old = spark.createDataFrame([(d, i) for i, d in enumerate(DAYS)], "data_hora_utc TIMESTAMP_NTZ, v INT")
    new = spark.createDataFrame([(datetime(2026, 1, 2, 12), 99)], "data_hora_utc TIMESTAMP_NTZ, v INT")
    out = T.replace_window(old, new, datetime(2026, 1, 2), datetime(2026, 1, 4))
    assert column(out, "v", "data_hora_utc") == [0, 99, 3, 4]
    assert column(T.replace_window(old, new, None, datetime(2026, 1, 4)), "v", "data_hora_utc") == [99, 3, 4]


def test_replace_window_at_rest_touches_only_its_months(spark, tmp_path):
    path = str(tmp_path / "obs")
    stamps = [datetime(2026, 1, 5), datetime(2026, 2, 3), datetime(2026, 2, 20), datetime(2026, 3, 1)]
    old = spark.createDataFrame([("a", d, i) for i, d in enumerate(stamps)], "station STRING, data_hora_utc TIMESTAMP_NTZ, v INT")
    W.write_observations(old, path)
    january = os.listdir(os.path.join(path, "year=2026", "month=1"))
    new = spark.createDataFrame([("a", datetime(2026, 2, 4), 9)], "station STRING, data_hora_utc TIMESTAMP_NTZ, v INT")
    W.overwrite_window(new, path, datetime(2026, 2, 1), datetime(2026, 2, 10))
    assert column(spark.read.parquet(path), "v", "data_hora_utc") == [0, 9, 2, 3]
    assert os.listdir(os.path.join(path, "year=2026", "month=1")) == january
    W.overwrite_window(new.limit(0), path, datetime(2026, 2, 1), datetime(2026, 3, 1))
    assert column(spark.read.parquet(path), "v", "data_hora_utc") == [0, 3]
    assert not [f for f in os.listdir(tmp_path) if "staged" in f]
    for start, end in ((datetime(2026, 2, 5), None), (None, datetime(2026, 2, 1)), (datetime(2026, 2, 1), datetime(2026, 2, 4))):
        with pytest.raises(ValueError):
            W.overwrite_window(new, path, start, end)
    with pytest.raises(ValueError):
        W.overwrite_window(new.withColumn("data_hora_utc", F.lit(None).cast("timestamp_ntz")), path, None, None)
    assert column(spark.read.parquet(path), "v", "data_hora_utc") == [0, 3]
    late = spark.createDataFrame([("a", datetime(2026, 4, 1), 7)], "station STRING, data_hora_utc TIMESTAMP_NTZ, v INT")
    W.overwrite_window(late, path, datetime(2026, 3, 15), None)
    assert column(spark.read.parquet(path), "v", "data_hora_utc") == [0, 3, 7]
    W.overwrite_window(late.limit(0), path, None, datetime(2026, 1, 31))
    assert column(spark.read.parquet(path), "v", "data_hora_utc") == [3, 7]
    assert not [f for f in os.listdir(tmp_path) if "staged" in f]
    span = R.load_span(spark, path, date(2026, 2, 1), date(2026, 3, 31))
    assert column(span, "v") == [3]
    assert "PartitionFilters: [" in span._jdf.queryExecution().toString()


def test_axis_check(spark):
    whole = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2021-02-01 00:00:00', TIMESTAMP_NTZ'2021-02-28 23:00:00', INTERVAL 1 HOUR)) AS ts")
    assert I.check_hourly_axis(whole) is whole
    with pytest.raises(ValueError):
        I.check_hourly_axis(whole.filter("ts <> TIMESTAMP_NTZ'2021-02-10 05:00:00'"))
    with pytest.raises(ValueError):
        I.check_hourly_axis(whole.withColumn("ts", F.col("ts") + F.expr("INTERVAL '30' MINUTE")))
    with pytest.raises(ValueError):
        I.check_hourly_axis(whole.unionByName(whole.limit(1)))


def test_field_and_matrix_sinks(spark, tmp_path):
    f = spark.createDataFrame([(0, 0, at(0), 1.0, 2.0, -1.0), (40, 3, at(20), 5.0, 5.0, 0.0)],
                              "iy INT, ix INT, ts TIMESTAMP_NTZ, T_final DOUBLE, T_final_bc DOUBLE, T_final_oi DOUBLE")
    grid = spark.createDataFrame([(0, 0, -50.0, -27.0), (40, 3, -49.0, -26.0)], "iy INT, ix INT, lon DOUBLE, lat DOUBLE")
    W.write_field(W.field_columns(f, grid), str(tmp_path / "field"))
    back = spark.read.parquet(str(tmp_path / "field"))
    assert dict(back.dtypes)["T_final"] == "float" and dict(back.dtypes)["lat"] == "double"
    assert rows(back.select("month", "T_final", "lon"), "month") == [(1, 1.0, -50.0), (2, 5.0, -49.0)]
    m = spark.range(50).selectExpr("concat(id % 5, '_0') AS cell_id", "TIMESTAMP_NTZ'2020-01-01' + make_dt_interval(0, CAST(id AS INT)) AS ts", "CAST(id AS DOUBLE) AS v")
    W.write_matrix(m, str(tmp_path / "m"), partitions=3)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 50


def test_station_lists_and_excluded(spark, tmp_path):
    obs = spark.createDataFrame([("a", 1.0), ("b", None), ("a", 1.0)], "station STRING, latitude DOUBLE")
    W.write_station_lists(obs, str(tmp_path))
    read = lambda n: column(R.read_semicolon_csv(spark, str(tmp_path / n), "codigo_estacao STRING"), "codigo_estacao")
    assert read("estacoes_aprovadas") == ["a"] and read("estacoes_sem_metadados") == ["b"]
    bad = spark.createDataFrame([("a", 1.0, 2.0, "ok"), ("b", 3.0, 4.0, "fora_extent")], "station STRING, longitude DOUBLE, latitude DOUBLE, motivo STRING")
    W.write_excluded(bad, str(tmp_path / "x"))
    assert rows(R.read_semicolon_csv(spark, str(tmp_path / "x"), "station STRING, longitude DOUBLE, latitude DOUBLE, motivo STRING")) == [("b", 3.0, 4.0, "fora_extent")]


def test_guards(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None)], "k INT, v DOUBLE")
    with pytest.raises(ValueError):
        T.assert_unique(df, ["k"])
    with pytest.raises(KeyError):
        T.require_columns(df, ["k", "z"])
    with pytest.raises(Exception):
        T.require_not_null(df, "v").collect()
    assert T.assert_unique(df, ["k", "v"]) is df
