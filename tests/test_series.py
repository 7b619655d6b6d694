import pytest
from pyspark.sql import functions as F

from finescale.operators import series as S
from tests.helpers import at, column, rows


@pytest.mark.parametrize("unit", ["day", "month"])
def test_memory_features(spark, unit):
    df = spark.createDataFrame([(0, 0, at(h), float(h * h)) for h in range(7)], "iy INT, ix INT, ts TIMESTAMP_NTZ, t2m_1km DOUBLE")
    out = S.memory_features(df).filter(F.col("ts") == at(6)).first()
    assert [out[f"dt2m_{h}h"] for h in (1, 2, 3)] == [11.0, 20.0, 27.0]
    assert [out[f"d2t2m_{h}h"] for h in (1, 2, 3)] == [2.0, 8.0, 18.0]
    # hours 0..5 are January, hour 6 is February
    local = S.memory_features(df, month_local=True).filter(F.col("ts") == at(6)).first()
    assert local["dt2m_1h"] is None and local["d2t2m_3h"] is None


def test_lag_is_by_hour_not_by_row(spark):
    df = spark.createDataFrame([(0, 0, at(h), float(h)) for h in (0, 1, 3, 4, 30)], "iy INT, ix INT, ts TIMESTAMP_NTZ, v DOUBLE")
    out = S.lag_exact(df, "v", [1, 2, 26], unit="day")
    assert rows(out.select("v", "v_lag1", "v_lag2", "v_lag26"), "v") == [
        (0.0, None, None, None), (1.0, 0.0, None, None), (3.0, None, 1.0, None), (4.0, 3.0, None, None), (30.0, None, None, 4.0)]


@pytest.mark.parametrize("unit", ["hour", "day", "month"])
def test_lags_longer_than_a_bucket(spark, unit):
    df = spark.createDataFrame([(0, 0, at(h), float(h)) for h in range(0, 90, 3)], "iy INT, ix INT, ts TIMESTAMP_NTZ, v DOUBLE")
    out = S.lag_exact(df, "v", [3, 30, 60], unit=unit)
    assert rows(out.select("v", "v_lag3", "v_lag30", "v_lag60"), "v") == [
        tuple([float(h)] + [float(h - k) if h >= k else None for k in (3, 30, 60)]) for h in range(0, 90, 3)]


def test_deaccumulate_resets_daily_and_monthly(spark):
    stamps = [(1, 0, 100.0), (1, 1, 3600.0), (1, 2, 10800.0), (1, 3, 10800.0), (1, 23, 36000.0), (2, 0, 39600.0), (2, 1, 7200.0)]
    df = spark.sql("SELECT 1 AS lat_i, 1 AS lon_i, make_timestamp_ntz(2020, 3, d, h, 0, 0) AS ts, v FROM VALUES "
                   + ", ".join(f"({d}, {h}, {v}D)" for d, h, v in stamps) + " AS t(d, h, v)")
    assert column(S.deaccumulate(df, ["v"]), "v", "ts") == [None, 1.0, 2.0, 0.0, 7.0, 1.0, 2.0]
    two = df.unionByName(df.withColumn("ts", F.col("ts") + F.expr("INTERVAL '31' DAY")))
    assert column(S.deaccumulate(two, ["v"]), "v", "ts").count(None) == 2
    across = column(S.deaccumulate(two, ["v"], reset="none"), "v", "ts")
    assert across.count(None) == 1 and across[7] == pytest.approx((100.0 - 7200.0) / 3600)


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k STRING, o INT, v STRING")
    assert rows(S.keep_first(df, ["k"], ["o"]), "k") == [("a", 1, "y"), ("b", 5, "z")]
