import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from finescale.operators import quality as Q
from tests.helpers import at, column

SCHEMA = "station STRING, ts TIMESTAMP_NTZ, md_valor STRING, md_final STRING"


def series(spark, values, station="a"):
    return spark.createDataFrame([(station, at(i), v) for i, v in enumerate(values)], "station STRING, ts TIMESTAMP_NTZ, t DOUBLE")


@pytest.mark.parametrize("unit", ["day", "month", "year"])
def test_spike_flags_both_sides_and_skips_missing_neighbours(spark, unit):
    df = series(spark, [10.0, 11.0, 30.0, 12.0, None, 40.0])
    assert column(Q.qc_spike(df, "t", unit=unit), "t", "ts") == [10.0, 11.0, None, None, None, 40.0]


@pytest.mark.parametrize("unit", ["hour", "day", "month"])
def test_stuck_keeps_the_first_six(spark, unit):
    out = column(Q.qc_stuck(series(spark, [10.0] * 9), "t", unit=unit), "t", "ts")
    assert out == [10.0] * 6 + [None] * 3


def brute(values, flags, lim):
    t = [None if v is None else v for v in values]
    t = [v if f in lim.flags else None for v, f in zip(t, flags)]
    t = [v if v is not None and lim.low <= v <= lim.high else None for v in t]
    jump = [i > 0 and t[i] is not None and t[i - 1] is not None and abs(t[i] - t[i - 1]) > lim.max_jump for i in range(len(t))]
    t = [None if j else v for v, j in zip(t, jump)]
    same = [i > 0 and t[i] is not None and t[i] == t[i - 1] for i in range(len(t))]
    n = lim.stuck_hours
    stuck = [i + 1 >= n and all(same[i - n + 1:i + 1]) for i in range(len(t))]
    return [None if s else v for v, s in zip(t, stuck)]


@pytest.mark.parametrize("unit,max_rows", [("hour", 1), ("day", 1), (None, 10**6), (None, 50), (None, 3)])
def test_chain_equals_brute_force_across_buckets(spark, unit, max_rows):
    rng = random.Random(7)
    lim = Q.Limits(stuck_hours=4)
    data, want = [], {}
    for st in ("hot", "b", "c"):
        n = 400 if st == "hot" else 40
        ts, v, seq = datetime(2021, 12, 30), 10.0, []
        for _ in range(n):
            ts += timedelta(minutes=rng.choice([20, 60, 60, 60, 300, 1600]))
            v = v if rng.random() < 0.75 else rng.choice([10.0, 12.0, 33.0, 60.0])
            seq.append((ts, None if rng.random() < 0.03 else v, rng.choice([4, 5, 5, 5, 4, 4, 9])))
        data += [(st, t, None if x is None else str(x), str(f)) for t, x, f in seq]
        for (t, _, _), w in zip(seq, brute([x for _, x, _ in seq], [f for _, _, f in seq], lim)):
            want[(st, t)] = w
    out = Q.qc_temperature(spark.createDataFrame(data, SCHEMA), limits=lim, unit=unit, max_rows=max_rows)
    got = {(r["station"], r["ts"]): r["temperatura_c_qc"] for r in out.collect()}
    assert got == want
    audit = {r["qc_stage"]: r["n"] for r in Q.qc_audit(out).collect()}
    assert sum(audit.values()) == len(data)          # every row read is accounted for
    assert audit["kept"] == sum(v is not None for v in want.values())
    assert audit["stuck"] > 0 and audit["spike"] > 0


def test_window_is_cut_after_quality_control(spark):
    df = spark.createDataFrame([("a", at(i), str(v), "4") for i, v in enumerate([10, 40, 40, 40])], SCHEMA)
    df = df.withColumn("data_hora_utc", F.col("ts"))
    out = Q.clean_observations(df, start=at(1), end=at(3))
    assert column(out, "temperatura_c_qc", "ts") == [None, 40.0]     # the jump is seen from outside the window


def test_coverage_drops_short_stations(spark):
    df = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 1.0), ("b", None), ("b", None)], "station STRING, temperatura_c_qc DOUBLE")
    assert column(Q.min_coverage(df, 2).select("station").distinct(), "station") == ["a"]


def test_hot_series_get_finer_units(spark):
    from finescale.operators.series import hot_units
    df = spark.range(5000).selectExpr("IF(id < 4000, 'hot', concat('s', id % 50)) AS station",
                                      "TIMESTAMP_NTZ'2021-01-01' + make_dt_interval(0, 0, CAST(id % 4000 AS INT)) AS ts")
    out = {r["station"]: r["_unit"] for r in hot_units(df, ["station"], "ts", 100).collect()}
    assert out == {"hot": "hour"}          # 60 rows an hour, 4000 in all; the others stay whole
