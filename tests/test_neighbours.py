import math
import random

import pytest

from finescale.operators import neighbours as N


def brute(targets, stations, k, scale=lambda t: 1.0):
    out = {}
    for ti, tx, ty in targets:
        d = sorted((math.hypot((sx - tx) * scale((ti, tx, ty)), sy - ty), s) for s, sx, sy in stations)
        out[ti] = d[:k]
    return out


@pytest.mark.parametrize("k,unit", [(1, 1.0), (5, 1000.0), (20, 0.01), (500, 1.0)])
def test_knn_is_exact_for_clustered_stations(spark, k, unit):
    rng = random.Random(k)
    # a third of the stations sit in one small town, one is far away
    stations = ([(i, rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(100)]
                + [(100 + i, 50 + rng.random(), 60 + rng.random()) for i in range(80)] + [(999, -40000.0, 2500.0)])
    targets = [(i, rng.uniform(-20, 320), rng.uniform(-20, 320)) for i in range(120)] + [(500, 50.5, 60.5), (501, 5000.0, 0.0), (502, 1e7, -1e7)]
    stations, targets = ([(i, x * unit, y * unit) for i, x, y in rows] for rows in (stations, targets))
    got = {}
    df = N.knn(spark.createDataFrame(targets, "cell INT, x DOUBLE, y DOUBLE"),
               spark.createDataFrame(stations, "station INT, x DOUBLE, y DOUBLE"), k, ["cell"])
    for r in df.collect():
        got.setdefault(r["cell"], []).append((r["d"], r["station"]))
    want = brute(targets, stations, k)
    assert got.keys() == want.keys()
    for c in want:
        mine = sorted(got[c])
        assert [s for _, s in mine] == [s for _, s in want[c]]
        assert [d for d, _ in mine] == pytest.approx([d for d, _ in want[c]])


def test_scaled_longitudes(spark):
    rng = random.Random(1)
    nodes = [(i, rng.uniform(0, 40), rng.uniform(-60, 60)) for i in range(60)]
    targets = [(i, rng.uniform(-5, 45), rng.uniform(-70, 70)) for i in range(60)]
    targets += [(900, 20.0, 90.0), (901, 5.0, -89.99)]
    cos = lambda t: abs(math.cos(math.radians(t[2])))
    tg = spark.createDataFrame([(*t, cos(t)) for t in targets], "cell INT, x DOUBLE, y DOUBLE, s DOUBLE")
    df = N.knn(tg, spark.createDataFrame(nodes, "station INT, x DOUBLE, y DOUBLE"), 1, ["cell"], x_scale="s")
    want = brute(targets, nodes, 1, cos)
    assert {r["cell"]: r["station"] for r in df.collect()} == {c: v[0][1] for c, v in want.items()}


def test_no_cross_join_in_the_plan(spark):
    t = spark.range(10).selectExpr("id AS cell", "CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y")
    s = t.withColumnRenamed("cell", "station")
    plan = N.knn(t, s, 3, ["cell"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_few_far_stations_in_metres(spark):
    st = spark.createDataFrame([(1, 0.0, 0.0), (2, 900_000.0, 10.0), (3, 5.0, 5.0), (4, 5.0, 5.0)], "station INT, x DOUBLE, y DOUBLE")
    tg = spark.createDataFrame([(0, 1.0, 1.0)], "cell INT, x DOUBLE, y DOUBLE")
    assert [r["station"] for r in N.knn(tg, st, 3, ["cell"]).orderBy("rank").collect()] == [1, 3, 4]
    assert [r["station"] for r in N.knn(tg, st, 9, ["cell"]).orderBy("rank").collect()] == [1, 3, 4, 2]
    assert N.knn(tg, st.limit(0), 3, ["cell"]).collect() == []
    assert {r["station"] for r in N.within_radius(tg, st, 10.0, ["cell"]).collect()} == {1, 3, 4}
