"""Lists of nearest stations: targets far from all stations ask few of them, fields meet corrections without a sort."""
import math
import random

import numpy as np
import pytest

from finescale.operators import anchoring as A
from finescale.operators import neighbours as N


@pytest.fixture
def strip(spark):
    rng = random.Random(4)
    stations = [(i, rng.uniform(0, 100), i * 0.5) for i in range(2000)]
    targets = [(i, rng.uniform(0, 100), 1000.0 + 2 * i) for i in range(400)] + [(900 + i, 50.0, 3.0 * i) for i in range(9)]
    return (stations, targets, spark.createDataFrame(targets, "cell INT, x DOUBLE, y DOUBLE"),
            spark.createDataFrame(stations, "station INT, x DOUBLE, y DOUBLE"))


def test_targets_far_from_all_stations_ask_few_of_them(spark, strip, monkeypatch):
    stations, targets, tg, st = strip
    asked = []
    found = N._far_tiles
    monkeypatch.setattr(N, "_far_tiles", lambda groups, top, need, level: asked.append(found(groups, top, need, level)) or asked[0])
    got = {}
    for r in N.knn(tg, st, 5, ["cell"]).collect():
        got.setdefault(r["cell"], {})[r["rank"]] = r["station"]
    for i, x, y in targets:
        want = sorted((math.sqrt((sx - x) ** 2 + (sy - y) ** 2), s) for s, sx, sy in stations)[:5]
        assert [got[i][r] for r in range(1, 6)] == [s for _, s in want]
    # without bounds by distance every far group asks all tiles that hold stations
    groups = asked[0].select("gx", "gy").distinct().count()
    assert asked[0].count() < 60 * groups


def test_reachable_boxes_hold_the_nearest():
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, (3000, 2))
    tile = (p // 10).astype(int)
    keys, at = np.unique(tile, axis=0, return_inverse=True)
    boxes = np.array([[*(p[at == i, 0].min(), p[at == i, 0].max()), *(p[at == i, 1].min(), p[at == i, 1].max())] for i in range(len(keys))])
    for low, high, x, y in ((1.0, 1.0, 400.0, 20.0), (0.2, 0.4, -90.0, 50.0), (1.0, 1.0, 45.0, 45.0)):
        held = np.array([x, x + 10, y, y + 10])
        places = set(N.reachable(boxes, held, np.bincount(at), low, high, 7).tolist())
        assert len(places) < len(keys)
        for scale in (low, high):
            for tx, ty in rng.uniform((x, y), (x + 10, y + 10), (20, 2)):
                near = np.argsort(np.hypot((p[:, 0] - tx) * scale, p[:, 1] - ty))[:7]
                assert set(at[near].tolist()) <= places
    assert len(N.reachable(boxes, held, np.bincount(at), 1.0, 1.0, 10 ** 6)) == len(keys)


def test_field_meets_corrections_by_hash_and_no_pairs_are_shuffled(spark):
    cells = spark.sql("SELECT CAST(id AS INT) AS iy, 0 AS ix, id * 1.0D AS x_km, 0.0D AS y_km, CAST(NULL AS DOUBLE) AS z_m FROM range(70)")
    net = spark.sql("SELECT id AS station, id * 3.0D AS x_km, 1.0D AS y_km, 5.0D AS z_m FROM range(30)")
    inc = spark.sql("SELECT id AS station, TIMESTAMP_NTZ'2020-01-01' AS ts, CAST(id AS DOUBLE) AS inc FROM range(30)")
    field = cells.selectExpr("iy", "ix", "TIMESTAMP_NTZ'2020-01-01' AS ts", "1D AS T_final")
    out = A.anchor_idw(field, cells, net, inc, k=4, radius_km=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Window" not in plan
    same = A.anchor(field, A.neighbours(cells, net, k=4, radius_km=8), inc)
    want = {r["iy"]: r["T_final_oi"] for r in same.collect()}
    assert {r["iy"]: r["T_final_oi"] for r in out.collect()} == pytest.approx(want) and len(set(want.values())) > 20
