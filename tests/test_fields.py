import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from finescale.functions import physics as P
from finescale.functions.metrics import pinball
from finescale.functions.time import with_time_features
from finescale.functions.utm import lonlat_to_utm, utm_to_lonlat
from finescale.operators import anchoring as A
from finescale.operators import grid as G
from finescale.operators import raster as R
from finescale.operators.interpolation import bilinear
from tests.helpers import at, column, rows

COARSE = "ts TIMESTAMP_NTZ, lat_i INT, lon_i INT, lat DOUBLE, lon DOUBLE, t2m DOUBLE"


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def nodes(values, hour=0):
    return [(at(hour), i, j, 10.0 - i, 20.0 + j, v) for (i, j), v in values.items()]


def test_bilinear_renormalises_and_falls_back(spark):
    grid = {(0, 0): 1.0, (0, 1): 2.0, (1, 0): None, (1, 1): 3.0, (0, 2): None, (1, 2): None, (0, 3): None, (1, 3): None, (0, 4): None, (1, 4): 9.0}
    coarse = spark.createDataFrame(nodes(grid), COARSE)
    cells = spark.createDataFrame([(0, 0, 9.5, 20.5), (0, 1, 9.4, 22.4), (0, 2, 10.0, 21.0), (0, 3, 9.5, 99.0), (0, 4, 9.0, 24.0)],
                                  "iy INT, ix INT, lat DOUBLE, lon DOUBLE")
    out = {r["ix"]: r["t2m"] for r in bilinear(coarse, cells, ["t2m"]).collect()}
    assert out[0] == pytest.approx(2.0)      # (1 + 2 + 3) / 3
    assert out[1] == pytest.approx(3.0)      # all missing: nearest land node, scaled by cos(lat)
    assert out[2] == pytest.approx(2.0)      # on a node
    assert out[4] == pytest.approx(9.0)      # on the last node of both axes
    assert out[3] == pytest.approx(9.0)      # outside the axes: nearest land node
    dry = {r["ix"]: r["t2m"] for r in bilinear(coarse, cells, ["t2m"], ocean="nan").collect()}
    assert dry[1] is None and dry[3] is None and len(dry) == 5


def test_each_variable_has_its_own_mask(spark):
    data = [(at(h), i, j, 10.0 - i, 20.0 + j, 1.0 + j if j < 2 else None, 5.0 + j if j > 0 else None) for h in (0, 1) for i in (0, 1) for j in range(4)]
    coarse = spark.createDataFrame(data, COARSE + ", d2m DOUBLE")
    cells = spark.createDataFrame([(0, 0, 9.5, 22.5), (0, 1, 9.5, 20.0), (0, 2, 50.0, 20.5)], "iy INT, ix INT, lat DOUBLE, lon DOUBLE")
    got = {(r["ix"], r["ts"]): (r["t2m"], r["d2m"]) for r in bilinear(coarse, cells, ["t2m", "d2m"]).collect()}
    for h in (0, 1):
        assert got[0, at(h)] == (2.0, 7.5)                  # t2m from the last node that has it, d2m interpolated
        assert got[1, at(h)] == (1.0, 6.0)                  # on a node without d2m: copied
        assert got[2, at(h)] == (1.0, 6.0)                  # outside
    assert len(got) == 6


def test_bilinear_missing_hour_is_not_filled_from_elsewhere(spark):
    base = {(i, j): float(i + j) for i in (0, 1) for j in (0, 1)}
    data = nodes(base, 0) + nodes({k: None for k in base}, 1)
    cells = spark.createDataFrame([(0, 0, 9.5, 20.5)], "iy INT, ix INT, lat DOUBLE, lon DOUBLE")
    assert column(bilinear(spark.createDataFrame(data, COARSE), cells, ["t2m"]), "t2m", "ts") == [1.0, None]


def test_block_statistics(spark):
    px = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (10, 10, None), (11, 0, 5.0)], "px INT, py INT, z DOUBLE")
    stats = {"mean": F.avg("z"), "std": F.stddev_pop("z"), "max": F.max("z"), "p10": F.percentile("z", 0.1), "p90": F.percentile("z", 0.9)}
    out = R.block_agg(px, stats)
    assert rows(out) == [(0, 0, 2.0, 1.0, 3.0, pytest.approx(1.2), pytest.approx(2.8))]    # second block is ragged: trimmed


def test_ring_deviation_matches_brute_force_over_tiles(spark):
    z = {(x, y): float((x * 31 + y * 17) % 23) if (x + y) % 7 else None for x in range(20) for y in range(15)}
    df = spark.createDataFrame([(x, y, v) for (x, y), v in z.items()], "px INT, py INT, z DOUBLE")
    got = {(r["px"], r["py"]): r["dev"] for r in R.ring_dev(df, 1.0, 4.0, 1.0, tile=6).collect()}
    want = {}
    for (x, y), v in z.items():
        if v is None:
            continue
        ring = [z[(a, b)] for a in range(x - 4, x + 5) for b in range(y - 4, y + 5)
                if 1 < math.hypot(a - x, b - y) <= 4 and z.get((a, b)) is not None]
        m = sum(ring) / len(ring)
        s = math.sqrt(max(sum(q * q for q in ring) / len(ring) - m * m, 0))
        want[(x, y)] = (v - m) / s if s >= 1e-6 else None
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_ring_of_constant_ground_is_missing(spark):
    df = spark.createDataFrame([(x, y, 5.0) for x in range(5) for y in range(5)], "px INT, py INT, z DOUBLE")
    assert set(column(R.ring_dev(df, 0.0, 1.0, 1.0), "dev")) == {None}


def test_region_mask_handles_shared_edges_and_holes(spark):
    square = lambda x, y, a, rev=False: [(x, y, x + a, y), (x + a, y, x + a, y + a), (x + a, y + a, x, y + a), (x, y + a, x, y)]
    edges = square(0.5, 0.5, 3.0) + square(3.5, 0.5, 3.0) + square(1.2, 1.2, 1.0)      # two neighbours, a hole in the first
    grid = spark.range(64).selectExpr("CAST(id div 8 AS INT) AS iy", "CAST(id % 8 AS INT) AS ix")
    out = G.region_mask(grid, spark.createDataFrame(edges, "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"), G.Axes(0, 0, 1, 1, 8, 8))
    inside = {(r["iy"], r["ix"]) for r in out.filter("in_region").collect()}
    assert inside == {(y, x) for y in (1, 2, 3) for x in range(1, 7)} - {(2, 2)}


def test_containing_cell_on_a_north_up_axis(spark):
    axes = G.Axes.from_bounds(0.0, 90.0, 0.0, 40.0, 10, 5)
    pts = spark.createDataFrame([(5.0, 40.0), (5.1, 35.0), (-50.0, 99.0), (94.0, -4.0)], "x DOUBLE, y DOUBLE")
    out = rows(G.containing_cell(pts, axes).select("iy", "ix"), "x")
    assert sorted(out) == sorted([(0, 0), (0, 1), (0, 0), (4, 9)])      # ties take the first index


def test_projection(spark):
    df = one(spark, lon=-48.55, lat=-27.6)
    x, y = lonlat_to_utm("lon", "lat")
    p = df.select(x.alias("x"), y.alias("y"))
    lon, lat = utm_to_lonlat("x", "y")
    r = p.select("x", "y", lon.alias("lon"), lat.alias("lat")).first()
    assert (r["lon"], r["lat"]) == (pytest.approx(-48.55, abs=1e-11), pytest.approx(-27.6, abs=1e-11))
    # on the central meridian the northing is the scaled meridian arc: 3,318,785.352 m at 30 degrees (GRS80)
    m = one(spark, lon=-51.0, lat=-30.0).select(*[c.alias(n) for c, n in zip(lonlat_to_utm("lon", "lat"), "xy")]).first()
    assert m["x"] == pytest.approx(500000.0, abs=1e-6)
    assert m["y"] == pytest.approx(10000000 - 0.9996 * 3320113.398, abs=0.01)


def test_scalars(spark):
    r = one(spark, t=20.0, td=20.0, hot=25.0).select(
        P.relative_humidity("t", "td").alias("a"), P.relative_humidity("t", "hot").alias("b"),
        P.bowen_ratio(F.lit(10.0), F.lit(-20.0)).alias("c"), P.bowen_ratio(F.lit(10.0), F.lit(0.5)).alias("d"),
        P.bowen_ratio(F.lit(10.0), F.lit(1.0)).alias("e"), P.to_number(F.lit("x1")).alias("f"), P.to_number(F.lit("nan")).alias("g"),
        P.wrap_longitude(F.lit(309.0)).alias("h")).first()
    assert r["a"] == pytest.approx(100.0) and r["b"] > 100
    assert (r["c"], r["d"], r["e"], r["f"], r["g"], r["h"]) == (-0.5, None, 10.0, None, None, -51.0)
    bands = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 200.0, 200.1, 2000.0, 2000.1)], "z DOUBLE").select("z", P.elevation_band("z").alias("b"))
    assert column(bands, "b", "z") == [None, "0-200", "0-200", "200-500", ">1000", None]
    six = with_time_features(spark.sql("SELECT TIMESTAMP_NTZ'2020-01-01 06:00:00' AS ts")).first()
    assert six["hora_sin"] == pytest.approx(1) and six["hora_cos"] == pytest.approx(0, abs=1e-12)
    loss = spark.createDataFrame([(1.0, 0.0)], "y DOUBLE, q DOUBLE").agg(pinball("y", "q", 0.84).alias("p")).first()["p"]
    assert loss == pytest.approx(0.84)


def anchor_case(spark, inc, lz=0.0, table=None):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0)], "iy INT, ix INT, x_km DOUBLE, y_km DOUBLE, z_m DOUBLE")
    st = spark.createDataFrame([("a", 1.0, 0.0, 0.0), ("b", 2.0, 0.0, 500.0)], "station STRING, x_km DOUBLE, y_km DOUBLE, z_m DOUBLE")
    neigh = A.neighbours(cells, st, k=20, lz_m=lz)
    field = spark.createDataFrame([(0, 0, at(0), 10.0)], "iy INT, ix INT, ts TIMESTAMP_NTZ, T_final DOUBLE")
    data = spark.createDataFrame([(s, at(0), v) for s, v in inc.items()], "station STRING, ts TIMESTAMP_NTZ, inc DOUBLE")
    r = A.anchor(field, neigh, data, table).first()
    assert r["T_final"] == pytest.approx(r["T_final_bc"] + r["T_final_oi"])
    return r["T_final_oi"]


def test_anchor_by_hand(spark):
    assert anchor_case(spark, {"a": 2.0, "b": -1.0}) == pytest.approx(-1.0)
    assert anchor_case(spark, {"a": 2.0, "b": None}) == pytest.approx(-2.0)
    assert anchor_case(spark, {"a": None}) == 0.0
    assert anchor_case(spark, {"a": 2.0, "b": -1.0}, lz=500.0) == pytest.approx(-1.533913, abs=1e-6)


def test_hourly_scale_replaces_the_fixed_one(spark):
    hour = at(0).hour
    off = spark.createDataFrame([(hour, 0.0)], "hora INT, lz_m DOUBLE")
    on = spark.createDataFrame([(hour, 500.0)], "hora INT, lz_m DOUBLE")
    assert anchor_case(spark, {"a": 2.0, "b": -1.0}, table=off) == pytest.approx(-1.0)
    assert anchor_case(spark, {"a": 2.0, "b": -1.0}, table=on) == pytest.approx(-1.533913, abs=1e-6)


def by_hand(cells, st, inc, weight):
    """Minus the weighted mean of the stations present, pair by pair."""
    out = {}
    for iy, cx, cy, cz in cells:
        for ts in {t for _, t, _ in inc}:
            num = den = 0.0
            for s, x, y, z in st:
                v = next((v for n, t, v in inc if n == s and t == ts), None)
                if v is not None:
                    w = weight(math.hypot(x - cx, y - cy), z - cz)
                    num, den = num + w * v, den + w
            out[iy, ts] = -num / den if den else 0.0
    return out


@pytest.mark.parametrize("rule", [dict(k=6), dict(method="gauss", length_km=20.0, lz_m=400.0), dict(method="gauss", length_km=2.0)])
def test_array_form_equals_pair_by_pair(spark, rule):
    cells = [(i, i * 12.0, 0.0, i * 40.0) for i in range(40)]
    st = [(f"s{i}", i * 9.0, 3.0, i * 300.0) for i in range(6)]
    inc = [(f"s{i % 6}", at(i // 6), i - 8.5 if i % 5 else None) for i in range(18)]
    field = spark.createDataFrame([(c[0], 0, t, 15.0) for c in cells for t in {t for _, t, _ in inc}], "iy INT, ix INT, ts TIMESTAMP_NTZ, T_final DOUBLE")
    grid = spark.createDataFrame([(c[0], 0, *c[1:]) for c in cells], "iy INT, ix INT, x_km DOUBLE, y_km DOUBLE, z_m DOUBLE")
    net = spark.createDataFrame(st, "station STRING, x_km DOUBLE, y_km DOUBLE, z_m DOUBLE")
    out = A.anchor(field, A.neighbours(grid, net, **rule), spark.createDataFrame(inc, "station STRING, ts TIMESTAMP_NTZ, inc DOUBLE"))
    damp = lambda dz: math.exp(-(dz / 400) ** 2) if rule.get("lz_m") else 1.0
    weight = (lambda d, dz: math.exp(-(d / rule["length_km"]) ** 2) * damp(dz)) if "method" in rule else (lambda d, dz: 1 / d)
    want, got = by_hand(cells, st, inc, weight), rows(out, "iy", "ts")
    assert len(got) == len(want) == 120
    for r in out.collect():
        assert r["T_final_oi"] == pytest.approx(want[r["iy"], r["ts"]], abs=1e-9) and r["T_final"] == r["T_final_bc"] + r["T_final_oi"]


def test_leave_one_out_ignores_missing_increments(spark):
    st = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", 1.0, 0.0, 0.0), ("c", 3.0, 0.0, 0.0)], "station STRING, x_km DOUBLE, y_km DOUBLE, z_m DOUBLE")
    inc = spark.createDataFrame([("a", at(0), 1.0), ("b", at(0), 2.0), ("c", at(0), None)], "station STRING, ts TIMESTAMP_NTZ, inc DOUBLE")
    rules = A.rules_of(ks=[2], powers=[1], lengths=[50])
    got = {r["station"]: r["hats"] for r in A.loo_anchor(inc, st, rules).collect()}
    assert got["a"] == pytest.approx([2.0, 2.0]) and got["b"] == pytest.approx([1.0, 1.0]) and got["c"][0] == pytest.approx((1 / 3 + 1) / (1 / 3 + 1 / 2))


def test_published_rules():
    assert len(A.rules_of(**A.PUBLISHED)) == 72


def test_leave_one_out_in_parts(spark):
    """An hour cut into parts gives what one group gives, and sums per rule equal sums over rows; strata may be NULL."""
    st = spark.range(40).selectExpr("concat('s', id) AS station", "id * 7919 % 97 * 1D AS x_km", "id * 31 % 53 * 1D AS y_km",
                                    "CASE WHEN id % 9 > 0 THEN id * 40D END AS z_m")
    inc = spark.range(200).selectExpr("concat('s', id % 40) AS station", "TIMESTAMP_NTZ'2020-01-01' + make_dt_interval(0, CAST(id div 40 AS INT)) AS ts",
                                      "CASE WHEN id % 11 > 0 THEN id * 13 % 17 - 8D END AS inc", "CASE WHEN id % 7 > 0 THEN id % 5 - 2D END AS y_residuo",
                                      "CASE WHEN id % 4 > 0 THEN concat('g', id % 4) END AS stratum")
    rules = A.rules_of(ks=[3, 12], powers=[1, 2], lengths=[20], lzs=[0, 300])
    whole = {(r["station"], r["ts"]): r["hats"] for r in A.loo_anchor(inc, st, rules).collect()}
    cut = A.loo_anchor(inc, st, rules, targets=7).collect()
    assert len(cut) == len(whole) == 200
    for r in cut:
        assert r["hats"] == pytest.approx(whole[r["station"], r["ts"]], abs=1e-12)
    loo = A.loo_anchor(inc, st, rules, targets=7)
    got = {(r["stratum"], r["rule"]): r for r in A.rule_errors(loo, rules, ["stratum"]).collect()}
    assert len(got) == 4 * (len(rules) + 1)
    for (stratum, rule), r in got.items():
        mine = [x for x in cut if x["stratum"] == stratum and x["inc"] is not None]
        e = [x["inc"] - (x["hats"][rule] if rule >= 0 else 0.0) for x in mine]
        base = [x["y_residuo"] ** 2 for x in mine if x["y_residuo"] is not None]
        rmse = math.sqrt(sum(v * v for v in e) / len(e))
        assert (r["n"], r["rmse"], r["mae"], r["me"], r["ss"]) == pytest.approx(
            (len(e), rmse, sum(map(abs, e)) / len(e), sum(e) / len(e), 1 - rmse / math.sqrt(sum(base) / len(base))), abs=1e-9)
    assert A.rule_errors(loo.filter("false"), rules).collect() == []


def test_increments_from_raw_across_months(spark):
    """Memory at the first hour of a month reads the month before; a month with a hole, or absent, stops the run."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    from finescale.plans.field import increments_from_raw
    hours = spark.range(60 * 24).selectExpr("id AS h", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, CAST(id AS INT)) AS ts")
    nodes = spark.range(9).selectExpr("CAST(id div 3 AS INT) AS lat_i", "CAST(id % 3 AS INT) AS lon_i", "1D * (id div 3) AS lat", "1D * (id % 3) AS lon")
    coarse = hours.crossJoin(nodes).selectExpr("ts", "lat_i", "lon_i", "lat", "lon", "280D + h / 100D AS t2m")
    cells = spark.createDataFrame([(0, 0, 0.5, 0.5, 10.0, 0.0), (0, 1, 1.5, 1.0, 20.0, 0.0)], "iy INT, ix INT, lat DOUBLE, lon DOUBLE, z_alvo DOUBLE, z_era5_orog DOUBLE")
    where = spark.createDataFrame([("a", 0, 0), ("b", 0, 0), ("c", 0, 0)], "station STRING, iy INT, ix INT")
    obs = spark.createDataFrame([("a", datetime(2024, 2, 1), 10.0), ("b", datetime(2024, 2, 1), 12.0), ("c", datetime(2024, 2, 1), 99.0),
                                 ("a", datetime(2024, 2, 2), 5.0), ("a", datetime(2024, 1, 31, 23), 5.0), ("z", datetime(2024, 2, 1), 5.0)],
                                "station STRING, ts TIMESTAMP_NTZ, temperatura_c_qc DOUBLE")
    out = spark.createDataFrame([("c",)], "station STRING")
    model = PipelineModel(stages=[SQLTransformer(statement="SELECT *, 100 * x_dt2m_1h + x_fracao_t1 AS pred_residuo FROM __THIS__")])
    statics = cells.selectExpr("iy", "ix", "z_alvo", "3D AS fracao_t1")
    run = lambda fields, **o: increments_from_raw(fields, cells, statics, ["dt2m_1h", "fracao_t1"], model, obs, where,
                                                  datetime(2024, 2, 1), datetime(2024, 2, 2), out, **o)
    rows_ = run(coarse).collect()
    assert [(r["cell_id"], r["ts"]) for r in rows_] == [("0_0", datetime(2024, 2, 1))]
    y = 11.0 - (280 + 744 / 100 - 273.15)
    assert rows_[0]["y_residuo"] == pytest.approx(y) and rows_[0]["inc"] == pytest.approx(1.0 + 3.0 - y)
    with pytest.raises(ValueError, match="2024-02"):
        run(coarse.filter("ts <> TIMESTAMP_NTZ'2024-02-20 05:00:00'"))
    with pytest.raises(ValueError, match="2024-01"):
        run(coarse.filter("ts >= TIMESTAMP_NTZ'2024-02-01'"))
