import pytest
from pyspark.sql import functions as F

from finescale.models import band as B
from finescale.models import folds as FO
from finescale.models import residual as RM
from finescale.operators import skill as S
from finescale.plans import features as FT
from finescale.plans import gates as G
from finescale.plans.matrix import build_matrix
from finescale.sources.readers import COARSE_VARIABLES
from tests.helpers import column, rows


def test_feature_sets(tmp_path):
    assert [len(FT.feature_set(s)) for s in ("28", "33", "53", "55", "57")] == [28, 33, 53, 55, 57]
    f = tmp_path / "f.txt"
    f.write_text("lapse, u10  # wind\n# none\nv10\n")
    assert FT.feature_set(f"@{f}") == ["lapse", "u10", "v10"] == FT.feature_set("lapse,u10, v10")
    assert FT.raw_needed(["razao_bowen"]) == ["slhf", "sshf", "t2m"]


@pytest.fixture(scope="module")
def world(spark):
    """Two months of hourly coarse fields around the month border on 3x3 nodes, and four cells."""
    hours = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2020-01-30 00:00:00', TIMESTAMP_NTZ'2020-02-02 23:00:00', INTERVAL 1 HOUR)) AS ts")
    nodes = spark.range(9).selectExpr("CAST(id div 3 AS INT) AS lat_i", "CAST(id % 3 AS INT) AS lon_i", "-26.0D - (id div 3) * 0.1D AS lat",
                                      "-50.0D + (id % 3) * 0.1D AS lon")
    f = hours.crossJoin(nodes)
    wave = F.hour("ts") + F.col("lat_i") + 2.0 * F.col("lon_i")
    coarse = f.select("ts", "lat_i", "lon_i", "lat", "lon", *[
        (wave * 3600.0 if v in ("sshf", "slhf", "ssr", "str") else 280.0 + wave).cast("double").alias(v) for v in COARSE_VARIABLES]).cache()
    cells = spark.createDataFrame([(0, 0, -26.05, -49.95, 500.0, 450.0), (0, 1, -26.15, -49.85, 800.0, 600.0), (1, 0, -26.0, -50.0, 10.0, 12.0),
                                   (1, 1, -26.12, -49.91, 900.0, 850.0)], "iy INT, ix INT, lat DOUBLE, lon DOUBLE, z_alvo DOUBLE, z_era5_orog DOUBLE")
    grid = cells.withColumns({"x": F.col("ix") * 1000.0, "y": F.col("iy") * 1000.0})
    layer = cells.select("iy", "ix", *[F.lit(0.5).alias(c) for c in (*FT.RELIEF, "dist_oceano", *FT.FRACTIONS)])
    statics = FT.static_features([layer], grid)
    return coarse, cells, statics


def test_matrix_has_57_features_and_matches_the_scoring_rows(spark, world):
    coarse, cells, statics = world
    dyn = FT.dynamic_features(coarse, cells).cache()
    obs = dyn.select("iy", "ix", "ts", (F.col("t2m_1km") - 273.15 + 1.0).alias("temperatura_c_qc")).withColumn("station", F.concat_ws("-", "iy", "ix"))
    station_cell = cells.select(F.concat_ws("-", "iy", "ix").alias("station"), "iy", "ix")
    m = build_matrix(obs.select("station", "ts", "temperatura_c_qc"), station_cell, dyn, statics).cache()
    assert m.count() == 4 * 96
    assert set(FT.FEATURES_57) <= set(m.columns)
    assert m.filter(F.abs(F.col("y_residuo") - 1.0) > 1e-9).isEmpty()
    again = FT.build_features(dyn, statics)
    gate = G.gate_train_equals_inference(m, again, ["iy", "ix", "ts"], list(FT.FEATURES_57)).first()
    assert gate["ok"] and gate["n_bad"] == 0
    # fluxes: 3600 J per hour step is 1 W m-2; the first hour of each month is missing
    cell = m.filter("iy = 1 AND ix = 0").orderBy("ts").select("ts", "ssr", "dt2m_1h").collect()
    assert cell[0]["ssr"] is None and cell[48]["ssr"] is None and cell[5]["ssr"] == pytest.approx(1.0)
    assert cell[48]["dt2m_1h"] is not None                # lags cross the month border
    short = FT.dynamic_features(coarse.select("ts", "lat_i", "lon_i", "lat", "lon", "t2m", "d2m"), cells, ["dep_orvalho"])
    assert set(short.columns) >= {"t2m_1km", "dep_orvalho"}
    with pytest.raises(ValueError):
        build_matrix(obs.select("station", "ts", "temperatura_c_qc"), station_cell, short, statics)


def test_gate_detects_differences(spark):
    a = spark.createDataFrame([(1, None), (2, 1.0), (3, 1.0)], "k INT, v DOUBLE")
    b = spark.createDataFrame([(1, None), (2, 1.0 + 1e-10), (3, None)], "k INT, v DOUBLE")
    gate = G.gate_train_equals_inference(a, b, ["k"], ["v"])
    assert gate.first()["n_bad"] == 1
    lost, more = b.filter("k <> 1"), b.union(spark.createDataFrame([(9, 5.0)], b.schema))      # rows on one side only, also where null
    assert [G.gate_train_equals_inference(a, x, ["k"], ["v"]).first()["n_bad"] for x in (lost, more)] == [2, 2]
    with pytest.raises(ValueError):
        G.stop_on_failure(gate)


@pytest.fixture(scope="module")
def rows_df(spark):
    return spark.range(1200).selectExpr("concat(id % 12, '_0') AS cell_id", "CAST(id % 12 AS INT) AS iy", "0 AS ix",
                                        "TIMESTAMP_NTZ'2020-01-01' + make_dt_interval(0, CAST(id div 12 AS INT)) AS ts",
                                        "280D + id % 7 AS t2m_1km", "CASE WHEN id % 10 <> 0 THEN CAST(id % 24 AS DOUBLE) END AS a",
                                        "CAST(id % 7 AS DOUBLE) + (id * 7919 % 100) / 100D AS y_residuo").cache()


def test_folds_keep_cells_whole_and_balanced(spark, rows_df):
    f = FO.assign_folds(rows_df, 4)
    per = rows(f.groupBy("cell_id").agg(F.count_distinct("fold")))
    assert {n for _, n in per} == {1}
    assert column(f.groupBy("fold").agg(F.count("*").alias("n")), "n") == [300] * 4
    h = FO.carve_holdout(rows_df, 0.2)
    assert h.filter("holdout").select("cell_id").distinct().count() == 2
    assert h.count() == 1200
    with pytest.raises(ValueError):
        FO.require_cells(rows_df, 13)


def test_out_of_fold_never_sees_its_cell_and_beats_the_baseline(spark, rows_df, tmp_path):
    params = RM.BoostParams(rounds=8, rate=0.5, depth=3, min_rows=5, features="all", rows=1.0, bins=32)
    oof, models = RM.oof_predict(rows_df, ["t2m_1km", "a"], 3, params, early_stop=False)
    assert oof.count() == 1200 and len(models) == 3
    g = S.skill_global(S.with_errors(oof)).first()
    assert g["ss"] > 0.5
    RM.save_model(models[0], str(tmp_path / "m"), ["t2m_1km", "a"], params)
    model, meta = RM.load_model(spark, str(tmp_path / "m"))
    assert meta["features"] == ["t2m_1km", "a"] and meta["baseline"] == "t2m_1km"
    a = column(RM.predict(rows_df, meta["features"], model), "pred_residuo", "ts", "cell_id")
    assert a == column(RM.predict(rows_df, ["t2m_1km", "a"], models[0]), "pred_residuo", "ts", "cell_id")


def test_band_is_ordered_and_covers(spark, rows_df):
    model = B.fit_band(rows_df, ["t2m_1km", "a"], trees=5, depth=4, min_rows=10)
    out = B.predict_band(rows_df, model)
    assert out.filter("pred_p_lo > pred_p_med OR pred_p_med > pred_p_hi").isEmpty()
    cov = S.coverage(out).first()
    assert 0.5 < cov["cob_int"] < 0.95


def test_error_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, -2.0), (2.0, 2.0)], "err_down DOUBLE, err_base DOUBLE")
    r = df.agg(*S.skill_columns()).first()
    assert (r["mae_down"], r["rmse_down"], r["me_down"], r["ss"]) == pytest.approx((4 / 3, 2 ** 0.5, 2 / 3, 1 - 2 ** 0.5 / 2))


def test_verdict(spark):
    v = lambda c, f, a, low: spark.range(1).select(S.tail_verdict(F.lit(c), F.lit(f), a, low)).first()[0]
    assert v(0.17, 0.15, 0.16, True) == "calibrado"
    assert v(0.17, 0.30, 0.16, True) == "sub-cobre" and v(0.10, 0.16, 0.16, True) == "sobre-cobre"
    assert v(0.70, 0.84, 0.84, False) == "sub-cobre"
