"""Training runs: pooled quantiles, split counts, cross-validation, counts taken while writing, missing baselines."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from finescale.models import band as B
from finescale.models import residual as RM
from finescale.operators import anchoring as A
from finescale.operators import tables as T
from finescale.plans import training as TR

FEATURES = ["t2m_1km", "a"]
PARAMS = RM.BoostParams(rounds=6, rate=0.5, depth=3, min_rows=5, features="all", rows=1.0, bins=32)


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.range(1500).selectExpr(
        "concat(id % 15, '_0') AS cell_id", "CAST(id % 15 AS INT) AS iy", "0 AS ix", "100D * (id % 15) AS z_alvo",
        "TIMESTAMP_NTZ'2020-01-01' + make_dt_interval(0, CAST(id div 15 AS INT)) AS ts", "280D + id % 7 AS t2m_1km",
        "CASE WHEN id % 10 <> 0 THEN CAST(id % 24 AS DOUBLE) END AS a", "(id % 7) * 2D + (id * 7919 % 1000) / 100D AS y_residuo").cache()


def test_band_equals_pooled_samples(spark, matrix):
    """Against every leaf's whole sample: the weighted share below a quantile holds its level, within the bound of the kept points."""
    model = B.fit_band(matrix, FEATURES, trees=6, depth=4, min_rows=20)
    data, _ = RM.missing_policy(matrix, FEATURES)
    hits = model.forest.transform(data).select("y_residuo", vector_to_array("_leaf").alias("leaf")).toPandas()
    y, leaf = hits["y_residuo"].to_numpy(), np.stack(hits["leaf"].to_numpy()).astype(int)
    out = B.predict_band(matrix, model).select("cell_id", "ts", *B.NAMES).toPandas()
    rows = model.forest.transform(data).select("cell_id", "ts", vector_to_array("_leaf").alias("leaf")).toPandas().merge(out, on=["cell_id", "ts"])
    assert len(rows) == 1500
    for r in rows.iloc[::25].itertuples():
        own = np.array(r.leaf).astype(int)
        weight = sum((leaf[:, t] == own[t]) / (leaf[:, t] == own[t]).sum() for t in range(6)) / 6
        for name, alpha in zip(B.NAMES, B.ALPHAS):
            q = getattr(r, name)
            assert weight[y < q].sum() <= alpha + 0.0051 and weight[y <= q].sum() >= alpha - 0.0051


def test_pooled_quantiles_by_hand():
    samples = np.array([[4.0, 1.0, 3.0, 2.0], [1.0, 1.0, 1.0, 9.0]])
    assert B.pooled_quantiles(samples, [0.25, 0.5, 1.0]).tolist() == [[1.0, 2.0, 4.0], [1.0, 1.0, 9.0]]
    assert B.pooled_quantiles(np.zeros((0, 4)), [0.5]).shape == (0, 1)


def test_splits_add_up_to_inner_nodes(spark, matrix):
    model = RM.fit_residual(matrix, FEATURES, PARAMS, early_stop=False)
    inner = sum((t.numNodes - 1) // 2 for t in model.stages[-1].trees)
    assert sum(RM.split_counts(model, FEATURES)) == inner > 0
    table = {r["feature"]: r for r in RM.importance([model, model], FEATURES, spark).collect()}
    assert sum(r["split"] for r in table.values()) == inner and sum(r["gain"] for r in table.values()) == pytest.approx(1)


def test_cross_validation_as_one_run(spark, matrix, tmp_path):
    cv = TR.cv_centre(matrix, FEATURES, str(tmp_path / "cv"), 3, PARAMS)
    alone, _ = RM.oof_predict(matrix, FEATURES, 3, PARAMS, path=str(tmp_path / "alone"))
    key = lambda df: {(r["cell_id"], r["ts"]): r["pred_residuo"] for r in df.collect()}
    got, want = key(cv.table), key(alone)
    assert cv.table.columns == ["cell_id", "ts", "y_residuo", "pred_residuo"]
    assert len(got) == 1500 and all(got[k] == pytest.approx(want[k], abs=1.0) for k in want)
    assert cv.overall.first()["n"] == 1500 and cv.folds.count() == 3 and len(cv.models) == 3
    assert {r["estrato"] for r in cv.strata.collect()} == {"hora", "faixa_elev", "mes"}
    gains = [r["gain"] for r in cv.importance.collect()]
    assert gains == sorted(gains, reverse=True)
    with pytest.raises(ValueError):
        TR.cv_centre(matrix, FEATURES, str(tmp_path / "few"), 16, PARAMS)


def test_missing_baseline_stops_training(spark, matrix):
    absent = F.when(F.col("iy") != 3, F.col("t2m_1km")).alias("t2m_1km")
    broken = matrix.select(*[c for c in matrix.columns if c != "t2m_1km"], absent)
    with pytest.raises(Exception, match="t2m_1km is missing"):
        TR.training_rows(broken, FEATURES).collect()
    without_target = broken.withColumn("y_residuo", F.when(F.col("iy") != 3, F.col("y_residuo")))
    assert TR.training_rows(without_target, FEATURES).count() == 1400
    assert TR.training_rows(without_target, FEATURES).select("t2m_1km").collect()
    odd = matrix.withColumn("y_residuo", F.when(F.col("iy") == 1, F.lit(float("nan"))).otherwise(F.col("y_residuo")))
    assert TR.training_rows(odd, FEATURES).count() == 1400
    with pytest.raises(KeyError):
        TR.training_rows(matrix, ["absent"])


def test_report_of_the_final_fit(spark, matrix):
    band, centre = TR.fit_branches(matrix, FEATURES, ["t2m_1km"], params=PARAMS, trees=5, depth=3, min_rows=20)
    r = TR.branch_report(matrix, band, centre, ["t2m_1km"]).first()
    assert r["n_train"] == 1500 and r["crossing"] == 0 and r["t_lo_K"] == 281.0 and r["t_hi_K"] == 285.0
    assert abs(r["cob_lo"] - 0.16) < 0.05 and abs(r["cob_med"] - 0.5) < 0.05 and abs(r["cob_hi"] - 0.84) < 0.05


def test_counts_come_with_the_rows(spark):
    df = spark.createDataFrame([(1, 0, 5, 1.0), (1, 0, 6, -30.0), (2, 0, 5, 30.5), (3, 0, 5, None)], "iy INT, ix INT, ts INT, y DOUBLE")
    stack = spark.createDataFrame([(1, 0, 5, 9.0), (1, 0, 6, None), (2, 0, 5, 9.0)], "iy INT, ix INT, ts INT, f DOUBLE")
    hours, cut = Observation(), Observation()
    out = T.cut_outliers(T.attach_stack(df, stack, watch=hours), "y", 30.0, cut)
    assert out.columns == T.attach_stack(df, stack).columns and sorted(r["y"] for r in out.collect()) == [-30.0, 1.0]
    assert hours.get == {"n_found": 3, "n_lost": 1} and cut.get == {"mantidos": 2, "removidos": 1, "maior_removido": 30.5}


def test_anchor_refuses_a_repeated_increment_and_takes_odd_values_as_absent(spark):
    cells = spark.createDataFrame([(i, -1, i * 3.0, 0.0, None) for i in (-40, 0, 7, 70)], "iy INT, ix INT, x_km DOUBLE, y_km DOUBLE, z_m DOUBLE")
    net = spark.createDataFrame([("a", 1.0, 0.0, 0.0), ("b", 2.0, 0.0, 5.0)], "station STRING, x_km DOUBLE, y_km DOUBLE, z_m DOUBLE")
    field = spark.sql("SELECT explode(array(-40, 0, 7, 70, 500)) AS iy, -1 AS ix, TIMESTAMP_NTZ'2020-01-01' AS ts, 1D AS T_final")
    near = A.neighbours(cells, net, k=2)
    at = "TIMESTAMP_NTZ'2020-01-01'"
    odd = spark.sql(f"SELECT * FROM VALUES ('a', {at}, 2D), ('b', {at}, double('nan')) AS t(station, ts, inc)")
    got = {r["iy"]: r["T_final_oi"] for r in A.anchor(field, near, odd).collect()}
    assert got == {-40: -2.0, 0: -2.0, 7: -2.0, 70: -2.0, 500: 0.0}
    assert A.anchor(field, near, odd.limit(0)).filter("T_final_oi <> 0").isEmpty()
    with pytest.raises(Exception, match="two increments"):
        A.anchor(field, near, odd.filter("station = 'a'").union(odd.filter("station = 'a'"))).collect()
