"""Folds, out-of-fold scoring, bands and scored fields.

SQL cannot grow trees, so fits are rows-only; beside each stands a query over its rows whose answer SQL does know. Rounds, depth and
folds are bounded here, since one machine grows the trees of every check: ROUNDS and FOLDS are the documented parameters of that.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import OBS_CELL_SQL, cells, check, obs_cell, r6, rounded, table
from checks.fields import BILINEAR_SQL, MATRIX_SQL, matrix
from checks.sinks import scratch
from finescale.models import band as B
from finescale.models import folds as FO
from finescale.models import residual as RM
from finescale.operators.one_row import attach_row
from finescale.plans import training as TR
from finescale.plans.field import anchored_field, score_field
from finescale.plans.matrix import MatrixCounts
from finescale.session import kept

ROUNDS, FOLDS = 5, 3
PARAMS = RM.BoostParams(rounds=ROUNDS, rate=0.3, depth=4, min_rows=20, features="all", rows=0.8, bins=64)
FEATURES = ["t2m_1km", "dt2m_1h", "d2t2m_1h", "hora_sin", "hora_cos", "z_alvo", "tri_mean_1km"]


def _rows(spark, d):
    """Rows for models, written once: a fit, its folds and its report read them many times, and nothing else of the matrix."""
    return kept(matrix(spark, d).select("iy", "ix", "ts", "cell_id", "y_residuo", *FEATURES), "matrix")


@check("fold_assignment", """
  WITH c AS (SELECT o_custkey AS cell_id, count(*) AS n FROM orders GROUP BY 1),
  b AS (SELECT *, length(bin(n)) AS bits, n >> greatest(length(bin(n)) - 4, 0) AS top, substr(md5(CAST(cell_id AS VARCHAR)), 1, 1) AS h FROM c),
  p AS (SELECT *, row_number() OVER (ORDER BY bits DESC, top DESC, h, n DESC, cell_id) - 1 AS p FROM b)
  SELECT cell_id, n, CAST(CASE WHEN floor(p / 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INTEGER) AS fold FROM p""")
def fold_assignment(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("cell_id"))
    return FO.assign_folds(o, 5).groupBy("cell_id", "fold").agg(F.count("*").alias("n"))


@check("early_stop_cells", """
  WITH c AS (SELECT DISTINCT o_custkey AS cell_id FROM orders),
  p AS (SELECT *, row_number() OVER (ORDER BY md5('42_' || cell_id), cell_id) - 1 AS p, count(*) OVER () AS n FROM c)
  SELECT o_orderkey, o_custkey AS cell_id, p < greatest(round_even(0.2 * n, 0), 1) AS holdout FROM orders JOIN p ON p.cell_id = o_custkey""")
def early_stop_cells(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cell_id"))
    return FO.carve_holdout(o, 0.2, 42)


@check("missing_policy", f"""WITH {OBS_CELL_SQL}
  SELECT iy, ix, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN n_est_cel > 1 THEN CAST(n_est_cel AS DOUBLE) END AS n, COALESCE(CASE WHEN n_est_cel > 1
         THEN CAST(n_est_cel AS DOUBLE) END, -9999.0) AS x_n, CASE WHEN n_est_cel > 1 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS m_n FROM obs_cell""")
def missing_policy(spark, d):
    o = obs_cell(spark, d).select("iy", "ix", "ts", F.when(F.col("n_est_cel") > 1, F.col("n_est_cel").cast("double")).alias("n"))
    return RM.missing_policy(o, ["n"])[0]


@check("gbt_out_of_fold")
def gbt_out_of_fold(spark, d):
    oof, _ = RM.oof_predict(_rows(spark, d), FEATURES, FOLDS, PARAMS)
    return oof.select("cell_id", "ts", "y_residuo", "pred_residuo", "fold")


@check("gbt_fold_diagnostics")
def gbt_fold_diagnostics(spark, d):
    m = _rows(spark, d)
    oof, models = RM.oof_predict(m, FEATURES, FOLDS, PARAMS)
    return RM.fold_diagnostics(oof).join(RM.fit_diagnostics(m, FEATURES, models, FOLDS), "fold")


@check("gbt_importance")
def gbt_importance(spark, d):
    from finescale.operators.skill import top_features
    model = RM.fit_residual(_rows(spark, d), FEATURES, PARAMS, early_stop=False)
    return top_features(RM.importance([model], FEATURES, spark), 12)


def _grid(spark, d):
    """Scored and anchored field of every grid cell at every hour that the coarse table holds."""
    from checks.fields import _fine, _statics
    m = _rows(spark, d)
    model = RM.fit_residual(m, FEATURES, PARAMS, early_stop=False)
    stack = _fine(spark, d).select("iy", "ix", "ts", F.col("t2m").alias("t2m_1km"))
    field = score_field(stack, _statics(spark, d), FEATURES, model, cells(spark, d))
    inc = m.groupBy(F.concat_ws("_", "iy", "ix").alias("station"), "ts").agg((F.avg("y_residuo") / -2).alias("inc"))
    stations = cells(spark, d).join(m.select("iy", "ix").distinct(), ["iy", "ix"]).select(
        F.concat_ws("_", "iy", "ix").alias("station"), "x_km", "y_km", "z_m")
    return anchored_field(field, cells(spark, d), inc, stations, k=5)


@check("grid_score_anchored")
def grid_score_anchored(spark, d):
    return _grid(spark, d)


@check("grid_score_structure", f"""WITH {BILINEAR_SQL}
  SELECT count(*) AS n, count(DISTINCT (iy, ix)) AS cells, count(DISTINCT ts) AS hours, 0 AS no_prediction, 0 AS not_a_sum, TRUE AS some_corrected FROM fine""")
def grid_score_structure(spark, d):
    f = _grid(spark, d)
    # a cell without a baseline has none after scoring either
    return f.agg(F.count("*").alias("n"), F.count_distinct("iy", "ix").alias("cells"), F.count_distinct("ts").alias("hours"),
                 F.count_if(F.col("t2m_1km").isNotNull() & F.col("T_final").isNull()).alias("no_prediction"),
                 F.count_if(F.abs(F.col("T_final") - F.col("T_final_bc") - F.col("T_final_oi")) > 1e-9).alias("not_a_sum"),
                 (F.count_if(F.col("T_final_oi") != 0) > 0).alias("some_corrected"))


@check("oof_structure", f"""WITH {MATRIX_SQL}
  SELECT count(*) AS n, count(DISTINCT cell_id) AS cells, {FOLDS} AS folds, 0 AS cells_in_two_folds, 0 AS no_prediction, TRUE AS unlike_target FROM mat""")
def oof_structure(spark, d):
    oof, _ = RM.oof_predict(_rows(spark, d), FEATURES, FOLDS, PARAMS)
    per = oof.groupBy("cell_id").agg(F.count("*").alias("n"), F.min("fold").alias("a"), F.max("fold").alias("z"), F.count_if(F.col("pred_residuo").isNull()).alias("none"),
                                     F.sum(F.pow(F.col("pred_residuo") - F.col("y_residuo"), 2)).alias("e"))
    return per.agg(F.sum("n").alias("n"), F.count("*").alias("cells"), F.count_distinct("a").cast("int").alias("folds"), F.count_if(F.col("a") != F.col("z")).alias("cells_in_two_folds"),
                   F.sum("none").alias("no_prediction"), (F.sum("e") > 0).alias("unlike_target"))


@check("fold_fit_structure", f"""WITH {MATRIX_SQL} SELECT unnest(range({FOLDS})) AS fold, {ROUNDS} AS best_iter, count(*) AS n_all, TRUE AS finite FROM mat""")
def fold_fit_structure(spark, d):
    m = _rows(spark, d)
    oof, models = RM.oof_predict(m, FEATURES, FOLDS, PARAMS, early_stop=False)
    both = RM.fold_diagnostics(oof).join(RM.fit_diagnostics(m, FEATURES, models, FOLDS), "fold")
    total = both.agg(F.sum("n").alias("n_all"))
    return attach_row(both, total).select(F.col("fold").cast("bigint").alias("fold"), "best_iter", "n_all",
                                          (F.col("mae_fit").isNotNull() & F.col("rmse_down").isNotNull() & (F.col("mae_fit") <= F.col("mae") * 1.2)).alias("finite"))


@check("importance_structure", f"""SELECT feature, TRUE AS in_range, TRUE AS sums_to_one FROM (VALUES {', '.join(f"('{f}')" for f in FEATURES)}) AS t(feature)""")
def importance_structure(spark, d):
    """Mean over the fold models."""
    _, models = RM.oof_predict(_rows(spark, d), FEATURES, FOLDS, PARAMS)
    gain = RM.importance(models, FEATURES, spark)
    return attach_row(gain, gain.agg(F.sum("gain").alias("_all"))).select(
        "feature", F.col("gain").between(0, 1).alias("in_range"), (F.abs(F.col("_all") - 1) < 1e-6).alias("sums_to_one"))


@check("split_counts_structure", f"SELECT {FOLDS} AS models, TRUE AS adds_up, TRUE AS some_split")
def split_counts_structure(spark, d):
    """Splits per feature add up to the inner nodes of all trees of every fold's model."""
    _, models = RM.oof_predict(_rows(spark, d), FEATURES, FOLDS, PARAMS)
    inner = sum((t.numNodes - 1) // 2 for m in models for t in m.stages[-1].trees)
    total = RM.importance(models, FEATURES, spark).agg((F.sum("split") * len(models)).alias("s"))
    return total.select(F.lit(len(models)).alias("models"), (F.abs(F.col("s") - inner) < 1e-6).alias("adds_up"), (F.col("s") > 0).alias("some_split"))


def _cv(spark, d):
    return TR.cv_centre(_rows(spark, d), FEATURES, scratch(spark, "cv"), FOLDS, PARAMS)


@check("cv_centre_table", f"""WITH {MATRIX_SQL} SELECT cell_id, ts, {r6('y_residuo')} AS y_residuo, TRUE AS predicted FROM mat""")
def cv_centre_table(spark, d):
    out = _cv(spark, d).table
    return rounded(out.withColumn("predicted", F.col("pred_residuo").isNotNull()).drop("pred_residuo"), only=["y_residuo"])


# what a report says about the baseline needs no model, so SQL knows it
@check("cv_centre_strata", f"""WITH {MATRIX_SQL},
  s AS (SELECT y_residuo AS y, 'hora' AS estrato, CAST(hour(ts) AS VARCHAR) AS grupo FROM mat
        UNION ALL SELECT y_residuo, 'mes', CAST(month(ts) AS VARCHAR) FROM mat
        UNION ALL SELECT y_residuo, 'faixa_elev', CASE WHEN z_alvo <= 200 THEN '0-200' WHEN z_alvo <= 500 THEN '200-500' WHEN z_alvo <= 1000 THEN '500-1000' ELSE '>1000' END
                  FROM mat WHERE z_alvo >= 0)
  SELECT estrato, grupo, count(*) AS n, {r6('sqrt(avg(y * y))')} AS rmse_era5, {r6('avg(abs(y))')} AS mae_era5, TRUE AS better FROM s GROUP BY 1, 2""")
def cv_centre_strata(spark, d):
    out = _cv(spark, d).strata
    return rounded(out.select("estrato", "grupo", "n", "rmse_era5", "mae_era5", (F.col("rmse_down").isNotNull() & (F.col("ss") <= 1)).alias("better")), only=["rmse_era5", "mae_era5"])


@check("matrix_counts_on_write", f"""WITH {MATRIX_SQL.replace('<= 60', '<= 1e9')}
  SELECT count(*) AS n_found, (SELECT count(*) FROM obs_cell) - count(*) AS n_lost, count(*) FILTER (abs(y_residuo) <= 30) AS mantidos,
         count(*) FILTER (abs(y_residuo) > 30) AS removidos, {r6('max(abs(y_residuo)) FILTER (abs(y_residuo) > 30)')} AS maior_removido,
         count(*) FILTER (abs(y_residuo) <= 30) AS n_rows, count(*) FILTER (abs(y_residuo) <= 30 AND n_est_cel > 1) AS n_multi,
         count(*) FILTER (abs(y_residuo) <= 30 AND dt2m_1h IS NULL) AS null_dt2m_1h, count(*) FILTER (abs(y_residuo) <= 30 AND z_alvo IS NULL) AS null_z_alvo FROM mat""")
def matrix_counts_on_write(spark, d):
    """All counts come from the one job that writes the matrix."""
    counts = MatrixCounts()
    matrix(spark, d, counts, outlier=30.0).write.parquet(scratch(spark, "matrix"))
    figures = counts.figures()
    names = ("n_found", "n_lost", "mantidos", "removidos", "n_rows", "n_multi", "null_dt2m_1h", "null_z_alvo")
    top = figures["maior_removido"]
    return rounded(spark.createDataFrame([(*[figures[n] for n in names], None if top is None else float(top))],
                                         ", ".join(f"{n} BIGINT" for n in names) + ", maior_removido DOUBLE"))


@check("branch_report", f"""WITH {MATRIX_SQL}
  SELECT count(*) AS n_train, 0 AS crossing, {r6('quantile_cont(T_ERA5_bilinear + 273.15, 0.16)')} AS "t_lo_K", {r6('quantile_cont(T_ERA5_bilinear + 273.15, 0.84)')} AS "t_hi_K",
         TRUE AS calibrated, TRUE AS centre_fits FROM mat""")
def branch_report(spark, d):
    """Shares below the quantiles lie within 0.05 of their levels on the rows of the fit; the centre beats the baseline there."""
    m = _rows(spark, d)
    band, centre = TR.fit_branches(m, FEATURES, FEATURES, params=PARAMS, trees=8, depth=5, min_rows=20)
    r = attach_row(TR.branch_report(m, band, centre, FEATURES), m.agg(F.sqrt(F.avg(F.col("y_residuo") * F.col("y_residuo"))).alias("_base")))
    near = lambda c, a: F.abs(F.col(c) - a) < 0.05
    return rounded(r.select("n_train", F.col("crossing").cast("int").alias("crossing"), "t_lo_K", "t_hi_K",
                            (near("cob_lo", 0.16) & near("cob_med", 0.5) & near("cob_hi", 0.84)).alias("calibrated"),
                            (F.col("rmse") < F.col("_base")).alias("centre_fits")), only=["t_lo_K", "t_hi_K"])


@check("forest_held_out")
def forest_held_out(spark, d):
    """Shares of the target below each quantile on a fifth of the cells, which the fit has not seen: figures, no verdict."""
    m = FO.carve_holdout(_rows(spark, d), 0.2, 42)
    model = B.fit_band(m.filter("NOT holdout"), FEATURES, trees=8, depth=5, min_rows=20)
    return B.predict_band(m.filter("holdout"), model).agg(
        F.count("*").alias("n"), F.count_distinct("cell_id").alias("cells"),
        *[F.avg((F.col("y_residuo") <= F.col(q)).cast("double")).alias(n) for q, n in zip(B.NAMES, ("cob_lo", "cob_med", "cob_hi"))])


@check("band_structure", f"""WITH {MATRIX_SQL}
  SELECT count(*) AS n, 0 AS missing, 0 AS out_of_order, TRUE AS low_covers, TRUE AS mid_covers, TRUE AS high_covers FROM mat""")
def band_structure(spark, d):
    """Shares of the target below each quantile lie within 0.1 of its level, on the rows of the fit."""
    m = _rows(spark, d)
    b = B.predict_band(m, B.fit_band(m, FEATURES, trees=8, depth=5, min_rows=20))
    lo, mid, hi = (F.col(c) for c in B.NAMES)
    covers = lambda q, level: (F.abs(F.avg((F.col("y_residuo") <= q).cast("double")) - level) < 0.1)
    return b.agg(F.count("*").alias("n"), F.count_if(lo.isNull() | mid.isNull() | hi.isNull()).alias("missing"), F.count_if((lo > mid) | (mid > hi)).alias("out_of_order"),
                 covers(lo, 0.16).alias("low_covers"), covers(mid, 0.5).alias("mid_covers"), covers(hi, 0.84).alias("high_covers"))


@check("forest_band")
def forest_band(spark, d):
    m = _rows(spark, d)
    band = B.fit_band(m, FEATURES, trees=8, depth=5, min_rows=20)
    return B.predict_band(m, band).select("cell_id", "ts", "y_residuo", *B.NAMES)


@check("branch_fields")
def branch_fields(spark, d):
    m = _rows(spark, d)
    band = B.fit_band(m, FEATURES, trees=8, depth=5, min_rows=20)
    centre = RM.fit_residual(m, FEATURES, PARAMS, early_stop=False)
    return B.score_branches(m, band, centre, FEATURES)
