"""Training runs: checked rows, cross-validation of the centre branch, final fit of all branches with its report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finescale.functions import metrics as M
from finescale.models.band import ALPHAS, NAMES, BandModel, fit_band, predict_band
from finescale.models.folds import assign_folds, require_cells
from finescale.models.residual import BoostParams, fit_folds, fit_residual, fold_diagnostics, importance, predict, score_folds
from finescale.operators.one_row import attach_row
from finescale.operators.quantiles import quantiles_wide
from finescale.operators.skill import skill_by, skill_global, with_errors, with_strata
from finescale.operators.tables import require_columns, require_not_null

BASELINE = "t2m_1km"
STRATA = ("hora", "faixa_elev", "faixa_costa", "mes")


def training_rows(matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with a finite target. A missing column stops at once; a missing baseline in a row that stays stops the job that reads it,
    since a row without baseline is a fault of the matrix and must not be dropped unseen."""
    data = require_columns(matrix, [*features, BASELINE, "cell_id", "ts", "y_residuo"])
    finite = F.col("y_residuo").isNotNull() & (F.abs("y_residuo") < float("inf"))      # NaN sorts above infinity
    bare = F.when(F.abs(BASELINE) < float("inf"), F.col(BASELINE))
    return require_not_null(data.filter(finite).withColumn(BASELINE, bare), BASELINE)


@dataclass
class CentreCV:
    """Result of ``cv_centre``; every table but ``importance`` is read from what the run has written."""

    table: DataFrame          # cell_id, ts, y_residuo, pred_residuo: drop-in for anchoring
    rows: DataFrame           # the same rows with fold, features and strata
    overall: DataFrame        # one row of skill
    strata: DataFrame         # skill by hour, elevation band, coast band and month
    folds: DataFrame          # per fold: cells, rows, errors
    importance: DataFrame     # feature, gain, split, largest gain first
    models: list[PipelineModel]


def cv_centre(matrix: DataFrame, features: Sequence[str], path: str, k: int = 10, params: BoostParams = BoostParams(),
              early_stop: bool = True, side_by_side: int = 2) -> CentreCV:
    """Leave-cell-out cross-validation of the centre branch as one run.

    The checked matrix is written once under ``path/matrix``, by fold, so that a fit reads the other folds' directories only; fits run
    ``side_by_side``. Predictions are written under ``path/oof`` and all reports read that. Nothing stays cached.
    """
    spark = matrix.sparkSession
    data = require_cells(training_rows(matrix, features), k)
    assign_folds(data, k).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("fold").parquet(f"{path}/matrix")
    folded = spark.read.parquet(f"{path}/matrix")
    models = fit_folds(folded, features, k, params, early_stop, side_by_side)
    with_strata(score_folds(folded, features, models)).write.mode("overwrite").parquet(f"{path}/oof")
    rows = spark.read.parquet(f"{path}/oof")
    errors = with_errors(rows)
    return CentreCV(rows.select("cell_id", "ts", "y_residuo", "pred_residuo"), rows, skill_global(errors),
                    skill_by(errors, [c for c in STRATA if c in rows.columns]), fold_diagnostics(rows),
                    importance(models, features, spark).orderBy(F.col("gain").desc(), "feature"), models)


def fit_branches(matrix: DataFrame, band_features: Sequence[str], centre_features: Sequence[str], alphas: Sequence[float] = ALPHAS,
                 params: BoostParams = BoostParams(), early_stop: bool = False, **forest: int) -> tuple[BandModel, PipelineModel]:
    """Final fit on all rows: the quantile band and the centre."""
    data = training_rows(matrix, dict.fromkeys([*band_features, *centre_features]))
    return fit_band(data, band_features, alphas, **forest), fit_residual(data, centre_features, params, early_stop)


def branch_report(matrix: DataFrame, band: BandModel, centre: PipelineModel, centre_features: Sequence[str]) -> DataFrame:
    """One row on the rows of the fit: per quantile the share of targets at or below it and its pinball loss, the share of crossings, the
    centre's errors, and the baseline's temperatures (K) at the outer levels."""
    data = predict_band(predict(training_rows(matrix, dict.fromkeys([*band.features, *centre_features])), centre_features, centre), band)
    e, y = F.col("pred_residuo") - F.col("y_residuo"), F.col("y_residuo")
    tails = [c for q, a, n in zip(NAMES, band.alphas, ("lo", "med", "hi"))
             for c in (F.avg((y <= F.col(q)).cast("double")).alias(f"cob_{n}"), M.pinball("y_residuo", q, a).alias(f"pinball_{n}"))]
    row = data.agg(F.count("*").alias("n_train"), *tails, M.crossing_share(*NAMES).alias("crossing"),
                   M.mae(e).alias("mae"), M.rmse(e).alias("rmse"), M.mean_error(e).alias("bias"))
    return attach_row(row, quantiles_wide(matrix, BASELINE, {"t_lo_K": band.alphas[0], "t_hi_K": band.alphas[-1]}))
