"""Residual regression with Spark ML trees: out-of-fold scoring, final fit, grid scoring."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finescale.functions import metrics as M
from finescale.functions.physics import DRY_LAPSE, to_celsius
from finescale.models.folds import assign_folds, carve_holdout, require_cells

SENTINEL = -9999.0


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` kept in memory and on disk while a fit runs over it."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


@dataclass(frozen=True)
class BoostParams:
    """Spark ML settings in the place of the published booster settings (L2 objective)."""

    rounds: int = 200
    rate: float = 0.02
    depth: int = 6               # 64 leaves
    min_rows: int = 500
    features: str = "0.8"
    rows: float = 0.7
    bins: int = 127
    tolerance: float = 0.01
    seed: int = 42


def missing_policy(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Trees here refuse missing values: a sentinel far outside the data plus an indicator column.

    A split below every real value then routes missing rows to one side, and the indicator lets a
    tree treat them apart.
    """
    filled = {f"x_{f}": F.coalesce(F.col(f).cast("double"), F.lit(SENTINEL)) for f in features}
    flags = {f"m_{f}": F.col(f).isNull().cast("double") for f in features}
    return df.withColumns(filled | flags), [*filled, *flags]


def _pipeline(inputs: Sequence[str], params: BoostParams, validation: bool) -> Pipeline:
    tree = GBTRegressor(featuresCol="features", labelCol="y_residuo", predictionCol="pred_residuo",
                        maxIter=params.rounds, stepSize=params.rate, maxDepth=params.depth,
                        minInstancesPerNode=params.min_rows, featureSubsetStrategy=params.features,
                        subsamplingRate=params.rows, maxBins=params.bins, seed=params.seed,
                        validationTol=params.tolerance, maxMemoryInMB=512)
    if validation:
        tree = tree.setValidationIndicatorCol("holdout")
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="features"), tree])


def fit_residual(df: DataFrame, features: Sequence[str], params: BoostParams = BoostParams(),
                 early_stop: bool = True) -> PipelineModel:
    """Fit on all rows of ``df``; with ``early_stop`` a fifth of the cells only guides stopping."""
    data, inputs = missing_policy(df, features)
    if early_stop:
        data = carve_holdout(data, 0.2, params.seed)
    keep = [*inputs, "y_residuo", *(["holdout"] if early_stop else [])]
    with cached(data.select(*keep)) as rows:            # boosting passes over the rows once per level
        return _pipeline(inputs, params, early_stop).fit(rows)


def predict(df: DataFrame, features: Sequence[str], model: PipelineModel, name: str = "pred_residuo") -> DataFrame:
    data, inputs = missing_policy(df, features)
    out = model.transform(data).drop("features", *inputs)
    return out if name == "pred_residuo" else out.withColumnRenamed("pred_residuo", name)


def fit_folds(folded: DataFrame, features: Sequence[str], k: int, params: BoostParams = BoostParams(), early_stop: bool = True,
              side_by_side: int = 1) -> list[PipelineModel]:
    """The model of every fold, which never saw its rows; ``side_by_side`` fits share the cluster at a time."""
    def fit(fold: int) -> PipelineModel:
        return fit_residual(folded.filter(F.col("fold") != fold), features, params, early_stop)

    with ThreadPoolExecutor(max(side_by_side, 1)) as pool:
        return list(pool.map(fit, range(k)))


def score_folds(folded: DataFrame, features: Sequence[str], models: Sequence[PipelineModel]) -> DataFrame:
    """Each row with the prediction of its fold's model; a row without one is an error."""
    parts = [predict(folded.filter(F.col("fold") == fold), features, model) for fold, model in enumerate(models)]
    bad = F.raise_error(F.lit("a row has no out-of-fold prediction")).cast("double")
    return reduce(DataFrame.unionByName, parts).withColumn("pred_residuo", F.coalesce("pred_residuo", bad))


def oof_predict(df: DataFrame, features: Sequence[str], k: int = 10, params: BoostParams = BoostParams(),
                early_stop: bool = True, path: str | None = None) -> tuple[DataFrame, list[PipelineModel]]:
    """Each row scored by the model that never saw its cell: ``(rows with pred_residuo and fold, models)``.

    The loop is over folds only; every fit and every transform is distributed. Fits and scores read the matrix
    with its folds many times: from ``path``, where it is written, or else from the cache, which stays until the
    caller clears it, since the rows returned are read from it.
    """
    require_cells(df, k)
    folded = assign_folds(df, k)
    if path is not None:
        folded.write.mode("overwrite").parquet(path)
        folded = df.sparkSession.read.parquet(path)
    else:
        folded.persist()
    models = fit_folds(folded, features, k, params, early_stop)
    return score_folds(folded, features, models), models


def split_counts(model: PipelineModel, features: Sequence[str]) -> list[int]:
    """How many inner nodes of the model's trees ask for each feature or for its indicator."""
    asked = [int(i) for i in re.findall(r"If \(feature (\d+) ", model.stages[-1].toDebugString)]
    return [sum(i % len(features) == f for i in asked) for f in range(len(features))]


def importance(models: Sequence[PipelineModel], features: Sequence[str], spark: SparkSession) -> DataFrame:
    """``(feature, gain, split)``: gain share and number of splits averaged over fold models, indicator columns added to theirs."""
    rows = []
    for fold, m in enumerate(models):
        gains, splits = m.stages[-1].featureImportances.toArray(), split_counts(m, features)
        rows += [(fold, f, float(gains[i] + gains[len(features) + i]), splits[i]) for i, f in enumerate(features)]
    table = spark.createDataFrame(rows, "fold INT, feature STRING, gain DOUBLE, split BIGINT")
    return table.groupBy("feature").agg(F.avg("gain").alias("gain"), F.avg("split").alias("split"))


def fold_diagnostics(oof: DataFrame) -> DataFrame:
    """Per fold: cells, rows, baseline and model error, skill."""
    e, b = F.col("pred_residuo") - F.col("y_residuo"), -F.col("y_residuo")
    return oof.groupBy("fold").agg(F.count_distinct("cell_id").alias("cells"), F.count("*").alias("n"),
                                   M.rmse(b).alias("rmse_era5"), M.rmse(e).alias("rmse_down"),
                                   M.mae(e).alias("mae"), M.mean_error(e).alias("bias"), M.skill_score(e, b).alias("ss"))


def fit_diagnostics(df: DataFrame, features: Sequence[str], models: Sequence[PipelineModel], k: int = 10) -> DataFrame:
    """In-sample error per fold model and its number of trees (overfit check)."""
    folded, out = assign_folds(df, k), None
    for fold, m in enumerate(models):
        tree: GBTRegressionModel = m.stages[-1]
        e = F.col("pred_residuo") - F.col("y_residuo")
        row = (predict(folded.filter(F.col("fold") != fold), features, m)
               .agg(M.mae(e).alias("mae_fit"), M.mean_error(e).alias("bias_fit"))
               .select(F.lit(fold).alias("fold"), F.lit(tree.getNumTrees).alias("best_iter"), "mae_fit", "bias_fit"))
        out = row if out is None else out.unionByName(row)
    return out


def save_model(model: PipelineModel, path: str, features: Sequence[str], params: BoostParams = BoostParams()) -> None:
    """Model folder plus a one-line JSON record of what scoring needs."""
    model.write().overwrite().save(f"{path}/model")
    record = {"features": list(features), "target": "y_residuo", "baseline": "t2m_1km", "lapse_rate": DRY_LAPSE,
              "best_iteration": model.stages[-1].getNumTrees, "params": asdict(params)}
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(record),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/meta").first()["value"])


def score_grid(features_df: DataFrame, features: Sequence[str], model: PipelineModel) -> DataFrame:
    """``(iy, ix, ts, t2m_1km, pred_residuo, T_final)``: baseline in Celsius plus predicted residual."""
    return (predict(features_df, features, model)
            .select("iy", "ix", "ts", "t2m_1km", "pred_residuo",
                    (to_celsius("t2m_1km") + F.col("pred_residuo")).alias("T_final")))


def branch_names(q_lo: float = 0.16, q_hi: float = 0.84) -> dict[str, str]:
    """Output variable of each branch."""
    lo, hi = round(q_lo * 100), round(q_hi * 100)
    return {"frio": f"t2m_p{lo}", "meio": f"t2m_p{lo}a{hi}", "quente": f"t2m_p{hi}", "completo": "t2m"}
