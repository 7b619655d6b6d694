"""Quantile band from a regression forest: quantiles of the training target per leaf."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finescale.functions.physics import to_celsius
from finescale.models.residual import branch_names, cached, missing_policy, predict
from finescale.operators.anchoring import output_triple

ALPHAS = (0.16, 0.5, 0.84)
NAMES = ("pred_p_lo", "pred_p_med", "pred_p_hi")


@dataclass
class BandModel:
    forest: PipelineModel
    leaves: list[np.ndarray]   # per tree (leaf, point); trees * 2**depth leaves at most, whatever the rows
    features: Sequence[str]
    alphas: Sequence[float] = ALPHAS


def fit_band(df: DataFrame, features: Sequence[str], alphas: Sequence[float] = ALPHAS, trees: int = 20,
             depth: int = 8, min_rows: int = 50, seed: int = 42, accuracy: int = 10_000, points: int = 100) -> BandModel:
    """All quantiles from one regression forest on the full matrix, without routing (Meinshausen, 2006).

    The band of a row is the quantile of the pooled samples of its leaves, each tree weighing the same. A leaf may hold any number of rows,
    so its sample is kept as ``points`` values at equal steps of its distribution, from a mergeable sketch. The rank of a pooled quantile is
    thereby off by at most ``1/(2 points) + 1/accuracy``. The points are part of the model, ``trees * 2**depth * points`` numbers at most.
    """
    data, inputs = missing_policy(df, features)
    with cached(data.select(*inputs, "y_residuo")) as rows:
        return _grow(rows, inputs, list(features), alphas, trees, depth, min_rows, seed, accuracy, points)


def _grow(data: DataFrame, inputs: Sequence[str], features: Sequence[str], alphas: Sequence[float], trees: int,
          depth: int, min_rows: int, seed: int, accuracy: int, points: int) -> BandModel:
    forest = Pipeline(stages=[
        VectorAssembler(inputCols=inputs, outputCol="features"),
        RandomForestRegressor(featuresCol="features", labelCol="y_residuo", predictionCol="_mean", leafCol="_leaf",
                              numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows, seed=seed, maxBins=64)]).fit(data)
    steps = [(i + 0.5) / points for i in range(points)]
    hits = (forest.transform(data)
            .select("y_residuo", F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))
            .groupBy("tree", F.col("leaf").cast("int").alias("leaf"))
            .agg(F.percentile_approx("y_residuo", steps, accuracy).alias("q")))
    found = hits.collect()
    table = [np.full((1 + max(r["leaf"] for r in found if r["tree"] == t), points), np.nan) for t in range(trees)]
    for r in found:
        table[r["tree"]][r["leaf"]] = r["q"]
    return BandModel(forest, table, features, tuple(alphas))


def pooled_quantiles(samples: np.ndarray, alphas: Sequence[float]) -> np.ndarray:
    """Per row of ``samples`` the smallest values with at least the share ``alphas`` of the row at or below them."""
    at = [max(int(np.ceil(a * samples.shape[1] - 1e-9)) - 1, 0) for a in alphas]
    return np.partition(samples, sorted(set(at)), axis=1)[:, at]


def predict_band(df: DataFrame, model: BandModel, names: Sequence[str] = NAMES, block: int = 1024) -> DataFrame:
    """Add the quantiles: leaf samples pooled over trees, looked up in Arrow batches ``block`` rows at a time (no shuffle)."""
    data, inputs = missing_policy(df, model.features)
    leaves, alphas = model.leaves, model.alphas

    @F.pandas_udf("array<double>")
    def band(leaf: pd.Series) -> pd.Series:
        at = np.stack(leaf.to_numpy()).astype(int) if len(leaf) else np.zeros((0, len(leaves)), int)
        parts = [pooled_quantiles(np.concatenate([t[at[a:a + block, k]] for k, t in enumerate(leaves)], axis=1), alphas)
                 for a in range(0, len(at), block)]
        return pd.Series([q for part in parts for q in part])

    out = model.forest.transform(data).withColumn("_q", band(vector_to_array("_leaf")))
    out = out.withColumns({name: F.col("_q")[i] for i, name in enumerate(names)})
    return out.drop("features", "_mean", "_leaf", "_q", *inputs)


def score_branches(features_df: DataFrame, band: BandModel, centre: PipelineModel, centre_features: Sequence[str],
                   q_lo: float = 0.16, q_hi: float = 0.84) -> DataFrame:
    """Four temperatures per cell-hour, each with its ``_bc`` and ``_oi`` companions."""
    names = branch_names(q_lo, q_hi)
    scored = predict_band(predict(features_df, centre_features, centre), band)
    out = scored.select("iy", "ix", "ts", *[(to_celsius("t2m_1km") + F.col(c)).alias(names[b]) for b, c in (
        ("frio", NAMES[0]), ("meio", NAMES[1]), ("quente", NAMES[2]), ("completo", "pred_residuo"))])
    for b in names.values():
        out = output_triple(out, b)
    return out
