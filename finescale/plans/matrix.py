"""Training matrix: cell-hour observations against the features of the same cell and hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from finescale.functions.physics import residual, to_celsius
from finescale.operators.tables import assert_unique, attach_stack, collapse_cells, cut_outliers, drop_missing, to_cells
from finescale.plans.features import FEATURES_57, build_features
from finescale.sources.inventory import prune_months

KEYS = ("cell_id", "ts", "temperatura_c_qc", "n_est_cel", "T_ERA5_bilinear", "y_residuo")
OUTLIER = 10.0                # fixed value: residual cut in Celsius


class MatrixCounts:
    """Counts of a matrix while it is written: no pass of their own. Read ``figures`` after the job."""

    def __init__(self) -> None:
        self.hours, self.cut, self.rows = Observation(), Observation(), Observation()

    def coverage(self, df: DataFrame) -> DataFrame:
        return df.observe(self.rows, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
                          F.count_if(F.col("n_est_cel") > 1).alias("n_multi"))

    def figures(self) -> dict:
        return self.hours.get | self.cut.get | self.rows.get


def with_target(df: DataFrame, t_obs: str = "temperatura_c_qc", t2m: str = "t2m_1km") -> DataFrame:
    return df.withColumns({"T_ERA5_bilinear": to_celsius(t2m), "y_residuo": residual(t_obs, t2m)})


def build_matrix(obs: DataFrame, station_cell: DataFrame, dynamic: DataFrame, statics: DataFrame,
                 months: DataFrame | None = None, month_local: bool = False, outlier: float = OUTLIER,
                 expected_features: Sequence[str] | None = FEATURES_57, counts: MatrixCounts | None = None) -> DataFrame:
    """Observations collapsed to cell-hours first, then joined; residual target, outliers cut.

    ``obs``: ``station, ts`` (UTC), ``temperatura_c_qc``. Months are pruned and the features are built for cells
    with stations only; statics widen the rows last. A repeated cell-hour stops the build, since it would
    weigh twice (a check of its own over the keys of ``dynamic``). ``counts`` is filled by the first job that reads the matrix.
    """
    per_cell = collapse_cells(to_cells(prune_months(obs, months) if months is not None else obs, station_cell))
    used = station_cell.select("iy", "ix").distinct()
    dynamic = assert_unique(dynamic.join(used, ["iy", "ix"], "left_semi"), ["iy", "ix", "ts"])
    features = build_features(dynamic, statics.join(used, ["iy", "ix"], "left_semi"), month_local)
    if expected_features is not None:
        have = [c for c in features.columns if c in expected_features]
        if len(have) != len(expected_features):
            raise ValueError(f"{len(have)} feature columns, expected {len(expected_features)}; missing "
                             f"{sorted(set(expected_features) - set(have))}")
    rows = with_target(attach_stack(per_cell, features, watch=counts and counts.hours))
    kept = cut_outliers(drop_missing(rows, ["y_residuo"]), "y_residuo", outlier, counts and counts.cut)
    return kept if counts is None else counts.coverage(kept)
