"""Consistency gates: every check is one row ``(gate, n_bad, ok)``; stop on any failure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finescale.functions.physics import ColumnLike, _c
from finescale.functions.utm import lonlat_to_utm
from finescale.operators.grid import Axes, containing_cell

# Physical range per static layer.
RANGES = {
    "svf_mean_1km": (0.0, 1.0), "svf_p10_1km": (0.0, 1.0),
    "northness_mean_1km": (-1.0, 1.0), "eastness_mean_1km": (-1.0, 1.0),
    "slope_mean_1km": (0.0, 90.0), "slope_max_1km": (0.0, 90.0),
    "mrvbf_p90_1km": (0.0, 10.0),
    "hand_mean_1km": (0.0, 3000.0), "hand_p10_1km": (0.0, 3000.0),
    "z_std_1km": (0.0, 1000.0),
    "dist_oceano": (0.0, 1.0e6),
}
SLACK = 1e-3


def _gate(name: str, bad: DataFrame) -> DataFrame:
    return bad.select(F.lit(name).alias("gate"), F.col("n_bad").cast("bigint").alias("n_bad"),
                      (F.col("n_bad") == 0).alias("ok"))


def differs(a: ColumnLike, b: ColumnLike, tol: float = 1e-9) -> Column:
    """True unless both are missing or they agree within ``tol``."""
    x, y = _c(a), _c(b)
    return ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tol, F.lit(False)))


def gate_static_ranges(statics: DataFrame, ranges: dict = RANGES, slack: float = SLACK) -> DataFrame:
    """``(camada, v_min, v_max, ok)`` of every ranged layer present, in one pass; a layer without any value fails."""
    layers = [c for c in statics.columns if c in ranges]
    row = statics.agg(*[f(c).alias(f"{c}__{n}") for c in layers for n, f in (("lo", F.min), ("hi", F.max))])
    cells = F.array(*[F.struct(F.lit(c).alias("camada"), F.col(f"{c}__lo").alias("v_min"), F.col(f"{c}__hi").alias("v_max"),
                               F.lit(ranges[c][0]).alias("lo"), F.lit(ranges[c][1]).alias("hi")) for c in layers])
    out = row.select(F.explode(cells).alias("_r")).select("_r.*")
    ok = (F.col("v_min") >= F.col("lo") - slack) & (F.col("v_max") <= F.col("hi") + slack)
    return out.select("camada", "v_min", "v_max", F.coalesce(ok, F.lit(False)).alias("ok"))


def gate_on_grid(layer: DataFrame, grid: DataFrame, name: str = "grid_keys") -> DataFrame:
    """Cells of one that the other lacks, in both directions (one full join on the key)."""
    a = layer.groupBy("iy", "ix").agg(F.lit(1).alias("_a"))
    b = grid.groupBy("iy", "ix").agg(F.lit(1).alias("_b"))
    return _gate(name, a.join(b, ["iy", "ix"], "full")
                 .agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_bad")))


def gate_reprojection(stations: DataFrame, tol_m: float = 1e-3) -> DataFrame:
    """Stored projected coordinates are reproduced within a millimetre."""
    x, y = lonlat_to_utm("longitude", "latitude")
    gap = F.sqrt((x - F.col("x_utm")) * (x - F.col("x_utm")) + (y - F.col("y_utm")) * (y - F.col("y_utm")))
    return _gate("reprojection", stations.agg(F.count_if(~(gap <= tol_m)).alias("n_bad")))


def gate_train_equals_inference(train: DataFrame, infer: DataFrame, keys: Sequence[str],
                                values: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Values read for training equal those read for scoring, missing matching missing. A row on one side only is bad, too."""
    b = infer.select(*keys, *[F.col(v).alias("_b_" + v) for v in values], F.lit(True).alias("_in_b"))
    a = train.select(*keys, *values, F.lit(True).alias("_in_a"))
    bad = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    for v in values:
        bad = bad | differs(v, "_b_" + v, tol)
    return _gate("train_equals_inference", a.join(b, list(keys), "full")
                 .agg(F.count_if(bad).alias("n_bad")))


def gate_same_cell(stations: DataFrame, axes: Axes, x: str = "x_utm", y: str = "y_utm") -> DataFrame:
    """The stored cell is the one the axes give."""
    again = containing_cell(stations.withColumnsRenamed({"iy": "_iy", "ix": "_ix"}), axes, x, y)
    return _gate("same_cell", again.agg(F.count_if((F.col("iy") != F.col("_iy")) | (F.col("ix") != F.col("_ix"))).alias("n_bad")))


def gate_fractions(df: DataFrame, n: int = 8) -> DataFrame:
    """Exactly the fraction columns 1..n are present."""
    want = {f"fracao_t{i}" for i in range(1, n + 1)}
    have = {c for c in df.columns if c.startswith("fracao_t")}
    return _gate("fraction_columns", df.sparkSession.range(1).select(F.lit(len(want ^ have)).alias("n_bad")))


def missing_baseline(stations: DataFrame, stack: DataFrame, at: str, t2m: str = "t2m_1km") -> DataFrame:
    """Stations whose cell has no baseline at the hour ``at`` (a diagnostic, not a gate)."""
    hour = stack.filter(F.col("ts") == F.lit(at).cast("timestamp_ntz")).select("iy", "ix", t2m)
    return (stations.join(hour, ["iy", "ix"], "left").filter(F.col(t2m).isNull())
            .select("station", "longitude", "latitude", "iy", "ix", F.lit("era5_t2m_nan_estrutural").alias("motivo")))


def gate_report(gates: Sequence[DataFrame]) -> DataFrame:
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out


def stop_on_failure(report: DataFrame) -> DataFrame:
    """Return the report; raise when a gate failed (a few rows, one per gate)."""
    failed = [r["gate"] for r in report.filter(~F.col("ok")).collect()]
    if failed:
        raise ValueError(f"gates failed: {failed}")
    return report
