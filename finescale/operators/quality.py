"""Ordered quality-control chain for station temperatures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finescale.functions.physics import VALID_FLAGS, in_range, keep_flags, to_number
from finescale.functions.time import in_window
from finescale.operators.series import MAX_ROWS, bucket_window, drop_halo, with_row_halo

# Names of the QC stages, in order.
STAGES = ("missing", "flag", "range", "spike", "stuck", "kept")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the chain; the defaults are those of the published method."""

    flags: Sequence[int] = VALID_FLAGS
    low: float = -15.0
    high: float = 45.0
    max_jump: float = 15.0
    stuck_hours: int = 6


def _jumped(value: str, window, max_jump: float) -> Column:
    return F.coalesce(F.abs(F.col(value) - F.lag(value).over(window)) > max_jump, F.lit(False))


def _same_as_previous(value: Column, window) -> Column:
    return F.coalesce(value == F.lag(value).over(window), F.lit(False)).cast("int")


def qc_spike(df: DataFrame, value: str, keys: Sequence[str] = ("station",),
             order: Sequence[str] = ("ts",), ts: str = "ts", max_jump: float = 15.0,
             unit: str | None = None) -> DataFrame:
    """NULL where the value differs from the previous *row* by more than ``max_jump``."""
    data = with_row_halo(df, keys, order, ts, rows=1, unit=unit, carry=[value])
    w = bucket_window(keys, order)
    return drop_halo(data.withColumn(value, F.when(~_jumped(value, w, max_jump), F.col(value))))


def qc_stuck(df: DataFrame, value: str, keys: Sequence[str] = ("station",),
             order: Sequence[str] = ("ts",), ts: str = "ts", hours: int = 6,
             unit: str | None = None, level: Column | None = None) -> DataFrame:
    """NULL where the last ``hours`` differences are all zero.

    The run is counted over rows, so the first ``hours`` equal values are kept. ``level``
    compares another expression of the value (for data that is never exactly equal).
    """
    carry = [value] if level is None else list(df.columns)
    data = with_row_halo(df, keys, order, ts, rows=hours, unit=unit, carry=carry)
    w = bucket_window(keys, order)
    data = data.withColumn("_same", _same_as_previous(F.col(value) if level is None else level, w))
    run = F.sum("_same").over(w.rowsBetween(-(hours - 1), 0))
    data = data.withColumn(value, F.when(run < hours, F.col(value)))
    return drop_halo(data).drop("_same")


def qc_temperature(df: DataFrame, value: str = "md_valor", flag: str = "md_final",
                   keys: Sequence[str] = ("station",), order: Sequence[str] = ("ts",),
                   ts: str = "ts", limits: Limits = Limits(), unit: str | None = None,
                   level: Column | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """All five stages in order, on the full series; adds ``temperatura_c_qc`` and ``qc_stage``.

    ``qc_stage`` names the first stage that dropped the row. ``order`` must be total. ``level``
    maps ``temperatura_c_qc`` to the quantity the stuck test compares. One pass of the chain
    needs ``stuck_hours + 1`` earlier rows, which is the halo; apply any time window afterwards
    (``in_window``), never before. Series are cut by ``unit``, or (None) by month, hot ones finer so that
    no task holds more than about ``max_rows`` rows of one series.
    """
    raw = to_number(value)
    flagged = keep_flags(raw, flag, limits.flags)
    ranged = in_range(flagged, limits.low, limits.high)
    data = df.withColumns({"temperatura_c_qc": ranged, "_early": (
        F.when(raw.isNull(), "missing").when(flagged.isNull(), "flag")
        .when(ranged.isNull(), "range"))})
    data = with_row_halo(data, keys, order, ts, rows=limits.stuck_hours + 1, unit=unit,
                         carry=["temperatura_c_qc"], max_rows=max_rows)
    w = bucket_window(keys, order)
    t = F.col("temperatura_c_qc")
    data = data.withColumn("_jump", _jumped("temperatura_c_qc", w, limits.max_jump))
    data = data.withColumn("temperatura_c_qc", F.when(~F.col("_jump"), t))
    data = data.withColumn("_same", _same_as_previous(t if level is None else level, w))
    run = F.sum("_same").over(w.rowsBetween(-(limits.stuck_hours - 1), 0))
    data = data.withColumn("_stuck", run >= limits.stuck_hours)
    stage = (F.when(F.col("_early").isNotNull(), F.col("_early"))
             .when(F.col("_jump"), "spike")
             .when(F.col("_stuck") & t.isNotNull(), "stuck").otherwise("kept"))
    data = data.withColumn("qc_stage", stage)
    data = data.withColumn("temperatura_c_qc", F.when(~F.col("_stuck"), t))
    return drop_halo(data).drop("_early", "_jump", "_same", "_stuck")


def qc_audit(df: DataFrame) -> DataFrame:
    """Rows per stage and their share; stages sum to the rows read (same rows throughout)."""
    counts = df.groupBy("qc_stage").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))    # at most six rows by now
    return counts.withColumn("pct", 100.0 * F.try_divide(F.col("n"), total))


def flag_audit(df: DataFrame, flag: str = "md_final", valid: Sequence[int] = VALID_FLAGS) -> DataFrame:
    """Rows and QC survivors per provider flag; text that is not a number is its own group."""
    number = to_number(flag)
    return (df.groupBy(F.coalesce(number.cast("int").cast("string"), F.lit("nan")).alias("flag"))
            .agg(F.count("*").alias("n"), F.count("temperatura_c_qc").alias("n_valid"))
            .withColumn("status", F.when(F.col("flag").isin([str(f) for f in valid]), "valid")
                        .otherwise("dropped")))


def coverage_counts(df: DataFrame, station: str = "station") -> DataFrame:
    return df.groupBy(station).agg(F.count("temperatura_c_qc").alias("n_valid"))


def min_coverage(df: DataFrame, n: int = 24 * 365, station: str = "station") -> DataFrame:
    """Rows of stations holding at least ``n`` valid hours (cut any window first).

    The kept stations are one small row each; the semi join leaves the hot rows in place when
    that list fits a broadcast and is split by AQE when it does not.
    """
    enough = coverage_counts(df, station).filter(F.col("n_valid") >= n).select(station)
    return df.join(enough, station, "left_semi")


def clean_observations(df: DataFrame, start: datetime | None = None, end: datetime | None = None,
                       min_hours: int | None = None, utc: str = "data_hora_utc", **qc) -> DataFrame:
    """QC on the full series, then the window, then coverage (0 hours by default in a window)."""
    windowed = start is not None or end is not None
    n = min_hours if min_hours is not None else (0 if windowed else 24 * 365)
    out = qc_temperature(df, **qc)
    if windowed:
        out = out.filter(in_window(utc, start, end))
    return min_coverage(out, n) if n > 0 else out
