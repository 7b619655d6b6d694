"""Aggregate expressions for error, skill, pinball loss and coverage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from finescale.functions.physics import ColumnLike, _c


def mae(err: ColumnLike) -> Column:
    return F.avg(F.abs(_c(err)))


def rmse(err: ColumnLike) -> Column:
    return F.sqrt(F.avg(_c(err) * _c(err)))


def mean_error(err: ColumnLike) -> Column:
    return F.avg(_c(err))


def error_metrics(err: ColumnLike, suffix: str = "") -> list[Column]:
    """``mae, rmse, me, n`` over the non-missing errors."""
    return [mae(err).alias("mae" + suffix), rmse(err).alias("rmse" + suffix),
            mean_error(err).alias("me" + suffix), F.count(_c(err)).alias("n" + suffix)]


def skill_score(err: ColumnLike, base: ColumnLike) -> Column:
    """``1 - rmse(err) / rmse(base)``; NULL when the baseline is perfect or absent."""
    return 1.0 - F.try_divide(rmse(err), rmse(base))


def pinball(y: ColumnLike, q: ColumnLike, alpha: float) -> Column:
    e = _c(y) - _c(q)
    return F.avg(F.greatest(F.lit(alpha) * e, F.lit(alpha - 1.0) * e))


def share(condition: Column) -> Column:
    """Fraction of rows where ``condition`` holds; NULL counts as not holding."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def coverage_metrics(y: ColumnLike, lo: ColumnLike, med: ColumnLike, hi: ColumnLike) -> list[Column]:
    """Share of observations under each quantile and inside the band, and the mean width."""
    y, lo, med, hi = _c(y), _c(lo), _c(med), _c(hi)
    return [F.count(y).alias("n"), share(y <= lo).alias("cob_lo"), share(y <= med).alias("cob_med"),
            share(y <= hi).alias("cob_hi"), share((y >= lo) & (y <= hi)).alias("cob_int"),
            F.avg(hi - lo).alias("larg")]


def crossing_share(lo: ColumnLike, med: ColumnLike, hi: ColumnLike) -> Column:
    return share((_c(lo) > _c(med)) | (_c(med) > _c(hi)))


def sort_band(*quantiles: ColumnLike) -> list[Column]:
    """The quantiles of one row in ascending order (repairs crossings)."""
    ordered = F.array_sort(F.array(*[_c(q) for q in quantiles]))
    return [ordered[i] for i in range(len(quantiles))]
