"""Column expressions on timestamps. All times are naive UTC (TIMESTAMP_NTZ)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from finescale.functions.physics import ColumnLike, _c

LOCAL_OFFSET_H = -3            # fixed value: local standard time of the network
DAYS_PER_YEAR = 365.25


def to_utc(local: ColumnLike, offset_h: int = LOCAL_OFFSET_H) -> Column:
    return _c(local) - F.expr(f"INTERVAL '{offset_h}' HOUR")


def trunc(ts: ColumnLike, unit: str) -> Column:
    """``date_trunc`` that keeps the naive type."""
    return F.date_trunc(unit, _c(ts)).cast("timestamp_ntz")


def epoch_seconds(ts: ColumnLike) -> Column:
    return F.unix_timestamp(_c(ts).cast("timestamp"))


def in_window(ts: ColumnLike, start: datetime | None, end: datetime | None) -> Column:
    """Half-open ``[start, end)``; either bound may be open."""
    hit = F.lit(True)
    if start is not None:
        hit = hit & (_c(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        hit = hit & (_c(ts) < F.lit(end).cast("timestamp_ntz"))
    return hit


def encode_time(ts: ColumnLike) -> dict[str, Column]:
    """Cyclic hour-of-day and day-of-year features."""
    hour = F.hour(_c(ts)) * (2 * F.pi() / 24)
    day = F.dayofyear(_c(ts)) * (2 * F.pi() / DAYS_PER_YEAR)
    return {"hora_sin": F.sin(hour), "hora_cos": F.cos(hour),
            "doy_sin": F.sin(day), "doy_cos": F.cos(day)}


def with_time_features(df, ts: str = "ts"):
    return df.withColumns(encode_time(ts))
