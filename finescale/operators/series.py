"""Windows over long ordered series without putting one whole series in one task.

A station (or cell) can hold a large share of all rows, so a window partitioned by station
alone would be one unbounded task. Here a series is cut into calendar buckets; each bucket
receives a small *halo* of the rows just before it, the window runs per (series, bucket), and
the halo rows are dropped. The result equals the window over the uncut series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finescale.functions.physics import ColumnLike, _c
from finescale.functions.time import epoch_seconds, trunc

BUCKET, HALO = "_bucket", "_halo"


# units a hot series is cut into, with the hours each spans at most
UNITS = (("month", 744.0), ("day", 24.0), ("hour", 1.0), ("minute", 1 / 60), ("second", 1 / 3600))
MAX_ROWS = 1_000_000


def hot_units(df: DataFrame, keys: Sequence[str], ts: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """``(keys, _unit)`` of the series with more than ``max_rows`` rows: the unit that keeps buckets smaller.

    At most (all rows / max_rows) series can be listed. Only they are counted by the hour.
    """
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > max_rows).select(*keys)
    busiest = (df.select(*keys, trunc(ts, "hour").alias("_hour")).join(hot, list(keys), "left_semi")
               .groupBy(*keys, "_hour").agg(F.count("*").alias("_n"))
               .groupBy(*keys).agg(F.max("_n").alias("_busy")))
    unit = None
    for name, hours in UNITS:
        fits = F.col("_busy") * hours <= max_rows
        unit = F.when(fits, name) if unit is None else unit.when(fits, name)
    return busiest.select(*keys, unit.otherwise("second").alias("_unit"))


def with_bucket(df: DataFrame, keys: Sequence[str], ts: str, unit: str | None = None,
                max_rows: int = MAX_ROWS) -> DataFrame:
    """Add ``_bucket``: a fixed ``unit``, or months with hot series cut as finely as they need."""
    if unit is not None:
        return df.withColumn(BUCKET, trunc(ts, unit))
    units = hot_units(df, keys, ts, max_rows)                        # rows / max_rows keys at most
    return (df.join(units, list(keys), "left")
            .withColumn(BUCKET, F.expr(f"CAST(date_trunc(coalesce(_unit, 'month'), {ts}) AS TIMESTAMP_NTZ)"))
            .drop("_unit"))


def with_row_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str,
                  rows: int, unit: str | None = None, carry: Sequence[str] = (),
                  max_rows: int = MAX_ROWS) -> DataFrame:
    """Add ``_bucket`` and the last ``rows`` rows before each bucket, flagged ``_halo``.

    The tails are taken with a top-k window (Spark limits it before the shuffle), so a
    hot series sends only ``rows`` rows per bucket to its successor. ``carry`` names the columns
    the halo rows need; the others are NULL there.
    """
    data = with_bucket(df, keys, ts, unit, max_rows)
    slim = list(dict.fromkeys([*keys, *order, ts, *carry]))
    newest = Window.partitionBy(*keys, BUCKET).orderBy(*[F.col(c).desc() for c in order])
    tails = (data.select(*slim, BUCKET)
             .withColumn("_rank", F.row_number().over(newest))
             .filter(F.col("_rank") <= rows))
    # one row per (series, bucket): its own tail, then the tails of earlier buckets until full
    packed = tails.groupBy(*keys, BUCKET).agg(
        F.sort_array(F.collect_list(F.struct(*order, *[c for c in slim if c not in order and c not in keys])))
        .alias("_tail"))
    earlier = (Window.partitionBy(*keys).orderBy(BUCKET)
               .rowsBetween(-rows, -1))
    reach = packed.withColumn("_before", F.flatten(F.collect_list("_tail").over(earlier)))
    halo = (reach.withColumn("_before", F.expr(
                f"slice(_before, greatest(size(_before) - {rows} + 1, 1), {rows})"))
            .select(*keys, BUCKET, F.explode("_before").alias("_row"))
            .select(*keys, BUCKET, "_row.*")
            .withColumn(HALO, F.lit(True)))
    return data.withColumn(HALO, F.lit(False)).unionByName(halo, allowMissingColumns=True)


def bucket_window(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, BUCKET).orderBy(*order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(BUCKET, HALO)


def with_time_halo(df: DataFrame, ts: str, hours: int, unit: str = "month") -> DataFrame:
    """Copy each row, as halo, into the later buckets that its following ``hours`` reach."""
    own = trunc(ts, unit)
    reach = trunc(_c(ts) + F.expr(f"INTERVAL '{hours}' HOUR"), unit)
    return (df.withColumn(BUCKET, F.explode(F.sequence(own, reach, F.expr(f"INTERVAL 1 {unit}"))))
            .withColumn(HALO, F.col(BUCKET) != own))


def lag_exact(df: DataFrame, value: str, hours: Sequence[int], keys: Sequence[str] = ("iy", "ix"),
              ts: str = "ts", unit: str = "month", month_local: bool = False,
              names: dict[int, str] | None = None) -> DataFrame:
    """``value`` exactly ``h`` hours earlier on the same series; an absent hour gives NULL.

    One shuffle for all lags. ``month_local=True`` keeps every lag inside its calendar month.
    """
    names = names or {h: f"{value}_lag{h}" for h in hours}
    if month_local:
        data = df.withColumn(BUCKET, trunc(ts, "month")).withColumn(HALO, F.lit(False))
    else:
        data = with_time_halo(df, ts, max(hours), unit)
    clock = Window.partitionBy(*keys, BUCKET).orderBy("_s")
    data = data.withColumn("_s", epoch_seconds(ts))
    for h in hours:
        data = data.withColumn(names[h], F.first(value).over(clock.rangeBetween(-h * 3600, -h * 3600)))
    return drop_halo(data).drop("_s")


def memory_features(df: DataFrame, value: str = "t2m_1km", keys: Sequence[str] = ("iy", "ix"),
                    ts: str = "ts", steps: Sequence[int] = (1, 2, 3),
                    month_local: bool = False) -> DataFrame:
    """First and second differences over 1, 2 and 3 hours (``dt2m_*h``, ``d2t2m_*h``)."""
    hours = sorted({h for s in steps for h in (s, 2 * s)})
    names = {h: f"_lag{h}" for h in hours}
    out = lag_exact(df, value, hours, keys, ts, month_local=month_local, names=names)
    for s in steps:
        one, two = F.col(names[s]), F.col(names[2 * s])
        out = (out.withColumn(f"dt2m_{s}h", F.col(value) - one)
               .withColumn(f"d2t2m_{s}h", F.col(value) - 2 * one + two))
    return out.drop(*names.values())


def deaccumulate(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("lat_i", "lon_i"),
                 ts: str = "ts", reset: str = "month") -> DataFrame:
    """Accumulated flux (J m-2, reset daily) to hourly flux (W m-2).

    The accumulation restarts at 01:00, where the raw value is the hour's total; elsewhere the
    previous row is subtracted. With ``reset='month'`` the first row of each month is missing
    (the sources are monthly); ``reset='none'`` looks across the month border, through a halo
    row. No task ever holds more than one node-month.
    """
    if reset not in ("month", "none"):
        raise ValueError("reset must be 'month' or 'none'")
    if reset == "none":
        data = with_row_halo(df, keys, [ts], ts, rows=1, unit="month", carry=columns)
    else:
        data = df.withColumn(BUCKET, trunc(ts, "month")).withColumn(HALO, F.lit(False))
    w = bucket_window(keys, [ts])
    first = F.lag(F.lit(1)).over(w).isNull()
    data = data.withColumns({c: F.when(~first, F.when(F.hour(ts) == 1, F.col(c))
                                       .otherwise(F.col(c) - F.lag(c).over(w)) / 3600.0)
                             for c in columns})
    return drop_halo(data)


def order_series(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Global, deterministic order by series then time (a range-partitioned sort)."""
    return df.orderBy(*keys, *order)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike]) -> DataFrame:
    """One row per key: the first by ``order``.

    An aggregate, not a window: each map task reduces a hot key to one row before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*[_c(c).alias(f"_o{i}") for i, c in enumerate(order)]))
    return (df.groupBy(*keys).agg(pick.alias("_row"))
            .select(*keys, "_row.*").select(*df.columns))
