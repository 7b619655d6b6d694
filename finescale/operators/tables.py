"""Set-style operators: window replace, guards, differences, observation joins."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from finescale.functions.time import in_window
from finescale.operators.series import keep_first


def replace_window(old: DataFrame, new: DataFrame, start: datetime | None, end: datetime | None,
                   ts: str = "data_hora_utc") -> DataFrame:
    """Rows of ``old`` inside ``[start, end)`` give way to ``new``; the rest is kept."""
    outside = F.coalesce(~in_window(ts, start, end), F.lit(True))
    return old.filter(outside).unionByName(new)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b.distinct(), a.columns, "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b.distinct(), a.columns, "left_semi")


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``df``; raise when a key repeats (runs a job that stops at the first one)."""
    if not duplicates(df, keys).isEmpty():
        raise ValueError(f"duplicate rows for {tuple(keys)}")
    return df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing} (present: {df.columns})")
    return df


def require_not_null(df: DataFrame, column: str) -> DataFrame:
    """Lazy guard: a NULL in ``column`` fails the job instead of being dropped."""
    bad = F.raise_error(F.lit(f"{column} is missing in a row that needs it"))
    return df.withColumn(column, F.coalesce(F.col(column), bad.cast(df.schema[column].dataType)))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def _outlier_columns(column: str, limit: float) -> list[Column]:
    gone = F.abs(column) > limit
    return [F.count_if(~gone).alias("mantidos"), F.count_if(gone).alias("removidos"), F.max(F.when(gone, F.abs(column))).alias("maior_removido")]


def cut_outliers(df: DataFrame, column: str = "y_residuo", limit: float = 10.0, watch: Observation | None = None) -> DataFrame:
    """Keep ``abs(value) <= limit``; the boundary stays. ``watch`` gets the figures of ``outlier_counts`` from the job that reads the rows."""
    seen = df if watch is None else df.observe(watch, *_outlier_columns(column, limit))
    return seen.filter(F.abs(column) <= limit)


def outlier_counts(df: DataFrame, column: str = "y_residuo", limit: float = 10.0) -> DataFrame:
    """One row: how many rows the cut keeps and removes, and the largest magnitude removed."""
    return df.filter(F.col(column).isNotNull()).agg(*_outlier_columns(column, limit))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def dense_index(df: DataFrame, key: str, seed: int | None = None) -> DataFrame:
    """Add ``idx`` 0..n-1 in the (seeded) order of ``md5(key)``, and ``n``.

    Two levels, hash bucket then order inside it: no task sees all keys, which must be distinct.
    """
    text = F.col(key).cast("string") if seed is None else F.concat_ws("_", F.lit(seed), F.col(key))
    data = df.withColumn("_m", F.md5(text)).withColumn("_b", F.substring("_m", 1, 2))
    sizes = data.groupBy("_b").agg(F.count("*").alias("_size"))
    all_buckets = Window.partitionBy(F.lit(0))                 # 256 buckets at most
    before = sizes.select("_b", (F.sum("_size").over(all_buckets.orderBy("_b")) - F.col("_size")).alias("_base"),
                          F.sum("_size").over(all_buckets).alias("n"))
    inside = Window.partitionBy("_b").orderBy("_m", key)
    return (data.withColumn("_r", F.row_number().over(inside)).join(before, "_b")
            .withColumn("idx", F.col("_base") + F.col("_r") - 1).drop("_m", "_b", "_r", "_base"))


# --- observations -----------------------------------------------------------------------------------

def attach_meta(obs: DataFrame, meta: DataFrame, station: str = "station", order: Sequence[str] = ("_line",)) -> DataFrame:
    """Left join of station coordinates. Of a repeated station the first row by ``order`` is kept; metadata without those columns
    must not repeat a station."""
    if all(c in meta.columns for c in order):
        meta = keep_first(meta, [station], list(order)).drop("_line")
    else:
        assert_unique(meta, [station])
    return obs.join(meta, station, "left")


def without_coords(obs: DataFrame, station: str = "station", lat: str = "latitude") -> DataFrame:
    """Stations without coordinates, to report and exclude."""
    return obs.filter(F.col(lat).isNull()).select(station).distinct()


def exclude_stations(obs: DataFrame, codes: DataFrame, station: str = "station") -> DataFrame:
    return obs.join(codes.select(station).distinct(), station, "left_anti")


def unknown_codes(codes: DataFrame, known: DataFrame, station: str = "station") -> DataFrame:
    return difference(codes.select(station), known.select(station))


def to_cells(obs: DataFrame, station_cell: DataFrame, station: str = "station") -> DataFrame:
    """Observations of mapped stations only, with their cell."""
    return obs.join(station_cell.select(station, "iy", "ix"), station)


def collapse_cells(obs: DataFrame, value: str = "temperatura_c_qc", station: str = "station",
                   ts: str = "ts") -> DataFrame:
    """Mean temperature and number of distinct stations per (cell, hour)."""
    return (obs.filter(F.col(value).isNotNull()).groupBy("iy", "ix", ts)
            .agg(F.avg(value).alias(value), F.count_distinct(station).cast("int").alias("n_est_cel")))


def attach_stack(obs: DataFrame, stack: DataFrame, ts: str = "ts", watch: Observation | None = None) -> DataFrame:
    """Observations with the features of their hour; others are dropped. ``watch`` counts both (``n_found, n_lost``) in the same job.

    By merge: a stack made from cells and hours is larger than its estimate, which would have it broadcast.
    """
    if watch is None:
        return obs.join(stack.hint("merge"), ["iy", "ix", ts])
    rows = obs.join(stack.withColumn("_found", F.lit(True)).hint("merge"), ["iy", "ix", ts], "left")
    return rows.observe(watch, F.count("_found").alias("n_found"), F.count_if(F.col("_found").isNull()).alias("n_lost")).filter("_found").drop("_found")


def unmatched_hours(obs: DataFrame, stack: DataFrame, ts: str = "ts") -> DataFrame:
    """How many collapsed observations have no hour in the stack, per month."""
    lost = obs.join(stack.select("iy", "ix", ts), ["iy", "ix", ts], "left_anti")
    return lost.groupBy(F.year(ts).alias("ano"), F.month(ts).alias("mes")).agg(F.count("*").alias("n_lost"))


def attach_statics(df: DataFrame, statics: DataFrame) -> DataFrame:
    return df.join(statics, ["iy", "ix"], "left")


def match_obs(scored: DataFrame, obs_cell: DataFrame, ts: str = "ts") -> DataFrame:
    return scored.join(obs_cell, ["iy", "ix", ts])


def attach_observed(oof: DataFrame, matrix: DataFrame, value: str = "temperatura_c_qc", ts: str = "ts") -> DataFrame:
    return oof.join(matrix.select("iy", "ix", ts, value), ["iy", "ix", ts], "left")


def representativeness(statics: DataFrame, stations: DataFrame) -> DataFrame:
    """Cell elevation minus the mean altitude of its stations (one row per station first)."""
    mean = (stations.groupBy("iy", "ix")
            .agg(F.avg("altitude").alias("altitude"), F.count_distinct("station").cast("int").alias("n_est_cel")))
    return (statics.select("iy", "ix", "z_alvo").join(mean, ["iy", "ix"], "left")
            .withColumn("delta_representatividade_m", F.col("z_alvo") - F.col("altitude")))


def first_hours(df: DataFrame, n: int, start: datetime, ts: str = "ts") -> DataFrame:
    """The first ``n`` hours of a run (a test switch of the field job)."""
    return df.filter(in_window(ts, start, start + timedelta(hours=n)))


def order_matrix(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Deterministic total order (cell key as text, then time)."""
    return df.orderBy("cell_id", ts)
