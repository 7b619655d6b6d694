"""Sinks. Every writer takes the sink path; layouts are chosen for later pruning."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finescale.functions.physics import to_celsius
from finescale.functions.time import in_window
from finescale.operators.series import keep_first
from finescale.operators.tables import replace_window

FLOAT_KEYS = ("x", "y", "lon", "lat", "longitude", "latitude", "coord_x", "coord_y")


def _with_month(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"year": F.year(ts), "month": F.month(ts)})


def as_float(df: DataFrame, keep: Sequence[str] = FLOAT_KEYS) -> DataFrame:
    """DOUBLE to FLOAT, the storage type; the last step before a sink."""
    return df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double" and c not in keep})


def write_observations(df: DataFrame, path: str, ts: str = "data_hora_utc", rows_per_file: int = 5_000_000) -> None:
    """Observation table by month. Ranges of (month, station, time) deal even a single month's rows to all tasks; a file holds at
    most ``rows_per_file``."""
    out = _with_month(df, ts).repartitionByRange("year", "month", "station", ts)
    (out.sortWithinPartitions("year", "month", "station", ts).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .option("maxRecordsPerFile", rows_per_file).partitionBy("year", "month").parquet(path))


def write_station_lists(df: DataFrame, folder: str) -> None:
    """Approved stations, and those without coordinates."""
    lists = df.groupBy("station").agg(F.max(F.col("latitude").isNotNull()).alias("_ok"))
    for name, keep in (("estacoes_aprovadas", True), ("estacoes_sem_metadados", False)):
        (lists.filter(F.col("_ok") == keep).select(F.col("station").alias("codigo_estacao")).orderBy("codigo_estacao")
         .write.mode("overwrite").options(sep=";", header=True).csv(f"{folder}/{name}"))


def _delete(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def overwrite_window(new: DataFrame, path: str, start: datetime | None, end: datetime | None,
                     ts: str = "data_hora_utc") -> None:
    """Window replace at rest: rewrites only the month partitions ``[start, end)`` touches; either bound may be open.

    Raises, before anything is written, when a row of ``new`` lies outside the window. The new months are
    staged beside the table first. Should the run break off later, each month is in its old or new state
    (or gone, if nothing of it remains), and running again completes it.
    """
    spark = new.sparkSession
    if not new.filter(~F.coalesce(in_window(ts, start, end), F.lit(False)) | F.col(ts).isNull()).isEmpty():
        raise ValueError("rows to insert lie outside the window")
    month, within = F.col("year") * 12 + F.col("month"), F.lit(True)
    if start is not None:
        within = within & (month >= start.year * 12 + start.month)
    if end is not None:
        within = within & (month <= end.year * 12 + end.month)
    touched = spark.read.parquet(path).filter(within)
    before = {tuple(r) for r in touched.select("year", "month").distinct().collect()}   # months of the window
    out = _with_month(replace_window(touched.drop("year", "month"), new, start, end, ts), ts)
    staged = f"{path.rstrip('/')}__staged_{uuid.uuid4().hex}"
    try:
        (out.write.option("partitionOverwriteMode", "static").partitionBy("year", "month").parquet(staged))
        kept = spark.read.schema(out.schema).parquet(staged)
        after = {tuple(r) for r in kept.select("year", "month").distinct().collect()}
        for y, m in before - after:           # dynamic mode leaves a month without new rows as it is
            _delete(spark, f"{path}/year={y}/month={m}")
        (kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("year", "month").parquet(path))
    finally:
        _delete(spark, staged)
    spark.catalog.refreshByPath(path)


def morton(bx: str, by: str, bits: int = 24) -> Column:
    """Place on the Z-order curve of two block numbers (SQL text) from -2**(bits-1) to 2**(bits-1) - 1: their bits by turns."""
    half = 1 << (bits - 1)
    return F.expr(f"aggregate(sequence(0, {bits - 1}), 0L, (m, k) -> m | shiftleft(shiftright({bx} + {half}L, k) & 1L, 2 * k)"
                  f" | shiftleft(shiftright({by} + {half}L, k) & 1L, 2 * k + 1))")


def write_pixels(df: DataFrame, path: str, px: str = "px", py: str = "py", block: int = 64, rows: int = 1 << 16, partitions: int | None = None) -> None:
    """A raster table whose files and row groups (of ``rows`` pixels at most) each cover a compact area: blocks of pixels in Z-order, dealt by
    ranges of it. A window then reads the row groups whose smallest and largest ``px, py`` meet it, not the table."""
    key = morton(f"CAST(floor(`{px}` / {block}) AS BIGINT)", f"CAST(floor(`{py}` / {block}) AS BIGINT)")
    order = ["_place", py, px]
    placed = df.withColumn("_place", key)
    spread = placed.repartitionByRange(partitions, *order) if partitions else placed.repartitionByRange(*order)
    (spread.sortWithinPartitions(*order).drop("_place").write.mode("overwrite").option("parquet.block.row.count.limit", rows)
     .option("parquet.page.row.count.limit", max(rows // 4, 1)).parquet(path))


def write_matrix(df: DataFrame, path: str, ts: str = "ts", partitions: int | None = None) -> None:
    """Matrix in (cell, hour) order: range partitions, sorted inside each."""
    key = ["cell_id", ts]
    spread = df.repartitionByRange(partitions, *key) if partitions else df.repartitionByRange(*key)
    as_float(spread.sortWithinPartitions(*key)).write.mode("overwrite").parquet(path)


def coverage_sidecar(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(coluna, n_null)`` of the columns that miss values, in one pass over the matrix."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features])
    pairs = F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(c).alias("n_null")) for c in features])
    return row.select(F.explode(pairs).alias("_p")).select("_p.*").filter("n_null > 0")


def matrix_counts(df: DataFrame) -> DataFrame:
    """One row: rows, cells, and cell-hours that average several stations."""
    return df.agg(F.count("*").alias("n_linhas"), F.count_distinct("iy", "ix").alias("celulas"),
                  F.count_if(F.col("n_est_cel") > 1).alias("instantes_celula_multi_estacao"))


def write_oof(df: DataFrame, path: str) -> None:
    df.select("cell_id", "ts", "y_residuo", *[c for c in df.columns if c.startswith(("pred_", "t2m_1km"))]) \
      .write.mode("overwrite").parquet(path)


def field_columns(field: DataFrame, grid: DataFrame, extras: bool = False) -> DataFrame:
    """Output layout: keys, centre coordinates, every ``var, var_bc, var_oi``; extras on request."""
    out = field.join(grid.select("iy", "ix", "lon", "lat"), ["iy", "ix"], "left")
    if extras:
        out = out.withColumn("T_ERA5", to_celsius("t2m_1km"))
    triples = [c for c in out.columns if c + "_bc" in out.columns]
    names = ["iy", "ix", "ts", "lon", "lat", *[v + s for v in triples for s in ("", "_bc", "_oi")]]
    return out.select(*names, *(["T_ERA5", "pred_residuo"] if extras else []))


def write_field(field: DataFrame, path: str) -> None:
    """Gridded output by month. Cells of one row block stay together; no month goes through one task."""
    out = _with_month(as_float(field), "ts")
    (out.repartition("year", "month", F.floor(F.col("iy") / 16), F.dayofmonth("ts"))
     .sortWithinPartitions("iy", "ix", "ts")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year", "month").parquet(path))


def excluded_stations(df: DataFrame) -> DataFrame:
    return df.filter(F.col("motivo") != "ok").select("station", "longitude", "latitude", "motivo")


def write_excluded(df: DataFrame, path: str) -> None:
    excluded_stations(df).write.mode("overwrite").options(sep=";", header=True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A small report as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_lz_by_hour(lz: DataFrame, path: str, method: str = "idw") -> None:
    """The record of vertical scales that ``read_lz_by_hour`` reads: one object with a map of 24 entries at most."""
    record = lz.agg(F.lit(method).alias("metodo"), F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(F.col("hora").cast("string").alias("h"), F.col("lz_m").cast("double").alias("z"))))).alias("lz_por_hora"))
    record.coalesce(1).write.mode("overwrite").json(path)


def trainable_cells(stations: DataFrame) -> DataFrame:
    """Distinct cells to populate, one row per cell."""
    ok = stations.filter("treinavel").select("iy", "ix", "cell_lon", "cell_lat")
    return keep_first(ok, ["iy", "ix"], ["cell_lon", "cell_lat"])
