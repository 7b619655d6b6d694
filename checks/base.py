"""Registry and shared inputs: the driver's tables read as stations, nodes, pixels and cells.

Each input exists twice, as a DataFrame and as SQL text for the oracle; both use the expressions
below. All inputs are whole tables and grow with them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        if name in CHECKS:
            raise KeyError(name)
        CHECKS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(e: str, places: int = 6) -> str:
    """SQL text of a rounded value; the shift makes both engines break decimal ties alike."""
    return f"round(({e}) + 1e-9, {places})"


def rounded(df: DataFrame, places: int = 6, only: Sequence[str] | None = None) -> DataFrame:
    floats = [c for c, t in df.dtypes if t in ("double", "float") and (only is None or c in only)]
    return df.withColumns({c: F.round(F.col(c).cast("double") + F.lit(1e-9), places) for c in floats})


# --- stations and observations: events -----------------------------------------------------------

OBS_SQL = """
  obs AS (
    SELECT user_id AS station, ts, event_id,
           CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS md_valor,
           CASE event_type WHEN 'click' THEN '4' WHEN 'view' THEN '5' WHEN 'error' THEN 'x' ELSE '9' END AS md_final,
           value, event_type
    FROM events)"""


def obs(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    flag = (F.when(F.col("event_type") == "click", "4").when(F.col("event_type") == "view", "5")
            .when(F.col("event_type") == "error", "x").otherwise("9"))
    return e.select(F.col("user_id").alias("station"), "ts", "event_id",
                    F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("md_valor"),
                    flag.alias("md_final"), "value", "event_type")


# station network: 100 km wide, growing northwards, so density does not depend on the scale
STATION_SQL = """
  net AS (
    SELECT DISTINCT user_id AS station,
           CAST((user_id * 37) % 101 AS DOUBLE) AS x_km,
           CAST((user_id * 53) % 97 + 100 * CAST(floor(user_id / 150) AS BIGINT) AS DOUBLE) AS y_km,
           CAST((user_id * 71) % 1800 AS DOUBLE) AS z_m
    FROM events)"""


def net(spark, d) -> DataFrame:
    u = F.col("user_id")
    return table(spark, d, "events").select("user_id").distinct().select(
        u.alias("station"), ((u * 37) % 101).cast("double").alias("x_km"),
        ((u * 53) % 97 + 100 * F.floor(u / 150)).cast("double").alias("y_km"),
        ((u * 71) % 1800).cast("double").alias("z_m"))


# target cells: customers on a lattice 40 wide over the same ground; z is missing on some (water)
CELL_SQL = """
  cells AS (
    SELECT CAST(floor(c_custkey / 40) AS INTEGER) AS iy, CAST(c_custkey % 40 AS INTEGER) AS ix,
           CAST((c_custkey % 40) * 2.5 AS DOUBLE) AS x_km,
           CAST(floor(c_custkey / 40) * 2.5 AS DOUBLE) AS y_km,
           CASE WHEN c_custkey % 13 <> 0 THEN CAST((c_custkey * 67) % 1800 AS DOUBLE) END AS z_m,
           CAST((c_custkey * 7) % 900 AS DOUBLE) AS z_era5_orog,
           CAST(c_custkey / 105.0 AS DOUBLE) AS lat,
           CAST((c_custkey * 7) % 1000 / 100.0 AS DOUBLE) AS lon,
           c_acctbal AS acctbal, c_custkey
    FROM customer)"""


def cells(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    row, col = F.floor(k / 40), k % 40
    return table(spark, d, "customer").select(
        row.cast("int").alias("iy"), col.cast("int").alias("ix"),
        (col * 2.5).cast("double").alias("x_km"), (row * 2.5).cast("double").alias("y_km"),
        F.when(k % 13 != 0, ((k * 67) % 1800).cast("double")).alias("z_m"),
        ((k * 7) % 900).cast("double").alias("z_era5_orog"),
        (k / F.lit(105.0)).alias("lat"), (((k * 7) % 1000) / F.lit(100.0)).alias("lon"),
        F.col("c_acctbal").alias("acctbal"), k)


# station cells: six stations share a cell
OBS_CELL_SQL = OBS_SQL + """,
  obs_cell AS (
    SELECT CAST(floor(station / 6) AS INTEGER) AS iy, CAST(floor(station / 6) AS INTEGER) % 7 AS ix,
           date_trunc('hour', ts) AS ts, avg(value) AS temperatura_c_qc,
           CAST(count(DISTINCT station) AS INTEGER) AS n_est_cel
    FROM obs WHERE event_type <> 'error'
    GROUP BY 1, 2, 3)"""


def station_cells(spark, d) -> DataFrame:
    s = F.floor(F.col("station") / 6).cast("int")
    return net(spark, d).select("station", s.alias("iy"), (s % 7).alias("ix"))


def hourly_obs(spark, d) -> DataFrame:
    """Observations stamped to the hour, with the value of usable rows."""
    return obs(spark, d).select("station", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
                                F.when(F.col("event_type") != "error", F.col("value")).alias("temperatura_c_qc"))


def obs_cell(spark, d) -> DataFrame:
    from finescale.operators.tables import collapse_cells, to_cells
    return collapse_cells(to_cells(hourly_obs(spark, d), station_cells(spark, d)))


# out-of-fold table: residual to a diurnal baseline; the prediction is the mean residual of the
# same hour over all other cells, so no cell is predicted from itself
OOF_SQL = OBS_CELL_SQL + """,
  res AS (
    SELECT *, temperatura_c_qc - (30 + 10 * sin(2 * pi() * hour(ts) / 24)) AS y_residuo, hour(ts) AS hh
    FROM obs_cell),
  by_cell AS (SELECT iy, ix, hh, sum(y_residuo) AS s, count(*) AS n FROM res GROUP BY 1, 2, 3),
  by_hour AS (SELECT hh, sum(s) AS s, sum(n) AS n FROM by_cell GROUP BY 1),
  oof AS (
    SELECT r.iy, r.ix, r.ts, r.temperatura_c_qc, r.y_residuo,
           (h.s - c.s) / NULLIF(h.n - c.n, 0) AS pred_residuo,
           CAST((r.iy * 331) % 2100 - 50 AS DOUBLE) AS z_alvo,
           CAST((r.iy * 17713) % 400000 AS DOUBLE) AS dist_oceano
    FROM res r JOIN by_cell c ON r.iy = c.iy AND r.ix = c.ix AND r.hh = c.hh JOIN by_hour h ON r.hh = h.hh)"""


def oof(spark, d) -> DataFrame:
    res = obs_cell(spark, d).withColumns({
        "y_residuo": F.col("temperatura_c_qc") - (30 + 10 * F.sin(2 * F.pi() * F.hour("ts") / 24)),
        "hh": F.hour("ts")})
    by_cell = res.groupBy("iy", "ix", "hh").agg(F.sum("y_residuo").alias("s"), F.count("*").alias("n"))
    by_hour = by_cell.groupBy("hh").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    return (res.join(by_cell, ["iy", "ix", "hh"]).join(F.broadcast(by_hour), "hh")      # 24 rows
            .select("iy", "ix", "ts", "temperatura_c_qc", "y_residuo",
                    F.try_divide(F.col("hs") - F.col("s"), F.col("hn") - F.col("n")).alias("pred_residuo"),
                    ((F.col("iy") * 331) % 2100 - 50).cast("double").alias("z_alvo"),
                    ((F.col("iy").cast("bigint") * 17713) % 400000).cast("double").alias("dist_oceano")))


# coarse nodes: users on a lattice 10 wide, daily stamps, many gaps
COARSE_SQL = """
  coarse AS (
    SELECT CAST(floor(user_id / 10) AS INTEGER) AS lat_i, CAST(user_id % 10 AS INTEGER) AS lon_i,
           CAST(floor(user_id / 10) AS DOUBLE) AS lat, CAST(user_id % 10 AS DOUBLE) AS lon,
           CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts,
           CASE WHEN user_id % 11 <> 3 THEN avg(value) + 273.15 END AS t2m,
           CASE WHEN user_id % 11 <> 3 THEN min(value) + 273.15 END AS d2m
    FROM events GROUP BY user_id, 5)"""


def coarse(spark, d) -> DataFrame:
    u = F.col("user_id")
    g = (table(spark, d, "events")
         .groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
         .agg(F.avg("value").alias("a"), F.min("value").alias("m")))
    return g.select(F.floor(u / 10).cast("int").alias("lat_i"), (u % 10).cast("int").alias("lon_i"),
                    F.floor(u / 10).cast("double").alias("lat"), (u % 10).cast("double").alias("lon"), "ts",
                    F.when(u % 11 != 3, F.col("a") + 273.15).alias("t2m"),
                    F.when(u % 11 != 3, F.col("m") + 273.15).alias("d2m"))


# fine pixels: orders on a raster 110 wide, one pixel each; pending orders are water
PIXEL_SQL = """
  pixels AS (
    SELECT CAST(o_orderkey % 110 AS INTEGER) AS px, CAST(floor(o_orderkey / 110) AS INTEGER) AS py,
           CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END AS z,
           (o_orderkey * 7919) % 360 AS aspect, CAST((o_orderkey * 31) % 400 AS DOUBLE) / 100 AS slope
    FROM orders)"""


def pixels(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        (k % 110).cast("int").alias("px"), F.floor(k / 110).cast("int").alias("py"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000).alias("z"),
        ((k * 7919) % 360).alias("aspect"), (((k * 31) % 400).cast("double") / 100).alias("slope"))
