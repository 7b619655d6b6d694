"""Areas, line work and windows of rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import CELL_SQL, cells, check, r6, rounded, table
from checks.grids import POINT_SQL, _lookup, _points
from checks.sinks import scratch
from finescale.operators import grid as G
from finescale.operators import lines as L
from finescale.operators import raster as R
from finescale.sources import writers as W

# pixels of 0.7 x 0.9 around the points of the line items, in cells of 2.5 from (1.1, 0.3): an area by its corners
AREA_SQL = POINT_SQL + """,
  px AS (SELECT l_orderkey, l_linenumber, x - 0.35 AS x0, x + 0.35 AS x1, y - 0.45 AS y0, y + 0.45 AS y1, p_size AS code,
                CASE WHEN p_size % 9 <> 0 THEN 'T' || (p_size % 8 + 1) END AS grupo FROM pts JOIN part ON p_partkey = l_partkey),
  near AS (SELECT *, CAST(floor((x0 - 1.1) / 2.5) AS INTEGER) + i AS ix, CAST(floor((y0 - 0.3) / 2.5) AS INTEGER) + j AS iy FROM px, range(-1, 3) a(i), range(-1, 3) b(j)),
  areas AS (SELECT *, greatest(0, least(x1, 1.1 + (ix + 1) * 2.5) - greatest(x0, 1.1 + ix * 2.5)) * greatest(0, least(y1, 0.3 + (iy + 1) * 2.5) - greatest(y0, 0.3 + iy * 2.5))
            / (0.7 * 0.9) AS share FROM near)"""


def _shares(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("code"))
    pixels = _points(spark, d).join(part, F.col("p_partkey") == F.col("l_partkey"))
    return R.cell_shares(pixels, (1.1, 0.3), (2.5, 2.5), (0.7, 0.9))


@check("area_fractions", f"""WITH {AREA_SQL}
  SELECT iy, ix, {', '.join(f"{r6(f"sum(CASE WHEN grupo = 'T{i}' THEN share ELSE 0 END) / nullif(sum(CASE WHEN grupo IS NOT NULL THEN share ELSE 0 END), 0)")} AS fracao_t{i}" for i in range(1, 9))},
         {r6("sum(CASE WHEN grupo IS NOT NULL THEN share ELSE 0 END) / sum(share)")} AS fracao_observada
  FROM areas WHERE share > 1e-9 GROUP BY 1, 2""")
def area_fractions(spark, d):
    return rounded(R.area_fractions(_shares(spark, d).filter("share > 1e-9"), _lookup(spark, d)))


@check("area_shares", f"""WITH {AREA_SQL}
  SELECT l_orderkey, l_linenumber, count(*) AS n_cells, {r6('sum(share)')} AS total, {r6('max(share)')} AS largest FROM areas WHERE share > 1e-9 GROUP BY 1, 2""")
def area_shares(spark, d):
    shares = _shares(spark, d).filter("share > 1e-9")
    return rounded(shares.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n_cells"), F.sum("share").alias("total"), F.max("share").alias("largest")))


# a line through the parts: short steps, with a long one now and then
LINE_SQL = """
  lines AS (SELECT p_partkey % 23 * 9.0 AS x1, floor(p_partkey / 20) * 1.1 AS y1, p_partkey % 23 * 9.0 + p_partkey % 5 * 1.3 + CASE WHEN p_partkey % 97 = 0 THEN 120.0 ELSE 0.0 END AS x2,
                   floor(p_partkey / 20) * 1.1 + p_partkey % 3 * 0.7 - CASE WHEN p_partkey % 101 = 0 THEN 40.0 ELSE 0.0 END AS y2 FROM part WHERE p_partkey % 4 <> 1)"""


@check("line_distance", f"""WITH {CELL_SQL}, {LINE_SQL},
  k AS (SELECT iy, ix, x_km AS px, y_km AS py, x1, y1, x2, y2,
               coalesce(greatest(0, least(1, ((x_km - x1) * (x2 - x1) + (y_km - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0))), 0) AS t
        FROM cells CROSS JOIN lines)
  SELECT iy, ix, {r6('min(sqrt(pow(px - x1 - t * (x2 - x1), 2) + pow(py - y1 - t * (y2 - y1), 2)))')} AS dist_oceano FROM k GROUP BY 1, 2""")
def line_distance(spark, d):
    p = F.col("p_partkey")
    x, y = p % 23 * 9.0, F.floor(p / 20) * 1.1
    lines = table(spark, d, "part").filter(p % 4 != 1).select(
        x.alias("x1"), y.alias("y1"), (x + p % 5 * 1.3 + F.when(p % 97 == 0, 120.0).otherwise(0.0)).alias("x2"),
        (y + p % 3 * 0.7 - F.when(p % 101 == 0, 40.0).otherwise(0.0)).alias("y2"))
    return rounded(L.distance_to_lines(cells(spark, d), lines, x="x_km", y="y_km"))


@check("densified_line", f"""WITH {LINE_SQL},
  n AS (SELECT *, greatest(1, CAST(ceil(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 2.0) AS BIGINT)) AS n FROM lines)
  SELECT {r6('x1 + (x2 - x1) * k / n')} AS x, {r6('y1 + (y2 - y1) * k / n')} AS y, count(*) AS times FROM (SELECT *, unnest(range(n + 1)) AS k FROM n) GROUP BY 1, 2""")
def densified_line(spark, d):
    p = F.col("p_partkey")
    x, y = p % 23 * 9.0, F.floor(p / 20) * 1.1
    lines = table(spark, d, "part").filter(p % 4 != 1).select(
        x.alias("x1"), y.alias("y1"), (x + p % 5 * 1.3 + F.when(p % 97 == 0, 120.0).otherwise(0.0)).alias("x2"),
        (y + p % 3 * 0.7 - F.when(p % 101 == 0, 40.0).otherwise(0.0)).alias("y2"))
    return rounded(L.densify(lines, 2.0)).groupBy("x", "y").agg(F.count("*").alias("times"))


@check("window_of_raster", """
  SELECT l_orderkey, l_linenumber, CAST((l_partkey * 7) % 1400 AS BIGINT) AS px, CAST((l_orderkey * 3) % 1700 - 300 AS BIGINT) AS py, l_quantity AS value FROM lineitem
  WHERE (l_partkey * 7) % 1400 BETWEEN 195 AND 405 AND (l_orderkey * 3) % 1700 - 300 BETWEEN -55 AND 155""")
def window_of_raster(spark, d):
    """Written in Z-order, then a window of it read."""
    path = scratch(spark, "raster")
    pixels = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 7 % 1400).alias("px"),
                                                (F.col("l_orderkey") * 3 % 1700 - 300).alias("py"), F.col("l_quantity").alias("value"))
    W.write_pixels(pixels, path)
    return G.bbox_scan(spark.read.parquet(path), (200, 400), (-50, 150), 5)
