"""Grid cells, pixels, masks and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (CELL_SQL, OBS_CELL_SQL, PIXEL_SQL, STATION_SQL, cells, check, net, obs_cell, pixels, r6, rounded,
                         station_cells, table)
from finescale.functions import physics as P
from finescale.operators import grid as G
from finescale.operators import neighbours as N
from finescale.functions.utm import utm_to_lonlat
from finescale.operators import raster as R
from finescale.plans import gates as GT
from finescale.sources import writers as W

# points of the line items against a 60 x 50 grid of 2.5 spacing, first centre (3, 2)
AXES = G.Axes(3.0, 2.0, 2.5, 2.5, 50, 60)
NEAR_X = "least(greatest(ceil((x - 3.0) / 2.5 - 0.5), 0), 49)"
NEAR_Y = "least(greatest(ceil((y - 2.0) / 2.5 - 0.5), 0), 59)"
POINT_SQL = """
  pts AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_partkey * 7) % 1400 / 10.0 AS DOUBLE) AS x,
                 CAST((l_orderkey * 3) % 1700 / 10.0 AS DOUBLE) AS y FROM lineitem)"""


def _points(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_partkey") * 7) % 1400 / F.lit(10.0)).alias("x"),
        ((F.col("l_orderkey") * 3) % 1700 / F.lit(10.0)).alias("y"))


@check("containing_cell", f"""WITH {POINT_SQL}
  SELECT l_orderkey, l_linenumber, l_partkey, x, y, CAST({NEAR_Y} AS INTEGER) AS iy, CAST({NEAR_X} AS INTEGER) AS ix FROM pts""")
def containing_cell(spark, d):
    return G.containing_cell(_points(spark, d), AXES)


CLASS_SQL = f"""{POINT_SQL}, {CELL_SQL},
  placed AS (SELECT *, CAST({NEAR_Y} AS INTEGER) AS iy, CAST({NEAR_X} AS INTEGER) AS ix,
                    x BETWEEN 1.75 AND 126.75 AND y BETWEEN 0.75 AND 150.75 AS inside FROM pts),
  classed AS (SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, p.x, p.y, p.iy, p.ix,
                     CASE WHEN NOT inside THEN 'fora_extent' WHEN c.z_m IS NULL THEN 'celula_oceano' ELSE 'ok' END AS motivo
              FROM placed p LEFT JOIN cells c ON c.iy = p.iy AND c.ix = p.ix)"""


def _classed(spark, d):
    grid = cells(spark, d).withColumnRenamed("z_m", "z_alvo").select("iy", "ix", "z_alvo")
    return G.classify_stations(_points(spark, d), grid, AXES)


@check("station_status", f"""WITH {CLASS_SQL}
  SELECT l_orderkey, l_linenumber, l_partkey, iy, ix, motivo, motivo = 'ok' AS treinavel FROM classed""")
def station_status(spark, d):
    return _classed(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "iy", "ix", "motivo", "treinavel")


@check("excluded_stations", f"""WITH {CLASS_SQL}
  SELECT l_orderkey AS station, x AS longitude, y AS latitude, motivo FROM classed WHERE motivo <> 'ok'""")
def excluded_stations(spark, d):
    return W.excluded_stations(_classed(spark, d).withColumnsRenamed(
        {"l_orderkey": "station", "x": "longitude", "y": "latitude"}))


@check("trainable_cells", f"""WITH {CLASS_SQL}
  SELECT DISTINCT iy, ix, CAST(ix AS DOUBLE) AS cell_lon, CAST(iy AS DOUBLE) AS cell_lat FROM classed WHERE motivo = 'ok'""")
def trainable_cells(spark, d):
    return W.trainable_cells(_classed(spark, d).withColumns(
        {"cell_lon": F.col("ix").cast("double"), "cell_lat": F.col("iy").cast("double")}))


@check("holdout_class", f"""WITH {STATION_SQL},
  s AS (SELECT station, CAST(floor(x_km / 5) AS INTEGER) AS ix, CAST(floor(y_km / 5) AS INTEGER) AS iy FROM net)
  SELECT station, CASE WHEN (iy, ix) IN (SELECT (iy, ix) FROM s WHERE station % 5 <> 0) THEN 'G1' ELSE 'G2' END AS classe
  FROM s WHERE station % 5 = 0""")
def holdout_class(spark, d):
    s = net(spark, d).select("station", F.floor(F.col("x_km") / 5).cast("int").alias("ix"),
                             F.floor(F.col("y_km") / 5).cast("int").alias("iy"))
    return G.holdout_class(s.filter("station % 5 = 0"), s.filter("station % 5 <> 0")).select("station", "classe")


@check("read_cells", f"""WITH {OBS_CELL_SQL}, {CELL_SQL}
  SELECT iy, ix, CAST(ts AS TIMESTAMP) AS ts, n_est_cel FROM obs_cell
  WHERE (iy, ix) IN (SELECT (iy, ix) FROM cells WHERE acctbal > 4000)""")
def read_cells(spark, d):
    return G.read_cells(obs_cell(spark, d), cells(spark, d).filter("acctbal > 4000")).select("iy", "ix", "ts", "n_est_cel")


@check("scatter", f"""WITH {OBS_CELL_SQL}, {CELL_SQL},
  h AS (SELECT DISTINCT CAST(ts AS TIMESTAMP) AS ts FROM obs_cell)
  SELECT c.iy, c.ix, h.ts, {r6('o.temperatura_c_qc')} AS temperatura_c_qc
  FROM cells c CROSS JOIN h LEFT JOIN obs_cell o ON o.iy = c.iy AND o.ix = c.ix AND o.ts = h.ts""")
def scatter(spark, d):
    hours = obs_cell(spark, d).select("ts").distinct()
    values = obs_cell(spark, d).drop("n_est_cel")
    return rounded(G.scatter(cells(spark, d).select("iy", "ix"), values, hours))


# lattice of diamonds, one per supplier, ten in a row; cells are the parts, 50 in a row
EDGE_SQL = """
  v AS (SELECT s_suppkey, (s_suppkey % 10) * 5.0 + 2.37 AS cx, floor(s_suppkey / 10) * 5.0 + 2.415 AS cy,
               1.1 + (s_suppkey * 7 % 10) * 0.1 AS r FROM supplier),
  edges AS (SELECT cx - r AS x1, cy AS y1, cx AS x2, cy + r AS y2 FROM v UNION ALL
            SELECT cx, cy + r, cx + r, cy FROM v UNION ALL
            SELECT cx + r, cy, cx, cy - r FROM v UNION ALL
            SELECT cx, cy - r, cx - r, cy FROM v),
  lattice AS (SELECT CAST(floor(p_partkey / 50) AS INTEGER) AS iy, CAST(p_partkey % 50 AS INTEGER) AS ix FROM part)"""


@check("region_mask", f"""WITH {EDGE_SQL}
  SELECT iy, ix, (SELECT count(*) FROM edges WHERE least(y1, y2) <= iy AND iy < greatest(y1, y2)
                  AND x1 + (iy - y1) * (x2 - x1) / (y2 - y1) > ix) % 2 = 1 AS in_region FROM lattice""")
def region_mask(spark, d):
    s = F.col("s_suppkey")
    v = table(spark, d, "supplier").select((s % 10 * 5.0 + 2.37).alias("cx"), (F.floor(s / 10) * 5.0 + 2.415).alias("cy"),
                                           (1.1 + s * 7 % 10 * 0.1).alias("r"))
    side = lambda a, b, c, e: F.struct(F.expr(a).alias("x1"), F.expr(b).alias("y1"), F.expr(c).alias("x2"), F.expr(e).alias("y2"))
    edges = v.select(F.explode(F.array(
        side("cx - r", "cy", "cx", "cy + r"), side("cx", "cy + r", "cx + r", "cy"),
        side("cx + r", "cy", "cx", "cy - r"), side("cx", "cy - r", "cx - r", "cy"))).alias("e")).select("e.*")
    p = F.col("p_partkey")
    grid = table(spark, d, "part").select(F.floor(p / 50).cast("int").alias("iy"), (p % 50).cast("int").alias("ix"))
    rows = grid.agg(F.max("iy")).first()[0] + 1               # the grid record, one number
    return G.region_mask(grid, edges, G.Axes(0.0, 0.0, 1.0, 1.0, 50, rows))


@check("locate_stations", f"""WITH {CELL_SQL}
  SELECT c_custkey AS station, CAST(floor(c_custkey / 40) AS INTEGER) AS iy, CAST(c_custkey % 40 AS INTEGER) AS ix,
         CASE WHEN z_m IS NULL THEN 'celula_oceano' ELSE 'ok' END AS motivo FROM cells""")
def locate_stations(spark, d):
    """Places given in degrees, at the centres of their cells on a grid of kilometres in the projection."""
    c = cells(spark, d)
    x0, y0 = 400000.0, 6900000.0
    lon, lat = utm_to_lonlat(F.lit(x0) + F.col("ix") * 1000.0, F.lit(y0) + F.col("iy") * 1000.0)
    st = c.select(F.col("c_custkey").alias("station"), lon.alias("longitude"), lat.alias("latitude"))
    grid = c.select("iy", "ix", F.col("z_m").alias("z_alvo"), "lon", "lat")
    rows = c.agg(F.max("iy")).first()[0] + 1
    return G.locate_stations(st, grid, G.Axes(x0, y0, 1000.0, 1000.0, 40, rows)).select("station", "iy", "ix", "motivo")


@check("grid_record", f"""WITH {CELL_SQL}
  SELECT count(DISTINCT iy) AS ny, count(DISTINCT ix) AS nx, min(x_km) AS x_min, max(x_km) AS x_max, min(y_km) AS y_min,
         max(y_km) AS y_max, (max(x_km) - min(x_km)) / (count(DISTINCT ix) - 1) AS dx,
         (max(y_km) - min(y_km)) / (count(DISTINCT iy) - 1) AS dy, CAST(11 AS INTEGER) AS factor,
         CAST(-9999.0 AS DOUBLE) AS nodata, 'EPSG:31982' AS crs FROM cells""")
def grid_record(spark, d):
    return G.grid_meta(cells(spark, d).withColumnsRenamed({"x_km": "x", "y_km": "y"}))


@check("bbox_scan", """
  SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  WHERE o_orderkey BETWEEN 995 AND 9005 AND o_custkey BETWEEN 95 AND 1205""")
def bbox_scan(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return G.bbox_scan(o, (1000, 9000), (100, 1200), 5, "o_orderkey", "o_custkey")


# --- pixels ------------------------------------------------------------------------------------------

@check("block_stats", f"""WITH {PIXEL_SQL},
  b AS (SELECT CAST(floor(py / 11) AS INTEGER) AS iy, CAST(floor(px / 11) AS INTEGER) AS ix, z FROM pixels)
  SELECT iy, ix, {r6('avg(z)')} AS z_mean, {r6('stddev_pop(z)')} AS z_std, {r6('max(z)')} AS z_max,
         {r6('quantile_cont(z, 0.1)')} AS z_p10, {r6('quantile_cont(z, 0.9)')} AS z_p90
  FROM b WHERE iy < (SELECT floor((max(py) + 1) / 11) FROM pixels) AND ix < (SELECT floor((max(px) + 1) / 11) FROM pixels)
  GROUP BY 1, 2""")
def block_stats(spark, d):
    stats = {"z_mean": F.avg("z"), "z_std": F.stddev_pop("z"), "z_max": F.max("z"), "z_p10": F.percentile("z", 0.1), "z_p90": F.percentile("z", 0.9)}
    return rounded(R.block_agg(pixels(spark, d), stats))


# pixel columns behind the layers, made from the raster's own values
PIXEL_LAYERS = ("tri", "eastness", "svf", "mrvbf", "hand", "dev_r300", "dev_r1000", "dev_r3000")


def _layer_sql():
    kinds = {"avg": "avg({0})", "stddev_pop": "stddev_pop({0})", "max": "max({0})"}
    out = []
    for name, (column, how) in R.TERRAIN_LAYERS.items():
        kind = kinds.get(getattr(how, "__name__", ""), "quantile_cont({0}, 0.9)" if "p90" in name else "quantile_cont({0}, 0.1)")
        out.append(f"{r6(kind.format(column))} AS {name}")
    return ", ".join(out)


@check("terrain_layers", f"""WITH {PIXEL_SQL},
  b AS (SELECT CAST(floor(py / 11) AS INTEGER) AS iy, CAST(floor(px / 11) AS INTEGER) AS ix, z, slope,
               CASE WHEN z IS NOT NULL THEN CASE WHEN slope < 0.5 THEN 0.0 ELSE cos(radians(aspect)) END END AS northness,
               {', '.join(f"CASE WHEN z IS NOT NULL THEN z * {i + 2} + slope END AS {n}" for i, n in enumerate(PIXEL_LAYERS))}
        FROM pixels)
  SELECT iy, ix, {_layer_sql()}
  FROM b WHERE iy < (SELECT floor((max(py) + 1) / 11) FROM pixels) AND ix < (SELECT floor((max(px) + 1) / 11) FROM pixels)
  GROUP BY 1, 2""")
def terrain_layers(spark, d):
    px = pixels(spark, d).withColumn("northness", P.northness("aspect", "slope", F.col("z").isNotNull())).drop("aspect")
    px = px.withColumns({n: F.col("z") * (i + 2) + F.col("slope") for i, n in enumerate(PIXEL_LAYERS)})
    return rounded(R.terrain_layers(px))


def _ring_sql(reach, low, high):
    return f"""WITH {PIXEL_SQL},
  v AS (SELECT px, py, z FROM pixels WHERE z IS NOT NULL),
  o AS (SELECT dx, dy FROM (SELECT unnest(generate_series(-{reach}, {reach})) AS dx) CROSS JOIN (SELECT unnest(generate_series(-{reach}, {reach})) AS dy)
        WHERE sqrt(dx * dx + dy * dy) > {low} AND sqrt(dx * dx + dy * dy) <= {high}),
  n AS (SELECT v.px, v.py, any_value(v.z) AS z, avg(w.z) AS m, stddev_pop(w.z) AS s
        FROM v CROSS JOIN o LEFT JOIN v w ON w.px = v.px + o.dx AND w.py = v.py + o.dy GROUP BY 1, 2)
  SELECT px, py, {r6('CASE WHEN s >= 1e-6 THEN (z - m) / s END')} AS dev FROM n"""


@check("ring_dev", _ring_sql(3, 1, 3))
def ring_dev(spark, d):
    return rounded(R.ring_dev(pixels(spark, d).select("px", "py", "z"), 1.0, 3.0, 1.0, tile=64))


@check("ring_dev_wide", _ring_sql(33, 30, 33))
def ring_dev_wide(spark, d):
    """The widest ring of the terrain layers: 33 pixels."""
    return rounded(R.ring_dev(pixels(spark, d).select("px", "py", "z"), 30.0, 33.0, 1.0, tile=128))


# 30 m classes: line items on a grid of order blocks, code from the part
CODE_SQL = """
  codes AS (SELECT CAST(floor(l_orderkey / 50) AS INTEGER) AS iy, CAST(l_partkey % 9 AS INTEGER) AS ix, p_size AS code,
                   CASE WHEN p_size % 9 <> 0 THEN 'T' || (p_size % 8 + 1) END AS grupo
            FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _codes(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("code"))
    return table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        "l_orderkey", "l_linenumber", F.floor(F.col("l_orderkey") / 50).cast("int").alias("iy"),
        (F.col("l_partkey") % 9).cast("int").alias("ix"), "code")


def _lookup(spark, d):
    p = F.col("p_size")
    return (table(spark, d, "part").filter(p % 9 != 0).select(
        p.alias("code"), F.concat(F.lit("T"), (p % 8 + 1).cast("string")).alias("grupo")).distinct())


FRACTION_SQL = CODE_SQL + """,
  f AS (SELECT iy, ix, """ + ", ".join(
    f"CAST(count(*) FILTER (grupo = 'T{i}') AS DOUBLE) / NULLIF(count(grupo), 0) AS fracao_t{i}" for i in range(1, 9)) + """,
         CAST(count(grupo) AS DOUBLE) / count(*) AS fracao_observada FROM codes GROUP BY 1, 2)"""


@check("class_fractions", f"""WITH {FRACTION_SQL}
  SELECT iy, ix, {', '.join(f"{r6(f'fracao_t{i}')} AS fracao_t{i}" for i in range(1, 9))},
         {r6('fracao_observada')} AS fracao_observada FROM f""")
def class_fractions(spark, d):
    return rounded(R.fractions(_codes(spark, d), _lookup(spark, d)))


_FR = ", ".join(f"fracao_t{i}" for i in range(1, 9))


@check("fraction_check", f"""WITH {FRACTION_SQL}
  SELECT {r6(f'min(least({_FR}))')} AS frac_min, {r6(f'max(greatest({_FR}))')} AS frac_max,
         {r6(f"max(abs({_FR.replace(', ', ' + ')} - 1.0))")} AS sum_err, TRUE AS ok FROM f""")
def fraction_check(spark, d):
    return rounded(R.check_fractions(R.fractions(_codes(spark, d), _lookup(spark, d))))


@check("classify_pixels", f"""WITH {CODE_SQL} SELECT iy, ix, code, grupo FROM codes""")
def classify_pixels(spark, d):
    return R.classify(_codes(spark, d), _lookup(spark, d)).select("iy", "ix", "code", "grupo")


@check("unmapped_codes", """SELECT DISTINCT p_size AS code FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size % 9 = 0""")
def unmapped_codes(spark, d):
    return R.unmapped_codes(_codes(spark, d), _lookup(spark, d))


# --- neighbours --------------------------------------------------------------------------------------

KNN_SQL = STATION_SQL + "," + CELL_SQL + """,
  pairs AS (SELECT c.iy, c.ix, n.station, sqrt((n.x_km - c.x_km) * (n.x_km - c.x_km) + (n.y_km - c.y_km) * (n.y_km - c.y_km)) AS d,
                   COALESCE(n.z_m - c.z_m, 0) AS dz FROM cells c CROSS JOIN net n)"""


@check("knn_stations", f"""WITH {KNN_SQL}
  SELECT iy, ix, station, {r6('d')} AS d, CAST(row_number() OVER (PARTITION BY iy, ix ORDER BY d, station) AS INTEGER) AS rank
  FROM pairs QUALIFY row_number() OVER (PARTITION BY iy, ix ORDER BY d, station) <= 20""")
def knn_stations(spark, d):
    return rounded(N.knn(cells(spark, d), net(spark, d), 20, x="x_km", y="y_km"))


@check("stations_within_radius", f"""WITH {KNN_SQL} SELECT iy, ix, station, {r6('d')} AS d FROM pairs WHERE d <= 30""")
def stations_within_radius(spark, d):
    return rounded(N.within_radius(cells(spark, d), net(spark, d), 30.0, x="x_km", y="y_km"))


@check("knn_leave_one_out", f"""WITH {STATION_SQL},
  p AS (SELECT a.station, b.station AS other, sqrt((a.x_km - b.x_km) * (a.x_km - b.x_km) + (a.y_km - b.y_km) * (a.y_km - b.y_km)) AS d,
               abs(a.z_m - b.z_m) AS dz FROM net a JOIN net b ON a.station <> b.station)
  SELECT station, other, {r6('d')} AS d_km, CAST(row_number() OVER (PARTITION BY station ORDER BY d, other) AS INTEGER) AS rank, dz
  FROM p QUALIFY row_number() OVER (PARTITION BY station ORDER BY d, other) <= 8""")
def knn_leave_one_out(spark, d):
    from finescale.operators.anchoring import knn_loo
    return rounded(knn_loo(net(spark, d), 8))


@check("station_pairs", f"""WITH {STATION_SQL},
  p AS (SELECT a.station, b.station AS other, sqrt((a.x_km - b.x_km) * (a.x_km - b.x_km) + (a.y_km - b.y_km) * (a.y_km - b.y_km)) AS d,
               abs(a.z_m - b.z_m) AS dz FROM net a JOIN net b ON a.station <> b.station)
  SELECT station, other, {r6('d')} AS d_km, dz FROM p WHERE d <= 60""")
def station_pairs(spark, d):
    from finescale.operators.anchoring import station_pairs
    return rounded(station_pairs(net(spark, d), 60.0))


@check("rank_neighbours", f"""WITH {KNN_SQL}
  SELECT iy, ix, station, {r6('d')} AS d FROM pairs WHERE d <= 25
  QUALIFY row_number() OVER (PARTITION BY iy, ix ORDER BY d, station) <= 3""")
def rank_neighbours(spark, d):
    near = N.within_radius(cells(spark, d), net(spark, d), 25.0, x="x_km", y="y_km")
    return rounded(N.rank_neighbours(near, 3).drop("rank"))


@check("coast_distance", f"""WITH {CELL_SQL},
  v AS (SELECT p_partkey, p_partkey % 23 * 9.0 AS x_km, floor(p_partkey / 20) * 1.1 AS y_km FROM part)
  SELECT iy, ix, {r6('min(sqrt((v.x_km - c.x_km) * (v.x_km - c.x_km) + (v.y_km - c.y_km) * (v.y_km - c.y_km)))')} AS dist_oceano
  FROM cells c CROSS JOIN v GROUP BY 1, 2""")
def coast_distance(spark, d):
    p = F.col("p_partkey")
    v = table(spark, d, "part").select(p.alias("vertex"), (p % 23 * 9.0).alias("x_km"), (F.floor(p / 20) * 1.1).alias("y_km"))
    return rounded(N.nearest_distance(cells(spark, d), v, x="x_km", y="y_km"))


# --- gates -------------------------------------------------------------------------------------------

@check("gate_static_ranges", f"""WITH {CELL_SQL},
  s AS (SELECT iy, ix, z_m AS hand_mean_1km, acctbal / 100 AS slope_mean_1km FROM cells)
  SELECT 'hand_mean_1km' AS camada, min(hand_mean_1km) AS v_min, max(hand_mean_1km) AS v_max, TRUE AS ok FROM s
  UNION ALL SELECT 'slope_mean_1km', {r6('min(slope_mean_1km)')}, {r6('max(slope_mean_1km)')},
         min(slope_mean_1km) >= -0.001 AND max(slope_mean_1km) <= 90.001 FROM s""")
def gate_static_ranges(spark, d):
    s = cells(spark, d).select("iy", "ix", F.col("z_m").alias("hand_mean_1km"), (F.col("acctbal") / 100).alias("slope_mean_1km"))
    return rounded(GT.gate_static_ranges(s))


GATE_SQL = CELL_SQL + """,
  land AS (SELECT iy, ix, z_m, acctbal FROM cells WHERE z_m IS NOT NULL),
  other AS (SELECT iy, ix, z_m, acctbal + CASE WHEN c_custkey % 100 = 0 THEN 1 ELSE 0 END AS acctbal FROM cells)"""


def _surveyed(spark, d):
    """Places on the central meridian with the northing of a closed formula: the meridian arc in powers of the eccentricity, which
    shares nothing with the projection under test. Every 50th is moved by 2 mm."""
    e2 = 1 / 298.257222101 * (2 - 1 / 298.257222101)
    k = F.col("c_custkey")
    lat = -28 + (k % 400) / 100
    phi = F.radians(lat)
    arc = 6378137.0 * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256 - 175 * e2**4 / 16384) * phi
                       - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024 + 105 * e2**4 / 4096) * F.sin(2 * phi)
                       + (15 * e2**2 / 256 + 45 * e2**3 / 1024 + 525 * e2**4 / 16384) * F.sin(4 * phi)
                       - (35 * e2**3 / 3072 + 175 * e2**4 / 12288) * F.sin(6 * phi) + 315 * e2**4 / 131072 * F.sin(8 * phi))
    moved = F.when(k % 50 == 0, 0.002).otherwise(0.0)
    return table(spark, d, "customer").select(F.lit(-51.0).alias("longitude"), lat.alias("latitude"), F.lit(500000.0).alias("x_utm"),
                                              (10000000 + 0.9996 * arc + moved).alias("y_utm"))


@check("gates", f"""WITH {GATE_SQL}
  SELECT 'grid_keys' AS gate, count(*) AS n_bad, count(*) = 0 AS ok FROM
    (SELECT * FROM (SELECT iy, ix FROM cells EXCEPT SELECT iy, ix FROM land)
     UNION ALL SELECT * FROM (SELECT iy, ix FROM land EXCEPT SELECT iy, ix FROM cells))
  UNION ALL SELECT 'train_equals_inference', count(*), count(*) = 0 FROM cells c LEFT JOIN other o ON o.iy = c.iy AND o.ix = c.ix
    WHERE c.z_m IS DISTINCT FROM o.z_m OR COALESCE(abs(c.acctbal - o.acctbal) > 1e-9, TRUE)
  UNION ALL SELECT 'same_cell', count(*) FILTER (floor(x_km / 2.5) <> ix OR floor(y_km / 2.5) <> iy), TRUE FROM cells
  UNION ALL SELECT 'fraction_columns', 0, TRUE
  UNION ALL SELECT 'reprojection', count(*) FILTER (c_custkey % 50 = 0), count(*) FILTER (c_custkey % 50 = 0) = 0 FROM customer""")
def gates(spark, d):
    c = cells(spark, d)
    other = c.select("iy", "ix", "z_m", (F.col("acctbal") + F.when(F.col("c_custkey") % 100 == 0, 1).otherwise(0)).alias("acctbal"))
    rows = c.agg(F.max("iy")).first()[0] + 1
    return GT.gate_report([
        GT.gate_on_grid(c.filter("z_m IS NOT NULL"), c),
        GT.gate_train_equals_inference(c, other, ["iy", "ix"], ["z_m", "acctbal"]),
        GT.gate_same_cell(c, G.Axes(0.0, 0.0, 2.5, 2.5, 40, rows), "x_km", "y_km"),
        GT.gate_fractions(R.fractions(_codes(spark, d), _lookup(spark, d))),
        GT.gate_reprojection(_surveyed(spark, d))])


@check("missing_baseline", f"""WITH {STATION_SQL}, {OBS_CELL_SQL}
  SELECT station, x_km AS longitude, y_km AS latitude, n.iy, n.ix, 'era5_t2m_nan_estrutural' AS motivo
  FROM (SELECT *, CAST(floor(station / 6) AS INTEGER) AS iy, CAST(floor(station / 6) AS INTEGER) % 7 AS ix FROM net) n
  LEFT JOIN (SELECT * FROM obs_cell WHERE ts = TIMESTAMP '2024-01-01 12:00:00' AND n_est_cel >= 2) o ON o.iy = n.iy AND o.ix = n.ix
  WHERE o.temperatura_c_qc IS NULL""")
def missing_baseline(spark, d):
    st = net(spark, d).withColumnsRenamed({"x_km": "longitude", "y_km": "latitude"}).join(station_cells(spark, d), "station")
    return GT.missing_baseline(st, obs_cell(spark, d).filter("n_est_cel >= 2").withColumnRenamed("temperatura_c_qc", "t2m_1km"), "2024-01-01 12:00:00")
