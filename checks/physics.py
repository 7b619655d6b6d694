"""Column expressions: time, moisture, flux, terrain, keys and projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import PIXEL_SQL, check, pixels, r6, rounded, table
from finescale.functions import physics as P
from finescale.functions.metrics import sort_band
from finescale.functions.time import to_utc, with_time_features
from finescale.functions.utm import lonlat_to_utm, utm_to_lonlat
from finescale.plans.features import derive, raw_needed


@check("time_encoding", f"""
  SELECT event_id, {r6('sin(2 * pi() * hour(ts) / 24)')} AS hora_sin, {r6('cos(2 * pi() * hour(ts) / 24)')} AS hora_cos,
         {r6('sin(2 * pi() * dayofyear(ts) / 365.25)')} AS doy_sin, {r6('cos(2 * pi() * dayofyear(ts) / 365.25)')} AS doy_cos
  FROM events""")
def time_encoding(spark, d):
    return rounded(with_time_features(table(spark, d, "events").select("event_id", "ts")).drop("ts"))


@check("to_utc", "SELECT event_id, ts + INTERVAL 3 HOUR AS utc FROM events")
def local_to_utc(spark, d):
    return table(spark, d, "events").select("event_id", to_utc("ts").alias("utc"))


# raw coarse variables out of the line items (Kelvin, Pascal, W m-2)
RAW_SQL = """
  raw AS (
    SELECT l_orderkey, l_linenumber, l_partkey,
           CAST(270 + l_quantity / 2 AS DOUBLE) AS t2m, CAST(265 + l_quantity / 2 * l_discount * 10 AS DOUBLE) AS d2m,
           270 + l_tax * 100 AS skt, 271 + l_tax * 50 AS stl1,
           CAST(l_suppkey % 20 - 10 AS DOUBLE) AS u10, CAST(l_partkey % 15 - 7 AS DOUBLE) AS v10,
           90000 + l_extendedprice / 10 AS sp, CAST(l_quantity - 25 AS DOUBLE) AS sshf,
           CAST((l_partkey % 40 - 20) / 10.0 AS DOUBLE) AS slhf, l_extendedprice / 100 AS ssr, -l_quantity AS "str",
           CAST(l_partkey % 900 - 300 AS DOUBLE) AS delta_z
    FROM lineitem)"""


def _raw(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (270 + c("l_quantity") / 2).alias("t2m"),
        (265 + c("l_quantity") / 2 * c("l_discount") * 10).alias("d2m"), (270 + c("l_tax") * 100).alias("skt"),
        (271 + c("l_tax") * 50).alias("stl1"), (c("l_suppkey") % 20 - 10).cast("double").alias("u10"),
        (c("l_partkey") % 15 - 7).cast("double").alias("v10"), (90000 + c("l_extendedprice") / 10).alias("sp"),
        (c("l_quantity") - 25).alias("sshf"), ((c("l_partkey") % 40 - 20) / F.lit(10.0)).alias("slhf"),
        (c("l_extendedprice") / 100).alias("ssr"), (-c("l_quantity")).alias("str"),
        (c("l_partkey") % 900 - 300).cast("double").alias("delta_z"))


def _es(t):
    return f"6.112 * exp(17.67 * ({t}) / (({t}) + 243.5))"


@check("derived_physics", f"""WITH {RAW_SQL}
  SELECT l_orderkey, l_linenumber, l_partkey, {r6('t2m')} AS t2m_1km, {r6('t2m - 0.0065 * delta_z')} AS lapse, u10, v10,
         {r6('sqrt(u10 * u10 + v10 * v10)')} AS vel_vento, {r6('sp / 100')} AS sp, {r6('t2m - d2m')} AS dep_orvalho,
         {r6(f"100 * {_es('d2m - 273.15')} / ({_es('t2m - 273.15')})")} AS umidade_relativa,
         {r6('t2m - skt')} AS dt_ar_pele, {r6('t2m - stl1')} AS dt_ar_solo, {r6('ssr + "str"')} AS rad_liquida,
         {r6('CASE WHEN abs(slhf) >= 1 THEN sshf / slhf END')} AS razao_bowen, {r6('ssr')} AS ssr, {r6('"str"')} AS "str"
  FROM raw""")
def derived_physics(spark, d):
    return rounded(derive(_raw(spark, d), keep=["l_orderkey", "l_linenumber", "l_partkey"]))


@check("raw_variables_needed", f"""WITH {RAW_SQL}
  SELECT l_orderkey, l_linenumber, l_partkey, {r6('t2m')} AS t2m_1km, {r6('sqrt(u10 * u10 + v10 * v10)')} AS vel_vento FROM raw""")
def raw_variables_needed(spark, d):
    key, want = ["l_orderkey", "l_linenumber", "l_partkey"], ["vel_vento"]
    return rounded(derive(_raw(spark, d).select(*key, *raw_needed(want)), want, keep=key))


@check("northness_eastness", f"""WITH {PIXEL_SQL}
  SELECT px, py, {r6('CASE WHEN z IS NOT NULL THEN CASE WHEN slope < 0.5 THEN 0.0 ELSE cos(radians(aspect)) END END')} AS northness,
         {r6('CASE WHEN z IS NOT NULL THEN CASE WHEN slope < 0.5 THEN 0.0 ELSE sin(radians(aspect)) END END')} AS eastness
  FROM pixels""")
def northness_eastness(spark, d):
    land = F.col("z").isNotNull()
    return rounded(pixels(spark, d).select("px", "py", P.northness("aspect", "slope", land).alias("northness"),
                                           P.eastness("aspect", "slope", land).alias("eastness")))


def _bins(v, edges, labels):
    return "CASE " + " ".join(f"WHEN {v} > {a} AND {v} <= {b} THEN '{n}'"
                              for a, b, n in zip(edges[:-1], edges[1:], labels)) + " END"


@check("right_closed_bins", f"""
  SELECT o_orderkey, {_bins('o_totalprice / 200', P.ELEVATION_EDGES, P.ELEVATION_LABELS)} AS faixa_elev,
         {_bins('o_custkey * 10 / 1000.0', P.COAST_EDGES_KM, P.COAST_LABELS)} AS faixa_costa FROM orders""")
def right_closed_bins(spark, d):
    return table(spark, d, "orders").select("o_orderkey", P.elevation_band(F.col("o_totalprice") / 200).alias("faixa_elev"),
                                            P.coast_band(F.col("o_custkey") * 10).alias("faixa_costa"))


@check("branch_routing", f"""
  SELECT l_orderkey, l_linenumber, l_partkey, {r6('''CASE WHEN l_quantity <= 10 THEN l_tax WHEN l_quantity > 40 THEN l_discount
         ELSE l_extendedprice END''')} AS pred FROM lineitem""")
def branch_routing(spark, d):
    return rounded(table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        P.route("l_quantity", 10.0, 40.0, "l_tax", "l_extendedprice", "l_discount").alias("pred")))


@check("cell_keys", """
  SELECT o_orderkey, (o_custkey % 90) || '_' || (o_orderkey % 130) AS cell_id,
         CAST(o_custkey % 90 AS INTEGER) AS iy, CAST(o_orderkey % 130 AS INTEGER) AS ix,
         (o_custkey % 90) * 120 + o_orderkey % 130 AS flat FROM orders
  WHERE o_custkey % 90 < 80 AND o_orderkey % 130 < 120""")
def cell_keys(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", P.cell_id((F.col("o_custkey") % 90).cast("int"), (F.col("o_orderkey") % 130).cast("int")).alias("cell_id"))
    iy, ix = P.parse_cell("cell_id")
    return (o.withColumns({"iy": iy, "ix": ix}).filter(P.inside_grid("iy", "ix", 80, 120))
            .withColumn("flat", P.flat_index("iy", "ix", 120)))


@check("sorted_band", """
  SELECT l_orderkey, l_linenumber, l_partkey, least(l_tax, l_discount) AS lo, greatest(l_tax, l_discount) AS hi FROM lineitem""")
def sorted_band(spark, d):
    lo, hi = sort_band("l_discount", "l_tax")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", lo.alias("lo"), hi.alias("hi"))


# The SQL side carries the series to the sixth order in the third flattening (the operator: fourth) and gets the conformal
# latitude from tangents instead of sines. Coefficients are fixed values, published in Karney (2011).
_N = 1 / (2 * 298.257222101 - 1)
_ALPHA = ((1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
          (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440), (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
          (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840), (0, 0, 0, 0, 0, 212378941 / 319334400))
_TERMS = [(2 * j, sum(c * _N ** k for k, c in enumerate(row, 1))) for j, row in enumerate(_ALPHA, 1)]
_ARC = 0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_ECC = (1 - ((1 - _N) / (1 + _N)) ** 2) ** 0.5
UTM_SQL = f"""
  p AS (SELECT c_custkey, -51 + (c_custkey % 97) / 97.0 - 0.5 AS lon, -28.5 + (c_custkey % 89) / 40.0 AS lat FROM customer),
  a AS (SELECT *, radians(lon + 51) AS lam, tan(radians(lat)) AS tau,
               sinh({_ECC!r} * atanh({_ECC!r} * tan(radians(lat)) / sqrt(1 + tan(radians(lat)) * tan(radians(lat))))) AS sig FROM p),
  c AS (SELECT *, tau * sqrt(1 + sig * sig) - sig * sqrt(1 + tau * tau) AS t FROM a),
  m AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM c)"""


@check("utm_projection", f"""WITH {UTM_SQL}
  SELECT c_custkey, {r6(f"500000 + {_ARC!r} * (eta + {' + '.join(f'({v!r}) * cos({k} * xi) * sinh({k} * eta)' for k, v in _TERMS)})", 3)} AS x,
    {r6(f"10000000 + {_ARC!r} * (xi + {' + '.join(f'({v!r}) * sin({k} * xi) * cosh({k} * eta)' for k, v in _TERMS)})", 3)} AS y,
    {r6('lon', 8)} AS lon, {r6('lat', 8)} AS lat
  FROM m""")
def utm_projection(spark, d):
    k = F.col("c_custkey")
    pts = table(spark, d, "customer").select(k, (-51 + (k % 97) / F.lit(97.0) - 0.5).alias("lon"),
                                             (-28.5 + (k % 89) / F.lit(40.0)).alias("lat"))
    x, y = lonlat_to_utm("lon", "lat")
    there = pts.select("c_custkey", x.alias("x"), y.alias("y"))
    lon, lat = utm_to_lonlat("x", "y")
    back = there.withColumns({"lon": lon, "lat": lat})
    return rounded(rounded(back, 3, ["x", "y"]), 8, ["lon", "lat"])
