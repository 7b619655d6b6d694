"""Quality control, collapse, joins, windows in time, inventories."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from checks.base import (CELL_SQL, OBS_CELL_SQL, OBS_SQL, STATION_SQL, cells, check, net, obs, obs_cell, r6,
                         rounded, station_cells, table)
from finescale.functions import physics as P
from finescale.functions.time import to_utc
from finescale.operators import quality as Q
from finescale.operators import series as S
from finescale.operators import tables as T
from finescale.sources import inventory as I
from finescale.sources import readers as R
from finescale.sources import writers as W

# thresholds fitted to the driver's event values
LIMITS = Q.Limits(low=0.0, high=150.0, max_jump=100.0, stuck_hours=3)
def _level():
    return F.floor(F.col("temperatura_c_qc") / 50)


ORDER = ("ts", "event_id")


def _qc(spark, d):
    return Q.qc_temperature(obs(spark, d), keys=["station"], order=ORDER, limits=LIMITS, level=_level())


QC_SQL = OBS_SQL + """,
  q0 AS (
    SELECT *, TRY_CAST(md_valor AS DOUBLE) AS raw, TRY_CAST(md_final AS DOUBLE) AS fl FROM obs),
  q1 AS (SELECT *, CASE WHEN fl IN (4, 5) THEN raw END AS t_flag FROM q0),
  q2 AS (SELECT *, CASE WHEN t_flag BETWEEN 0 AND 150 THEN t_flag END AS t_range FROM q1),
  q3 AS (SELECT *, COALESCE(abs(t_range - lag(t_range) OVER w) > 100, FALSE) AS jump FROM q2
         WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)),
  q4 AS (SELECT *, CASE WHEN NOT jump THEN t_range END AS t_spike FROM q3),
  q5 AS (SELECT *, CASE WHEN floor(t_spike / 50) = lag(floor(t_spike / 50)) OVER w THEN 1 ELSE 0 END AS same FROM q4
         WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)),
  q6 AS (SELECT *, sum(same) OVER (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3
                   AS stuck FROM q5),
  qc AS (
    SELECT station, ts, event_id, md_final, CASE WHEN NOT stuck THEN t_spike END AS temperatura_c_qc,
           CASE WHEN raw IS NULL THEN 'missing' WHEN t_flag IS NULL THEN 'flag' WHEN t_range IS NULL THEN 'range'
                WHEN jump THEN 'spike' WHEN stuck AND t_spike IS NOT NULL THEN 'stuck' ELSE 'kept' END AS qc_stage
    FROM q6)"""


@check("qc_temperature", f"WITH {QC_SQL} SELECT event_id, station, temperatura_c_qc, qc_stage FROM qc")
def qc_temperature(spark, d):
    return _qc(spark, d).select("event_id", "station", "temperatura_c_qc", "qc_stage")


@check("qc_spike", f"""WITH {OBS_SQL}
  SELECT event_id, CASE WHEN NOT COALESCE(abs(value - lag(value) OVER w) > 60, FALSE) THEN value END AS value
  FROM obs WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)""")
def qc_spike(spark, d):
    return Q.qc_spike(obs(spark, d), "value", order=ORDER, max_jump=60.0).select("event_id", "value")


@check("qc_stuck", f"""WITH {OBS_SQL},
  s AS (SELECT *, CASE WHEN floor(value / 40) = lag(floor(value / 40)) OVER w THEN 1 ELSE 0 END AS same FROM obs
        WINDOW w AS (PARTITION BY station ORDER BY ts, event_id))
  SELECT event_id, CASE WHEN sum(same) OVER (PARTITION BY station ORDER BY ts, event_id
         ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) < 4 THEN value END AS value FROM s""")
def qc_stuck(spark, d):
    return Q.qc_stuck(obs(spark, d), "value", order=ORDER, hours=4, unit="day",
                      level=F.floor(F.col("value") / 40)).select("event_id", "value")


@check("qc_audit", f"""WITH {QC_SQL}
  SELECT qc_stage, count(*) AS n, {r6('100.0 * count(*) / (SELECT count(*) FROM qc)')} AS pct FROM qc GROUP BY 1""")
def qc_audit(spark, d):
    return rounded(Q.qc_audit(_qc(spark, d)))


@check("flag_audit", f"""WITH {QC_SQL}
  SELECT COALESCE(CAST(TRY_CAST(md_final AS INTEGER) AS VARCHAR), 'nan') AS flag, count(*) AS n,
         count(temperatura_c_qc) AS n_valid,
         CASE WHEN TRY_CAST(md_final AS INTEGER) IN (4, 5) THEN 'valid' ELSE 'dropped' END AS status
  FROM qc GROUP BY 1, 4""")
def flag_audit(spark, d):
    return Q.flag_audit(_qc(spark, d))


@check("coverage_filter", f"""WITH {QC_SQL}
  SELECT station, count(*) AS n, count(temperatura_c_qc) AS n_valid FROM qc
  GROUP BY 1 HAVING count(temperatura_c_qc) >= 25""")
def coverage_filter(spark, d):
    kept = Q.min_coverage(_qc(spark, d), 25)
    return kept.groupBy("station").agg(F.count("*").alias("n"), F.count("temperatura_c_qc").alias("n_valid"))


@check("qc_then_window", f"""WITH {QC_SQL}
  SELECT event_id, ts + INTERVAL 3 HOUR AS data_hora_utc, temperatura_c_qc FROM qc
  WHERE ts + INTERVAL 3 HOUR >= TIMESTAMP '2024-01-10' AND ts + INTERVAL 3 HOUR < TIMESTAMP '2024-01-13'""")
def qc_then_window(spark, d):
    data = obs(spark, d).withColumn("data_hora_utc", to_utc("ts"))
    out = Q.clean_observations(data, datetime(2024, 1, 10), datetime(2024, 1, 13), keys=["station"], order=ORDER,
                               limits=LIMITS, level=_level())
    return out.select("event_id", "data_hora_utc", "temperatura_c_qc")


@check("replace_window", f"""WITH {OBS_SQL}
  SELECT event_id, ts, value FROM obs
  WHERE event_type <> 'signup' AND NOT (ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15')
  UNION ALL SELECT event_id, ts, -value FROM obs
  WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'""")
def replace_window(spark, d):
    o = obs(spark, d)
    start, end = datetime(2024, 1, 8), datetime(2024, 1, 15)
    old = o.filter("event_type <> 'signup'").select("event_id", "ts", "value")
    new = o.filter("event_type = 'signup'").select("event_id", "ts", (-F.col("value")).alias("value"))
    from finescale.functions.time import in_window
    return T.replace_window(old, new.filter(in_window("ts", start, end)), start, end, "ts")


@check("keep_first_duplicate", """
  SELECT o_custkey, o_orderkey, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def keep_first_duplicate(spark, d):
    o = table(spark, d, "orders")
    return S.keep_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


# metadata of stations (customers) known to the orders table only by code, with repeated lines
META_SQL = """
  meta AS (
    SELECT c_custkey AS station, c_acctbal AS altitude, CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_nationkey * 1.5 AS DOUBLE) END AS latitude
    FROM customer WHERE c_mktsegment <> 'MACHINERY')"""


def _meta(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment <> 'MACHINERY'")
    rows = c.select(F.col("c_custkey").alias("station"), F.col("c_acctbal").alias("altitude"),
                    F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey") * 1.5).alias("latitude"),
                    F.lit(1).alias("_line"))
    later = rows.withColumns({"altitude": F.lit(-1.0), "_line": F.lit(2)})
    return rows.unionByName(later)


def _order_obs(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("station"), "o_totalprice")


@check("attach_meta", f"""WITH {META_SQL}
  SELECT o_orderkey, o_custkey AS station, altitude, latitude FROM orders LEFT JOIN meta ON station = o_custkey""")
def attach_meta(spark, d):
    return T.attach_meta(_order_obs(spark, d), _meta(spark, d)).select("o_orderkey", "station", "altitude", "latitude")


@check("without_coords", f"""WITH {META_SQL}
  SELECT DISTINCT o_custkey AS station FROM orders LEFT JOIN meta ON station = o_custkey WHERE latitude IS NULL""")
def without_coords(spark, d):
    return T.without_coords(T.attach_meta(_order_obs(spark, d), _meta(spark, d)))


@check("exclude_stations", f"""WITH {OBS_SQL},
  codes AS (SELECT DISTINCT s_suppkey AS station FROM supplier WHERE s_acctbal < 0)
  SELECT event_id, station FROM obs WHERE station NOT IN (SELECT station FROM codes)""")
def exclude_stations(spark, d):
    codes = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("station"))
    return T.exclude_stations(obs(spark, d), codes).select("event_id", "station")


@check("unknown_codes", f"""WITH {STATION_SQL}
  SELECT DISTINCT c_custkey AS station FROM customer WHERE c_acctbal < 0
  EXCEPT SELECT station FROM net""")
def unknown_codes(spark, d):
    codes = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("station"))
    return T.unknown_codes(codes, net(spark, d))


@check("cell_hour_mean", f"""WITH {OBS_CELL_SQL}
  SELECT iy, ix, CAST(ts AS TIMESTAMP) AS ts, {r6('temperatura_c_qc')} AS temperatura_c_qc, n_est_cel FROM obs_cell""")
def cell_hour_mean(spark, d):
    return rounded(obs_cell(spark, d))


# hourly cell series as a field: the collapsed mean in Kelvin
STACK_SQL = OBS_CELL_SQL + """,
  stack AS (SELECT iy, ix, CAST(ts AS TIMESTAMP) AS ts, temperatura_c_qc + 273.15 AS t2m_1km FROM obs_cell)"""


def _stack(spark, d):
    return obs_cell(spark, d).select("iy", "ix", "ts", (F.col("temperatura_c_qc") + 273.15).alias("t2m_1km"))


MEMORY_SQL = f"""WITH {STACK_SQL}
  SELECT a.iy, a.ix, a.ts,
    {', '.join(f"{r6(f'a.t2m_1km - l{h}.t2m_1km')} AS dt2m_{h}h, {r6(f'a.t2m_1km - 2 * l{h}.t2m_1km + l{2 * h}.t2m_1km')} AS d2t2m_{h}h"
               for h in (1, 2, 3))}
  FROM stack a
  {' '.join(f"LEFT JOIN stack l{h} ON l{h}.iy = a.iy AND l{h}.ix = a.ix AND l{h}.ts = a.ts - INTERVAL {h} HOUR"
            for h in (1, 2, 3, 4, 6))}"""


@check("memory_features", MEMORY_SQL)
def memory_features(spark, d):
    return rounded(S.memory_features(_stack(spark, d)).drop("t2m_1km"))


@check("lag_exact", f"""WITH {STACK_SQL}
  SELECT a.iy, a.ix, a.ts, {r6('b.t2m_1km')} AS lag5, {r6('CASE WHEN month(b.ts) = month(a.ts) THEN b.t2m_1km END')} AS lag5_month
  FROM stack a LEFT JOIN stack b ON b.iy = a.iy AND b.ix = a.ix AND b.ts = a.ts - INTERVAL 5 HOUR""")
def lag_exact(spark, d):
    out = S.lag_exact(_stack(spark, d), "t2m_1km", [5], unit="day", names={5: "lag5"})
    out = S.lag_exact(out, "t2m_1km", [5], month_local=True, names={5: "lag5_month"})
    return rounded(out.drop("t2m_1km"))


# accumulated flux: running sum within the day, as the sources deliver it
FLUX_SQL = OBS_CELL_SQL + """,
  flux AS (SELECT iy, ix, CAST(ts AS TIMESTAMP) AS ts,
                  sum(temperatura_c_qc) OVER (PARTITION BY iy, ix, date_trunc('day', ts) ORDER BY ts) * 3600 AS ssr
           FROM obs_cell)"""


def _flux(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("iy", "ix", F.to_date("ts")).orderBy("ts")
    return obs_cell(spark, d).select("iy", "ix", "ts", (F.sum("temperatura_c_qc").over(w) * 3600).alias("ssr"))


@check("deaccumulate", f"""WITH {FLUX_SQL}
  SELECT iy, ix, ts, {r6('''CASE WHEN lag(ts) OVER w IS NULL THEN NULL WHEN hour(ts) = 1 THEN ssr
                            ELSE ssr - lag(ssr) OVER w END / 3600.0''')} AS ssr
  FROM flux WINDOW w AS (PARTITION BY iy, ix, date_trunc('month', ts) ORDER BY ts)""")
def deaccumulate(spark, d):
    return rounded(S.deaccumulate(_flux(spark, d), ["ssr"], ("iy", "ix")))


@check("deaccumulate_across_months", f"""WITH {FLUX_SQL}
  SELECT iy, ix, ts, {r6('''CASE WHEN lag(ts) OVER w IS NULL THEN NULL WHEN hour(ts) = 1 THEN ssr
                            ELSE ssr - lag(ssr) OVER w END / 3600.0''')} AS ssr
  FROM (SELECT iy, ix, ts + to_days(15) AS ts, ssr FROM flux) WINDOW w AS (PARTITION BY iy, ix ORDER BY ts)""")
def deaccumulate_across_months(spark, d):
    shifted = _flux(spark, d).withColumn("ts", F.col("ts") + F.expr("INTERVAL '15' DAY"))
    return rounded(S.deaccumulate(shifted, ["ssr"], ("iy", "ix"), reset="none"))


@check("attach_stack", f"""WITH {STACK_SQL},
  o AS (SELECT iy, ix, CAST(ts AS TIMESTAMP) + INTERVAL 2 HOUR AS ts, temperatura_c_qc FROM obs_cell)
  SELECT o.iy, o.ix, o.ts, {r6('temperatura_c_qc')} AS temperatura_c_qc, {r6('t2m_1km')} AS t2m_1km
  FROM o JOIN stack s ON s.iy = o.iy AND s.ix = o.ix AND s.ts = o.ts""")
def attach_stack(spark, d):
    o = obs_cell(spark, d).withColumn("ts", F.col("ts") + F.expr("INTERVAL '2' HOUR")).drop("n_est_cel")
    return rounded(T.attach_stack(o, _stack(spark, d)))


@check("unmatched_hours", f"""WITH {STACK_SQL},
  o AS (SELECT iy, ix, CAST(ts AS TIMESTAMP) + INTERVAL 2 HOUR AS ts FROM obs_cell)
  SELECT CAST(year(o.ts) AS INTEGER) AS ano, CAST(month(o.ts) AS INTEGER) AS mes, count(*) AS n_lost
  FROM o WHERE NOT EXISTS (SELECT 1 FROM stack s WHERE s.iy = o.iy AND s.ix = o.ix AND s.ts = o.ts) GROUP BY 1, 2""")
def unmatched_hours(spark, d):
    o = obs_cell(spark, d).withColumn("ts", F.col("ts") + F.expr("INTERVAL '2' HOUR"))
    return T.unmatched_hours(o, _stack(spark, d))


@check("to_cells", f"""WITH {OBS_SQL}
  SELECT event_id, station, CAST(floor(station / 6) AS INTEGER) AS iy, CAST(floor(station / 6) AS INTEGER) % 7 AS ix
  FROM obs WHERE (station * 71) % 1800 > 300""")
def to_cells(spark, d):
    known = net(spark, d).filter("z_m > 300").select("station").join(station_cells(spark, d), "station")
    return T.to_cells(obs(spark, d), known).select("event_id", "station", "iy", "ix")


@check("attach_statics", f"""WITH {OBS_CELL_SQL}, {CELL_SQL}
  SELECT o.iy, o.ix, CAST(o.ts AS TIMESTAMP) AS ts, c.z_m, c.z_era5_orog FROM obs_cell o
  LEFT JOIN cells c ON c.iy = o.iy AND c.ix = o.ix""")
def attach_statics(spark, d):
    statics = cells(spark, d).select("iy", "ix", "z_m", "z_era5_orog")
    return T.attach_statics(obs_cell(spark, d), statics).select("iy", "ix", "ts", "z_m", "z_era5_orog")


@check("attach_observed", f"""WITH {OBS_CELL_SQL},
  o AS (SELECT iy, ix, CAST(ts AS TIMESTAMP) + INTERVAL 1 HOUR AS ts, n_est_cel FROM obs_cell)
  SELECT o.iy, o.ix, o.ts, o.n_est_cel, {r6('m.temperatura_c_qc')} AS temperatura_c_qc FROM o
  LEFT JOIN obs_cell m ON m.iy = o.iy AND m.ix = o.ix AND m.ts = o.ts""")
def attach_observed(spark, d):
    m = obs_cell(spark, d)
    o = m.select("iy", "ix", (F.col("ts") + F.expr("INTERVAL '1' HOUR")).alias("ts"), "n_est_cel")
    return rounded(T.attach_observed(o, m))


@check("match_obs", f"""WITH {OBS_CELL_SQL}, {CELL_SQL}
  SELECT o.iy, o.ix, CAST(o.ts AS TIMESTAMP) AS ts, {r6('o.temperatura_c_qc - c.z_m / 100')} AS y
  FROM obs_cell o JOIN cells c ON c.iy = o.iy AND c.ix = o.ix""")
def match_obs(spark, d):
    o = obs_cell(spark, d)
    scored = o.select("iy", "ix", "ts").join(cells(spark, d).select("iy", "ix", "z_m"), ["iy", "ix"])
    return rounded(T.match_obs(scored, o).select(
        "iy", "ix", "ts", (F.col("temperatura_c_qc") - F.col("z_m") / 100).alias("y")))


@check("representativeness", f"""WITH {STATION_SQL}, {CELL_SQL},
  m AS (SELECT CAST(floor(station / 6) AS INTEGER) AS iy, CAST(floor(station / 6) AS INTEGER) % 7 AS ix,
               avg(z_m) AS altitude, CAST(count(DISTINCT station) AS INTEGER) AS n_est_cel FROM net GROUP BY 1, 2)
  SELECT c.iy, c.ix, c.z_m AS z_alvo, {r6('altitude')} AS altitude, n_est_cel,
         {r6('c.z_m - altitude')} AS delta_representatividade_m
  FROM cells c LEFT JOIN m ON m.iy = c.iy AND m.ix = c.ix""")
def representativeness(spark, d):
    st = net(spark, d).join(station_cells(spark, d), "station").withColumnRenamed("z_m", "altitude")
    statics = cells(spark, d).withColumnRenamed("z_m", "z_alvo")
    return rounded(T.representativeness(statics, st))


# --- inventories -----------------------------------------------------------------------------------

MONTHS_SQL = """
  expected AS (SELECT CAST(year(m) AS INTEGER) AS ano, CAST(month(m) AS INTEGER) AS mes, strftime(m, '%Y%m') AS ym
               FROM (SELECT unnest(generate_series(DATE '1994-11-01', DATE '2002-02-01', INTERVAL 1 MONTH)) AS m)),
  src AS (SELECT 'a' AS fonte, strftime(o_orderdate, '%Y%m') AS ym FROM orders WHERE o_orderpriority = '1-URGENT'
          UNION SELECT 'b', strftime(o_orderdate, '%Y%m') FROM orders WHERE o_totalprice > 490000),
  comum AS (SELECT ym FROM expected INTERSECT SELECT ym FROM src WHERE fonte = 'a' INTERSECT SELECT ym FROM src WHERE fonte = 'b'),
  every AS (SELECT * FROM src UNION ALL SELECT 'comum', ym FROM comum)"""


def _month_sources(spark, d):
    o = table(spark, d, "orders")
    return {"a": I.months_of(o.filter("o_orderpriority = '1-URGENT'"), "o_orderdate"),
            "b": I.months_of(o.filter("o_totalprice > 490000"), "o_orderdate")}


@check("month_inventory", f"""WITH {MONTHS_SQL}
  SELECT fonte, min(ym) AS first, max(ym) AS last, count(*) AS n,
         (SELECT count(*) FROM expected) - count(*) FILTER (ym IN (SELECT ym FROM expected)) AS n_gaps
  FROM every GROUP BY 1""")
def month_inventory(spark, d):
    return I.coverage_report(_month_sources(spark, d), I.expected_months(spark, date(1994, 11, 1), date(2002, 2, 1)))


@check("month_gaps", f"""WITH {MONTHS_SQL}
  SELECT ano, mes FROM expected WHERE ym NOT IN (SELECT ym FROM src WHERE fonte = 'b')""")
def month_gaps(spark, d):
    return I.month_gaps(_month_sources(spark, d)["b"], I.expected_months(spark, date(1994, 11, 1), date(2002, 2, 1)))


@check("prune_months", f"""WITH {MONTHS_SQL}
  SELECT o_orderkey, o_orderdate FROM orders WHERE strftime(o_orderdate, '%Y%m') IN (SELECT ym FROM comum)""")
def prune_months(spark, d):
    src = _month_sources(spark, d)
    common = I.common_months(list(src.values()), I.expected_months(spark, date(1994, 11, 1), date(2002, 2, 1)))
    return I.prune_months(table(spark, d, "orders"), common, "o_orderdate").select("o_orderkey", "o_orderdate")


@check("hourly_axis_gaps", f"""WITH {OBS_CELL_SQL},
  m AS (SELECT iy, ix, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*) AS n,
               CAST(24 * day(last_day(any_value(ts))) AS BIGINT) AS expected FROM obs_cell GROUP BY 1, 2, 3)
  SELECT *, expected - n AS missing, CAST(0 AS BIGINT) AS extra FROM m WHERE expected > n""")
def hourly_axis_gaps(spark, d):
    return I.axis_problems(obs_cell(spark, d), ["iy", "ix"])


@check("axis_off_hour", f"""WITH {OBS_SQL},
  m AS (SELECT station, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*) AS n,
               CAST(24 * day(last_day(any_value(ts))) AS BIGINT) AS expected,
               count(DISTINCT ts) FILTER (ts = date_trunc('hour', ts)) AS whole FROM obs GROUP BY 1, 2)
  SELECT station, month, n, expected, expected - whole AS missing, n - whole AS extra FROM m""")
def axis_off_hour(spark, d):
    return I.axis_problems(obs(spark, d), ["station"])


@check("axis_absent_months", """WITH
  m AS (SELECT o_custkey % 10 AS station, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n, count(DISTINCT o_orderdate) AS whole
        FROM orders WHERE month(o_orderdate) <> 4 GROUP BY 1, 2),
  s AS (SELECT station, unnest(generate_series(TIMESTAMP '1991-12-01', TIMESTAMP '2002-09-01', INTERVAL 1 MONTH)) AS month FROM (SELECT DISTINCT station FROM m))
  SELECT station, month, coalesce(n, 0) AS n, CAST(24 * day(last_day(month)) AS BIGINT) AS expected, 24 * day(last_day(month)) - coalesce(whole, 0) AS missing,
         coalesce(n - whole, 0) AS extra FROM s LEFT JOIN m USING (station, month)""")
def axis_absent_months(spark, d):
    """Every April is missing, and so are the months around the table's span. Stamps are days, so repeated ones are extra rows."""
    o = table(spark, d, "orders").filter(F.month("o_orderdate") != 4)
    o = o.select((F.col("o_custkey") % 10).alias("station"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    return I.axis_problems(o, ["station"], span=("1991-12-07", "2002-09-30"))


@check("adopt_axis", """SELECT o_orderkey, TIMESTAMP '2021-01-01' + to_hours(o_orderkey) AS ts FROM orders""")
def adopt_axis(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("step"))
    return I.adopt_axis(o, "step", "2021-01-01")


@check("normalize_coarse", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate AS ts, l_quantity AS lat,
         CASE WHEN l_suppkey % 360 > 180 THEN CAST(l_suppkey % 360 AS DOUBLE) - 360 ELSE CAST(l_suppkey % 360 AS DOUBLE) END AS lon,
         CASE WHEN l_tax > 0.01 THEN l_extendedprice END AS t2m FROM lineitem""")
def normalize_coarse(spark, d):
    raw = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("valid_time"), F.col("l_quantity").alias("latitude"),
        (F.col("l_suppkey") % 360).cast("double").alias("longitude"),
        F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")).otherwise(F.lit(float("nan"))).alias("t2m"),
        F.lit(1).alias("expver"), F.lit(0).alias("number"))
    return R.normalize_coarse(raw)


@check("merge_families", """
  SELECT o_orderdate AS ts, CAST(o_custkey % 50 AS DOUBLE) AS lat, CAST(o_custkey % 7 AS DOUBLE) AS lon,
         max(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS t2m,
         max(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) AS d2m FROM orders GROUP BY 1, 2, 3""")
def merge_families(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderdate").alias("ts"), (F.col("o_custkey") % 50).cast("double").alias("lat"),
        (F.col("o_custkey") % 7).cast("double").alias("lon"), (F.col("o_orderkey") % 2).alias("odd"), "o_totalprice")
    key = ["ts", "lat", "lon"]
    part = lambda odd, name: o.filter(F.col("odd") == odd).groupBy(*key).agg(F.max("o_totalprice").alias(name))
    return R.merge_families([part(0, "t2m"), part(1, "d2m")])


@check("class_lookup", """
  SELECT 'T' || (p_size % 8 + 1) AS grupo, list_sort(list(DISTINCT p_size)) AS codes FROM part WHERE p_size % 9 <> 0 GROUP BY 1""")
def class_lookup(spark, d):
    p = F.col("p_size")
    raw = table(spark, d, "part").select(p.alias("code"), F.when(p % 9 == 0, "NA").otherwise(
        F.concat(F.lit("T"), (p % 8 + 1).cast("string"))).alias("grupo"))
    return R.codes_per_group(R.class_map(raw))


@check("duplicate_keys", """
  SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    return T.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@check("distinct_counts", f"""WITH {OBS_SQL}
  SELECT count(DISTINCT station) AS n_station, count(DISTINCT md_final) AS n_md_final FROM obs""")
def distinct_counts(spark, d):
    return T.distinct_counts(obs(spark, d), ["station", "md_final"])


@check("first_hours", f"""WITH {OBS_SQL}
  SELECT event_id, ts FROM obs WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'""")
def first_hours(spark, d):
    return T.first_hours(obs(spark, d), 48, datetime(2024, 1, 5)).select("event_id", "ts")


@check("coverage_sidecar", f"""WITH {STACK_SQL},
  l AS (SELECT a.*, b.t2m_1km AS l1, c.t2m_1km AS l6 FROM stack a
        LEFT JOIN stack b ON b.iy = a.iy AND b.ix = a.ix AND b.ts = a.ts - INTERVAL 1 HOUR
        LEFT JOIN stack c ON c.iy = a.iy AND c.ix = a.ix AND c.ts = a.ts - INTERVAL 6 HOUR)
  SELECT * FROM (SELECT 'l1' AS coluna, count(*) - count(l1) AS n_null FROM l
                 UNION ALL SELECT 'l6', count(*) - count(l6) FROM l) WHERE n_null > 0""")
def coverage_sidecar(spark, d):
    lagged = S.lag_exact(_stack(spark, d), "t2m_1km", [1, 6], names={1: "l1", 6: "l6"})
    return W.coverage_sidecar(lagged, ["t2m_1km", "l1", "l6"])


@check("matrix_counts", f"""WITH {OBS_CELL_SQL}
  SELECT count(*) AS n_linhas, count(DISTINCT (iy, ix)) AS celulas,
         count(*) FILTER (n_est_cel > 1) AS instantes_celula_multi_estacao FROM obs_cell""")
def matrix_counts(spark, d):
    return W.matrix_counts(obs_cell(spark, d))


@check("outlier_cut", f"""WITH {OBS_SQL}
  SELECT event_id, value FROM obs WHERE event_id % 97 <> 0 AND abs(value) <= 60""")
def outlier_cut(spark, d):
    o = obs(spark, d).select("event_id", P.to_number("md_valor").alias("value"))
    return T.cut_outliers(T.drop_missing(o, ["value"]), "value", 60.0)


@check("outlier_counts", f"""WITH {OBS_SQL}
  SELECT count(*) FILTER (abs(value) <= 60) AS mantidos, count(*) FILTER (abs(value) > 60) AS removidos, max(abs(value)) FILTER (abs(value) > 60) AS maior_removido
  FROM obs WHERE event_id % 97 <> 0""")
def outlier_counts(spark, d):
    return T.outlier_counts(obs(spark, d).select(P.to_number("md_valor").alias("value")), "value", 60.0)
