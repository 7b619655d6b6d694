"""Anchoring by neighbouring station errors, and the choice of its weight rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import CELL_SQL, OBS_SQL, STATION_SQL, cells, check, net, obs, oof, OOF_SQL, r6, rounded, table
from finescale.operators import anchoring as A
from finescale.operators.grid import expand_hours
from finescale.operators.skill import temperature_band

# increments: residual of each usable observation to its network-hour mean, per station and day
INC_SQL = OBS_SQL + "," + STATION_SQL + "," + CELL_SQL + """,
  inc AS (SELECT station, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 HOUR * (station % 3) AS ts,
                 CASE WHEN station % 11 <> 5 THEN avg(value) - 40 END AS inc
          FROM obs WHERE event_type <> 'error' GROUP BY station, 2),
  hours AS (SELECT DISTINCT ts FROM inc),
  field AS (SELECT c.iy, c.ix, h.ts, CAST(20 + c.iy / 10.0 AS DOUBLE) AS t FROM cells c CROSS JOIN hours h),
  pairs AS (SELECT c.iy, c.ix, n.station, sqrt((n.x_km - c.x_km) * (n.x_km - c.x_km) + (n.y_km - c.y_km) * (n.y_km - c.y_km)) AS d,
                   COALESCE(n.z_m - c.z_m, 0) AS dz FROM cells c CROSS JOIN net n),
  near AS (SELECT *, row_number() OVER (PARTITION BY iy, ix ORDER BY d, station) AS rk FROM pairs)"""


def _inc(spark, d, hours=3):
    o = obs(spark, d).filter("event_type <> 'error'")
    ts = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("station") % hours).cast("int"))
    present = F.when(F.col("station") % 11 != 5, F.avg("value") - 40)            # some stations report nothing
    return o.groupBy("station", ts.alias("ts")).agg(present.alias("inc"))


def _field(spark, d):
    hours = _inc(spark, d).select("ts").distinct()
    return expand_hours(cells(spark, d).select("iy", "ix"), hours).withColumn("T_final", 20 + F.col("iy") / 10)


def _anchored_sql(weight, where, lz=""):
    return f"""WITH {INC_SQL}{lz},
  w AS (SELECT * FROM (SELECT *, {weight} AS w FROM near) WHERE {where}),
  corr AS (SELECT w.iy, w.ix, i.ts, -sum(w.w * i.inc) / NULLIF(sum(w.w), 0) AS corr
           FROM w JOIN inc i ON i.station = w.station AND i.inc IS NOT NULL GROUP BY 1, 2, 3)
  SELECT f.iy, f.ix, f.ts, {r6('f.t + COALESCE(c.corr, 0)')} AS "T_final", {r6('f.t')} AS "T_final_bc", {r6('COALESCE(c.corr, 0)')} AS "T_final_oi"
  FROM field f LEFT JOIN corr c ON c.iy = f.iy AND c.ix = f.ix AND c.ts = f.ts"""


def _anchor(spark, d, lz_by_hour=None, **rule):
    if rule.get("method") == "gauss":
        rule = {k: v for k, v in rule.items() if k != "method"}
        return rounded(A.anchor_gauss(_field(spark, d), cells(spark, d), net(spark, d), _inc(spark, d), lz_by_hour, **rule))
    return rounded(A.anchor_idw(_field(spark, d), cells(spark, d), net(spark, d), _inc(spark, d), lz_by_hour, **rule))


@check("idw_anchor", _anchored_sql("1 / greatest(d, 1e-6)", "rk <= 20"))
def idw_anchor(spark, d):
    return _anchor(spark, d, k=20, power=1)


@check("idw_anchor_vertical", _anchored_sql("1 / pow(greatest(d, 1e-6), 2) * exp(-pow(dz / 500, 2))", "rk <= 10"))
def idw_anchor_vertical(spark, d):
    return _anchor(spark, d, k=10, power=2, lz_m=500)


@check("anchor_radius", _anchored_sql("1 / greatest(d, 1e-6)", "rk <= 20 AND d <= 15"))
def anchor_radius(spark, d):
    return _anchor(spark, d, k=20, radius_km=15)


@check("gauss_anchor", _anchored_sql("exp(-pow(d / 6, 2)) * exp(-pow(dz / 800, 2))", "w > 0"))
def gauss_anchor(spark, d):
    return _anchor(spark, d, method="gauss", length_km=6, lz_m=800)


@check("gauss_anchor_long", _anchored_sql("exp(-pow(d / 50, 2))", "w > 0"))
def gauss_anchor_long(spark, d):
    return _anchor(spark, d, method="gauss", length_km=50)


@check("gauss_anchor_radius", _anchored_sql("exp(-pow(d / 50, 2)) * exp(-pow(dz / 500, 2))", "w > 0 AND d <= 30"))
def gauss_anchor_radius(spark, d):
    return _anchor(spark, d, method="gauss", length_km=50, lz_m=500, radius_km=30)


@check("gauss_anchor_all_pairs", _anchored_sql("exp(-pow(d / 4, 2))", "w > 0"))
def gauss_anchor_all_pairs(spark, d):
    return _anchor(spark, d, method="gauss", length_km=4)


@check("anchor_hourly_lz", f"""WITH {INC_SQL},
  lz AS (SELECT h AS hora, CASE WHEN h % 3 = 0 THEN 0 ELSE 100.0 * h END AS lz FROM (SELECT DISTINCT hour(ts) AS h FROM events)),
  corr AS (SELECT n.iy, n.ix, i.ts, -sum(i.inc / greatest(d, 1e-6) * CASE WHEN lz > 0 THEN exp(-pow(dz / lz, 2)) ELSE 1 END)
             / NULLIF(sum(1 / greatest(d, 1e-6) * CASE WHEN lz > 0 THEN exp(-pow(dz / lz, 2)) ELSE 1 END), 0) AS corr
           FROM near n JOIN inc i ON i.station = n.station AND i.inc IS NOT NULL JOIN lz ON lz.hora = hour(i.ts) WHERE rk <= 20 GROUP BY 1, 2, 3)
  SELECT f.iy, f.ix, f.ts, {r6('f.t + COALESCE(c.corr, 0)')} AS "T_final", {r6('f.t')} AS "T_final_bc", {r6('COALESCE(c.corr, 0)')} AS "T_final_oi"
  FROM field f LEFT JOIN corr c ON c.iy = f.iy AND c.ix = f.ix AND c.ts = f.ts""")
def anchor_hourly_lz(spark, d):
    h = F.hour("ts")
    lz = table(spark, d, "events").select(h.alias("hora")).distinct().withColumn(
        "lz_m", F.when(F.col("hora") % 3 == 0, 0.0).otherwise(100.0 * F.col("hora")))
    return _anchor(spark, d, lz, k=20)


@check("increments", f"""WITH {OOF_SQL}
  SELECT iy, ix, ts, {r6('pred_residuo - y_residuo')} AS inc FROM (SELECT iy, ix, CAST(ts AS TIMESTAMP) AS ts, pred_residuo, y_residuo FROM oof)
  WHERE pred_residuo IS NOT NULL""")
def increments(spark, d):
    return rounded(A.increments(oof(spark, d)).select("iy", "ix", "ts", "inc"))


@check("hours_covered", f"""WITH {INC_SQL} SELECT count(DISTINCT ts) AS hours_with_obs, count(DISTINCT station) AS stations FROM inc WHERE inc IS NOT NULL""")
def hours_covered(spark, d):
    return A.hours_covered(_inc(spark, d))


# --- array form: orders by nation as stations (a fixed network of 25), days as hours -------------------

NATION_SQL = """
  ninc AS (SELECT c_nationkey AS station, o_orderdate AS ts, o_totalprice / 1000 AS inc FROM orders JOIN customer ON c_custkey = o_custkey),
  mean AS (SELECT station, ts, avg(inc) AS inc FROM ninc GROUP BY 1, 2)"""


def _nation_inc(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("station"))
    return table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        "station", F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 1000).alias("inc"))


@check("pivot_increments", f"""WITH {NATION_SQL},
  axis AS (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS ts)
  SELECT a.ts, {', '.join(f"{r6(f'max(CASE WHEN station = {i} THEN inc END)')} AS s{i}" for i in range(25))}
  FROM axis a LEFT JOIN mean m ON m.ts = a.ts GROUP BY 1""")
def pivot_increments(spark, d):
    from finescale.sources.inventory import hourly_axis
    o = table(spark, d, "orders")
    span = o.agg(F.expr("make_timestamp_ntz(year(min(o_orderdate)), 1, 1, 0, 0, 0)").alias("start"),
                 F.expr("make_timestamp_ntz(year(max(o_orderdate)), 12, 31, 0, 0, 0)").alias("end"))
    wide = A.pivot_increments(_nation_inc(spark, d), list(range(25)), hourly_axis(span, unit="DAY"))
    return rounded(wide.select("ts", *[F.col("inc")[i].alias(f"s{i}") for i in range(25)]))


@check("weighted_mean_array", f"""WITH {NATION_SQL}
  SELECT ts, {r6('sum(inc / (station + 1)) / sum(1.0 / (station + 1))')} AS inc_hat FROM mean GROUP BY 1""")
def weighted_mean_array(spark, d):
    wide = A.pivot_increments(_nation_inc(spark, d), list(range(25)))
    weights = F.array(*[F.lit(1.0 / (i + 1)) for i in range(25)])
    return rounded(wide.select("ts", A.weighted_mean_array("inc", weights).alias("inc_hat")))


# --- rule choice ---------------------------------------------------------------------------------------

RULES = A.rules_of(**A.PUBLISHED)
REFERENCE = next(i for i, r in enumerate(RULES) if (r["k"], r["power"], r["lz"]) == (20, 1.0, 0.0))
TALL = next(i for i, r in enumerate(RULES) if (r["k"], r["power"], r["lz"]) == (20, 1.0, 500.0))
LZ_RULES = A.rules_of(ks=[20], powers=[1], lzs=A.PUBLISHED["lzs"])
SHORT = A.rules_of(ks=[5, 20], powers=[1, 2], lengths=[4, 50], lzs=[0, 300])


def _w(rule):
    w = (f"CASE WHEN rk <= {rule['k']} THEN 1 / pow(greatest(d, 1e-6), {rule['power']}) END" if rule["method"] == "idw"
         else f"exp(-pow(d / {rule['length']}, 2))")
    return f"({w}) * exp(-pow(dz / {rule['lz']}, 2))" if rule["lz"] else f"({w})"


def _loo_sql(rules, hours=3):
    hats = ", ".join(f"sum({_w(r)} * j.inc) / NULLIF(sum({_w(r)}) FILTER (j.inc IS NOT NULL), 0) AS h{i}" for i, r in enumerate(rules))
    return INC_SQL.replace("(station % 3)", f"(station % {hours})") + f""",
  sp AS (SELECT a.station, b.station AS other, sqrt((a.x_km - b.x_km) * (a.x_km - b.x_km) + (a.y_km - b.y_km) * (a.y_km - b.y_km)) AS d,
                COALESCE(abs(a.z_m - b.z_m), 0) AS dz FROM net a JOIN net b ON a.station <> b.station),
  sr AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY d, other) AS rk FROM sp),
  hat AS (SELECT i.station, i.ts, any_value(i.inc) AS inc, -any_value(i.inc) * 1.3 AS y, {hats}
          FROM inc i JOIN sr ON sr.station = i.station LEFT JOIN inc j ON j.station = sr.other AND j.ts = i.ts
          WHERE j.inc IS NOT NULL OR sr.rk = 1 GROUP BY 1, 2),
  loo AS (SELECT station, ts, inc, y, {', '.join(f'COALESCE(h{i}, 0) AS hat_{i}' for i in range(len(rules)))} FROM hat)"""


def _loo(spark, d, rules, hours=3):
    inc = _inc(spark, d, hours).withColumn("y_residuo", -F.col("inc") * 1.3)
    return A.loo_anchor(inc, net(spark, d), rules)


@check("loo_anchor_rules", f"""WITH {_loo_sql(SHORT)}
  SELECT station, ts, {r6('inc')} AS inc, {', '.join(f"{r6(f'hat_{i}')} AS hat_{i}" for i in range(len(SHORT)))} FROM loo""")
def loo_anchor_rules(spark, d):
    return rounded(_loo(spark, d, SHORT).select("station", "ts", "inc", *[F.col("hats")[i].alias(f"hat_{i}") for i in range(len(SHORT))]))


def _rule_row(i, rule):
    e = f"(inc - hat_{i})" if rule else "inc"
    own = rule or {"method": "none", "k": None, "power": None, "length": None, "lz": None}
    names = ", ".join(f"CAST({'NULL' if own[n] is None else own[n]} AS {t}) AS {n}" for n, t in
                      (("k", "INTEGER"), ("power", "DOUBLE"), ("length", "DOUBLE"), ("lz", "DOUBLE")))
    return (f"SELECT CAST({i} AS INTEGER) AS rule, '{own['method']}' AS method, {names}, count(*) AS n, {r6(f'sqrt(avg({e} * {e}))', 5)} AS rmse, "
            f"{r6(f'avg(abs({e}))', 5)} AS mae, {r6(f'avg({e})', 5)} AS me, {r6(f'1 - sqrt(avg({e} * {e})) / sqrt(avg(y * y))', 5)} AS ss "
            "FROM loo WHERE inc IS NOT NULL")


def _table_sql(rules):
    return " UNION ALL ".join(_rule_row(i, r) for i, r in [(-1, None), *enumerate(rules)])


@check("anchor_rule_table", f"WITH {_loo_sql(RULES)} {_table_sql(RULES)}")
def anchor_rule_table(spark, d):
    return rounded(A.tune_anchor(_inc(spark, d).withColumn("y_residuo", -F.col("inc") * 1.3), net(spark, d), RULES), 5)


@check("rank_rules", f"""WITH {_loo_sql(RULES)}, t AS ({_table_sql(RULES)})
  SELECT (SELECT rule FROM t WHERE rule NOT IN (-1, {REFERENCE}) ORDER BY rmse, rule LIMIT 1) AS winner,
         min(rmse) FILTER (rule NOT IN (-1, {REFERENCE})) AS rmse_win, max(rmse) FILTER (rule = {REFERENCE}) AS rmse_ref,
         (SELECT rule FROM t WHERE rule >= 0 ORDER BY rmse, rule LIMIT 1) AS best_overall FROM t""")
def rank_rules(spark, d):
    return A.rank_rules(rounded(A.rule_errors(_loo(spark, d, RULES), RULES), 5), REFERENCE)


@check("compare_rules", f"""WITH {_loo_sql([RULES[REFERENCE], RULES[TALL]])},
  q AS (SELECT quantile_cont(-y, 0.1) AS p10, quantile_cont(-y, 0.9) AS p90 FROM loo)
  SELECT CASE WHEN y IS NULL THEN 'sem_obs' WHEN -y <= p10 THEN 'frio<=p10' WHEN -y > p90 THEN 'quente>p90' ELSE 'meio' END AS faixa,
         hour(ts) AS hora, count(inc) AS n, {r6('sqrt(avg(pow(inc - hat_0, 2)))', 5)} AS rmse_a, {r6('sqrt(avg(pow(inc - hat_1, 2)))', 5)} AS rmse_b,
         {r6('1 - sqrt(avg(pow(inc - hat_0, 2))) / sqrt(avg(y * y))', 5)} AS ss_a,
         {r6('1 - sqrt(avg(pow(inc - hat_1, 2))) / sqrt(avg(y * y))', 5)} AS ss_b,
         {r6('(sqrt(avg(pow(inc - hat_0, 2))) - sqrt(avg(pow(inc - hat_1, 2)))) / sqrt(avg(y * y))', 5)} AS d_ss
  FROM loo, q GROUP BY 1, 2""")
def compare_rules(spark, d):
    loo = _loo(spark, d, [RULES[REFERENCE], RULES[TALL]]).withColumn("hora", F.hour("ts").cast("bigint"))
    loo = temperature_band(loo.withColumn("t", -F.col("y_residuo")), "t", missing="sem_obs")
    return rounded(A.compare_rules(loo, 0, 1, ["faixa", "hora"]), 5)


@check("lz_by_hour", f"""WITH {_loo_sql(LZ_RULES, 24)},
  m AS ({' UNION ALL '.join(f"SELECT hour(ts) AS hora, {r['lz']} AS z, avg(pow(inc - hat_{i}, 2)) AS m FROM loo GROUP BY 1" for i, r in enumerate(LZ_RULES))})
  SELECT hora, CAST(z AS DOUBLE) AS lz_m FROM m WHERE m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hora ORDER BY round(m, 9), z) = 1""")
def lz_by_hour(spark, d):
    out = A.lz_by_hour(_loo(spark, d, LZ_RULES, 24), [r["lz"] for r in LZ_RULES])
    return out.withColumn("hora", F.col("hora").cast("bigint"))
