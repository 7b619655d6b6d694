"""Skill, coverage, distributions and station-level inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import OOF_SQL, check, oof, r6, rounded, table
from finescale.functions import metrics as M
from finescale.functions import physics as P
from finescale.operators import skill as S
from finescale.operators.quantiles import exact_quantiles, quantiles_wide

ERR_SQL = OOF_SQL + """,
  err AS (SELECT *, pred_residuo - y_residuo AS e, -y_residuo AS b FROM oof WHERE pred_residuo IS NOT NULL)"""


def _err(spark, d):
    return S.with_errors(oof(spark, d))


SKILL_SQL = (f"count(e) AS n, {r6('sqrt(avg(b * b))')} AS rmse_era5, {r6('sqrt(avg(e * e))')} AS rmse_down, {r6('avg(abs(b))')} AS mae_era5, "
             f"{r6('avg(abs(e))')} AS mae_down, {r6('avg(e)')} AS me_down, {r6('1 - sqrt(avg(e * e)) / sqrt(avg(b * b))')} AS ss")


@check("error_metrics", f"""WITH {ERR_SQL}
  SELECT {r6('avg(abs(e))')} AS mae, {r6('sqrt(avg(e * e))')} AS rmse, {r6('avg(e)')} AS me, count(e) AS n FROM err""")
def error_metrics(spark, d):
    return rounded(_err(spark, d).agg(*M.error_metrics("err_down")))


@check("skill_global", f"""WITH {ERR_SQL}
  SELECT {SKILL_SQL}, {r6('avg(b)')} AS me_era5, {r6('corr(pred_residuo, y_residuo)')} AS corr,
         {r6('pow(corr(pred_residuo, y_residuo), 2)')} AS r2 FROM err""")
def skill_global(spark, d):
    return rounded(S.skill_global(_err(spark, d)))


def _band(v, edges, labels):
    return "CASE " + " ".join(f"WHEN {v} > {a} AND {v} <= {b} THEN '{n}'" for a, b, n in zip(edges[:-1], edges[1:], labels)) + " END"


STRATA_SQL = ERR_SQL + f""",
  strata AS (SELECT *, CAST(hour(ts) AS VARCHAR) AS hora, CAST(month(ts) AS VARCHAR) AS mes,
                    {_band('z_alvo', P.ELEVATION_EDGES, P.ELEVATION_LABELS)} AS faixa_elev,
                    {_band('dist_oceano / 1000', P.COAST_EDGES_KM, P.COAST_LABELS)} AS faixa_costa FROM err)"""
STRATA = ("hora", "mes", "faixa_elev", "faixa_costa")


@check("skill_by_strata", f"WITH {STRATA_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS estrato, {c} AS grupo, {SKILL_SQL} FROM strata WHERE {c} IS NOT NULL GROUP BY {c}" for c in STRATA))
def skill_by_strata(spark, d):
    return rounded(S.skill_by(S.with_strata(_err(spark, d)), STRATA))


@check("skill_by_cell", f"WITH {ERR_SQL} SELECT 'cell_id' AS estrato, iy || '_' || ix AS grupo, {SKILL_SQL} FROM err GROUP BY iy, ix")
def skill_by_cell(spark, d):
    return rounded(S.skill_by(_err(spark, d).withColumn("cell_id", P.cell_id("iy", "ix")), ["cell_id"]))


CELL_SKILL_SQL = """
  cs AS (SELECT l_suppkey AS station, count(*) AS n, sqrt(avg(pow(l_discount - 0.05, 2))) AS rmse_down, sqrt(avg(pow(l_tax - 0.05, 2))) AS rmse_base,
                1 - sqrt(avg(pow(l_discount - 0.05, 2))) / sqrt(avg(pow(l_tax - 0.05, 2))) AS ss FROM lineitem GROUP BY 1)"""


def _station_rows(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("station"), (F.col("l_discount") - 0.05).alias("err_down"),
                                              (F.col("l_tax") - 0.05).alias("err_base"))


def _stations(spark, d):
    return S.station_metrics(_station_rows(spark, d))


@check("skill_summary", f"""WITH {CELL_SKILL_SQL}
  SELECT count(ss) AS n_cells, {r6('avg(CASE WHEN ss > 0 THEN 1.0 ELSE 0 END)')} AS frac_pos, {r6('quantile_cont(ss, 0.1)')} AS p10,
         {r6('quantile_cont(ss, 0.5)')} AS p50, {r6('quantile_cont(ss, 0.9)')} AS p90 FROM cs""")
def skill_summary(spark, d):
    return rounded(S.skill_summary(_stations(spark, d)))


@check("station_metrics", f"""WITH {CELL_SKILL_SQL}
  SELECT station, n, {r6('rmse_down')} AS rmse_down, {r6('rmse_base')} AS rmse_era5, {r6('ss')} AS ss FROM cs""")
def station_metrics(spark, d):
    return rounded(_stations(spark, d).select("station", "n", "rmse_down", "rmse_era5", "ss"))


@check("station_spread", f"""WITH {CELL_SKILL_SQL}
  SELECT {r6('quantile_cont(rmse_down, 0.25)')} AS p25, {r6('quantile_cont(rmse_down, 0.5)')} AS p50, {r6('quantile_cont(rmse_down, 0.75)')} AS p75,
         {r6('quantile_cont(rmse_down, 0.75) - quantile_cont(rmse_down, 0.25)')} AS iqr FROM cs""")
def station_spread(spark, d):
    return rounded(S.station_spread(_stations(spark, d)))


@check("bootstrap_ci", f"""WITH {CELL_SKILL_SQL},
  ix AS (SELECT row_number() OVER (ORDER BY md5(CAST(station AS VARCHAR)), station) - 1 AS idx, rmse_down AS v FROM cs),
  n AS (SELECT count(*) AS n FROM ix),
  draw AS (SELECT rep, CAST(floor(('0x' || substr(md5('42_' || rep || '_' || idx), 1, 8))::BIGINT / 4294967296.0 * n) AS BIGINT) AS pick
           FROM ix, n, (SELECT unnest(generate_series(0, 1999)) AS rep)),
  reps AS (SELECT rep, avg(v) AS m FROM draw JOIN ix ON ix.idx = draw.pick GROUP BY 1)
  SELECT (SELECT {r6('avg(v)')} FROM ix) AS mean, (SELECT n FROM n) AS n_stations, {r6('quantile_cont(m, 0.025)')} AS ci_low,
         {r6('quantile_cont(m, 0.975)')} AS ci_high FROM reps""")
def bootstrap_ci(spark, d):
    return rounded(S.bootstrap_ci(_stations(spark, d), "rmse_down"))


@check("wilcoxon_paired", f"""WITH {CELL_SKILL_SQL},
  d AS (SELECT rmse_down - rmse_base AS d FROM cs WHERE rmse_down <> rmse_base),
  r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM d),
  w AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS wm FROM r),
  t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM d GROUP BY abs(d))),
  z AS (SELECT n, wp, wm, (wp - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM w, t),
  k AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS q FROM z)
  SELECT n, CAST(wp AS DOUBLE) AS w_plus, CAST(wm AS DOUBLE) AS w_minus, {r6('z')} AS z,
         {r6('q * (0.254829592 + q * (-0.284496736 + q * (1.421413741 + q * (-1.453152027 + q * 1.061405429)))) * exp(-z * z / 2)')} AS p_value FROM k""")
def wilcoxon_paired(spark, d):
    return rounded(S.wilcoxon_paired(_stations(spark, d), "rmse_down", "rmse_era5", exact_upto=0), only=["z", "p_value"])


# a nation's mean balance of customers against that of suppliers: one pair a nation, no ties. The sums of either half of the ranks are
# counted apart and then added
HALVES_SQL = "SELECT s, count(*) AS ways FROM (SELECT coalesce(list_sum(list_transform(list_filter(range(1, 14), lambda k: k <= n AND (m >> (k - 1)) & 1 = 1)," \
             " lambda k: k + first)), 0) AS s FROM {side}, range(1 << n) t(m)) GROUP BY s"


@check("wilcoxon_exact", f"""WITH d AS (
  SELECT avg(c_acctbal) - any_value(b) AS d FROM customer JOIN (SELECT s_nationkey, avg(s_acctbal) AS b FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey GROUP BY c_nationkey),
  r AS (SELECT d, rank() OVER (ORDER BY abs(d)) AS rk FROM d),
  w AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS wm FROM r),
  low AS (SELECT CAST(n // 2 AS BIGINT) AS n, CAST(0 AS BIGINT) AS first FROM w), high AS (SELECT CAST(n - n // 2 AS BIGINT) AS n, CAST(n // 2 AS BIGINT) AS first FROM w),
  a AS ({HALVES_SQL.format(side='low')}), b AS ({HALVES_SQL.format(side='high')}),
  p AS (SELECT sum(a.ways * b.ways) AS ways FROM a JOIN b ON a.s + b.s <= (SELECT least(wp, wm) FROM w))
  SELECT n, CAST(wp AS DOUBLE) AS w_plus, CAST(wm AS DOUBLE) AS w_minus, {r6('(wp - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0)')} AS z,
         {r6('least(1, 2 * CAST(ways AS DOUBLE) / pow(2, n))')} AS p_value FROM w, p""")
def wilcoxon_exact(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("station")).agg(F.avg("c_acctbal").alias("a"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("station")).agg(F.avg("s_acctbal").alias("b"))
    return rounded(S.wilcoxon_paired(c.join(s, "station"), "a", "b"), only=["z", "p_value"])


@check("gain_decomposition", f"""
  SELECT l_suppkey AS station, {r6('sqrt(avg(pow(l_tax, 2)))')} AS rmse_naive, {r6('sqrt(avg(pow(l_discount, 2)))')} AS rmse_model,
         {r6('sqrt(avg(pow(l_discount - 0.02, 2)))')} AS rmse_anchored,
         {r6('sqrt(avg(pow(l_tax, 2))) - sqrt(avg(pow(l_discount, 2)))')} AS g_lgbm,
         {r6('sqrt(avg(pow(l_discount, 2))) - sqrt(avg(pow(l_discount - 0.02, 2)))')} AS g_anc,
         {r6('sqrt(avg(pow(l_tax, 2))) - sqrt(avg(pow(l_discount - 0.02, 2)))')} AS g_tot FROM lineitem GROUP BY 1""")
def gain_decomposition(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("station"), F.col("l_tax").alias("err_naive"),
                                              F.col("l_discount").alias("err_down"), (F.col("l_discount") - 0.02).alias("err_anchored"))
    return rounded(S.gain_decomposition(rows))


# --- quantile band: price against the exact quantiles of its line status ------------------------------

BAND_SQL = """
  cut AS (SELECT l_linestatus, l_returnflag, quantile_cont(l_extendedprice, 0.16) AS lo, quantile_cont(l_extendedprice, 0.5) AS med,
                 quantile_cont(l_extendedprice, 0.84) AS hi FROM lineitem GROUP BY 1, 2),
  band AS (SELECT l.l_orderkey, l.l_extendedprice AS y, lo, med, hi, l.l_linenumber AS hora, l.l_quantity * 40 AS z_alvo
           FROM lineitem l JOIN cut c ON c.l_linestatus = l.l_linestatus AND c.l_returnflag = l.l_returnflag)"""


def _band_rows(spark, d):
    li = table(spark, d, "lineitem")
    key = ["l_linestatus", "l_returnflag"]                     # a row per status and flag: a handful
    cut = quantiles_wide(li, "l_extendedprice", {"pred_p_lo": 0.16, "pred_p_med": 0.5, "pred_p_hi": 0.84}, key)
    return li.join(F.broadcast(cut), key).select("l_orderkey", F.col("l_extendedprice").alias("y_residuo"), *S.BAND,
                                    F.col("l_linenumber").alias("hora"), (F.col("l_quantity") * 40).alias("z_alvo"))


COV_SQL = (f"count(y) AS n, {r6('avg(CASE WHEN y <= lo THEN 1.0 ELSE 0 END)')} AS cob_lo, {r6('avg(CASE WHEN y <= med THEN 1.0 ELSE 0 END)')} AS cob_med, "
           f"{r6('avg(CASE WHEN y <= hi THEN 1.0 ELSE 0 END)')} AS cob_hi, {r6('avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0 END)')} AS cob_int, "
           f"{r6('avg(hi - lo)', 3)} AS larg")
FOCUS_SQL = "z_alvo > 500 AND hora BETWEEN 3 AND 9"


def _coverage(spark, d):
    focus = (F.col("z_alvo") > S.FOCUS_Z) & F.col("hora").between(*S.FOCUS_HOURS)
    rows = _band_rows(spark, d).withColumn("faixa_elev", P.elevation_band("z_alvo"))
    return S.coverage(rows, ["hora", "faixa_elev"], focus=focus)


@check("band_coverage", f"""WITH {BAND_SQL}
  SELECT 'global' AS estrato, 'all' AS faixa, {COV_SQL} FROM band
  UNION ALL SELECT 'vale_alto_noturno', 'foco', {COV_SQL} FROM band WHERE {FOCUS_SQL}
  UNION ALL SELECT 'hora', CAST(hora AS VARCHAR), {COV_SQL} FROM band GROUP BY hora
  UNION ALL SELECT 'faixa_elev', f, {COV_SQL} FROM (SELECT *, {_band('z_alvo', P.ELEVATION_EDGES, P.ELEVATION_LABELS)} AS f FROM band)
            WHERE f IS NOT NULL GROUP BY f""")
def band_coverage(spark, d):
    return rounded(rounded(_coverage(spark, d), 3, ["larg"]), 6, ["cob_lo", "cob_med", "cob_hi", "cob_int"])


@check("band_losses", f"""WITH {BAND_SQL}
  SELECT {', '.join(f"{r6(f'avg(greatest({a} * (y - {q}), ({a} - 1) * (y - {q})))', 3)} AS pinball_{q}" for q, a in (('lo', 0.16), ('med', 0.5), ('hi', 0.84)))},
         {r6('avg(CASE WHEN lo > med OR med > hi THEN 1.0 ELSE 0 END)')} AS crossing, {r6('avg(hi - lo)', 3)} AS larg FROM band""")
def band_losses(spark, d):
    return rounded(S.band_losses(_band_rows(spark, d)), 3)


@check("band_verdict", f"""WITH {BAND_SQL},
  v AS (SELECT avg(CASE WHEN y <= lo THEN 1.0 ELSE 0 END) AS lo, avg(CASE WHEN y <= lo THEN 1.0 ELSE 0 END) FILTER ({FOCUS_SQL}) AS lo_f,
               avg(CASE WHEN y <= hi THEN 1.0 ELSE 0 END) AS hi, avg(CASE WHEN y <= hi THEN 1.0 ELSE 0 END) FILTER ({FOCUS_SQL}) AS hi_f FROM band)
  SELECT {r6('lo')} AS lo, {r6('lo_f')} AS lo_f, {r6('hi')} AS hi, {r6('hi_f')} AS hi_f,
         CASE WHEN abs(lo - 0.16) <= 0.03 AND abs(lo_f - 0.16) <= 0.03 THEN 'calibrado' WHEN lo > 0.16 THEN 'sub-cobre' ELSE 'sobre-cobre' END AS frio,
         CASE WHEN abs(hi - 0.84) <= 0.03 AND abs(hi_f - 0.84) <= 0.03 THEN 'calibrado' WHEN hi < 0.84 THEN 'sub-cobre' ELSE 'sobre-cobre' END AS quente
  FROM v""")
def band_verdict(spark, d):
    return rounded(S.verdict(_coverage(spark, d)))


@check("focus_subset", f"""WITH {BAND_SQL} SELECT hora, z_alvo, count(*) AS n FROM band WHERE {FOCUS_SQL} GROUP BY 1, 2""")
def focus_subset(spark, d):
    return S.focus_subset(_band_rows(spark, d)).groupBy("hora", "z_alvo").agg(F.count("*").alias("n"))


@check("exact_quantiles", f"""
  SELECT l_returnflag, q, count(l_extendedprice) AS n, {r6('''CASE WHEN q = 0.1 THEN quantile_cont(l_extendedprice, 0.1) WHEN q = 0.5 THEN
         quantile_cont(l_extendedprice, 0.5) WHEN q = 0.995 THEN quantile_cont(l_extendedprice, 0.995) ELSE max(l_extendedprice) END''', 4)} AS value
  FROM lineitem CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (0.5), (0.995), (1.0)) AS t(q) GROUP BY 1, 2""")
def exact_quantiles_by_group(spark, d):
    return rounded(exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.995, 1.0], ["l_returnflag"]), 4, ["value"])


@check("temperature_band", """
  WITH c AS (SELECT quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM (
    SELECT CASE WHEN event_type <> 'error' THEN value END AS v FROM events))
  SELECT event_id, CASE WHEN event_type <> 'error' AND value <= p10 THEN 'frio<=p10' WHEN event_type <> 'error' AND value > p90 THEN 'quente>p90'
         ELSE 'meio' END AS faixa FROM events, c""")
def temperature_band(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("t_obs"))
    return S.temperature_band(e).select("event_id", "faixa")


# --- distributions -------------------------------------------------------------------------------------

@check("error_histogram", f"""WITH {ERR_SQL},
  l AS (SELECT 'err_down' AS serie, e FROM err UNION ALL SELECT 'err_base', b FROM err),
  m AS (SELECT quantile_cont(abs(e), 0.995) AS lim FROM l),
  k AS (SELECT serie, CAST(least(floor((e + lim) / (2 * lim / 119)), 118) AS INTEGER) AS bin, lim, count(*) AS n FROM l, m
        WHERE abs(e) <= lim GROUP BY 1, 2, 3)
  SELECT serie, bin, {r6('-lim + bin * 2 * lim / 119')} AS "left", {r6('-lim + (bin + 1) * 2 * lim / 119')} AS "right", n,
         {r6('n / (sum(n) OVER (PARTITION BY serie) * 2 * lim / 119)')} AS density FROM k""")
def error_histogram(spark, d):
    return rounded(S.error_histogram(_err(spark, d)))


@check("density2d", f"""WITH {ERR_SQL},
  c AS (SELECT quantile_cont(y_residuo, 0.005) AS lo, quantile_cont(y_residuo, 0.995) AS hi FROM err),
  p AS (SELECT (y_residuo - lo) / ((hi - lo) / 80) AS u, (pred_residuo - lo) / ((hi - lo) / 46) AS v FROM err, c
        WHERE y_residuo BETWEEN lo AND hi AND pred_residuo BETWEEN lo AND hi),
  q AS (SELECT u, v, floor(u + 0.5) AS i1, floor(v + 0.5) AS j1, floor(u) AS i2, floor(v) AS j2 FROM p),
  r AS (SELECT *, pow(u - i1, 2) + 3 * pow(v - j1, 2) < pow(u - i2 - 0.5, 2) + 3 * pow(v - j2 - 0.5, 2) AS first FROM q)
  SELECT CAST(CASE WHEN first THEN i1 ELSE i2 END AS INTEGER) AS hx, CAST(CASE WHEN first THEN j1 ELSE j2 END AS INTEGER) AS hy,
         CAST(CASE WHEN first THEN 0 ELSE 1 END AS INTEGER) AS lattice, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def density2d(spark, d):
    return S.density2d(_err(spark, d))


@check("field_summary", f"""WITH {OOF_SQL}
  SELECT count(*) AS n, count(pred_residuo) AS n_finite, {r6('min(pred_residuo)')} AS t_min, {r6('max(pred_residuo)')} AS t_max,
         {r6('avg(pred_residuo)')} AS t_mean, {r6('avg(abs(y_residuo))')} AS abs_mean, {r6('quantile_cont(abs(y_residuo), 0.5)')} AS abs_p50,
         {r6('quantile_cont(abs(y_residuo), 0.95)')} AS abs_p95 FROM oof""")
def field_summary(spark, d):
    f = oof(spark, d).withColumnsRenamed({"pred_residuo": "T_final", "y_residuo": "T_final_oi"})
    return rounded(S.field_summary(f))


@check("period", "SELECT min(ts) AS ts_min, max(ts) AS ts_max FROM events")
def period(spark, d):
    return S.period(table(spark, d, "events"))


@check("rounded_report", """SELECT l_suppkey, round(avg(l_quantity) + 1e-7, 3) AS q, round(avg(l_discount) + 1e-7, 3) AS disc FROM lineitem GROUP BY 1""")
def rounded_report(spark, d):
    rep = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.avg("l_quantity") + 1e-7).alias("q"), (F.avg("l_discount") + 1e-7).alias("disc"))
    return S.rounded(rep, 3)


@check("top_features", f"""
  SELECT p_brand AS feature, {r6('sum(p_retailprice)', 4)} AS gain FROM part GROUP BY 1 ORDER BY gain DESC, feature LIMIT 15""")
def top_features(spark, d):
    gains = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("gain"))
    return rounded(S.top_features(gains, 15), 4)
