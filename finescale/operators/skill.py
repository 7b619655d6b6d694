"""Skill, coverage and calibration reports; error distributions; station-level inference."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finescale.functions import metrics as M
from finescale.functions.physics import ColumnLike, _c, coast_band, elevation_band
from finescale.operators.one_row import attach_row
from finescale.operators.quantiles import exact_quantiles, quantiles_wide
from finescale.operators.tables import dense_index

FOCUS_Z, FOCUS_HOURS = 500.0, (3, 9)      # fixed values: high-valley night regime
TOLERANCE = 0.03                          # fixed value: calibration tolerance


def with_errors(oof: DataFrame) -> DataFrame:
    """``err_down = pred - y`` and ``err_base = -y`` for rows with both."""
    return (oof.filter(F.col("y_residuo").isNotNull() & F.col("pred_residuo").isNotNull())
            .withColumns({"err_down": F.col("pred_residuo") - F.col("y_residuo"), "err_base": -F.col("y_residuo")}))


def with_strata(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour, month, elevation band and coast band columns (those whose inputs exist)."""
    strata = {"hora": F.hour(ts), "mes": F.month(ts)}
    if "z_alvo" in df.columns:
        strata["faixa_elev"] = elevation_band("z_alvo")
    if "dist_oceano" in df.columns:
        strata["faixa_costa"] = coast_band("dist_oceano")
    return df.withColumns(strata)


def skill_columns() -> list[Column]:
    return [F.count("err_down").alias("n"),
            M.rmse("err_base").alias("rmse_era5"), M.rmse("err_down").alias("rmse_down"),
            M.mae("err_base").alias("mae_era5"), M.mae("err_down").alias("mae_down"),
            M.mean_error("err_down").alias("me_down"), M.skill_score("err_down", "err_base").alias("ss")]


def skill_global(df: DataFrame) -> DataFrame:
    """One row: metrics of baseline and prediction, skill, correlation and its square."""
    r = F.corr("pred_residuo", "y_residuo")
    return df.agg(*skill_columns(), M.mean_error("err_base").alias("me_era5"),
                  r.alias("corr"), (r * r).alias("r2"))


def skill_by(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """``(estrato, grupo, metrics)`` for every stratum column, in one aggregation (grouping sets).

    Rows whose stratum is NULL are left out of that stratum.
    """
    sets = df.groupingSets([[c] for c in strata], *strata).agg(
        *skill_columns(), *[F.grouping(c).alias(f"_g_{c}") for c in strata])
    return _unpivot_sets(sets, strata)


def _unpivot_sets(sets: DataFrame, strata: Sequence[str]) -> DataFrame:
    name, level = None, None
    for c in strata:
        mine = F.col(f"_g_{c}") == 0
        name = F.when(mine, c) if name is None else name.when(mine, c)
        text = F.col(c).cast("string")
        level = F.when(mine, text) if level is None else level.when(mine, text)
    rest = [c for c in sets.columns if c not in strata and not c.startswith("_g_")]
    return (sets.select(name.alias("estrato"), level.alias("grupo"), *rest)
            .filter(F.col("grupo").isNotNull()))


def skill_summary(cells: DataFrame, ss: str = "ss") -> DataFrame:
    """One row over per-cell skill: share above zero, median, p10 and p90."""
    share = cells.agg(F.count(ss).alias("n_cells"), M.share(F.col(ss) > 0).alias("frac_pos"))
    q = quantiles_wide(cells, ss, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return _side_by_side(share, q)


def _side_by_side(*one_row: DataFrame) -> DataFrame:
    out = one_row[0]
    for other in one_row[1:]:
        out = attach_row(out, other)
    return out


def temperature_band(df: DataFrame, obs: str = "t_obs", missing: str = "meio") -> DataFrame:
    """``faixa`` by the p10/p90 of the observed temperature; a row without an observation is ``missing``."""
    cuts = quantiles_wide(df, obs, {"_p10": 0.1, "_p90": 0.9})
    band = (F.when(F.col(obs) <= F.col("_p10"), "frio<=p10")
            .when(F.col(obs) > F.col("_p90"), "quente>p90").when(F.col(obs).isNull(), missing).otherwise("meio"))
    return attach_row(df, cuts).withColumn("faixa", band).drop("_p10", "_p90")


def focus_subset(df: DataFrame, z: str = "z_alvo", hour: str = "hora") -> DataFrame:
    return df.filter((F.col(z) > FOCUS_Z) & F.col(hour).between(*FOCUS_HOURS))


# --- quantile band ------------------------------------------------------------------------------

BAND = ("pred_p_lo", "pred_p_med", "pred_p_hi")


def coverage(df: DataFrame, strata: Sequence[str] = (), y: str = "y_residuo", band: Sequence[str] = BAND,
             focus: Column | None = None) -> DataFrame:
    """``(estrato, faixa, n, cob_*, larg)``: global, focus subset and every stratum in one pass."""
    data = df.withColumns({"global": F.lit("all")} | ({} if focus is None else
                          {"vale_alto_noturno": F.when(focus, "foco")}))
    sets = ["global", *([] if focus is None else ["vale_alto_noturno"]), *strata]
    grouped = data.groupingSets([[c] for c in sets], *sets).agg(
        *M.coverage_metrics(y, *band), *[F.grouping(c).alias(f"_g_{c}") for c in sets])
    return _unpivot_sets(grouped, sets).withColumnRenamed("grupo", "faixa")


def band_losses(df: DataFrame, alphas: Sequence[float] = (0.16, 0.5, 0.84), y: str = "y_residuo",
                band: Sequence[str] = BAND) -> DataFrame:
    """One row: pinball loss per quantile, crossing share and mean width."""
    return df.agg(*[M.pinball(y, q, a).alias(f"pinball_{n}") for q, a, n in zip(band, alphas, ("lo", "med", "hi"))],
                  M.crossing_share(*band).alias("crossing"), F.avg(F.col(band[2]) - F.col(band[0])).alias("larg"))


def tail_verdict(cov: ColumnLike, cov_focus: ColumnLike, alpha: float, lower: bool,
                 tol: float = TOLERANCE) -> Column:
    """Calibrated when both coverages are within ``tol``; else too narrow or too wide."""
    c, f = _c(cov), _c(cov_focus)
    narrow = (c > alpha) if lower else (c < alpha)
    return (F.when((F.abs(c - alpha) <= tol) & (F.abs(f - alpha) <= tol), "calibrado")
            .when(narrow, "sub-cobre").otherwise("sobre-cobre"))


def verdict(cov: DataFrame, alphas: tuple[float, float] = (0.16, 0.84), tol: float = TOLERANCE) -> DataFrame:
    """One row from a ``coverage`` report with a focus subset: both tail verdicts."""
    pick = lambda c, s: F.max(F.when(F.col("estrato") == s, F.col(c)))
    row = cov.agg(pick("cob_lo", "global").alias("lo"), pick("cob_lo", "vale_alto_noturno").alias("lo_f"),
                  pick("cob_hi", "global").alias("hi"), pick("cob_hi", "vale_alto_noturno").alias("hi_f"))
    return row.select("lo", "lo_f", "hi", "hi_f",
                      tail_verdict("lo", "lo_f", alphas[0], True, tol).alias("frio"),
                      tail_verdict("hi", "hi_f", alphas[1], False, tol).alias("quente"))


# --- distributions ------------------------------------------------------------------------------

def error_histogram(df: DataFrame, columns: Sequence[str] = ("err_down", "err_base"),
                    edges: int = 120, q: float = 0.995) -> DataFrame:
    """``(serie, bin, left, right, n, density)`` over plus/minus the pooled ``q`` of the absolute errors."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("serie"), F.col(c).alias("e"))
                                         for c in columns])).alias("_r")).select("_r.*").filter("e IS NOT NULL")
    lim = exact_quantiles(long, F.abs("e"), [q]).agg(F.max("value").alias("_lim"))
    bins = edges - 1
    width = 2 * F.col("_lim") / bins
    slot = F.least(F.floor((F.col("e") + F.col("_lim")) / width), F.lit(bins - 1)).cast("int")
    counts = (attach_row(long, lim).filter(F.abs("e") <= F.col("_lim"))
              .groupBy("serie", slot.alias("bin"), "_lim").agg(F.count("*").alias("n")))
    total = F.sum("n").over(Window.partitionBy("serie"))      # at most ``bins`` rows per series
    return counts.select("serie", "bin", (-F.col("_lim") + F.col("bin") * width).alias("left"),
                         (-F.col("_lim") + (F.col("bin") + 1) * width).alias("right"), "n",
                         (F.col("n") / (total * width)).alias("density"))


def density2d(df: DataFrame, x: str = "y_residuo", y: str = "pred_residuo", n: int = 80,
              q: tuple[float, float] = (0.005, 0.995)) -> DataFrame:
    """``(hx, hy, lattice, x, y, n)``: hexagonal density over the square spanned by ``q`` of ``x``.

    Two interleaved lattices; each point goes to the nearer centre, which tiles the plane by
    hexagons. Points outside the square are left out, as in a plot with that extent.
    """
    cut = quantiles_wide(df, x, {"_lo": q[0], "_hi": q[1]})
    rows = max(int(n / math.sqrt(3)), 1)
    data = (attach_row(df.select(F.col(x).alias("_x"), F.col(y).alias("_y")), cut)
            .filter(F.col("_x").between(F.col("_lo"), F.col("_hi")) & F.col("_y").between(F.col("_lo"), F.col("_hi"))))
    span = F.col("_hi") - F.col("_lo")
    u, v = (F.col("_x") - F.col("_lo")) / (span / n), (F.col("_y") - F.col("_lo")) / (span / rows)
    data = data.withColumns({"_u": u, "_v": v})
    u, v = F.col("_u"), F.col("_v")
    i1, j1 = F.floor(u + 0.5), F.floor(v + 0.5)
    i2, j2 = F.floor(u), F.floor(v)
    d1 = (u - i1) * (u - i1) + 3 * (v - j1) * (v - j1)
    d2 = (u - i2 - 0.5) * (u - i2 - 0.5) + 3 * (v - j2 - 0.5) * (v - j2 - 0.5)
    near1 = d1 < d2
    return data.groupBy(F.when(near1, i1).otherwise(i2).cast("int").alias("hx"),
                        F.when(near1, j1).otherwise(j2).cast("int").alias("hy"),
                        F.when(near1, 0).otherwise(1).alias("lattice")).agg(F.count("*").alias("n"))


def field_summary(df: DataFrame, t: str = "T_final") -> DataFrame:
    """One row: finite values, range, mean; mean, median and p95 of the absolute correction."""
    base = df.agg(F.count("*").alias("n"), F.count(t).alias("n_finite"), F.min(t).alias("t_min"),
                  F.max(t).alias("t_max"), F.avg(t).alias("t_mean"),
                  F.avg(F.abs(f"{t}_oi")).alias("abs_mean"))
    q = quantiles_wide(df, F.abs(f"{t}_oi"), {"abs_p50": 0.5, "abs_p95": 0.95})
    return _side_by_side(base, q)


def period(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.agg(F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max"))


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Round every floating column for a report."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(c, places) for c in floats})


# --- station-level inference ----------------------------------------------------------------------

def station_metrics(df: DataFrame, station: str = "station") -> DataFrame:
    return df.groupBy(station).agg(*skill_columns())


def station_spread(stations: DataFrame, column: str = "rmse_down") -> DataFrame:
    """Median and interquartile range across stations."""
    return quantiles_wide(stations, column, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).withColumn(
        "iqr", F.col("p75") - F.col("p25"))


def bootstrap_ci(stations: DataFrame, column: str, n: int = 2000, seed: int = 42,
                 low: float = 0.025, high: float = 0.975, station: str = "station") -> DataFrame:
    """One row: mean and percentile interval from ``n`` resamples of the stations.

    Every resample draws as many stations as there are, with replacement; draw ``j`` of resample
    ``r`` is a hash of (seed, r, j), so the result does not depend on partitioning.
    """
    data = _indexed(stations, column, station)
    reps = bootstrap_draws(data, n, seed).groupBy("_rep").agg(F.avg("_v").alias("mean"))
    ci = quantiles_wide(reps, "mean", {"ci_low": low, "ci_high": high})
    return _side_by_side(data.agg(F.avg("_v").alias("mean"), F.count("_v").alias("n_stations")), ci)


def _indexed(stations: DataFrame, column: str, station: str) -> DataFrame:
    return dense_index(stations.filter(F.col(column).isNotNull()).select(station, F.col(column).alias("_v")), station)


def bootstrap_draws(data: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``(_rep, _v)``: all draws of ``n`` resamples of ``data`` (``idx`` from 0 without gaps, ``_v``)."""
    word = F.md5(F.concat_ws("_", F.lit(seed), F.col("_rep"), F.col("idx")))
    u = F.conv(F.substring(word, 1, 8), 16, 10).cast("double") / float(1 << 32)
    # resamples are spread first: the station list is short, its draws are many
    reps = data.sparkSession.range(n).select(F.col("id").alias("_rep"))
    draws = (attach_row(reps, data.agg(F.count("*").alias("n"))).filter("n > 0")
             .withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .select("_rep", F.floor(u * F.col("n")).alias("idx")))
    # draws are some thousands a station, which size estimates do not see: the stations (two numbers each) go to them
    return draws.join(F.broadcast(data.select("idx", "_v")), "idx").select("_rep", "_v")


def _signed_rank_tail(n: str, w: str) -> str:
    """SQL: P(W <= w) of the signed-rank statistic of n untied differences. The array of ways to reach each sum grows by one rank
    at a time: those without the rank, and those with it, shifted. Ways stay exact in doubles up to 2^53."""
    ways = (f"aggregate(sequence(1L, {n}), array(1D), (ways, r) -> zip_with(concat(ways, array_repeat(0D, CAST(r AS INT))),"
            " concat(array_repeat(0D, CAST(r AS INT)), ways), (a, b) -> a + b))")
    return f"aggregate(slice({ways}, 1, CAST({w} AS INT) + 1), 0D, (s, c) -> s + c) / power(2D, {n})"


def wilcoxon_paired(stations: DataFrame, a: str, b: str, exact_upto: int = 50) -> DataFrame:
    """Signed-rank test of paired station metrics: ``n, w_plus, w_minus, z, p_value`` (two-sided).

    Zero differences are dropped, ties share their mean rank. Up to ``exact_upto`` (at most 50) untied
    differences, ``p_value`` comes from the exact distribution; else from the normal form with
    tie correction. ``z`` is the normal form's in either case. Ranks come from value counts in two levels (value buckets, then values inside a
    bucket), so no task sees all stations.
    """
    d = (stations.select((F.col(a) - F.col(b)).alias("d")).filter("d IS NOT NULL AND d <> 0")
         .groupBy(F.abs("d").alias("v"))
         .agg(F.count("*").alias("t"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up")))
    # powers of 2^(1/64) order the values coarsely over their whole range
    d = d.withColumn("bucket", F.floor(F.log2("v") * 64).cast("int"))
    sizes = d.groupBy("bucket").agg(F.sum("t").alias("size"))
    before = sizes.withColumn("base", F.coalesce(
        F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).select("bucket", "base")                   # a few thousand buckets at most
    inside = Window.partitionBy("bucket").orderBy("v")
    ranked = (d.withColumn("upto", F.sum("t").over(inside)).join(before, "bucket")
              .withColumn("rank", F.col("base") + F.col("upto") - (F.col("t") - 1) / 2.0))
    row = ranked.agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"),
                     F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("w_minus"),
                     F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("_ties"))
    mean = F.col("n") * (F.col("n") + 1) / 4.0
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("_ties") / 48.0
    row = row.withColumn("z", F.try_divide(F.col("w_plus") - mean, F.sqrt(var)))
    exact = F.expr(f"least(1D, 2 * {_signed_rank_tail('n', 'least(w_plus, w_minus)')})")
    return row.withColumn("p_value", F.when((F.col("n") <= min(exact_upto, 50)) & (F.col("n") > 0) & (F.col("_ties") == 0), exact)
                          .otherwise(2 * _normal_tail(F.abs("z")))).drop("_ties")


def _normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal (Abramowitz and Stegun 7.1.26 on erfc)."""
    x = z / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x) / 2


def gain_decomposition(df: DataFrame, station: str | None = "station", naive: str = "err_naive",
                       model: str = "err_down", anchored: str = "err_anchored") -> DataFrame:
    """RMSE gains over the naive baseline: model (``g_lgbm``), anchoring (``g_anc``), total (``g_tot``)."""
    grouped = df.groupBy(station) if station else df.groupBy()
    r = grouped.agg(M.rmse(naive).alias("rmse_naive"), M.rmse(model).alias("rmse_model"),
                    M.rmse(anchored).alias("rmse_anchored"))
    return r.withColumns({"g_lgbm": F.col("rmse_naive") - F.col("rmse_model"),
                          "g_anc": F.col("rmse_model") - F.col("rmse_anchored"),
                          "g_tot": F.col("rmse_naive") - F.col("rmse_anchored")})


# --- importance -----------------------------------------------------------------------------------

def top_features(importance: DataFrame, n: int = 15, by: str = "gain") -> DataFrame:
    return importance.orderBy(F.col(by).desc(), "feature").limit(n)
