"""Exact quantiles with linear interpolation, without gathering a group in one task.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here a mergeable sketch brackets each wanted rank
(its error is bounded), a second pass counts rows in ``BINS`` equal parts of the bracket, and a third counts the distinct values of the
one or two parts that hold the rank. All passes combine map-side, and what a window then orders is at most ``BINS`` parts, or one
part's distinct values, per group and quantile. The values are written once, so that all passes count the same bits; so are the few
rows per group, whose real size lets the planner join them without dealing all values by a group key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finescale.functions.physics import ColumnLike, _c
from finescale.operators.one_row import attach_row
from finescale.session import kept

BINS = 4096


def exact_quantiles(df: DataFrame, value: ColumnLike, qs: Sequence[float],
                    by: Sequence[str] = (), accuracy: int = 20_000) -> DataFrame:
    """Rows ``(by..., q, n, value)``: the exact quantile of the non-missing values."""
    by = list(by)
    key = by or ["_all"]
    data = df.select(*by, _c(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if not by:
        data = data.withColumn("_all", F.lit(0))
    data = kept(data, "values")
    join = (lambda a, b: a.join(kept(b, "groups"), key)) if by else (lambda a, b: attach_row(a, b.drop("_all")))
    slack, k = 4.0 / accuracy, len(qs)
    lows, highs = [max(q - slack, 0.0) for q in qs], [min(q + slack, 1.0) for q in qs]
    sketch = data.groupBy(*key).agg(F.count("*").alias("n"), F.percentile_approx("_v", lows + highs, accuracy).alias("_b"))
    # room for the last bits of the bracket's own arithmetic
    pad = lambda b, sign: b + sign * F.abs(b) * F.lit(1e-9)
    brackets = sketch.select(*key, "n", F.array(*[
        F.struct(F.lit(float(q)).alias("q"), pad(F.col("_b")[i], -1).alias("lo"), pad(F.col("_b")[k + i], 1).alias("hi"))
        for i, q in enumerate(qs)]).alias("_qs"))
    placed = (join(data, brackets).select(*key, "n", "_v", F.explode("_qs").alias("_q")).select(*key, "n", "_v", "_q.*"))
    part = F.when(F.col("_v") < F.col("lo"), -1).when(F.col("_v") > F.col("hi"), BINS).otherwise(
        F.coalesce(F.least(F.lit(BINS - 1), F.floor(F.try_divide(F.col("_v") - F.col("lo"), F.col("hi") - F.col("lo")) * BINS)), F.lit(0)))
    counts = placed.groupBy(*key, "n", "q", part.cast("int").alias("_part")).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    run = Window.partitionBy(*key, "q").orderBy("_part")
    rank = F.col("q") * (F.col("n") - 1)                     # 0-based, fractional
    below, above = F.floor(rank), F.ceil(rank)
    # the parts that hold the rank or its upper neighbour; ranks count from the part's first row
    held = (counts.withColumn("_start", F.sum("_c").over(run) - F.col("_c"))
            .filter((below < F.col("_start") + F.col("_c")) & (above >= F.col("_start")))
            .select(*key, "q", "n", "_start", "_c", "_min", "_max"))
    wanted = held.groupBy(*key).agg(F.collect_list(F.struct("q", "n", "_start", "_min", "_max")).alias("_ps"))
    if not by:
        wanted = wanted.select(F.lit(0).alias("_all"), "_ps")
    inside = (join(data, wanted)
              .select(*key, "_v", F.explode(F.filter("_ps", lambda p: F.col("_v").between(p["_min"], p["_max"]))).alias("_p"))
              .groupBy(*key, "_p.q", "_p.n", "_p._start", "_v").agg(F.count("*").alias("_c")))
    order = Window.partitionBy(*key, "q", "_start").orderBy("_v")
    ranked = inside.withColumn("_end", F.col("_start") + F.sum("_c").over(order))
    first = F.col("_end") - F.col("_c")
    holds = lambda r: (first <= r) & (r < F.col("_end"))
    out = ranked.groupBy(*key, "q", "n").agg(F.max(F.when(holds(below), F.col("_v"))).alias("_a"),
                                             F.max(F.when(holds(above), F.col("_v"))).alias("_z"))
    share = rank - F.floor(rank)
    exact = F.when(share == 0, F.col("_a")).otherwise(F.col("_a") * (1 - share) + F.col("_z") * share)
    return out.select(*by, "q", "n", exact.alias("value"))


def quantiles_wide(df: DataFrame, value: ColumnLike, named: dict[str, float],
                   by: Sequence[str] = (), accuracy: int = 20_000) -> DataFrame:
    """One row per group with a named column per quantile."""
    long = exact_quantiles(df, value, list(named.values()), by, accuracy)
    picks = [F.max(F.when(F.col("q") == F.lit(float(q)), F.col("value"))).alias(name)
             for name, q in named.items()]
    return long.groupBy(*by).agg(*picks) if by else long.agg(*picks)
