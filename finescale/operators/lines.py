"""Distance to line work (a coast): exact point-to-segment distances by equi-joins on tiles.

Segments of any length are dealt to the tiles they cross, on halving tile sizes. A target uses the finest level at which its 3x3
block of tiles holds a piece of a segment: that piece is at most 2*sqrt(2) tile edges away, so the nearest segment crosses the 7x7 block
around the target. Levels stop where a tile is about as wide as a mean segment is long, so a level deals out some three tiles a
segment in the mean.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finescale.operators.neighbours import REACH, _block, _tile_text
from finescale.session import spread

SLACK = 1e-9                    # of a tile: a segment on a tile's edge counts as crossing both sides
DEEPEST = 24

_LENGTH = "sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))"


def _segments(segments: DataFrame) -> DataFrame:
    """Segments with two places; the others are no line."""
    ends = ("x1", "y1", "x2", "y2")
    return segments.select(*[F.col(c).cast("double").alias(c) for c in ends]).dropna()


def densify(segments: DataFrame, step: float) -> DataFrame:
    """Vertices ``x, y`` along every segment (``x1, y1, x2, y2``), at most ``step`` apart, both ends included."""
    cut = _segments(segments).withColumn("_n", F.expr(f"greatest(1L, CAST(ceil({_LENGTH} / {step!r}D) AS BIGINT))"))
    cut = cut.withColumn("_k", F.explode(F.expr("sequence(0L, _n)")))
    return cut.select(F.expr("x1 + (x2 - x1) * _k / _n").alias("x"), F.expr("y1 + (y2 - y1) * _k / _n").alias("y"))


def _crossed(size: str) -> str:
    """SQL array of the tiles of edge ``size`` that a segment (moved to the origin) crosses, column by column."""
    left, right = "least(x1, x2)", "greatest(x1, x2)"
    at = lambda x: f"IF(x1 = x2, {{0}}, y1 + (y2 - y1) * (({x}) - x1) / (x2 - x1))"
    low = at(f"greatest({left}, i * {size})").format("y1")
    high = at(f"least({right}, (i + 1) * {size})").format("y2")
    rows = (f"sequence(CAST(floor(least({low}, {high}) / {size} - {SLACK}D) AS BIGINT), CAST(floor(greatest({low}, {high}) / {size} + {SLACK}D) AS BIGINT))")
    columns = f"sequence(CAST(floor({left} / {size} - {SLACK}D) AS BIGINT), CAST(floor({right} / {size} + {SLACK}D) AS BIGINT))"
    return f"flatten(transform({columns}, i -> transform({rows}, j -> named_struct('tx', i, 'ty', j))))"


def distance_to_lines(targets: DataFrame, segments: DataFrame, target_keys: Sequence[str] = ("iy", "ix"), x: str = "x", y: str = "y",
                      name: str = "dist_oceano") -> DataFrame:
    """Distance of every target to the nearest of ``segments`` (``x1, y1, x2, y2``, in the targets' unit).

    Targets without a place, and all of them where there is no segment, are left out. Segments of no length are points.
    Extent and mean length of the segments are read first, one row.
    """
    lines = _segments(segments)
    x0, y0, x1, y1, mean, n = lines.agg(*[F.min(F.least(c + "1", c + "2")) for c in "xy"], *[F.max(F.greatest(c + "1", c + "2")) for c in "xy"],
                                        F.avg(F.expr(_LENGTH)), F.count("*")).first()
    if not n:
        return targets.select(*target_keys, F.lit(0.0).alias(name)).filter("false")
    edge = max(x1 - x0, y1 - y0) * (1 + 1e-9) or 1.0
    finest = max(0, min(DEEPEST, int(math.log2(edge / mean)) if mean else DEEPEST, int(math.log(n, 4)) + 2))
    size = f"({edge!r}D * power(2D, -level))"
    moved = lines.select(*[(F.col(c) - F.lit(o)).alias(c) for c, o in (("x1", x0), ("y1", y0), ("x2", x0), ("y2", y0))])
    tiled = (spread(moved).withColumn("level", F.expr(f"explode(sequence(0, {finest}))"))
             .select("level", "x1", "y1", "x2", "y2", F.explode(F.expr(_crossed(size))).alias("_t"))
             .select("level", "_t.tx", "_t.ty", "x1", "y1", "x2", "y2"))
    served = (tiled.select("level", "tx", "ty").distinct().select("level", F.explode(_block("tx", "ty", 1, 1)).alias("_t"))
              .select("level", "_t.tx", "_t.ty").distinct())
    least = f"({edge!r}D * power(2D, -{finest}))"
    tg = targets.select(*target_keys, (F.col(x) - F.lit(x0)).alias("_x"), (F.col(y) - F.lit(y0)).alias("_y")).dropna(subset=["_x", "_y"])
    tg = tg.withColumns({"_fx": F.expr(_tile_text("_x", least)), "_fy": F.expr(_tile_text("_y", least))})
    coarser = "CAST(floor({0} / power(2D, " + str(finest) + " - level)) AS BIGINT)"
    level_of = (tg.select("_fx", "_fy").distinct().withColumn("level", F.expr(f"explode(sequence(0, {finest}))"))
                .withColumns({"tx": F.expr(coarser.format("_fx")), "ty": F.expr(coarser.format("_fy"))})
                .join(served.hint("merge"), ["level", "tx", "ty"]).groupBy("_fx", "_fy").agg(F.max("level").alias("level")))
    reach = math.ceil(REACH)
    # a target far outside has no level: it meets the one tile of level 0, which every segment crosses
    around = (spread(tg).join(level_of, ["_fx", "_fy"], "left")
              .withColumn("_t", F.explode(F.when(F.col("level").isNull(), F.expr("array(named_struct('tx', 0L, 'ty', 0L))"))
                                          .otherwise(_block(f"({_tile_text('_x', size)})", f"({_tile_text('_y', size)})", reach, reach))))
              .select(*target_keys, "_x", "_y", F.coalesce("level", F.lit(0)).alias("level"), "_t.tx", "_t.ty"))
    part = "((_x - x1) * (x2 - x1) + (_y - y1) * (y2 - y1)) / nullif(power(x2 - x1, 2) + power(y2 - y1, 2), 0)"
    # an explode has multiplied the pieces, which size estimates do not see: no broadcast
    met = around.join(tiled.hint("merge"), ["level", "tx", "ty"]).withColumn("_k", F.expr(f"coalesce(greatest(0D, least(1D, {part})), 0D)"))
    return met.groupBy(*target_keys).agg(F.min(F.expr("sqrt(power(_x - x1 - _k * (x2 - x1), 2) + power(_y - y1 - _k * (y2 - y1), 2))")).alias(name))
