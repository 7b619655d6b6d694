"""Canonical grid: containing cell, station classification, region mask, scatter."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from finescale.functions.physics import ColumnLike, _c
from finescale.functions.utm import lonlat_to_utm
from finescale.operators.one_row import attach_row
from finescale.session import spread


@dataclass(frozen=True)
class Axes:
    """Regular cell-centre axes; ``dy`` may be negative (north-up rasters)."""

    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int

    @classmethod
    def from_bounds(cls, x_min, x_max, y_min, y_max, nx, ny, north_up=True) -> "Axes":
        """Step from the bounds, not the nominal spacing, which is rounded."""
        dx, dy = (x_max - x_min) / (nx - 1), (y_max - y_min) / (ny - 1)
        return cls(x_min, y_max if north_up else y_min, dx, -dy if north_up else dy, nx, ny)


def _nearest(v: Column, v0: float, step: float, n: int) -> Column:
    """Index of the nearest centre, the lower index on a tie, clipped to the axis."""
    i = F.ceil((v - v0) / step - 0.5)
    return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)).cast("int")


def containing_cell(points: DataFrame, axes: Axes, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``iy, ix`` of the nearest cell centre (pure arithmetic, no join)."""
    return points.withColumns({"iy": _nearest(F.col(y), axes.y0, axes.dy, axes.ny),
                               "ix": _nearest(F.col(x), axes.x0, axes.dx, axes.nx)})


def inside_extent(axes: Axes, x: ColumnLike = "x", y: ColumnLike = "y") -> Column:
    """Within half a cell of the outermost centres."""
    xs = sorted((axes.x0, axes.x0 + axes.dx * (axes.nx - 1)))
    ys = sorted((axes.y0, axes.y0 + axes.dy * (axes.ny - 1)))
    hx, hy = abs(axes.dx) / 2, abs(axes.dy) / 2
    return _c(x).between(xs[0] - hx, xs[1] + hx) & _c(y).between(ys[0] - hy, ys[1] + hy)


def classify_stations(stations: DataFrame, grid: DataFrame, axes: Axes,
                      x: str = "x", y: str = "y") -> DataFrame:
    """Containing cell, ``treinavel`` and ``motivo`` (extent is tested before land)."""
    placed = containing_cell(stations, axes, x, y).withColumn("_in", inside_extent(axes, x, y))
    land = grid.select("iy", "ix", F.col("z_alvo").isNotNull().alias("_land"))
    joined = placed.join(land, ["iy", "ix"], "left")
    reason = (F.when(~F.col("_in"), "fora_extent")
              .when(~F.coalesce(F.col("_land"), F.lit(False)), "celula_oceano").otherwise("ok"))
    return (joined.withColumn("motivo", reason)
            .withColumn("treinavel", F.col("motivo") == "ok").drop("_in", "_land"))


def locate_stations(stations: DataFrame, grid: DataFrame, axes: Axes) -> DataFrame:
    """Stations with ``longitude, latitude`` to UTM, cell, centre coordinates and status."""
    x, y = lonlat_to_utm("longitude", "latitude")
    placed = classify_stations(stations.withColumns({"x_utm": x, "y_utm": y}), grid, axes, "x_utm", "y_utm")
    centres = grid.select("iy", "ix", F.col("lon").alias("cell_lon"), F.col("lat").alias("cell_lat"))
    return placed.join(centres, ["iy", "ix"], "left")


def read_cells(stack: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of the given cells only (direct index read)."""
    return stack.join(cells.select("iy", "ix").distinct(), ["iy", "ix"])


def region_mask(grid: DataFrame, edges: DataFrame, axes: Axes) -> DataFrame:
    """Add ``in_region``: is the cell centre inside the (multi)polygon, even-odd rule.

    ``edges``: ``x1, y1, x2, y2`` in grid units. A scan-line fill: each edge is expanded to the grid
    rows it crosses, crossings of a row are paired in x order and each pair expands to the cells
    between. Work follows outline length plus filled area; no cell-edge pairs are formed.
    """
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    row = lambda y: (y - F.lit(axes.y0)) / F.lit(axes.dy)
    first = F.greatest(F.floor(F.least(row(lo), row(hi))), F.lit(0))
    last = F.least(F.ceil(F.greatest(row(lo), row(hi))), F.lit(axes.ny - 1))
    y = F.lit(axes.y0) + F.col("iy") * F.lit(axes.dy)
    crossings = (edges.filter("y1 <> y2").withColumns({"_lo": lo, "_hi": hi, "_a": first, "_z": last})
                 .filter("_a <= _z")
                 .withColumn("iy", F.explode(F.sequence(F.col("_a").cast("int"), F.col("_z").cast("int"))))
                 .withColumn("_y", y)
                 .filter((F.col("_lo") <= F.col("_y")) & (F.col("_y") < F.col("_hi")))
                 .select("iy", (F.col("x1") + (F.col("_y") - F.col("y1")) * (F.col("x2") - F.col("x1"))
                                / (F.col("y2") - F.col("y1"))).alias("_x")))
    line = Window.partitionBy("iy").orderBy("_x")
    spans = (crossings.withColumns({"_n": F.row_number().over(line), "_to": F.lead("_x").over(line)})
             .filter("_n % 2 = 1 AND _to IS NOT NULL"))
    # centre is inside when crossing <= x < next crossing (dx is positive on this axis)
    start = F.greatest(F.ceil((F.col("_x") - axes.x0) / axes.dx), F.lit(0))
    stop = F.least(F.ceil((F.col("_to") - axes.x0) / axes.dx) - 1, F.lit(axes.nx - 1))
    inside = (spans.withColumns({"_s": start, "_e": stop}).filter("_s <= _e")
              .select("iy", F.explode(F.sequence(F.col("_s").cast("int"), F.col("_e").cast("int"))).alias("ix")).distinct()
              .withColumn("in_region", F.lit(True)))
    return (grid.join(inside, ["iy", "ix"], "left")
            .withColumn("in_region", F.coalesce("in_region", F.lit(False))))


def scatter(grid: DataFrame, values: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """Values back on the full grid, missing where there is none; per hour when hours are given.

    A cell meets the values of a day as one list, by merge, before the day's hours multiply it: rows per cell and day are shuffled
    and sorted, rows per cell and hour are not. A list holds the values of one cell and day.
    """
    if hours is None:
        return grid.join(values, ["iy", "ix"], "left")
    rest = [c for c in values.columns if c not in ("iy", "ix", "ts")]
    lists = (values.groupBy("iy", "ix", F.to_date("ts").alias("_day"))
             .agg(F.collect_list(F.struct(F.col("ts").alias("_ts"), *rest)).alias("_values")))
    dealt, days = _cell_days(grid, hours)
    met = dealt.join(lists.hint("merge"), ["iy", "ix", "_day"], "left").join(F.broadcast(days), "_day")
    return (met.select("iy", "ix", F.explode("_hours").alias("ts"), *[c for c in grid.columns if c not in ("iy", "ix")], "_values")
            .select("*", F.inline_outer(F.filter("_values", lambda v: v["_ts"] == F.col("ts")))).drop("_values", "_ts"))


def expand_hours(cells: DataFrame, hours: DataFrame) -> DataFrame:
    """Every cell at every hour (the output is that product by definition).

    A cell is dealt to the days of the span and joins each day's hours by key: an equi-join whose one
    side has a row per day, for spans of any length.
    """
    dealt, days = _cell_days(cells, hours)
    return dealt.join(F.broadcast(days), "_day").withColumn("ts", F.explode("_hours")).drop("_day", "_hours")


def _cell_days(cells: DataFrame, hours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every cell at every ``_day`` of the hours, and the ``_hours`` of each day."""
    days = hours.groupBy(F.to_date("ts").alias("_day")).agg(F.collect_set("ts").alias("_hours"))
    span = days.agg(F.sort_array(F.collect_list("_day")).alias("_days"))       # a date per day
    return attach_row(spread(cells), span).withColumn("_day", F.explode("_days")).drop("_days"), days


def grid_meta(grid: DataFrame, factor: int = 11, nodata: float = -9999.0,
              crs: str = "EPSG:31982") -> DataFrame:
    """One-row grid record; the step comes from the bounds."""
    row = grid.agg(F.count_distinct("iy").alias("ny"), F.count_distinct("ix").alias("nx"),
                   F.min("x").alias("x_min"), F.max("x").alias("x_max"),
                   F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return row.withColumns({
        "dx": F.try_divide(F.col("x_max") - F.col("x_min"), F.col("nx") - 1),
        "dy": F.try_divide(F.col("y_max") - F.col("y_min"), F.col("ny") - 1),
        "factor": F.lit(factor), "nodata": F.lit(nodata), "crs": F.lit(crs)})


def bbox_scan(df: DataFrame, x: tuple[float, float], y: tuple[float, float], margin: float = 0.0,
              px: str = "px", py: str = "py") -> DataFrame:
    """Pixels of a window plus margin; the range predicates reach the Parquet scan, which skips what lies outside in a table of
    ``write_pixels``."""
    def inside(name: str, low: float, high: float) -> Column:
        if isinstance(df.schema[name].dataType, IntegralType):     # compared as integers: a cast of the column would keep the scan from skipping
            low, high = math.ceil(low), math.floor(high)
        return F.col(name).between(low, high)

    return df.filter(inside(px, x[0] - margin, x[1] + margin) & inside(py, y[0] - margin, y[1] + margin))


def holdout_class(stations: DataFrame, training: DataFrame, cell: Sequence[str] = ("iy", "ix")) -> DataFrame:
    """``G1``: shares a cell with a training station; ``G2``: independent."""
    used = training.select(*cell).distinct().withColumn("_used", F.lit(True))
    return (stations.join(used, list(cell), "left")
            .withColumn("classe", F.when(F.col("_used"), "G1").otherwise("G2")).drop("_used"))
