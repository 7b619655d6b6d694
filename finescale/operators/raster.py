"""Fine pixels to coarse cells: block statistics, class fractions, ring deviation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finescale.functions.physics import ColumnLike, _c
from finescale.operators.one_row import attach_row

FACTOR = 11                   # fixed value: fine pixels per cell edge
GROUPS = tuple(f"T{i}" for i in range(1, 9))


def block_keys(px: ColumnLike = "px", py: ColumnLike = "py", factor: int = FACTOR) -> dict[str, Column]:
    return {"iy": F.floor(_c(py) / factor).cast("int"), "ix": F.floor(_c(px) / factor).cast("int")}


def _share(p: float) -> Callable[[str], Column]:
    # at most factor*factor pixels per block, so the exact built-in is bounded here
    return lambda c: F.percentile(c, p)


def block_agg(pixels: DataFrame, stats: dict[str, Column], factor: int = FACTOR,
              shape: tuple[int, int] | None = None) -> DataFrame:
    """Statistics of ``factor`` x ``factor`` blocks; missing skipped, ragged edges trimmed.

    ``pixels``: one row per ``(px, py)``. ``stats``: output name -> aggregate. ``shape``
    is (rows, columns) of the fine raster; without it the extent is read from the data in a
    one-row aggregate.
    """
    data = pixels.withColumns(block_keys(factor=factor))
    out = data.groupBy("iy", "ix").agg(*[s.alias(n) for n, s in stats.items()])
    if shape is not None:
        return out.filter((F.col("iy") < shape[0] // factor) & (F.col("ix") < shape[1] // factor))
    extent = pixels.agg(F.floor((F.max("py") + 1) / factor).alias("_ny"),
                        F.floor((F.max("px") + 1) / factor).alias("_nx"))
    return (attach_row(out, extent).filter((F.col("iy") < F.col("_ny")) & (F.col("ix") < F.col("_nx")))
            .drop("_ny", "_nx"))


# Terrain layers, their pixel columns and block statistics (deviation of the population, as for rasters).
TERRAIN_LAYERS: dict[str, tuple[str, Callable[[str], Column]]] = {
    "z_alvo": ("z", F.avg),
    "z_std_1km": ("z", F.stddev_pop),
    "slope_mean_1km": ("slope", F.avg),
    "slope_max_1km": ("slope", F.max),
    "tri_mean_1km": ("tri", F.avg),
    "tri_std_1km": ("tri", F.stddev_pop),
    "tri_max_1km": ("tri", F.max),
    "northness_mean_1km": ("northness", F.avg),
    "eastness_mean_1km": ("eastness", F.avg),
    "svf_mean_1km": ("svf", F.avg),
    "svf_p10_1km": ("svf", _share(0.1)),
    "mrvbf_p90_1km": ("mrvbf", _share(0.9)),
    "hand_mean_1km": ("hand", F.avg),
    "hand_p10_1km": ("hand", _share(0.1)),
    "dev_r300_mean_1km": ("dev_r300", F.avg),
    "dev_r300_p10_1km": ("dev_r300", _share(0.1)),
    "dev_r1000_mean_1km": ("dev_r1000", F.avg),
    "dev_r1000_p10_1km": ("dev_r1000", _share(0.1)),
    "dev_r3000_mean_1km": ("dev_r3000", F.avg),
    "dev_r3000_p10_1km": ("dev_r3000", _share(0.1)),
}


def terrain_layers(pixels: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """All block statistics whose pixel column is present, in one aggregation."""
    stats = {n: f(c) for n, (c, f) in TERRAIN_LAYERS.items() if c in pixels.columns}
    return block_agg(pixels, stats, shape=shape)


def classify(pixels: DataFrame, lookup: DataFrame, code: str = "code") -> DataFrame:
    """Attach the thermal group of each pixel code; unmapped codes get NULL."""
    return pixels.join(lookup.select("code", "grupo"), pixels[code] == lookup["code"], "left").drop(lookup["code"])


def unmapped_codes(pixels: DataFrame, lookup: DataFrame) -> DataFrame:
    """Codes present but not in the lookup, reduced to distinct codes before the join."""
    return pixels.select("code").distinct().join(lookup, "code", "left_anti")


def fractions(pixels: DataFrame, lookup: DataFrame, land: DataFrame | None = None,
              keys: Sequence[str] = ("iy", "ix"), groups: Sequence[str] = GROUPS) -> DataFrame:
    """Share of each thermal group among the mapped pixels of a cell, and the mapped share.

    ``pixels``: cell keys and ``code``. Counts combine map-side per (cell, code), so a cell with
    very many pixels is no hot spot; the lookup then joins counts, not pixels. Cells without a
    mapped pixel have NULL fractions. ``land`` keeps land cells only.
    """
    counts = pixels.groupBy(*keys, "code").agg(F.count("*").alias("n"))
    grouped = counts.join(lookup.select("code", "grupo"), "code", "left")
    n = lambda g: F.sum(F.when(F.col("grupo") == g, F.col("n")).otherwise(0))
    mapped = F.sum(F.when(F.col("grupo").isin(list(groups)), F.col("n")).otherwise(0))
    out = grouped.groupBy(*keys).agg(
        *[F.try_divide(n(g).cast("double"), mapped.cast("double")).alias(f"fracao_{g.lower()}") for g in groups],
        (mapped / F.sum("n")).alias("fracao_observada"))
    return out if land is None else out.join(land.select(*keys), list(keys), "left_semi")


def _axis_shares(at: str, origin: float, edge: float, width: float, name: str) -> str:
    """SQL array of the cells that the stretch of ``width`` around ``at`` meets on one axis, each with the stretch's share in it."""
    low, high = f"(({at} - {width / 2!r}D - {origin!r}D) / {edge!r}D)", f"(({at} + {width / 2!r}D - {origin!r}D) / {edge!r}D)"
    shares = (f"transform(sequence(CAST(floor({low}) AS INT), CAST(floor({high}) AS INT)), i -> named_struct('{name}', i,"
              f" 'share', (least({high}, i + 1D) - greatest({low}, CAST(i AS DOUBLE))) / ({high} - {low})))")
    return f"filter({shares}, s -> s.share > 0)"


def cell_shares(pixels: DataFrame, origin: tuple[float, float], cell: tuple[float, float], pixel: tuple[float, float],
                x: str = "x", y: str = "y") -> DataFrame:
    """Pixels dealt to every cell they overlap: ``iy, ix`` and ``share``, the part of the pixel's area inside. The shares of a pixel add up to
    one.

    ``x, y``: pixel centres; ``pixel``: their width and height; cell (0, 0) begins at ``origin`` and is ``cell`` wide and high, all in
    one unit. Pixels may be finer or coarser than cells. A pixel without a place meets no cell.
    """
    rows = pixels.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumn("_h", F.explode(F.expr(_axis_shares(f"`{x}`", origin[0], cell[0], pixel[0], "ix"))))
    rows = rows.withColumn("_v", F.explode(F.expr(_axis_shares(f"`{y}`", origin[1], cell[1], pixel[1], "iy"))))
    return rows.withColumns({"iy": F.col("_v.iy"), "ix": F.col("_h.ix"), "share": F.col("_h.share") * F.col("_v.share")}).drop("_h", "_v")


def area_fractions(shares: DataFrame, lookup: DataFrame, land: DataFrame | None = None, keys: Sequence[str] = ("iy", "ix"),
                   groups: Sequence[str] = GROUPS) -> DataFrame:
    """As ``fractions``, by area: ``shares`` of ``cell_shares`` with a ``code``. Areas add up per (cell, code) before any shuffle and before
    the lookup. Codes without a group lie in a cell's area but in no fraction; cells without a mapped pixel have NULL fractions."""
    areas = shares.groupBy(*keys, "code").agg(F.sum("share").alias("area"))
    grouped = areas.join(lookup.select("code", "grupo"), "code", "left")
    area = lambda g: F.sum(F.when(F.col("grupo") == g, F.col("area")).otherwise(0.0))
    mapped = F.sum(F.when(F.col("grupo").isin(list(groups)), F.col("area")).otherwise(0.0))
    out = grouped.groupBy(*keys).agg(*[F.try_divide(area(g), mapped).alias(f"fracao_{g.lower()}") for g in groups],
                                     (mapped / F.sum("area")).alias("fracao_observada"))
    return out if land is None else out.join(land.select(*keys), list(keys), "left_semi")


def check_fractions(df: DataFrame, groups: Sequence[str] = GROUPS, tol: float = 1e-3) -> DataFrame:
    """One row: extremes over all groups, worst deviation of the sum from one, and the verdict."""
    cols = [F.col(f"fracao_{g.lower()}") for g in groups]
    total = sum(cols[1:], cols[0])
    row = df.agg(F.min(F.least(*cols)).alias("frac_min"), F.max(F.greatest(*cols)).alias("frac_max"),
                 F.max(F.abs(total - 1.0)).alias("sum_err"))
    return row.withColumn("ok", (F.col("frac_min") >= -tol) & (F.col("frac_max") <= 1 + tol))


# Ring bands in metres.
RINGS = {"r300": (0.0, 300.0), "r1000": (300.0, 1000.0), "r3000": (1000.0, 3000.0)}


def _ring_runs(r_in: float, r_out: float, res: float) -> list[tuple[int, int, int]]:
    """The ring as horizontal runs ``(dy, first dx, last dx)`` of pixel offsets."""
    reach, runs = int(round(r_out / res)), []
    for dy in range(-reach, reach + 1):
        hits = [dx for dx in range(-reach, reach + 1)
                if r_in < math.hypot(dx, dy) * res <= r_out]
        start = None
        for dx in hits:
            if start is None:
                start = last = dx
            elif dx == last + 1:
                last = dx
            else:
                runs.append((dy, start, last))
                start = last = dx
        if start is not None:
            runs.append((dy, start, last))
    return runs


def ring_dev(pixels: DataFrame, r_in: float, r_out: float, res: float = 1000.0 / FACTOR,
             value: str = "z", name: str = "dev", tile: int = 256) -> DataFrame:
    """``(value - ring mean) / ring std`` around each valid pixel; missing ring pixels ignored.

    ``pixels``: one row per ``(px, py)``. Pixels are copied to the tiles they influence (a halo of
    the ring radius), so each task holds one tile of fixed size: row-wise cumulative sums turn
    every horizontal run of the ring into two look-ups.
    """
    reach = int(round(r_out / res))
    runs = _ring_runs(r_in, r_out, res)
    if not runs:
        raise ValueError("the ring holds no pixel at this resolution")

    def spread(p: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(p) - reach) / tile), F.floor((F.col(p) + reach) / tile)))

    tiles = (pixels.filter(F.col(value).isNotNull())
             .select(F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"),
                     F.col(value).cast("double").alias("v"))
             .withColumn("_tx", spread("px")).withColumn("_ty", spread("py")))
    side = tile + 2 * reach

    def dev(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(key[0]) * tile - reach, int(key[1]) * tile - reach
        z = np.zeros((3, side, side + 1))
        rows, cols = pdf["py"].to_numpy() - y0, pdf["px"].to_numpy() - x0
        v = pdf["v"].to_numpy()
        centre = v.mean()                      # shift keeps the squares well conditioned
        z[0, rows, cols + 1], z[1, rows, cols + 1] = 1.0, v - centre
        z[2, rows, cols + 1] = (v - centre) ** 2
        sums = z.cumsum(axis=2)
        mine = (rows >= reach) & (rows < reach + tile) & (cols >= reach) & (cols < reach + tile)
        r, c, v = rows[mine], cols[mine], v[mine] - centre
        n, s, q = (np.zeros(len(r)) for _ in range(3))
        for dy, first, last in runs:
            hi, lo = sums[:, r + dy, c + last + 1], sums[:, r + dy, c + first]
            n, s, q = n + (hi[0] - lo[0]), s + (hi[1] - lo[1]), q + (hi[2] - lo[2])
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = s / n
            std = np.sqrt(np.clip(q / n - mean ** 2, 0.0, None))
            out = np.where((n > 0) & (std >= 1e-6), (v - mean) / std, np.nan)
        return pd.DataFrame({"px": c + x0, "py": r + y0, name: out})

    result = tiles.groupBy("_tx", "_ty").applyInPandas(dev, f"px int, py int, {name} double")
    return result.withColumn(name, F.when(~F.isnan(name), F.col(name)))
