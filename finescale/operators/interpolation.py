"""Coarse-to-fine interpolation that renormalises over the nodes present.

The coarse table is small next to the fine one (about 80 cells per node), so the four corners of
every coarse box are gathered on the coarse side; cells then join their box by key and the
weighted mean is a plain projection: no aggregation on fine rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finescale.operators.neighbours import knn
from finescale.operators.one_row import attach_row
from finescale.session import spread

CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def node_axis(coarse: DataFrame) -> DataFrame:
    """One row: origin, spacing and last index of the regular coarse axes."""
    axis = coarse.agg(F.min("lat_i").alias("i0"), F.max("lat_i").alias("i1"),
                      F.min("lon_i").alias("j0"), F.max("lon_i").alias("j1"),
                      F.min_by("lat", "lat_i").alias("lat0"), F.max_by("lat", "lat_i").alias("lat1"),
                      F.min_by("lon", "lon_i").alias("lon0"), F.max_by("lon", "lon_i").alias("lon1"))
    return axis.select(
        "lat0", "lon0", "i0", "i1", "j0", "j1",
        F.try_divide(F.col("lat1") - F.col("lat0"), F.col("i1") - F.col("i0")).alias("dlat"),
        F.try_divide(F.col("lon1") - F.col("lon0"), F.col("j1") - F.col("j0")).alias("dlon"))


def stencil(cells: DataFrame, coarse: DataFrame, keys: Sequence[str] = ("iy", "ix"),
            lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Per cell: its coarse box ``(bi, bj)`` and the weights ``w0..w3`` of the box corners.

    Cells outside the coarse axes get the box at the edge with all weights zero: interpolation gives missing there.
    The descending latitude axes of the sources work too: only index order matters.
    """
    u = F.col("i0") + F.try_divide(F.col("_lat") - F.col("lat0"), F.col("dlat"))
    v = F.col("j0") + F.try_divide(F.col("_lon") - F.col("lon0"), F.col("dlon"))
    placed = attach_row(cells.select(*keys, F.col(lat).alias("_lat"), F.col(lon).alias("_lon")),
                        node_axis(coarse)).withColumns({"_u": u, "_v": v})
    inside = F.col("_u").between(F.col("i0"), F.col("i1")) & F.col("_v").between(F.col("j0"), F.col("j1"))
    bi = F.least(F.greatest(F.floor("_u"), F.col("i0")), F.col("i1") - 1)
    bj = F.least(F.greatest(F.floor("_v"), F.col("j0")), F.col("j1") - 1)
    boxed = placed.select(*keys, F.col("_lat").alias("lat"), F.col("_lon").alias("lon"),
                          bi.cast("int").alias("bi"), bj.cast("int").alias("bj"), "_u", "_v", inside.alias("_inside"))
    fu, fv = F.col("_u") - F.col("bi"), F.col("_v") - F.col("bj")
    return boxed.withColumns({f"w{n}": F.when(F.col("_inside"), (fu if i else 1 - fu) * (fv if j else 1 - fv)).otherwise(0.0)
                              for n, (i, j) in enumerate(CORNERS)}).drop("_u", "_v", "_inside")


def node_presence(coarse: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``(lat_i, lon_i, lat, lon, _has_<variable>...)``: which variables a node holds at some hour, in one pass."""
    return coarse.groupBy("lat_i", "lon_i").agg(
        F.first("lat").alias("lat"), F.first("lon").alias("lon"), *[F.max(F.col(v).isNotNull()).alias(f"_has_{v}") for v in variables])


def variable_classes(nodes: DataFrame, variables: Sequence[str]) -> list[list[str]]:
    """Variables held by the same nodes, together. The driver reads one row of comparisons; families of one source share a class."""
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i + 1:]]
    same = nodes.agg(F.count("*"), *[F.count_if(F.col(f"_has_{a}") != F.col(f"_has_{b}")).alias(f"{a}|{b}") for a, b in pairs]).first()
    classes: list[list[str]] = []
    for v in variables:
        home = next((c for c in classes if same[f"{c[0]}|{v}"] == 0), None)
        if home is None:
            classes.append([v])
        else:
            home.append(v)
    return classes


def dry_cells(sten: DataFrame, nodes: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("iy", "ix")) -> DataFrame:
    """Cells outside the axes, or none of whose weighted corners ever holds one of ``variables``, with a flag ``_dry_<variable>`` each."""
    corners = (sten.select(*keys, "lat", "lon", F.explode(F.array(*[
                   F.struct((F.col("bi") + c[0]).alias("lat_i"), (F.col("bj") + c[1]).alias("lon_i"),
                            F.col(f"w{n}").alias("w")) for n, c in enumerate(CORNERS)])).alias("_c"))
               .select(*keys, "lat", "lon", "_c.*"))
    flags = {v: f"_dry_{v}" for v in variables}
    absent = [~F.coalesce(F.max((F.col("w") > 0) & F.col(f"_has_{v}")), F.lit(False)) for v in variables]
    return (corners.join(nodes.drop("lat", "lon"), ["lat_i", "lon_i"], "left")
            .groupBy(*keys).agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), *[x.alias(c) for x, c in zip(absent, flags.values())])
            .filter(reduce(Column.__or__, map(F.col, flags.values()))))


def nearest_land(dry: DataFrame, land: DataFrame, keys: Sequence[str] = ("iy", "ix")) -> DataFrame:
    """Nearest land node per dry cell; longitudes shrink with the cosine of the cell latitude."""
    nodes = land.withColumns({"x": F.col("lon"), "y": F.col("lat"),
                              "node": F.struct("lat_i", "lon_i")})
    cells = dry.withColumns({"x": F.col("lon"), "y": F.col("lat"), "_cos": F.abs(F.cos(F.radians("lat")))})
    return knn(cells, nodes, 1, keys, "node", "x", "y", x_scale="_cos").select(*keys, "node.*")


def box_corners(coarse: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row per (hour, coarse box) with the four corner values of every variable."""
    spread = coarse.select("ts", *variables, F.explode(F.array(*[
        F.struct((F.col("lat_i") - c[0]).alias("bi"), (F.col("lon_i") - c[1]).alias("bj"), F.lit(n).alias("c"))
        for n, c in enumerate(CORNERS)])).alias("_b"), ).select("ts", *variables, "_b.*")
    return spread.groupBy("bi", "bj", "ts").agg(*[
        F.max(F.when(F.col("c") == n, F.col(v))).alias(f"{v}__{n}")
        for v in variables for n in range(len(CORNERS))])


def _weighted(v: str) -> Column:
    num, den = F.lit(0.0), F.lit(0.0)
    for n in range(len(CORNERS)):
        value, w = F.col(f"{v}__{n}"), F.col(f"w{n}")
        num = num + w * F.coalesce(value, F.lit(0.0))
        den = den + F.when(value.isNotNull(), w).otherwise(0.0)
    return F.when(den > 0, num / den)


def bilinear(coarse: DataFrame, cells: DataFrame, variables: Sequence[str],
             keys: Sequence[str] = ("iy", "ix"), ocean: str = "nearest") -> DataFrame:
    """``(keys, ts, variables)``: missing-aware bilinear values at the cell centres.

    ``cells``: keys, ``lat``, ``lon``. ``coarse``: ``ts, lat_i, lon_i, lat, lon, variables``. A variable that
    is missing at a cell at all hours, since the cell is outside the axes or none of its corners ever holds
    it, is copied from the nearest node that holds that variable at some hour, or stays missing with
    ``ocean='nan'``. Every cell keeps its rows either way.
    """
    if ocean not in ("nearest", "nan"):
        raise ValueError("ocean must be 'nearest' or 'nan'")
    sten, boxes = stencil(cells, coarse, keys), box_corners(coarse, variables)

    def weighted(cell_boxes: DataFrame) -> DataFrame:
        return (spread(cell_boxes).join(boxes, ["bi", "bj"])
                .select(*keys, "ts", *[_weighted(v).alias(v) for v in variables]))

    if ocean == "nan":
        return weighted(sten)
    nodes = node_presence(coarse, variables)
    classes = variable_classes(nodes, variables)
    some = dry_cells(sten, nodes, [c[0] for c in classes], keys)
    copied = []
    for own in classes:                                              # one search for all variables of a class
        land = nodes.filter(f"`_has_{own[0]}`").select("lat_i", "lon_i", "lat", "lon")
        found = nearest_land(some.filter(f"`_dry_{own[0]}`").select(*keys, "lat", "lon"), land, keys)
        copied.append(found.join(coarse.select("lat_i", "lon_i", "ts", *own), ["lat_i", "lon_i"])
                      .select(*keys, "ts", *[F.col(v) if v in own else F.lit(None).cast("double").alias(v) for v in variables]))
    wet = sten.join(some.select(*keys), list(keys), "left_anti")     # per cell, before the hours
    # of a cell that lacks a variable, each variable has a value in one of the parts only
    parts = reduce(DataFrame.unionByName, copied, weighted(sten.join(some.select(*keys), list(keys), "left_semi")))
    return weighted(wet).unionByName(parts.groupBy(*keys, "ts").agg(*[F.max(v).alias(v) for v in variables]))
