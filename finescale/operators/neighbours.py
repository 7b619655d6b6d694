"""Nearest-station joins on tiles: equi-joins only, exact for any density and extent.

A uniform tile size is too fine for empty country and too coarse for a dense city, so tiles exist on halving sizes, from one tile
that holds all stations down to the size at which no tile holds more than are asked for. Every target uses the finest level whose 3x3
block of tiles already holds ``k`` stations: the k-th neighbour is then at most 2*sqrt(2) tile edges away, so the 7x7 block around the
target is sure to contain the answer. Levels coarser than the finest one with at most ``TOP`` occupied tiles are not searched: targets that no
finer level serves lie far from the stations, and ask the tiles of that table that can hold an answer by their distances.

Sides whose rows an explode has multiplied are joined by merge: size estimates see the rows before it, and would broadcast them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finescale.functions.physics import ColumnLike, _c
from finescale.session import kept, spread

REACH = 2 * math.sqrt(2)
TOP = 16_384                    # occupied tiles of the coarsest level searched: the one table of tiles that the driver reads
SHARE = 4096                    # targets of a tile that meet its array of stations in one group
FINEST = 40                     # halvings after which tiles stop: what is still together lies within 1e-12 of the extent


def _tile(x: Column, size: Column | float) -> Column:
    return F.floor(x / size).cast("bigint")


def _block(tx: str, ty: str, rx: int, ry: int) -> Column:
    """Array of the tiles within ``rx`` columns and ``ry`` rows; ``tx, ty`` are SQL text."""
    return F.expr(f"flatten(transform(sequence(-{rx}, {rx}), i -> transform(sequence(-{ry}, {ry}), "
                  f"j -> named_struct('tx', {tx} + i, 'ty', {ty} + j))))")


def _tile_text(x: str, size: str | float) -> str:
    return f"CAST(floor({x} / {size}) AS BIGINT)"


def _without_self(pairs: DataFrame, exclude_self: Sequence[tuple[str, str]]) -> DataFrame:
    if not exclude_self:
        return pairs
    same = F.lit(True)
    for a, b in exclude_self:
        same = same & (F.col("_t_" + a) == F.col("_s_" + b))
    return pairs.filter(~same)


def _extent(st: DataFrame) -> tuple[float, float, float, float, float]:
    """Origin and edge of the square tile that holds all stations, and their last coordinates."""
    x0, x1, y0, y1 = st.agg(F.min("_sx"), F.max("_sx"), F.min("_sy"), F.max("_sy")).first()
    if x0 is None:
        return 0.0, 0.0, 1.0, 0.0, 0.0
    # an edge a little larger than the extent, so that the last station is inside; a unit tile for a single place
    return x0, y0, max(x1 - x0, y1 - y0) * (1 + 1e-9) + math.ulp(max(abs(v) for v in (x0, x1, y0, y1))) * 8 or 1.0, x1, y1


def _levels(st: DataFrame, x0: float, y0: float, edge: float, need: int) -> tuple[int, int]:
    """Halvings until the fullest tile holds ``need`` stations or fewer, or does not get emptier any more, and the finest level up to that
    on which ``TOP`` tiles or fewer hold stations. The driver reads one row per level."""
    size = f"({edge!r}D * power(2D, -level))"
    tiled = (st.withColumn("level", F.expr(f"explode(sequence(0, {FINEST}))"))
             .groupBy("level", F.expr(_tile_text(f"(_sx - {x0!r}D)", size)).alias("tx"), F.expr(_tile_text(f"(_sy - {y0!r}D)", size)).alias("ty"))
             .agg(F.count("*").alias("n")).groupBy("level").agg(F.max("n").alias("n"), F.count("*").alias("tiles")))
    rows = tiled.orderBy("level").collect()
    least = max(need, rows[-1]["n"]) if rows else 0
    finest = next((k for k, r in enumerate(rows) if r["n"] <= least), 0)
    return finest, max((k for k, r in enumerate(rows[:finest + 1]) if r["tiles"] <= TOP), default=0)


def reachable(boxes: np.ndarray, held: np.ndarray, count: np.ndarray, low: float, high: float, need: int) -> np.ndarray:
    """Places of the ``boxes`` (rows of ``x0, x1, y0, y1``) that can hold one of the ``need`` nearest points of some point of the box
    ``held``: no farther from it than the distance within which boxes with ``need`` points lie whole. x shrinks by ``low`` to ``high``."""
    ax, bx, ay, by = boxes.T
    x0, x1, y0, y1 = held
    most = np.hypot(high * np.maximum(np.abs(bx - x0), np.abs(x1 - ax)), np.maximum(np.abs(by - y0), np.abs(y1 - ay)))
    least = np.hypot(low * np.maximum(0.0, np.maximum(ax - x1, x0 - bx)), np.maximum(0.0, np.maximum(ay - y1, y0 - by)))
    order = np.argsort(most)
    enough = np.searchsorted(np.cumsum(count[order]), need)
    return np.flatnonzero(least <= most[order[enough]] * (1 + 1e-9)) if enough < len(order) else np.arange(len(count))


def _far_tiles(groups: DataFrame, top: Sequence[tuple], need: int, level: int) -> DataFrame:
    """Tiles that groups of targets far from the stations ask: ``top`` is the table of at most ``TOP`` tiles of ``level``."""
    table = np.array(top, float).reshape(-1, 7)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                at = reachable(table[:, 3:], np.array([r.bx0, r.bx1, r.by0, r.by1]), table[:, 2], r.low, r.high, need)
                yield pd.DataFrame({"level": -1, "gx": r.gx, "gy": r.gy, "parts": r.parts, "at": level,
                                    "tx": table[at, 0].astype(int), "ty": table[at, 1].astype(int)})

    return groups.mapInPandas(ask, "level INT, gx BIGINT, gy BIGINT, parts INT, at INT, tx BIGINT, ty BIGINT")


def knn_lists(targets: DataFrame, stations: DataFrame, k: int, target_keys: Sequence[str] = ("iy", "ix"),
              station: str = "station", x: str = "x", y: str = "y", exclude_self: Sequence[tuple[str, str]] = (),
              x_scale: ColumnLike | None = None, carry: Sequence[str] = (), station_carry: Sequence[str] = ()) -> DataFrame:
    """``(target_keys, carry, _near)``: one row per target with its ``k`` nearest stations in order, structs of ``d``, the station and
    its ``station_carry``. See ``knn`` for the rest.

    Targets of a tile ask the same stations, so these are gathered once per tile, as one array that meets the tile's targets; no
    row per pair is made, sorted or shuffled.
    """
    spark = targets.sparkSession
    scale = F.lit(1.0) if x_scale is None else _c(x_scale)
    need = k + (1 if exclude_self else 0)
    st = stations.select(F.col(station).alias("_id"), F.col(x).alias("_sx"), F.col(y).alias("_sy"),
                         *[F.col(b).alias("_s_" + b) for _, b in exclude_self], *[F.col(c).alias("_v_" + c) for c in station_carry]).filter(
        F.col("_sx").isNotNull() & F.col("_sy").isNotNull())
    x0, y0, edge, x1, y1 = _extent(st)
    finest, coarse = _levels(st, x0, y0, edge, need)
    size = f"({edge!r}D * power(2D, -level))"

    def tile(name: str, origin: float, at: str = size) -> str:
        return _tile_text(f"({name} - {origin!r}D)", at)

    leveled = (st.withColumn("level", F.expr(f"explode(sequence({coarse}, {finest}))"))
               .withColumns({"tx": F.expr(tile("_sx", x0)), "ty": F.expr(tile("_sy", y0))}))
    # stations per tile, spread over the 3x3 block it serves; counted before the spread
    counts = leveled.groupBy("level", "tx", "ty").agg(F.count("*").alias("n"))
    served = (counts.select("level", "n", F.explode(_block("tx", "ty", 1, 1)).alias("_t"))
              .groupBy("level", "_t.tx", "_t.ty").agg(F.sum("n").alias("n"))
              .filter(F.col("n") >= need).select("level", "tx", "ty"))

    least = f"({edge!r}D * power(2D, -{finest}))"
    tg = targets.withColumns({"_x": F.col(x), "_y": F.col(y), "_scale": scale,
                              "_fx": F.expr(tile(f"`{x}`", x0, least)), "_fy": F.expr(tile(f"`{y}`", y0, least))})
    tg = tg.select(*target_keys, *[c for c in carry if c not in target_keys], *[F.col(a).alias("_t_" + a) for a, _ in exclude_self],
                   "_x", "_y", "_scale", "_fx", "_fy").filter(
        F.col("_x").isNotNull() & F.col("_y").isNotNull())
    # tiles of the finest level that hold targets, with their level: the finest that serves them, or -1
    fine = tg.groupBy("_fx", "_fy").agg(F.count("*").alias("n"), F.min("_scale").alias("low"), F.max("_scale").alias("high"), F.min("_x").alias("bx0"),
                                        F.max("_x").alias("bx1"), F.min("_y").alias("by0"), F.max("_y").alias("by1"))
    coarser = "CAST(floor({0} / power(2D, " + str(finest) + " - {1})) AS BIGINT)"
    level_of = (fine.select("_fx", "_fy").withColumn("level", F.expr(f"explode(sequence({coarse}, {finest}))"))
                .withColumns({"tx": F.expr(coarser.format("_fx", "level")), "ty": F.expr(coarser.format("_fy", "level"))})
                .join(served.hint("merge"), ["level", "tx", "ty"])
                .groupBy("_fx", "_fy").agg(F.max("level").alias("level")))
    held = f"CASE WHEN level < 0 THEN {coarse} ELSE level END"
    group = Window.partitionBy("level", "gx", "gy")
    tiles = kept(fine.join(level_of, ["_fx", "_fy"], "left").withColumn("level", F.coalesce("level", F.lit(-1)))
                 .withColumns({"gx": F.expr(coarser.format("_fx", f"({held})")), "gy": F.expr(coarser.format("_fy", f"({held})"))})
                 .withColumn("parts", F.ceil(F.sum("n").over(group) / SHARE).cast("int")), "tiles")
    groups = tiles.groupBy("level", "gx", "gy", "parts").agg(*[f(c).alias(c) for c, f in (
        ("low", F.min), ("high", F.max), ("bx0", F.min), ("bx1", F.max), ("by0", F.min), ("by1", F.max))])

    # tiles within reach that can hold a station
    wide = f"CAST(least(ceil({REACH} / greatest(low, 1e-9) + 1e-6), power(2D, level)) AS BIGINT)"

    def within(name: str, origin: float, end: float, reach: str) -> str:
        low, high = f"greatest(0L, {name} - ({reach}))", f"least({tile(f'{end!r}D', origin)}, {name} + ({reach}))"
        return f"CASE WHEN {low} <= {high} THEN sequence({low}, {high}) ELSE array() END"

    asked = (groups.filter("level >= 0").withColumn("tx", F.explode(F.expr(within("gx", x0, x1, wide))))
             .withColumn("ty", F.explode(F.expr(within("gy", y0, y1, str(math.ceil(REACH)))))).withColumn("at", F.col("level"))
             .select("level", "gx", "gy", "parts", "at", "tx", "ty"))
    far = groups.filter("level < 0")
    if not far.isEmpty():
        top = (leveled.filter(F.col("level") == coarse).groupBy("tx", "ty")
               .agg(F.count("*"), F.min("_sx"), F.max("_sx"), F.min("_sy"), F.max("_sy")).collect())        # TOP rows at most
        asked = asked.union(_far_tiles(far, top, need, coarse))
    held_there = leveled.withColumnRenamed("level", "at")
    candidates = (asked.join(held_there.hint("merge"), ["at", "tx", "ty"]).groupBy("level", "gx", "gy", "parts")
                  .agg(F.collect_list(F.struct(*st.columns)).alias("_c")).withColumn("_part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts"))
    place = ["level", "gx", "gy", "_part"]
    dealt = (tg.join(tiles.select("_fx", "_fy", "level", "gx", "gy", "parts"), ["_fx", "_fy"])
             .withColumn("_part", F.pmod(F.xxhash64("_x", "_y"), F.col("parts")).cast("int")).drop("_fx", "_fy", "parts")
             .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *place))
    met = dealt.join(candidates.hint("merge"), place)
    # k stations lie within that reach for certain: what is farther cannot be among the nearest
    met = met.withColumn("_far", F.when(F.col("level") >= 0, REACH * F.expr(size) * (1 + 1e-9)))

    def measured(c: Column) -> Column:
        dx, dy = (c["_sx"] - F.col("_x")) * F.col("_scale"), c["_sy"] - F.col("_y")
        same = [F.col("_t_" + a) == c["_s_" + b] for a, b in exclude_self]
        other = ~reduce(Column.__and__, same) if same else F.lit(True)
        return F.struct(F.when(other, F.sqrt(dx * dx + dy * dy)).alias("d"), c["_id"].alias(station), *[c["_v_" + v].alias(v) for v in station_carry])

    inside = lambda e: e["d"].isNotNull() & (F.col("_far").isNull() | (e["d"] <= F.col("_far")))
    near = F.slice(F.array_sort(F.filter(F.transform("_c", measured), inside)), 1, k)
    return met.select(*target_keys, *[c for c in carry if c not in target_keys], near.alias("_near"))


def knn(targets: DataFrame, stations: DataFrame, k: int, target_keys: Sequence[str] = ("iy", "ix"),
        station: str = "station", x: str = "x", y: str = "y",
        exclude_self: Sequence[tuple[str, str]] = (), x_scale: ColumnLike | None = None) -> DataFrame:
    """``(target_keys, station, d, rank)`` of the ``k`` nearest stations, ties by station id.

    ``x, y`` share one unit and so does ``d``. ``exclude_self`` lists (target column, station column)
    pairs that must not all be equal (leave-one-out). ``x_scale``, from 0 to 1, shrinks x differences
    per target (cosine of latitude on a lon/lat grid). Fewer than ``k`` stations overall give as many
    as there are. Extent and density of the stations and the targets' tiles are read first (small jobs).
    """
    lists = knn_lists(targets, stations, k, target_keys, station, x, y, exclude_self, x_scale)
    return (lists.select(*target_keys, F.posexplode("_near").alias("_rank", "_e"))
            .select(*target_keys, F.col(f"_e.`{station}`").alias(station), F.col("_e.d").alias("d"), (F.col("_rank") + 1).alias("rank")))


def within_radius(targets: DataFrame, stations: DataFrame, radius: float,
                  target_keys: Sequence[str] = ("iy", "ix"), station: str = "station",
                  x: str = "x", y: str = "y",
                  exclude_self: Sequence[tuple[str, str]] = (), parts: int = 4) -> DataFrame:
    """``(target_keys, station, d)`` of every pair at most ``radius`` apart.

    Tiles are ``radius / parts`` wide and each station is dealt to all tiles it reaches, so that the
    targets of one tile are few and stay where they are.
    """
    edge = float(radius) / parts
    st = stations.select(F.col(station), F.col(x).alias("_sx"), F.col(y).alias("_sy"),
                         *[F.col(b).alias("_s_" + b) for _, b in exclude_self])
    reach = parts + 1                       # one more, so that rounding of tiles cannot lose a pair
    st = spread(st).select("*", F.explode(_block(_tile_text("_sx", edge), _tile_text("_sy", edge), reach, reach)).alias("_t")
                           ).select("*", "_t.tx", "_t.ty").drop("_t")
    tg = targets.select(*target_keys, *[F.col(a).alias("_t_" + a) for a, _ in exclude_self],
                        F.col(x).alias("_x"), F.col(y).alias("_y")).withColumns(
        {"tx": F.expr(_tile_text("_x", edge)), "ty": F.expr(_tile_text("_y", edge))})
    dx, dy = F.col("_sx") - F.col("_x"), F.col("_sy") - F.col("_y")
    pairs = tg.join(st.hint("merge"), ["tx", "ty"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).filter(F.col("d") <= radius)
    pairs = _without_self(pairs, exclude_self)
    return pairs.select(*target_keys, station, "d")


def rank_neighbours(pairs: DataFrame, k: int, target_keys: Sequence[str] = ("iy", "ix"),
                    station: str = "station", d: str = "d") -> DataFrame:
    """Keep the ``k`` nearest of given pairs; ties by station id (top-k before the shuffle)."""
    w = Window.partitionBy(*target_keys).orderBy(d, station)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_distance(targets: DataFrame, points: DataFrame, target_keys: Sequence[str] = ("iy", "ix"),
                     point: str = "vertex", x: str = "x", y: str = "y") -> DataFrame:
    """Distance to the nearest of many points (coast vertices) per target."""
    return (knn(targets, points, 1, target_keys, point, x, y)
            .select(*target_keys, F.col("d").alias("dist_oceano")))
