"""Scored and anchored fields, and fresh increments for a window outside the training period."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from finescale.functions.physics import cell_id, residual
from finescale.functions.time import in_window
from finescale.models.residual import score_grid
from finescale.operators.anchoring import anchor_gauss, anchor_idw, increments, output_triple, require_obs
from finescale.operators.tables import collapse_cells, exclude_stations, match_obs, to_cells
from finescale.plans.features import DYNAMIC, build_features, dynamic_features
from finescale.sources.inventory import axis_problems


MEMORY = timedelta(hours=6)          # what second differences over 3 hours look back


def score_field(dynamic: DataFrame, statics: DataFrame, features: list[str], model: PipelineModel,
                region: DataFrame | None = None, start: datetime | None = None,
                end: datetime | None = None) -> DataFrame:
    """Baseline plus predicted residual for the cells of ``region``.

    Region and window cut the rows before the features are built; the window keeps the hours before
    it that memory features look back to, and is cut exactly afterwards.
    """
    if region is not None:
        dynamic = dynamic.join(region.select("iy", "ix"), ["iy", "ix"], "left_semi")
    dynamic = dynamic.filter(in_window("ts", start and start - MEMORY, end))
    rows = build_features(dynamic, statics, features=[*features, "t2m_1km"]).filter(in_window("ts", start, end))
    return score_grid(rows, features, model)


def anchored_field(scored: DataFrame, cells: DataFrame, inc: DataFrame | None, stations: DataFrame | None = None,
                   lz_by_hour: DataFrame | None = None, **rule) -> DataFrame:
    """Field with its output triple; without increments the correction is zero. Raises when no increment is present at any hour."""
    if inc is None:
        return output_triple(scored)
    if lz_by_hour is not None:
        rule["lz_m"] = 0.0                       # the hourly table wins
    require_obs(inc)
    if rule.get("method") == "gauss":
        return anchor_gauss(scored, cells, stations, inc, lz_by_hour, **{k: v for k, v in rule.items() if k in ("length_km", "lz_m", "radius_km")})
    return anchor_idw(scored, cells, stations, inc, lz_by_hour, **{k: v for k, v in rule.items() if k in ("k", "power", "lz_m", "radius_km")})


def increments_out_of_training(scored: DataFrame, obs: DataFrame, station_cell: DataFrame, start: datetime,
                               end: datetime, excluded: DataFrame | None = None) -> DataFrame:
    """Increments of station cells for ``[start, end)`` from fresh observations.

    ``scored``: ``iy, ix, ts, t2m_1km, pred_residuo`` at the station cells, by a model that never saw the
    period. Observations of ``excluded`` stations do not anchor.
    """
    fresh = obs.filter(in_window("ts", start, end))
    if excluded is not None:
        fresh = exclude_stations(fresh, excluded)
    per_cell = collapse_cells(to_cells(fresh, station_cell))
    rows = match_obs(scored.filter(in_window("ts", start, end)), per_cell)
    rows = rows.withColumn("y_residuo", residual("temperatura_c_qc", "t2m_1km")).withColumn("cell_id", cell_id("iy", "ix"))
    return increments(rows)


def increments_from_raw(coarse: DataFrame, cells: DataFrame, statics: DataFrame, features: list[str], model: PipelineModel, obs: DataFrame,
                        station_cell: DataFrame, start: datetime, end: datetime, excluded: DataFrame | None = None,
                        hourly: bool = True) -> DataFrame:
    """Increments of station cells for ``[start, end)`` from coarse fields and fresh observations, by a model that never saw the period.

    Only the cells that hold a station are interpolated and scored. Coarse rows are read by whole months, from the one that memory
    features reach back to, so that fluxes restart where they do in training. ``hourly`` stops at a month of these whose hourly axis is
    not whole or that is absent. No match gives no rows, at which ``anchored_field`` stops.
    """
    first = (start - MEMORY).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    last = (end - timedelta(microseconds=1)).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    near = coarse.filter(in_window("ts", first, (last + timedelta(days=32)).replace(day=1)))
    if hourly:
        bad = axis_problems(near.select("ts").distinct(), span=(f"{first:%Y-%m-%d}", f"{last:%Y-%m-%d}")).limit(12).collect()
        if bad:
            raise ValueError("hourly axis not whole: " + ", ".join(f"{r['month']:%Y-%m} ({r['n']} of {r['expected']})" for r in bad))
    used = station_cell.select("iy", "ix").distinct()
    wanted = [f for f in DYNAMIC if f in features or f == "t2m_1km"]
    dynamic = dynamic_features(near, cells.join(used, ["iy", "ix"], "left_semi"), wanted)
    layers = statics.join(used, ["iy", "ix"], "left_semi")
    layers = layers.drop(*[c for c in dynamic.columns if c not in ("iy", "ix") and c in layers.columns])
    scored = score_field(dynamic, layers, features, model, start=start, end=end)
    return increments_out_of_training(scored, obs, station_cell, start, end, excluded)
