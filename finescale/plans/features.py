"""One feature builder for training and scoring, joined on the cell key."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finescale.functions import physics as P
from finescale.functions.time import encode_time
from finescale.operators.grid import expand_hours
from finescale.operators.interpolation import bilinear
from finescale.operators.series import deaccumulate, memory_features
from finescale.sources.readers import ACCUMULATED

# Feature names, in groups.
DYNAMIC = ("t2m_1km", "lapse", "u10", "v10", "vel_vento", "sp", "dep_orvalho", "umidade_relativa",
           "dt_ar_pele", "dt_ar_solo", "rad_liquida", "razao_bowen", "ssr", "str")
CELL_DYNAMIC = ("z_era5_orog", "delta_z")
RELIEF = ("slope_mean_1km", "slope_max_1km", "tri_mean_1km", "tri_std_1km", "tri_max_1km", "z_std_1km",
          "northness_mean_1km", "eastness_mean_1km", "svf_mean_1km", "svf_p10_1km", "mrvbf_p90_1km",
          "hand_mean_1km", "hand_p10_1km", "dev_r300_mean_1km", "dev_r300_p10_1km",
          "dev_r1000_mean_1km", "dev_r1000_p10_1km", "dev_r3000_mean_1km", "dev_r3000_p10_1km")
FRACTIONS = tuple(f"fracao_t{i}" for i in range(1, 9))
STATIC = (*RELIEF, "dist_oceano", *FRACTIONS, "z_alvo", "coord_x", "coord_y")
TIME = ("hora_sin", "hora_cos", "doy_sin", "doy_cos")
MEMORY = tuple(f"{d}_{h}h" for d in ("dt2m", "d2t2m") for h in (1, 2, 3))
FEATURES_57 = (*DYNAMIC, *CELL_DYNAMIC, *STATIC, *TIME, *MEMORY)
# The published subsets, each in full.
FEATURES_55 = (
    "t2m_1km", "lapse", "u10", "v10", "vel_vento", "sp", "dep_orvalho", "umidade_relativa", "dt_ar_pele", "dt_ar_solo",
    "rad_liquida", "razao_bowen", "ssr", "str", "delta_z", "slope_mean_1km", "slope_max_1km", "tri_mean_1km", "tri_std_1km",
    "tri_max_1km", "z_std_1km", "northness_mean_1km", "eastness_mean_1km", "svf_mean_1km", "svf_p10_1km", "mrvbf_p90_1km",
    "hand_mean_1km", "hand_p10_1km", "dev_r300_mean_1km", "dev_r300_p10_1km", "dev_r1000_mean_1km", "dev_r1000_p10_1km",
    "dev_r3000_mean_1km", "dev_r3000_p10_1km", "dist_oceano", "fracao_t1", "fracao_t3", "fracao_t4", "fracao_t5", "fracao_t6",
    "fracao_t7", "fracao_t8", "z_alvo", "coord_x", "coord_y", "hora_sin", "hora_cos", "doy_sin", "doy_cos", "dt2m_1h",
    "dt2m_2h", "dt2m_3h", "d2t2m_1h", "d2t2m_2h", "d2t2m_3h",
)
FEATURES_53 = (
    "t2m_1km", "lapse", "u10", "v10", "vel_vento", "sp", "dep_orvalho", "umidade_relativa", "dt_ar_pele", "dt_ar_solo",
    "rad_liquida", "razao_bowen", "delta_z", "slope_mean_1km", "slope_max_1km", "tri_mean_1km", "tri_std_1km", "tri_max_1km",
    "z_std_1km", "northness_mean_1km", "eastness_mean_1km", "svf_mean_1km", "svf_p10_1km", "mrvbf_p90_1km", "hand_mean_1km",
    "hand_p10_1km", "dev_r300_mean_1km", "dev_r300_p10_1km", "dev_r1000_mean_1km", "dev_r1000_p10_1km", "dev_r3000_mean_1km",
    "dev_r3000_p10_1km", "dist_oceano", "fracao_t1", "fracao_t3", "fracao_t4", "fracao_t5", "fracao_t6", "fracao_t7",
    "fracao_t8", "z_alvo", "coord_x", "coord_y", "hora_sin", "hora_cos", "doy_sin", "doy_cos", "dt2m_1h", "dt2m_2h",
    "dt2m_3h", "d2t2m_1h", "d2t2m_2h", "d2t2m_3h",
)
FEATURES_33 = (
    "lapse", "u10", "v10", "vel_vento", "sp", "dep_orvalho", "dt_ar_pele", "dt_ar_solo", "rad_liquida", "razao_bowen",
    "delta_z", "tri_mean_1km", "northness_mean_1km", "eastness_mean_1km", "mrvbf_p90_1km", "hand_mean_1km",
    "dev_r300_p10_1km", "dev_r1000_p10_1km", "dev_r3000_mean_1km", "dist_oceano", "fracao_t1", "fracao_t3", "fracao_t4",
    "fracao_t5", "fracao_t6", "fracao_t7", "fracao_t8", "z_alvo", "coord_y", "hora_sin", "hora_cos", "doy_sin", "doy_cos",
)
FEATURES_28 = (
    "lapse", "u10", "v10", "vel_vento", "sp", "dep_orvalho", "dt_ar_pele", "dt_ar_solo", "rad_liquida", "razao_bowen",
    "delta_z", "tri_mean_1km", "northness_mean_1km", "eastness_mean_1km", "mrvbf_p90_1km", "hand_mean_1km",
    "dev_r300_p10_1km", "dev_r1000_p10_1km", "dev_r3000_mean_1km", "dist_oceano", "fracao_t1", "fracao_t3", "fracao_t4",
    "fracao_t5", "fracao_t6", "fracao_t7", "fracao_t8", "z_alvo",
)
SETS = {"28": FEATURES_28, "33": FEATURES_33, "53": FEATURES_53, "55": FEATURES_55, "57": FEATURES_57}

# Raw coarse variables behind each dynamic feature.
RAW_NEEDS = {
    "t2m_1km": ("t2m",), "lapse": ("t2m",), "u10": ("u10",), "v10": ("v10",), "vel_vento": ("u10", "v10"),
    "sp": ("sp",), "dep_orvalho": ("t2m", "d2m"), "umidade_relativa": ("t2m", "d2m"),
    "dt_ar_pele": ("t2m", "skt"), "dt_ar_solo": ("t2m", "stl1"), "rad_liquida": ("ssr", "str"),
    "ssr": ("ssr",), "str": ("str",), "razao_bowen": ("sshf", "slhf"),
}


def feature_set(spec: str) -> list[str]:
    """A named set, a comma list, or ``@file`` (comma or line separated, ``#`` starts a comment)."""
    if spec in SETS:
        return list(SETS[spec])
    if spec.startswith("@"):
        lines = Path(spec[1:]).read_text().splitlines()
        spec = ",".join(line.partition("#")[0] for line in lines)
    return [name.strip() for name in spec.split(",") if name.strip()]


def select_features(df: DataFrame, spec: str, extra: Sequence[str] = ()) -> DataFrame:
    names = feature_set(spec)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"features missing from the matrix: {missing}")
    return df.select(*dict.fromkeys([*extra, *names]))


def raw_needed(features: Sequence[str]) -> list[str]:
    """Coarse variables to load; the baseline temperature always is."""
    need = {"t2m"}
    for f in features:
        need.update(RAW_NEEDS.get(f, ()))
    return sorted(need)


def dynamic_expressions(lapse_rate: float = P.DRY_LAPSE) -> dict[str, Column]:
    """Derived features from interpolated raw variables (Kelvin, Pa, W m-2) and ``delta_z``."""
    return {
        "t2m_1km": F.col("t2m"),
        "lapse": P.dry_lapse("t2m", "delta_z", lapse_rate),
        "u10": F.col("u10"), "v10": F.col("v10"),
        "vel_vento": P.wind_speed("u10", "v10"),
        "sp": P.to_hpa("sp"),
        "dep_orvalho": P.difference("t2m", "d2m"),
        "umidade_relativa": P.relative_humidity(P.to_celsius("t2m"), P.to_celsius("d2m")),
        "dt_ar_pele": P.difference("t2m", "skt"),
        "dt_ar_solo": P.difference("t2m", "stl1"),
        "rad_liquida": P.net_radiation("ssr", "str"),
        "razao_bowen": P.bowen_ratio("sshf", "slhf"),
        "ssr": F.col("ssr"), "str": F.col("str"),
    }


def derive(raw: DataFrame, features: Sequence[str] = DYNAMIC, lapse_rate: float = P.DRY_LAPSE,
           keep: Sequence[str] = ("iy", "ix", "ts")) -> DataFrame:
    exprs = dynamic_expressions(lapse_rate)
    names = dict.fromkeys(["t2m_1km", *[f for f in features if f in exprs]])
    return raw.select(*keep, *[exprs[n].alias(n) for n in names])


def dynamic_features(coarse: DataFrame, cells: DataFrame, features: Sequence[str] = DYNAMIC,
                     lapse_rate: float = P.DRY_LAPSE, ocean: str = "nearest",
                     reset: str = "month") -> DataFrame:
    """Hourly features at the cells: de-accumulate, interpolate, derive.

    ``cells``: ``iy, ix, lat, lon, z_alvo, z_era5_orog``. Only the raw variables the features need are
    read.
    """
    need = raw_needed(features)
    flux = [v for v in need if v in ACCUMULATED]
    base = coarse.select("ts", "lat_i", "lon_i", "lat", "lon", *need)
    if flux:
        base = deaccumulate(base, flux, ("lat_i", "lon_i"), "ts", reset)
    raw = bilinear(base, cells, need, ("iy", "ix"), ocean)
    heights = cells.select("iy", "ix", "z_era5_orog", P.delta_z("z_alvo", "z_era5_orog").alias("delta_z"))
    wide = raw.join(heights, ["iy", "ix"])
    extra = [c for c in CELL_DYNAMIC if c in features] or list(CELL_DYNAMIC)
    return derive(wide, features, lapse_rate, keep=["iy", "ix", "ts", *extra])


def static_features(layers: Sequence[DataFrame], grid: DataFrame) -> DataFrame:
    """Per-cell layers side by side, with elevation and centre coordinates of the grid."""
    out = grid.select("iy", "ix", "z_alvo", F.col("x").alias("coord_x"), F.col("y").alias("coord_y"))
    for layer in layers:
        fresh = [c for c in layer.columns if c in ("iy", "ix") or c not in out.columns]
        out = out.join(layer.select(*fresh), ["iy", "ix"], "left")
    return out.drop("fracao_observada")


def build_features(dynamic: DataFrame, statics: DataFrame, month_local: bool = False,
                   features: Sequence[str] | None = None) -> DataFrame:
    """Full feature rows (cell, hour) from dynamic and static parts: the one builder for all uses.

    Memory features are formed on the dynamic table (one row per cell-hour), before the statics
    widen the rows, so the only shuffle carries few columns.
    """
    want = features or FEATURES_57
    out = dynamic
    if any(f in MEMORY for f in want):
        out = memory_features(out, "t2m_1km", ("iy", "ix"), "ts", month_local=month_local)
    out = out.withColumns({n: c for n, c in encode_time("ts").items() if n in want})
    return out.join(statics, ["iy", "ix"], "left").withColumn("cell_id", P.cell_id("iy", "ix"))


def scoring_rows(cells: DataFrame, hours: DataFrame, dynamic: DataFrame, statics: DataFrame) -> DataFrame:
    """Feature rows for every cell at every hour asked for, missing where the fields are."""
    have = build_features(dynamic, statics).drop("cell_id")
    return (expand_hours(cells.select("iy", "ix"), hours).join(have, ["iy", "ix", "ts"], "left")
            .withColumn("cell_id", P.cell_id("iy", "ix")))
