"""Column expressions for unit handling, moisture, wind, flux and terrain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Fixed values shared with the published method.
KELVIN = 273.15
DRY_LAPSE = 0.0065            # K per metre
MAGNUS_A, MAGNUS_B, MAGNUS_C = 6.112, 17.67, 243.5
BOWEN_MIN_LATENT = 1.0        # W m-2
FLAT_SLOPE_DEG = 0.5
VALID_FLAGS = (4, 5)
T_MIN, T_MAX = -15.0, 45.0


def _c(col: ColumnLike) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_number(col: ColumnLike) -> Column:
    """Cast to DOUBLE; text that is not a number, and NaN, become NULL."""
    number = _c(col).try_cast("double")
    return F.when(~F.isnan(number), number)


def nan_to_null(col: ColumnLike) -> Column:
    """Missing is NULL everywhere in this package; call once at the source."""
    return F.when(~F.isnan(_c(col)), _c(col))


def keep_flags(value: ColumnLike, flag: ColumnLike, flags: Sequence[int] = VALID_FLAGS) -> Column:
    """``value`` where the provider flag is whitelisted, else NULL."""
    return F.when(to_number(flag).isin([float(f) for f in flags]), _c(value))


def in_range(value: ColumnLike, low: float = T_MIN, high: float = T_MAX) -> Column:
    """``value`` inside the closed physical range, else NULL."""
    return F.when(_c(value).between(low, high), _c(value))


def wind_speed(u: ColumnLike, v: ColumnLike) -> Column:
    return F.sqrt(_c(u) * _c(u) + _c(v) * _c(v))


def dry_lapse(t: ColumnLike, dz: ColumnLike, rate: float = DRY_LAPSE) -> Column:
    return _c(t) - F.lit(rate) * _c(dz)


def _saturation(t: Column) -> Column:
    return F.lit(MAGNUS_A) * F.exp(F.try_divide(F.lit(MAGNUS_B) * t, t + F.lit(MAGNUS_C)))


def relative_humidity(t_c: ColumnLike, td_c: ColumnLike) -> Column:
    """Percent, from temperature and dewpoint in Celsius; supersaturation is not clipped. Missing where the saturation pressure has no
    value in double precision or is zero there (the formula ends near -243.5)."""
    return F.try_divide(F.lit(100.0) * _saturation(_c(td_c)), _saturation(_c(t_c)))


def difference(a: ColumnLike, b: ColumnLike) -> Column:
    return _c(a) - _c(b)


def net_radiation(shortwave: ColumnLike, longwave: ColumnLike) -> Column:
    return _c(shortwave) + _c(longwave)


def bowen_ratio(sensible: ColumnLike, latent: ColumnLike) -> Column:
    """Sensible over latent heat; NULL when the latent flux is too small to divide by."""
    return F.when(F.abs(_c(latent)) >= BOWEN_MIN_LATENT, _c(sensible) / _c(latent))


def to_hpa(pressure_pa: ColumnLike) -> Column:
    return _c(pressure_pa) / 100.0


def delta_z(z: ColumnLike, z_orog: ColumnLike) -> Column:
    return _c(z) - _c(z_orog)


def to_celsius(t_k: ColumnLike) -> Column:
    return _c(t_k) - F.lit(KELVIN)


def residual(t_obs_c: ColumnLike, t2m_k: ColumnLike) -> Column:
    """Target: observed minus interpolated baseline, both in Celsius."""
    return _c(t_obs_c) - to_celsius(t2m_k)


def northness(aspect_deg: ColumnLike, slope_deg: ColumnLike, land: ColumnLike) -> Column:
    return _aspect_component(F.cos, aspect_deg, slope_deg, land)


def eastness(aspect_deg: ColumnLike, slope_deg: ColumnLike, land: ColumnLike) -> Column:
    return _aspect_component(F.sin, aspect_deg, slope_deg, land)


def _aspect_component(fn, aspect_deg, slope_deg, land) -> Column:
    flat = F.coalesce(_c(slope_deg) < FLAT_SLOPE_DEG, F.lit(False))
    return F.when(_c(land), F.when(flat, F.lit(0.0)).otherwise(fn(F.radians(_c(aspect_deg)))))


def bin_right_closed(col: ColumnLike, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edge, next edge]`` holding the value; NULL outside."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    value, out = _c(col), None
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        hit = (value > low) & (value <= high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


# Stratum edges and labels.
ELEVATION_EDGES = (-1.0, 200.0, 500.0, 1000.0, 2000.0)
ELEVATION_LABELS = ("0-200", "200-500", "500-1000", ">1000")
COAST_EDGES_KM = (-1.0, 10.0, 50.0, 150.0, 1000.0)
COAST_LABELS = ("0-10km", "10-50km", "50-150km", ">150km")


def elevation_band(z: ColumnLike) -> Column:
    return bin_right_closed(z, ELEVATION_EDGES, ELEVATION_LABELS)


def coast_band(distance_m: ColumnLike) -> Column:
    return bin_right_closed(_c(distance_m) / 1000.0, COAST_EDGES_KM, COAST_LABELS)


def route(t: ColumnLike, t_low: ColumnLike | float, t_high: ColumnLike | float,
          cold: ColumnLike, middle: ColumnLike, hot: ColumnLike) -> Column:
    """Pick one of three branch predictions by the baseline temperature (hard cut)."""
    lo = F.lit(t_low) if isinstance(t_low, (int, float)) else _c(t_low)
    hi = F.lit(t_high) if isinstance(t_high, (int, float)) else _c(t_high)
    return F.when(_c(t) <= lo, _c(cold)).when(_c(t) > hi, _c(hot)).otherwise(_c(middle))


def cell_id(iy: ColumnLike, ix: ColumnLike) -> Column:
    return F.concat_ws("_", _c(iy), _c(ix))


def parse_cell(cell: ColumnLike) -> tuple[Column, Column]:
    """(iy, ix) as INT from the text key ``iy_ix``."""
    parts = F.split(_c(cell), "_")
    return parts[0].cast("int"), parts[1].cast("int")


def inside_grid(iy: ColumnLike, ix: ColumnLike, ny: int, nx: int) -> Column:
    return _c(iy).between(0, ny - 1) & _c(ix).between(0, nx - 1)


def flat_index(iy: ColumnLike, ix: ColumnLike, nx: int) -> Column:
    return _c(iy).cast("bigint") * nx + _c(ix)


def wrap_longitude(lon: ColumnLike) -> Column:
    """0..360 to -180..180."""
    return F.pmod(_c(lon) + 180.0, F.lit(360.0)) - 180.0
