"""Column functions of slope stability: safety factors, suction, critical saturation, hazard classes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Unit weight of water (kN/m3), radar wavelength (m); below, the sites' soil and retention curve.
WATER_WEIGHT = 9.81
WAVELENGTH_M = 0.055465763


@dataclass(frozen=True)
class Soil:
    """Cohesion dry and wet (kPa), friction angle (degrees), unit weight (kN/m3), depth (m)."""

    cohesion_dry: float = 18.5
    cohesion_wet: float = 5.0
    phi: float = 36.0
    gamma: float = 19.0
    depth: float = 3.0


@dataclass(frozen=True)
class Suction:
    """Parameters of the retention curve: alpha (1/kPa) and n."""

    alpha: float = 0.204
    n: float = 1.41


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, low: float, high: float) -> Column:
    """`x` within limits; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def los_displacement(phase: Column) -> Column:
    """Displacement along the line of sight (m) of an unwrapped phase (rad)."""
    return -phase * F.lit(WAVELENGTH_M / (4 * math.pi))


def coherence_masked(value: Column, coherence: Column, least: float = 0.4) -> Column:
    """`value` where coherence is known and high enough."""
    return F.when(coherence >= least, value)


def plausible(value: Column, low: float = -100.0, high: float = 9000.0) -> Column:
    """`value` within physical limits, else null."""
    return F.when(value.between(low, high), value)


def deramped(value: Column, row: Column, col: Column, a: Column, b: Column, c: Column) -> Column:
    """`value` less the plane a col + b row + c."""
    return value - (a * col + b * row + c)


def factor_of_safety(slope_deg: Column, cohesion: Column | float, saturation: Column | float, soil: Soil) -> Column:
    """Infinite-slope safety factor, from 0 to 5; 5 on ground flatter than two degrees."""
    s, m = F.radians(slope_deg), _c(saturation)
    top = _c(cohesion) + (F.lit(soil.gamma) - m * WATER_WEIGHT) * soil.depth * F.cos(s) * F.cos(s) * F.tan(F.radians(F.lit(soil.phi)))
    bottom = F.lit(soil.gamma * soil.depth) * F.sin(s) * F.cos(s)
    return F.when(slope_deg < 2.0, F.lit(5.0)).when(bottom > 1e-6, clip(top / bottom, 0, 5))


def saturation_field(m: Column | float, twi: Column, twi_mean: Column, kappa: float) -> Column:
    """Local saturation for a mean wetness, moved by the wetness index."""
    m = _c(m)
    return m if not kappa else F.coalesce(clip(m + kappa * (twi - twi_mean), 0, 1), m)


def suction_kpa(m: Column, suction: Suction) -> Column:
    """Matric suction at an effective saturation between 0 and 1."""
    mv = 1.0 - 1.0 / suction.n
    return F.pow(F.pow(m, F.lit(-1.0 / mv)) - 1.0, F.lit(1.0 / suction.n)) / suction.alpha


def cohesion(m: Column | float, soil: Soil, suction: Suction) -> Column:
    """Cohesion at a saturation; dry at 0 and below, wet at 1 and above."""
    m, span = _c(m), soil.cohesion_dry - soil.cohesion_wet
    inside = F.least(F.lit(span), suction_kpa(m, suction) * m * math.tan(math.radians(soil.phi)))
    return F.lit(soil.cohesion_wet) + F.when(m <= 0, F.lit(span)).when(m >= 1, F.lit(0.0)).otherwise(inside)


def cohesion_correction(m: Column | float, soil: Soil, suction: Suction) -> Column:
    """By how much the cohesion differs from a straight line between dry and wet."""
    m = _c(m)
    return cohesion(m, soil, suction) - ((1.0 - m) * soil.cohesion_dry + m * soil.cohesion_wet)


def cohesion_sensitivity(slope_deg: Column | float, soil: Soil) -> Column:
    """Change of the safety factor with cohesion; 0 on ground flatter than two degrees or of unknown slope."""
    slope_deg = _c(slope_deg)
    bottom = F.lit(soil.gamma * soil.depth) * F.sin(F.radians(slope_deg)) * F.cos(F.radians(slope_deg))
    return F.when((bottom > 1e-6) & (slope_deg >= 2.0), 1.0 / bottom).otherwise(F.lit(0.0))


def safety_at(m: Column | float, fs_dry: Column, fs_sat: Column, slope_deg: Column | None = None, soil: Soil | None = None, suction: Suction | None = None) -> Column:
    """Safety factor at a saturation; with suction also the cohesion's curve, and limits of 0 and 5."""
    m = _c(m)
    linear = (1.0 - m) * fs_dry + m * fs_sat
    if suction is None:
        return linear
    return clip(linear + cohesion_correction(m, soil, suction) * cohesion_sensitivity(slope_deg, soil), 0, 5)


def critical_saturation(fs_dry: Column, fs_sat: Column) -> Column:
    """Saturation at which the safety factor falls to 1; null where saturation does not lower it."""
    return F.when(fs_sat - fs_dry < 0, clip((1.0 - fs_dry) / (fs_sat - fs_dry), 0, 1))


def critical_saturation_suction(fs_dry: Column, fs_sat: Column, slope_deg: Column, soil: Soil, suction: Suction, points: int = 1024) -> Column:
    """As critical_saturation, with suction: the first of evenly spaced points below 1, interpolated.

    The curve of the cohesion is made once; rows meet it in Arrow batches (as lambdas over
    the points it takes some fifty times as long).
    """
    m = np.linspace(0.0, 1.0, points)
    mv, span = 1.0 - 1.0 / suction.n, soil.cohesion_dry - soil.cohesion_wet
    with np.errstate(all="ignore"):
        inside = np.minimum(span, (m ** (-1.0 / mv) - 1.0) ** (1.0 / suction.n) / suction.alpha * m * np.tan(np.radians(soil.phi)))
    c = soil.cohesion_wet + np.where(m <= 0, span, np.where(m >= 1, 0.0, inside))
    correction = c - ((1.0 - m) * soil.cohesion_dry + m * soil.cohesion_wet)

    @pandas_udf(DoubleType())
    def scan(dry: pd.Series, sat: pd.Series, k: pd.Series) -> pd.Series:
        d, s, kk = (x.to_numpy(float)[:, None] for x in (dry, sat, k))
        out = np.empty(len(dry), object)
        for at in range(0, len(dry), 1024):
            part = slice(at, at + 1024)
            fs = (1.0 - m) * d[part] + m * s[part] + correction * kk[part]
            low = fs < 1.0
            i = low.argmax(axis=1)
            rows = np.arange(len(fs))
            f1, f0 = fs[rows, i], fs[rows, np.maximum(i - 1, 0)]
            with np.errstate(all="ignore"):
                t = np.where(f1 != f0, (1.0 - f0) / (f1 - f0), 0.0)
            met = np.where(low.any(axis=1), np.where(i == 0, 0.0, np.clip((i - 1 + t) / (points - 1), 0, 1)), 1.0)
            out[part] = np.where(s[part, 0] < d[part, 0], met, None)
        return pd.Series(out, dtype="object")

    k = F.coalesce(cohesion_sensitivity(F.coalesce(slope_deg, F.lit(0.0)), soil), F.lit(0.0))
    return scan(fs_dry, fs_sat, k)


def effective_critical_saturation(mstar: Column, twi: Column, twi_mean: Column, kappa: float) -> Column:
    """Mean wetness at which a place reaches its critical saturation."""
    return mstar if not kappa else F.coalesce(clip(mstar - kappa * (twi - twi_mean), 0, 1), mstar)


def creeping(velocity: Column, threshold: float = -15.0) -> Column:
    return F.coalesce(velocity < threshold, F.lit(False))


def unstable(fs: Column, threshold: float = 1.0) -> Column:
    return F.coalesce(fs < threshold, F.lit(False))


def hazard_class(fs: Column, velocity: Column, fail: float = 1.0, marginal: float = 1.3, creep: float = -15.0) -> Column:
    """2 unstable and creeping, 1 marginal or creeping, 0 where the safety factor is known, else null."""
    moving = creeping(velocity, creep)
    return F.when(unstable(fs, fail) & moving, 2).when(unstable(fs, marginal) | moving, 1).when(fs.isNotNull(), 0)


def severity(mean_velocity: Column, mean_fs: Column, velocity: float = -50.0, fs: float = 0.7) -> Column:
    return F.when((mean_velocity <= velocity) | (mean_fs <= fs), "CRITICAL").otherwise("HIGH")


def banded(value: Column, bands: list[tuple[float, str]], below: bool = False) -> Column:
    """The name of the first band that `value` reaches (or, with `below`, stays under); the last one otherwise."""
    out = None
    for cut, name in bands:
        hit = value < cut if below else value >= cut
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(value.isNotNull(), out.otherwise(bands[-1][1]))


def slope_velocity(v_los: Column, c: Column, slope_deg: Column, least_c: float = 0.3, least_slope: float = 10.0) -> Column:
    """Velocity along the slope where the line of sight sees it well enough."""
    return F.when((F.abs(c) >= least_c) & (slope_deg >= least_slope), v_los / c)


def los_unit(theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    """East, north and up of the unit vector towards the satellite."""
    return F.cos(theta) * F.cos(phi), F.cos(theta) * F.sin(phi), F.sin(theta)


def downslope_unit(dz_drow: Column, dz_dcol: Column) -> tuple[Column, Column, Column]:
    """East, north and up of the unit vector down the slope; rows run southward."""
    e, n = dz_dcol, -dz_drow
    g = F.hypot(e, n)
    s = F.atan(g)
    across = lambda x: F.when(g > 0, F.cos(s) * -x / g).otherwise(F.when(g.isNotNull(), F.lit(0.0)))
    return across(e), across(n), -F.sin(s)


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def ndvi(nir: Column, red: Column) -> Column:
    return F.try_divide(nir - red, nir + red)


def clear_pixel(scene_class: Column) -> Column:
    """Whether a scene classification is neither shadow, cloud nor snow."""
    return ~scene_class.isin(3, 8, 9, 10, 11)


def slant_delay_mm(zenith_delay_m: Column, incidence_elevation: Column) -> Column:
    """Delay along the line of sight of a zenith delay (mm)."""
    return F.try_divide(zenith_delay_m, F.sin(incidence_elevation)) * 1000.0
