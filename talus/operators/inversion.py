"""Operators on displacement networks: plane fits, inversion to time series, trends, failure times."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.physics import WAVELENGTH_M


def fit_planes(pixels: DataFrame, by: list[str], value: str, least: int = 100) -> DataFrame:
    """a, b, c of the plane a col + b row + c through the values, from nine sums; zero for too few pixels."""
    x, y, z = F.col("col").cast("double"), F.col("row").cast("double"), F.col(value).cast("double")
    s = pixels.filter(z.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"))
    det = F.nullif(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.lit(0.0))
    a = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det
    b = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    ok = (F.col("n") >= least) & a.isNotNull()
    zero = lambda c: F.when(ok, c).otherwise(F.lit(0.0))
    return s.select(*by, "n", zero(a).alias("a"), zero(b).alias("b"), zero(F.col("mz") - a * F.col("mx") - b * F.col("my")).alias("c"))


def trends(series: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Slope of each series, and its number of values."""
    return series.groupBy(*by).agg(F.regr_slope(value, time).alias("slope"), F.regr_count(value, time).alias("n"))


def centred_slope(series: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """`velocity`: slope over the row before, itself and the next; null for fewer than two values."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(-1, 1)
    n = F.count(F.when(F.col(value).isNotNull() & F.col(time).isNotNull(), 1)).over(w)
    return series.withColumn("velocity", F.when(n >= 2, F.regr_slope(value, time).over(w)))


class Network:
    """Pairs of a stack and the matrix that turns displacements at dates into differences of pairs."""

    def __init__(self, pairs: list[tuple]) -> None:
        """pairs: (product, first date, second date), in the order of the pixels' observations."""
        self.dates = sorted({d for _, *ds in pairs for d in ds})
        at = {d: i for i, d in enumerate(self.dates)}
        self.matrix = np.zeros((len(pairs), len(self.dates) - 1))
        for r, (_, a, b) in enumerate(pairs):
            for d, sign in ((min(a, b), -1.0), (max(a, b), 1.0)):
                if at[d]:
                    self.matrix[r, at[d] - 1] = sign
        days = np.array([(d - self.dates[0]).days for d in self.dates], float)
        centred = days - days.mean()
        self.weights = centred / max((centred**2).sum(), 1e-12)


def invert(observations: DataFrame, network: Network, by: list[str], least_pairs: int) -> DataFrame:
    """Displacement at each date (m), velocity (m a day) and temporal coherence of each pixel.

    `observations` has `obs`, an array with one value for each pair, null where it is missing.
    Pixels with the same pattern of missing pairs share one pseudo-inverse: within each batch
    of a task pixels are solved pattern by pattern, so that neither many patterns nor one that all
    pixels have makes large groups. Patterns of too few pairs, or that do not tie all dates
    together, give null.
    """
    g, weights = network.matrix, network.weights
    scale = 4.0 * np.pi / WAVELENGTH_M

    def run(frames):
        inverses: dict[bytes, np.ndarray | None] = {}

        def inverse(mask: np.ndarray) -> np.ndarray | None:
            key = mask.tobytes()
            if key not in inverses:
                ok = mask.sum() >= least_pairs and np.linalg.matrix_rank(g[mask]) == g.shape[1]
                inverses[key] = np.linalg.pinv(g[mask]) if ok else None
            return inverses[key]

        for frame in frames:
            obs = np.array([np.asarray(x, float) for x in frame["obs"]]).reshape(-1, g.shape[0])
            known = np.isfinite(obs)
            series: list = [None] * len(obs)
            gamma, velocity = np.full(len(obs), np.nan), np.full(len(obs), np.nan)
            patterns, at = np.unique(known, axis=0, return_inverse=True)
            for k, mask in enumerate(patterns):
                if (p := inverse(mask)) is None:
                    continue
                rows = np.flatnonzero(at.ravel() == k)
                x = obs[np.ix_(rows, mask)] @ p.T
                rest = (obs[np.ix_(rows, mask)] - x @ g[mask].T) * scale
                gamma[rows] = np.hypot(np.cos(rest).mean(axis=1), np.sin(rest).mean(axis=1))
                whole = np.hstack([np.zeros((len(rows), 1)), x])
                velocity[rows] = whole @ weights
                for i, r in enumerate(rows):
                    series[r] = whole[i].tolist()
            known_only = lambda x: [float(v) if np.isfinite(v) else None for v in x]
            yield frame[[*by]].assign(disp=series, velocity=pd.Series(known_only(velocity), dtype="object", index=frame.index), gamma=pd.Series(known_only(gamma), dtype="object", index=frame.index))

    kinds = ", ".join(f"{c} {observations.schema[c].dataType.simpleString()}" for c in by)
    return observations.select(*by, "obs").mapInPandas(run, f"{kinds}, disp array<double>, velocity double, gamma double")


#: Slowest velocity, in mm a day, that is movement.
STILL = 1e-9


def failure_times(series: DataFrame, by: list[str], least_r2: float = 0.6, horizon: float = 730.0, creep: float = -15.0, least_v: int = 5, least_share: float = 0.7) -> DataFrame:
    """Class and days to failure of each displacement series (t in days, d in mm), by the inverse velocity.

    The series must creep as a whole, and mostly in the direction of failure; then a falling
    line through the inverse velocities of a good fit points to the time of failure. Steps slower
    than STILL do not creep: their sign is rounding, and their inverse would outweigh all others.
    """
    rows = series.filter(F.col("t").isNotNull() & F.col("d").isNotNull())
    v = centred_slope(rows, by, "t", "d")
    creeps = F.col("velocity") < -STILL
    inv = F.when(creeps, 1.0 / F.abs("velocity"))
    t_inv = F.when(inv.isNotNull(), F.col("t"))
    s = v.groupBy(*by).agg(
        F.count("*").alias("n_obs"), (F.regr_slope("d", "t") * 365.25).alias("net"), F.avg(F.when(creeps, 1.0).when(F.col("velocity").isNotNull(), 0.0)).alias("share"),
        F.count(inv).alias("n_creep"), F.regr_slope(inv, t_inv).alias("b"), F.regr_intercept(inv, t_inv).alias("a"), F.regr_r2(inv, t_inv).alias("r2"), F.max("t").alias("last"),
    )
    ttf = F.try_divide(-F.col("a"), F.col("b")) - F.col("last")
    steady = (F.col("net") > creep) | (F.col("share") < least_share) | (F.col("n_creep") < least_v) | F.col("net").isNull()
    fast = (F.col("b") < 0) & (F.coalesce("r2", F.lit(0.0)) >= least_r2)
    kind = F.when(F.col("n_obs") < 6, "INSUFFICIENT").when(steady, "STEADY").when(fast & (ttf > 0) & (ttf <= horizon), "ACCELERATING").when(fast, "ACCEL_BEYOND_HORIZON").otherwise("STEADY")
    return s.withColumn("klass", kind).select(*by, "n_obs", F.col("net").alias("net_mmyr"), F.col("share").alias("creep_share"), "r2", "klass", F.when(F.col("klass").startswith("ACCEL"), ttf).alias("ttf_days"))
